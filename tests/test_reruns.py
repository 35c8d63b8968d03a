"""Repeats, reused run numbers, odd names and crashes between writes."""

import json

from pyspark.sql import functions as F

from docspark.operators import archive, state
from docspark.operators.results import aggregate_job, job_result
from docspark.operators.rollup import aggregate
from docspark.plans import run as runs
from docspark.plans.chain import NO_PREVIOUS, StageStore, enrich_stage, extract_stage, normalize_stage, run_stage
from docspark.plans.run import Workspace, run_jobs
from docspark.schema import ENRICH_STAGE, EXTRACT_STAGE, MESSAGE
from docspark.sources.dictionary import seed_dictionary
from docspark.sources.tables import claim_number, read_or_empty, replace_part
from test_run import PAGE, documents, json_extractor, now, requests, stages


def message(job, page, stage, chain=(), idx=0, uri=""):
    steps = [(n, v, "") for n, v in chain]
    return (job, page, *stage, uri, steps, idx)


def messages(spark, *rows):
    names = ["job_id", "page", "stage", "version", "input_uri", "chain", "chain_idx"]
    df = spark.createDataFrame(
        rows, "job_id string, page int, stage string, version string, input_uri string, "
        "chain array<struct<name:string,version:string,queue_name:string>>, chain_idx int"
    )
    rest = {"metadata": F.create_map()}
    return df.select(
        *[(F.col(f.name) if f.name in names else rest.get(f.name, F.lit(""))).cast(f.dataType).alias(f.name) for f in MESSAGE.fields]
    )


def test_parts_are_replaced_whole_and_names_stay_text(spark, tmp_path):
    df = spark.createDataFrame([("007", "06", 1), ("b", "2.10", 2)], "tenant string, version string, n int")
    path = str(tmp_path / "t")
    replace_part(df, path, "run", 1, "tenant", "version")
    replace_part(df.limit(0), path, "run", 2, "tenant", "version")
    read = read_or_empty(spark, path, df.schema)
    assert sorted(map(tuple, read.collect())) == [("007", "06", 1), ("b", "2.10", 2)]
    replace_part(df.limit(0), path, "run", 1, "tenant", "version")
    assert read_or_empty(spark, path, df.schema).count() == 0
    assert [claim_number(spark, f"{path}-claims") for _ in range(3)] == [0, 1, 2]


def test_stage_rules(spark, tmp_path):
    """New work under an old number, odd versions, other stages, no previous result."""
    store = StageStore(spark, str(tmp_path), "work")
    docs = documents(spark, x=json.dumps(PAGE), y=json.dumps(PAGE))
    gemini = extract_stage(docs, json_extractor)
    odd = type(gemini)("gemini", "2.10", gemini.fn)
    chain = [("gemini", "2.10"), ENRICH_STAGE]
    first = messages(spark, message("a", 1, ("gemini", "2.10"), chain, uri="s3://in/x"))
    second = messages(spark, message("b", 1, ("gemini", "2.10"), chain, uri="s3://in/y"))
    other = messages(spark, message("c", 1, ("elsewhere", "v1")))
    next_work = run_stage(store, odd, first, now(), 0)
    more = run_stage(store, odd, second.unionByName(other), now(), 0)
    assert {(r.job_id, r.stage) for r in next_work.collect()} == {("a", ENRICH_STAGE[0])}
    assert {(r.job_id, r.stage) for r in more.collect()} == {("b", ENRICH_STAGE[0]), ("c", "elsewhere")}
    done = store.state("gemini", "2.10").collect()
    assert {(r.job_id, r.version, r.status) for r in done} == {(j, "2.10", "succeeded") for j in "ab"}

    enrich = enrich_stage(seed_dictionary(spark))
    lost = messages(spark, message("lost", 1, ENRICH_STAGE, chain, 1))
    run_stage(store, enrich, next_work.unionByName(more).unionByName(lost), now(), 0, header_stage=("gemini", "2.10"))
    got = {r.job_id: (r.status, r.error) for r in store.state(*ENRICH_STAGE).collect()}
    assert got == {"a": ("succeeded", ""), "b": ("succeeded", ""), "lost": ("failed", NO_PREVIOUS)}
    assert store.load("transactions", *ENRICH_STAGE).count() == 6

    loose = messages(spark, message("n", 1, EXTRACT_STAGE, uri="s3://in/x"))
    routed = run_stage(store, gemini, loose, now(), 0, fallback=("normalize_card_statement", "v1"))
    assert [(r.job_id, r.stage) for r in routed.collect()] == [("n", "normalize_card_statement")]
    run_stage(store, normalize_stage(), routed, now(), 0, previous=EXTRACT_STAGE)
    assert store.load("transactions", "normalize_card_statement", "v1").count() == 1


def test_an_extractor_that_raises_fails_one_page(spark):
    from docspark.operators.extract import extract_pages

    def touchy(batch):
        bodies = [bytes(c).decode() for c in batch["content"]]
        if "bad" in bodies:
            raise ValueError("service said no")
        return json_extractor(batch)

    work = messages(spark, *[message("j", p, EXTRACT_STAGE, uri=f"s3://in/{n}") for p, n in enumerate("xy", 1)])
    made = extract_pages(work.coalesce(1), documents(spark, x=json.dumps(PAGE), y="bad"), touchy).collect()
    assert {r.page: r.error for r in made} == {1: None, 2: "service said no"}


def test_resubmission_rejects_and_late_archives(spark, tmp_path, monkeypatch):
    docs = documents(spark, a=json.dumps(PAGE), b=json.dumps(PAGE))
    space = Workspace(spark, str(tmp_path), "work", "vault")
    steps = stages(spark, docs)
    asked = requests(spark, ("a", "", []))
    unknown = requests(spark, ("z", "", [])).withColumn("chain_id", F.lit("none"))
    run_jobs(space, unknown, docs, steps, now(), 1)
    assert [(r.job_id, r.errors) for r in space.rejected().collect()] == [("z", ["chain none is not in the registry"])]
    assert space.jobs(now()).count() == 0

    write = archive.write_manifests
    monkeypatch.setattr(runs.archive, "write_manifests", lambda *a: (_ for _ in ()).throw(RuntimeError("down")))
    run_jobs(space, asked, docs, steps, now(), 1)
    assert space.jobs(now()).first().status == "succeeded"
    monkeypatch.setattr(runs.archive, "write_manifests", write)
    run_jobs(space, asked.unionByName(requests(spark, ("b", "", []))), docs, steps, now(), 1)
    totals = {r.job_id: (r.row_count, r.total) for r in aggregate(space.merged("transactions"), "merchant", "STARBUCKS").collect()}
    assert totals == {"a": (1, "480"), "b": (1, "480")}
    assert {r.job_id for r in spark.read.parquet(space.archive.manifests).collect()} == {"a", "b"}
    current = archive.read_current_archive(spark, space.archive, "transactions").collect()
    assert [(r.job_id, r.merchant, r.month) for r in current] == [("b", "STARBUCKS", "06")]


def test_purged_log_is_kept_by_later_writes(spark, tmp_path):
    work = messages(spark, message("a", 1, EXTRACT_STAGE), message("b", 1, EXTRACT_STAGE))
    ended = work.withColumn("result_uri", F.lit("u")).withColumn("next_stage", F.lit(""))
    log, kept = str(tmp_path / "log"), str(tmp_path / "kept")
    state.append_state(state.succeeded_rows(ended.filter("job_id = 'a'"), now("2026-06-01"), 1), log, 1)
    state.append_state(state.succeeded_rows(ended.filter("job_id = 'b'"), now("2026-07-01"), 3), log, 3)
    state.purge_expired(spark, log, kept, now())
    state.append_state(state.running_rows(work.filter("job_id = 'a'"), now(), 0), kept, 0)
    assert sorted((r.job_id, r.status) for r in state.read_state_log(spark, kept).collect()) == [
        ("a", "running"), ("b", "succeeded"),
    ]


def test_results_beyond_the_page_count_and_totals_of_nothing(spark, tx):
    jobs = spark.createDataFrame([("j", "succeeded", "u", 2, "")], "job_id string, status string, result_uri string, page_count int, error string")
    pages = spark.createDataFrame([("j", p, '{"text":"t"}') for p in (1, 5000)], "job_id string, page int, result string")
    assert sorted(r.page for r in job_result(jobs, pages).collect()) == [1, 5000]
    rows = tx(*[{"job_id": "j", "merchant": "m", "amount": "9" * 32}] * 3)
    none = aggregate_job(jobs, rows, "j", {"merchant": "absent"})[0].first()
    assert (none.row_count, none.total) == (0, "0")
    much = aggregate_job(jobs, rows, "j", {"merchant": "m"})[0].first()
    assert (much.row_count, much.total) == (3, None)


def test_work_that_leaves_is_not_looked_up_again(spark, tmp_path, monkeypatch):
    from docspark.plans import chain
    from docspark.plans.chain import Stage, StageData
    from docspark.schema import TRANSACTION_ROW

    asked, real = [], chain.read_state_log

    def spy(spark, root, work=None):
        asked.append(work.select("job_id").distinct().count())
        return real(spark, root, work)

    monkeypatch.setattr(chain, "read_state_log", spy)
    store = StageStore(spark, str(tmp_path / "stages"), "work")
    stage = Stage("s", "v1", lambda work, data: StageData(transactions=spark.createDataFrame([], TRANSACTION_ROW)))
    work = messages(spark, message("a", 1, ("s", "v1")), message("b", 1, ("s", "v1")))
    for _ in range(2):
        assert run_stage(store, stage, work, now(), 0).count() == 0
    # What is done is asked for both jobs; where they go on, for none.
    assert asked == [2, 0, 2, 0]
    assert sorted(r.job_id for r in store.stored("done", "s", "v1").collect()) == ["a", "b"]
    assert run_stage(store, stage, work, now(), 0, fallback=("t", "v1")).count() == 2


def test_pages_found_finished_are_not_read_again(spark, tmp_path, monkeypatch):
    """Work that names no write is looked up among the finished pages once, and the log is folded once."""
    from docspark.plans import chain

    store = StageStore(spark, str(tmp_path), "work")
    docs = documents(spark, x=json.dumps(PAGE))
    loose = messages(spark, message("a", 1, EXTRACT_STAGE, uri="s3://in/x"), message("b", 1, EXTRACT_STAGE, uri="s3://in/none"))
    run_stage(store, extract_stage(docs, json_extractor), loose, now(), 0)
    asked, looked = [], []
    real, runs = StageStore.rows_of, chain._runs
    monkeypatch.setattr(StageStore, "rows_of", lambda self, table, *a: asked.append(table) or real(self, table, *a))
    monkeypatch.setattr(chain, "_runs", lambda *a: looked.append(a[2]) or runs(*a))
    work = messages(spark, message("a", 1, ENRICH_STAGE), message("b", 1, ENRICH_STAGE), message("a", 1, ENRICH_STAGE))
    for _ in range(2):
        run_stage(store, enrich_stage(seed_dictionary(spark)), work, now(), 0, previous=EXTRACT_STAGE)
    assert (asked, looked) == (["transactions", "headers"] * 2, ["_result"] * 2)
    got = {(r.job_id, r.status, r.error) for r in store.state(*ENRICH_STAGE, columns=("status", "error")).collect()}
    assert got == {("a", "succeeded", ""), ("b", "failed", NO_PREVIOUS)}
