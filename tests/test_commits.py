"""Claims, retention, archive snapshots: what a crash, a repeat or a purge leaves."""

import json
import os

from pyspark.sql import functions as F

from docspark.operators import archive
from docspark.operators.state import LOG_BUCKETS, log_bucket, read_state_log
from docspark.plans.chain import RESULT_WRITE, StageStore, enrich_stage, extract_stage, run_stage
from docspark.plans.run import Workspace, run_jobs
from docspark.schema import ENRICH_STAGE, EXTRACT_STAGE
from docspark.sources.dictionary import seed_dictionary
from docspark.sources.pages import latest_page_results, read_page_results, write_page_results
from docspark.sources.tables import CLAIM, claim_number
from test_reruns import message, messages
from test_run import PAGE, documents, json_extractor, now, requests, stages


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_claim_cut_short_is_passed_over(spark, tmp_path):
    path = tmp_path / "claims"
    assert claim_number(spark, str(path)) == 0
    (path / "claim=1" / "_temporary").mkdir(parents=True)
    assert claim_number(spark, str(path)) == 1
    # Another claimant is already there under the next number, unseen by the first look.
    other = spark.createDataFrame([(7, "other", None)], CLAIM)
    other.write.parquet(str(path / "claim=2"))
    assert claim_number(spark, str(path)) > 2


def test_versions_stay_text_and_odd_folders_are_passed(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "s", "2.10"), ("b", 2, "s", "2.1"), ("c", 3, "7", "007")],
                                 "job_id string, page int, stage string, version string")
    root = str(tmp_path / "t")
    write_page_results(rows, root, 0)
    write_page_results(rows.filter("job_id = 'a'").withColumn("page", F.lit(1)), root, 1)
    assert [tuple(r) for r in latest_page_results(spark, root, "s", "2.10").collect()] == [("a", 1, "s", "2.10")]
    assert [r.job_id for r in latest_page_results(spark, root, "7", "007").collect()] == ["c"]
    folder = tmp_path / "raw" / "jobs" / "j" / "pages" / "xx" / "s" / "2.10"
    folder.mkdir(parents=True)
    (folder / "result.json").write_text("{}")
    assert read_page_results(spark, str(tmp_path / "raw"), "s", "2.10").count() == 0


def test_requests_are_told_apart_row_by_row(spark, tmp_path):
    docs = documents(spark, a=json.dumps(PAGE))
    space = Workspace(spark, str(tmp_path), "work", "vault")
    asked = requests(spark, ("a", "", []), (None, "", []))
    twin = requests(spark, ("a", "", [])).withColumn("tenant_id", F.lit("a=b"))
    run_jobs(space, asked.unionByName(twin), docs, stages(spark, docs), now(), 1)
    assert {(r.job_id, r.status) for r in space.jobs(now()).collect()} == {("a", "succeeded")}
    assert sorted((r.job_id or "", len(r.errors)) for r in space.rejected().collect()) == [("", 1), ("a", 1)]


def test_a_stage_reads_the_writes_its_work_names(spark, tmp_path):
    store = StageStore(spark, str(tmp_path), "work")
    docs = documents(spark, x=json.dumps(PAGE), y=json.dumps(PAGE))
    chain = [EXTRACT_STAGE, ENRICH_STAGE]
    extract = extract_stage(docs, json_extractor)
    routed = [
        run_stage(store, extract, messages(spark, message(j, 1, EXTRACT_STAGE, chain, uri=f"s3://in/{u}")), now(), 0)
        for j, u in (("a", "x"), ("b", "y"), ("c", "x"))
    ]
    assert [r.metadata[RESULT_WRITE] for part in routed for r in part.collect()] == ["0", "1", "2"]
    runs = spark.createDataFrame([("b", 1, 1)], "job_id string, page int, run int")
    shown = plan(store.rows_of("transactions", *EXTRACT_STAGE, runs))
    assert "PartitionFilters" in shown and "(run#" in shown.split("PartitionFilters")[1].split("]")[0]
    work = messages(spark, message("b", 1, EXTRACT_STAGE))
    shown = plan(read_state_log(spark, store.log_root, work))
    assert "bucket#" in shown.split("PartitionFilters")[1].split("]")[0]
    assert LOG_BUCKETS > 1 and work.select(log_bucket().alias("b")).first().b < LOG_BUCKETS

    enrich = enrich_stage(seed_dictionary(spark))
    run_stage(store, enrich, routed[1], now(), 0)
    # A newer result of the same page does not replace the one that the work names.
    assert store.load("transactions", *ENRICH_STAGE).select("job_id").distinct().collect()[0].job_id == "b"
    # The message that comes again without its metadata finds its page all the same.
    bare = routed[0].withColumn("metadata", F.create_map().cast("map<string,string>"))
    run_stage(store, enrich, bare, now(), 0)
    assert {r.job_id for r in store.load("transactions", *ENRICH_STAGE).collect()} == {"a", "b"}


def test_purge_takes_all_tables_of_one_age(spark, tmp_path):
    docs = documents(spark, a=json.dumps(PAGE), b=json.dumps(PAGE))
    space = Workspace(spark, str(tmp_path), "work", "vault")
    steps = stages(spark, docs)
    run_jobs(space, requests(spark, ("a", "", [])), docs, steps, now("2026-06-01"), 1)
    run_jobs(space, requests(spark, ("b", "", [])), docs, steps, now("2026-07-01"), 1)
    space.purge(now("2026-06-10"))
    assert space.stages.stored("headers", *EXTRACT_STAGE).count() == 2
    space.purge(now("2026-07-02"))
    store = space.stages
    for table in ("headers", "transactions", "done", "work"):
        assert {r.job_id for r in store.stored(table, *EXTRACT_STAGE).collect()} == {"b"}
    assert {r.job_id for r in read_state_log(spark, store.log_root).collect()} == {"b"}
    assert {r.job_id for r in space.merged("transactions").collect()} == {"b"}
    assert {r.job_id for r in space.jobs(now("2026-07-02")).collect()} == {"b"}
    # The archive stays, and numbers go on from where they were.
    assert {r.job_id for r in spark.read.parquet(space.archive.manifests).collect()} == {"a", "b"}
    left = [d for d, names, _ in os.walk(tmp_path / "stages") if os.path.basename(d).startswith("run=0")]
    assert left == []
    before = store.claim(now())
    space.purge(now("2027-01-01"))
    assert store.claim(now()) > before
    assert space.merged("documents").count() == 0


def place(spark, *jobs):
    return spark.createDataFrame(
        [(j, "acme", "2026", "06", "bank", "gold", "receipt", "s3://vault/one.json", "", "", 1) for j in jobs],
        "job_id string, tenant string, year string, month string, issuer_slug string, card_slug string, "
        "document_type string, archive_uri string, issuer string, card_name string, max_page int",
    ).withColumn("raw_uri", F.lit("")).withColumn("chain_id", F.lit("")).withColumn(
        "chain", F.array().cast("array<struct<name:string,version:string,queue_name:string>>")
    )


def put(spark, tx, roots, job, run, at, vouched=True):
    targets = place(spark, job)
    rows = tx({"job_id": job, "merchant": f"{job}-{run}"})
    fields = spark.createDataFrame([(job, "k", "1")], "job_id string, key string, value string")
    archive.write_archive(targets, rows, fields, roots, run)
    if vouched:
        archive.write_manifests(archive.build_manifests(targets, now(at)), roots, run)


def test_archive_follows_manifests_and_snapshots(spark, tx, tmp_path):
    roots = archive.ArchiveRoots(str(tmp_path))
    read = lambda **k: [r.merchant for r in archive.read_current_archive(spark, roots, "transactions", **k).collect()]
    put(spark, tx, roots, "a", 0, "2026-07-01")
    assert read() == ["a-0"]
    put(spark, tx, roots, "b", 1, "2026-07-02", vouched=False)  # dies before its manifest
    assert read() == ["a-0"]
    put(spark, tx, roots, "b", 2, "2026-07-02")
    assert read() == ["b-2"]
    put(spark, tx, roots, "c", 3, "2026-06-01")  # written later, of an earlier time
    assert read() == ["b-2"]
    archive.compact_archive(spark, roots, 4)
    assert read() == ["b-2"] == read(tenant="acme")
    assert read(tenant="other") == []
    archive.drop_superseded(spark, roots)
    assert read() == ["b-2"] and {r.run for r in archive.current_documents(spark, roots).collect()} == {4}
    put(spark, tx, roots, "d", 5, "2026-07-03")
    assert read() == ["d-5"]
    archive.compact_archive(spark, roots, 6)
    archive.drop_superseded(spark, roots)
    assert read() == ["d-5"]
    shown = plan(archive.read_current_archive(spark, roots, "transactions", tenant="acme"))
    assert "tenant#" in shown.split("PartitionFilters")[1].split("]")[0]


def test_bytes_of_documents_are_not_shuffled(spark, tmp_path):
    from docspark.operators.extract import extract_pages
    from docspark.operators.spread import with_content

    path = str(tmp_path / "docs")
    documents(spark, x="one", y="two").write.parquet(path)
    stored = spark.read.parquet(path)
    rows = spark.createDataFrame([("j", 1, "s3://in/x"), ("j", 2, "s3://in/none")], "job_id string, page int, uri string")
    joined = with_content(rows, stored)
    assert sorted((r.page, r.content and bytes(r.content)) for r in joined.collect()) == [(1, b"one"), (2, None)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        work = messages(spark, message("j", 1, EXTRACT_STAGE, uri="s3://in/x"), message("j", 2, EXTRACT_STAGE, uri="s3://in/q"))
        made = extract_pages(work, stored)
        moved = [line for line in plan(made).splitlines() if "Exchange hash" in line]
        scans = [line for line in plan(made).splitlines() if "FileScan" in line]
        assert any("content" in s for s in scans) and len(scans) == 2 and len(moved) == 2
        assert sum("content" in s.split("ReadSchema")[1] for s in scans) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.page: r.error for r in made.collect()} == {1: None, 2: "document not found"}
