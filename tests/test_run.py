import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docspark.operators import archive
from docspark.operators.rollup import aggregate
from docspark.plans.chain import Chain, Stage, StageData, enrich_stage, extract_stage, normalize_stage, run_stage
from docspark.plans.run import Workspace, run_jobs
from docspark.sources.dictionary import seed_dictionary

# The workers cannot import test modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGE = {
    "text": "statement",
    "document_type": "credit_card_statement",
    "fields": {"issuer_name": "KAWA", "card_name": "Gold", "statement_date": "2026-06-10"},
    "transactions": [
        {"date": "2026/06/01", "merchant": "STARBUCKS", "amount": "480"},
        {"date": "2026/06/02", "merchant": "KAWA", "amount": "900"},
        {"date": "2026/06/03", "merchant": "x", "amount": "0円"},
    ],
}


def json_extractor(batch: pd.DataFrame) -> pd.DataFrame:
    """The content is the page already; "bad" stands for a failed call."""
    bodies = [bytes(c).decode() for c in batch["content"]]
    return pd.DataFrame(
        {
            "body": bodies, "provider": "t", "model": "t", "input_tokens": 1, "output_tokens": 1,
            "error": ["no answer" if b == "bad" else None for b in bodies],
        }
    )


def now(text="2026-07-02 00:00:00"):
    return F.lit(text).cast("timestamp")


def documents(spark, **content):
    return spark.createDataFrame(
        [(f"s3://in/{k}", bytearray(v.encode())) for k, v in content.items()], "uri string, content binary"
    )


def requests(spark, *jobs):
    return spark.createDataFrame(
        [(j, f"s3://in/{j}", mode, "", "acme", [f"s3://in/{p}" for p in pages]) for j, mode, pages in jobs],
        "job_id string, input_uri string, mode string, chain_id string, tenant_id string, pages array<string>",
    )


def stages(spark, docs):
    return [extract_stage(docs, json_extractor), normalize_stage(), enrich_stage(seed_dictionary(spark))]


def refusing(stage, job):
    """The stage, failing all pages of one job."""

    def fn(work, data):
        out = stage.fn(work, data)
        bad = work.filter(F.col("job_id") == job).select("job_id", "page", F.lit("boom").alias("error"))
        return StageData(transactions=out.transactions.filter(F.col("job_id") != job), failed=bad)

    return Stage(stage.name, stage.version, fn)


def test_whole_run(spark, tmp_path):
    second = {**PAGE, "fields": {}, "transactions": [{"merchant": "REHAN RESTAURANT", "amount": "1,200"}]}
    docs = documents(
        spark, a=json.dumps(PAGE), b="whole", b1=json.dumps(PAGE), b2=json.dumps(second), c="bad", d=json.dumps(PAGE),
    )
    asked = requests(spark, ("a", "", []), ("b", "rendered", ["b1", "b2"]), ("c", "", []), ("d", "", []))
    space = Workspace(spark, str(tmp_path), "work", "vault")
    sent = str(tmp_path / "sent.txt")
    told = str(tmp_path / "told.txt")

    def send(batch):
        with open(sent, "a") as f:
            f.writelines(f"{j}\n" for j in batch["job_id"])
        return batch[["job_id"]].assign(
            http_status=200, status="ok", collection="c", index_job_id="i", vector_count=1, embedding_model="m",
            indexed_at="2026-07-02T00:00:00Z",
        )

    def notify(kind, events):
        with open(told, "a") as f:
            f.writelines(f"{kind} {j}\n" for j in events["job_id"])

    extract, normalize, enrich = stages(spark, docs)
    run_jobs(space, asked, docs, [extract, normalize, refusing(enrich, "d")], now(), 1, send, notify)
    # The gate looks at the last stage only, so a page that never got there
    # leaves its job running.
    jobs = {r.job_id: r for r in space.jobs(now()).collect()}
    assert {j: r.status for j, r in jobs.items()} == {"a": "succeeded", "b": "succeeded", "c": "running", "d": "failed"}
    assert jobs["b"].page_count == 2 and jobs["b"].mode == "rendered"
    assert jobs["a"].result_uri == "s3://work/jobs/a/merged/v1/result.json"

    assert space.jobs(now("2026-07-16")).count() == 0

    rows = space.merged("transactions")
    assert sorted((r.job_id, r.page, r.merchant_normalized, r.country) for r in rows.collect()) == [
        ("a", 1, "Starbucks", "JP"), ("b", 1, "Starbucks", "JP"), ("b", 2, "Rehan Restaurant", "MY"),
    ]
    totals = aggregate(rows, "country", "MY").first()
    assert (totals.job_id, totals.total) == ("b", "1200")

    manifests = {r.job_id: r for r in spark.read.parquet(space.archive.manifests).collect()}
    assert set(manifests) == {"a", "b"}
    assert manifests["a"].results.transactions.endswith("tenant=acme/year=2026/month=06/kawa-gold.json")
    # Both jobs share one archive key; the current document is one of them.
    current = archive.read_current_archive(spark, space.archive, "transactions")
    assert {r.job_id for r in current.collect()} == {"b"}
    assert sorted(open(sent).read().split()) == ["a", "b"]
    assert sorted(open(told).read().splitlines()) == ["failed d", "succeeded a", "succeeded b"]


def test_stage_is_not_run_again_for_pages_that_succeeded(spark, tmp_path):
    from docspark.plans.chain import StageStore
    from docspark.functions import chain_literal
    from docspark.operators.pages import fan_out_pages
    from docspark.schema import CHAIN_REGISTRY, DEFAULT_CHAIN_ID

    store = StageStore(spark, str(tmp_path), "work")
    jobs = spark.createDataFrame([("j", ["s3://in/x", "s3://in/y"])], "job_id string, pages array<string>")
    work = fan_out_pages(jobs.withColumn("chain", chain_literal(CHAIN_REGISTRY[DEFAULT_CHAIN_ID])))
    calls = str(tmp_path / "calls.txt")

    def counting(batch):
        with open(calls, "a") as f:
            f.write("x" * len(batch))
        return json_extractor(batch)

    docs = documents(spark, x=json.dumps(PAGE), y="bad")
    stage = extract_stage(docs, counting)
    first = run_stage(store, stage, work.union(work), now(), 1)
    assert [(r.page, r.stage, r.previous_uri) for r in first.collect()] == [
        (1, "normalize_card_statement", "s3://work/jobs/j/pages/000001/gemini/v1/result.json")
    ]
    before = len(open(calls).read())
    assert run_stage(store, stage, work, now(), 1).count() == 1
    # Only the page that failed is asked for again, whatever the run is called.
    assert len(open(calls).read()) == before + before // 2

    fixed = extract_stage(documents(spark, x="bad", y=json.dumps(PAGE)), counting)
    second = run_stage(store, fixed, work, now(), 2)
    assert sorted(r.page for r in second.collect()) == [1, 2]
    assert sorted((r.page, r.merchant) for r in store.load("transactions", "gemini", "v1").collect()) == [
        (p, m) for p in (1, 2) for m in ("KAWA", "STARBUCKS", "x")
    ]
    # Beyond the retention window the page is new work.
    late = run_stage(store, extract_stage(documents(spark), counting), work, now("2026-09-01"), 3)
    assert late.count() == 0


def test_chain_without_state(spark):
    docs = documents(spark, x=json.dumps(PAGE), y="{bad")
    from docspark.schema import MESSAGE

    work = spark.createDataFrame(
        [
            {"job_id": "j", "page": p, "input_uri": f"s3://in/{n}", "previous_uri": "", "prompt_profile_id": ""}
            for p, n in enumerate("xy", 1)
        ],
        MESSAGE,
    )
    out = Chain(stages(spark, docs)).run(work, StageData())
    assert [(r.page, r.merchant_normalized) for r in out.transactions.collect()] == [(1, "Starbucks")]
    assert [(r.page, r.error) for r in out.failed.collect()] == [(2, "not valid JSON")]
