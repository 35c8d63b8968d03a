import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docspark.functions import chain_literal
from docspark.operators import archive, index
from docspark.operators.transactions import explode_transactions
from docspark.schema import CHAIN_REGISTRY, DEFAULT_CHAIN_ID
from docspark.sources.pages import decode_pages, good_pages

NOW = "2026-07-02 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def make_pages(spark, *pages):
    rows = [(p.pop("job_id", "job_1"), p.pop("page", i), json.dumps(p)) for i, p in enumerate(pages, 1)]
    return good_pages(decode_pages(spark.createDataFrame(rows, "job_id string, page int, body string")))


def make_jobs(spark, *rows):
    df = spark.createDataFrame(
        [{"job_id": "job_1", "tenant_id": "acme", "input_uri": "s3://in/x.pdf", "result_uri": "s3://w/m", **r} for r in rows],
        "job_id string, tenant_id string, input_uri string, result_uri string",
    )
    return df.withColumn("chain_id", F.lit(DEFAULT_CHAIN_ID)).withColumn(
        "chain", chain_literal(CHAIN_REGISTRY[DEFAULT_CHAIN_ID])
    )


def targets(spark, pages, *jobs):
    headers = archive.document_headers(make_pages(spark, *pages))
    return archive.archive_targets(headers, make_jobs(spark, *(jobs or [{}])), now(), "vault")


def one(spark, fields, **job):
    name = job.get("job_id", "job_1")
    return targets(spark, [{"job_id": name, "page": 1, "fields": fields}], job).first()


KAWA = {"issuer_name": "Kawa Bank", "card_name": "Travel Plus", "statement_date": "2026-06-28"}


def test_target_keys(spark):
    t = one(spark, KAWA)
    assert t.archive_uri == "s3://vault/results/transactions/tenant=acme/year=2026/month=06/kawa-bank-travel-plus.json"
    assert t.raw_uri == "s3://vault/raw/card-statements/kawa-bank/2026/06/original.pdf"
    assert t.manifest_uri == "s3://vault/manifests/jobs/job_1.json" and t.error is None


@pytest.mark.parametrize(
    "fields,job,want",
    [
        ({"issuer_name": "Hill"}, {}, ("2026", "07", "hill", "hill")),
        ({}, {"job_id": "upload-2031-000123456789"}, ("2026", "07", "unknown", "000123456789")),
        ({"statement_date": "2026年6月3日", "card": "Gold"}, {}, ("2026", "06", "unknown", "gold")),
        ({"issuer_name": 5, "issuer": "B"}, {}, ("2026", "07", "b", "b")),
    ],
)
def test_target_fallbacks(spark, fields, job, want):
    t = one(spark, fields, **job)
    assert (t.year, t.month, t.issuer_slug, t.card_slug) == want


def test_target_without_input_has_no_raw_copy(spark):
    assert one(spark, KAWA, input_uri="").raw_uri == ""


@pytest.mark.parametrize(
    "job,error",
    [
        ({"tenant_id": ""}, "empty tenant_id"),
        ({"tenant_id": "a/b"}, "tenant_id may hold letters, digits, - and _ only"),
        ({"result_uri": ""}, "nothing was merged for the job"),
    ],
)
def test_target_errors(spark, job, error):
    assert one(spark, KAWA, **job).error == error


def test_first_value_that_is_not_empty_wins(spark):
    pages = make_pages(
        spark,
        {"page": 2, "fields": {"a": "second", "b": "B", "z": 1}, "document_type": "receipt"},
        {"page": 1, "fields": {"a": " ", "b": None, "z": 0, "l": [], "o": {}, "f": False}, "document_type": ""},
        {"page": 3, "fields": {"a": "third"}, "document_type": "bill"},
    )
    got = {r.key: json.loads(r.value) for r in archive.flatten_fields(pages).collect()}
    assert got == {"a": "second", "b": "B", "z": 0, "l": [], "o": {}, "f": False}
    assert archive.document_headers(pages).first().document_type == "receipt"


def test_manifest(spark):
    m = archive.build_manifests(targets(spark, [{"page": 1, "fields": KAWA}]), now()).first()
    assert m.source.asDict() == {
        "kind": "card_statement", "issuer": "Kawa Bank", "card_name": "Travel Plus",
        "raw_uri": "s3://vault/raw/card-statements/kawa-bank/2026/06/original.pdf",
    }
    assert m.chain.id == DEFAULT_CHAIN_ID and m.chain.stages == [s[0] for s in CHAIN_REGISTRY[DEFAULT_CHAIN_ID]]
    assert m.archived_at == "2026-07-02T00:00:00Z"


def test_second_run_finds_the_manifest(spark):
    first = targets(spark, [{"page": 1, "fields": KAWA}])
    manifests = archive.build_manifests(first, now())
    later = targets(spark, [{"page": 1, "fields": {**KAWA, "card_name": "Other"}}])
    assert archive.pending_archives(later, manifests).count() == 0
    seen = archive.archived_view(later, manifests).first()
    assert not seen.archived and seen.archive_uri == first.first().archive_uri


def test_shared_key_goes_to_the_last_write(spark):
    both = targets(
        spark,
        [{"job_id": "a", "page": 1, "fields": KAWA}, {"job_id": "b", "page": 1, "fields": KAWA}],
        {"job_id": "a"}, {"job_id": "b"},
    ).withColumn("at", F.when(F.col("job_id") == "a", 2).otherwise(1))
    won = archive.archive_winners(both, "at").first()
    assert (won.job_id, won.jobs) == ("a", 2)


def test_stored_archive(spark, tmp_path):
    roots = archive.ArchiveRoots(str(tmp_path))
    pages = make_pages(
        spark,
        {"page": 2, "transactions": [{"merchant": "c"}]},
        {"page": 1, "fields": KAWA, "transactions": [{"merchant": "a"}, {"merchant": "b"}]},
    )
    plan = archive.archive_targets(archive.document_headers(pages), make_jobs(spark, {}), now(), "vault")
    for _ in range(2):
        archive.write_archive(plan, explode_transactions(pages), archive.flatten_fields(pages), roots, 1)
        docs = spark.createDataFrame([("s3://in/x.pdf", bytearray(b"pdf"))], "uri string, content binary")
        archive.write_raw_catalog(plan, docs, roots, 1)
        archive.write_manifests(archive.build_manifests(plan, now()), roots, 1)
    rows = archive.read_current_archive(spark, roots, "transactions").orderBy("page", "pos").collect()
    assert [(r.merchant, r.tenant, int(r.year), int(r.month), r.card_slug) for r in rows] == [
        (m, "acme", 2026, 6, "kawa-bank-travel-plus") for m in "abc"
    ]
    assert archive.read_current_archive(spark, roots, "fields").count() == 3
    assert [bytes(r.content) for r in spark.read.parquet(roots.raw).collect()] == [b"pdf"]
    assert spark.read.parquet(roots.manifests).count() == 1


def make_manifests(spark, tenant="acme", uri="s3://vault/a.json"):
    return spark.createDataFrame(
        [("job_1", tenant, (uri,), "2026-07-01T00:00:00Z")],
        "job_id string, tenant_id string, results struct<transactions:string>, archived_at string",
    )


def requests(spark, asked=("job_1", "acme"), manifests=None, jobs=("job_1",)):
    inputs = spark.createDataFrame([asked], "job_id string, tenant_id string")
    known = spark.createDataFrame([(j,) for j in jobs], "job_id string")
    return index.index_requests(inputs, manifests or make_manifests(spark), known)


def test_index_request(spark):
    r = requests(spark).first()
    assert (r.result_uri, r.result_type, r.schema_version, r.error) == (
        "s3://vault/a.json", "transactions", "transactions.v1", None,
    )


def test_index_request_errors(spark):
    def error(**kw):
        return requests(spark, **kw).first().error

    assert error(asked=("job_1", "other")) == "tenant mismatch"
    assert error(asked=("job_9", "acme"), jobs=("job_9",)) == "manifest not found"
    assert error(jobs=("x",)) == "job not found"
    assert error(manifests=make_manifests(spark, uri="")) == "manifest has no archive uri"
    assert error(manifests=make_manifests(spark, tenant="")) is None
    assert error(asked=("job_1", "")) == "empty tenant_id"


def answer(code):
    def send(batch: pd.DataFrame) -> pd.DataFrame:
        return batch[["job_id"]].assign(
            http_status=code, status="ok", collection="c", index_job_id="i1", vector_count=2,
            embedding_model="m", indexed_at="2026-07-02T00:00:00Z",
        )

    return send


@pytest.mark.parametrize("code,outcome,stored", [(200, "ok", 1), (400, "schema", 0), (503, "transient", 0), (404, "unexpected", 0)])
def test_index_outcomes(spark, code, outcome, stored):
    sent = index.send_requests(requests(spark), answer(code))
    assert [r.outcome for r in sent.collect()] == [outcome]
    assert index.build_sidecars(sent, now()).count() == stored


def test_indexed_job_is_not_sent_again(spark):
    sidecars = index.build_sidecars(index.send_requests(requests(spark), answer(200)), now())
    assert index.pending_index(requests(spark), sidecars).count() == 0
    seen = index.indexed_view(spark.createDataFrame([("job_1",)], "job_id string"), sidecars, "vault").first()
    assert (seen.indexed, seen.index_job_id, seen.sidecar_uri) == (False, "i1", "s3://vault/index/jobs/job_1.json")
