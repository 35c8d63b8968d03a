import datetime as dt

import pytest
from pyspark.sql import functions as F

from docspark.operators import jobs as job_ops
from docspark.operators import merge, state
from docspark.schema import CHAIN_REGISTRY, DEFAULT_CHAIN_ID, JOB, STAGE_LOG

CHAIN = CHAIN_REGISTRY[DEFAULT_CHAIN_ID]
FINAL = CHAIN[-1][:2]


def at(text):
    return F.lit(text).cast("timestamp")


def job_rows(spark, *rows):
    base = {"status": "running", "input_uri": "in", "result_uri": "", "page_count": 0, "error": "", "mode": "",
            "chain_id": DEFAULT_CHAIN_ID, "chain": CHAIN, "expires_at": 0, "updated_at": ""}
    return spark.createDataFrame([{**base, **r} for r in rows], JOB)


def log_rows(spark, *rows):
    base = {"job_id": "j", "page": 1, "stage": FINAL[0], "version": FINAL[1], "status": "succeeded", "idempotency_key": "",
            "input_uri": "", "result_uri": "r", "next_stage": "", "error": "", "expires_at": 0,
            "ts": dt.datetime(2026, 1, 1), "seq": 0}
    return spark.createDataFrame([{**base, **r} for r in rows], STAGE_LOG)


@pytest.mark.parametrize(
    "pages,count,want",
    [
        (["succeeded"] * 3, 3, ("succeeded", 3, 0, 0)),
        (["succeeded", "failed", "running"], 3, ("failed", 1, 1, 1)),
        (["succeeded", "running"], 3, ("pending", 1, 0, 2)),
        ([], 2, ("pending", 0, 0, 2)),
        ([], 0, ("pending", 0, 0, 0)),
        (["succeeded"] * 3, 2, ("pending", 3, 0, 0)),
    ],
)
def test_gate(spark, pages, count, want):
    rows = [{"page": i, "status": s} for i, s in enumerate(pages, 1)]
    rows += [{"page": 9, "stage": "gemini", "status": "failed"}, {"page": 0, "status": "failed"}]
    got = job_ops.check_jobs(
        job_rows(spark, {"job_id": "j", "page_count": count}), log_rows(spark, *rows), at("2026-02-01")
    ).first()
    assert (got.decision, got.succeeded_count, got.failed_count, got.pending_count) == want


def test_status_hides_expired_pages(spark):
    end = int(dt.datetime(2026, 1, 10, tzinfo=dt.timezone.utc).timestamp())
    log = log_rows(spark, {"page": 1, "expires_at": end}, {"page": 2, "expires_at": end + 1})
    jobs = job_rows(spark, {"job_id": "j", "page_count": 2, "expires_at": end})
    got = job_ops.job_status(jobs, log, at("2026-01-10")).first()
    assert (got.succeeded_count, got.pending_count, got.expires_at) == (1, 1, "2026-01-10T00:00:00Z")


def test_newest_row_wins_whatever_the_order(spark):
    rows = [
        {"status": "running", "ts": dt.datetime(2026, 1, 1)},
        {"status": "failed", "ts": dt.datetime(2026, 1, 2), "seq": 1},
        {"status": "running", "ts": dt.datetime(2026, 1, 2), "seq": 2},
        {"page": 2, "status": "succeeded"},
    ]
    for order in (rows, rows[::-1]):
        got = state.latest_state(log_rows(spark, *order)).orderBy("page").collect()
        assert [(r.page, r.status, r.seq) for r in got] == [(1, "running", 2), (2, "succeeded", 0)]


def test_stage_listing(spark):
    log = log_rows(
        spark, {"page": 2}, {"page": 1}, {"page": 0}, {"page": 3, "version": "v2"}, {"page": 4, "stage": "mock"}
    )
    assert sorted(r.page for r in state.stages_for(log, *FINAL).collect()) == [1, 2]


def test_pending_work(spark):
    end = int(dt.datetime(2026, 1, 10, tzinfo=dt.timezone.utc).timestamp())
    log = log_rows(
        spark,
        {"page": 1}, {"page": 2, "status": "failed"}, {"page": 3, "status": "running"},
        {"page": 4, "expires_at": end}, {"page": 6, "stage": "gemini"},
    )
    work = log.select(*state.KEY).filter(F.col("page") != 6)
    work = work.unionByName(work.filter("page = 1").withColumn("page", F.lit(5)))
    work = work.unionByName(work.filter("page = 1").withColumn("page", F.lit(6)))
    got = state.pending_work(work, log, at("2026-01-10")).collect()
    assert sorted(r.page for r in got) == [2, 3, 4, 5, 6]


def test_state_log_repeats_and_purges(spark, tmp_path):
    root, target = str(tmp_path / "log"), str(tmp_path / "kept")
    assert state.read_state_log(spark, root).count() == 0
    rows = log_rows(spark, {"page": 1, "expires_at": 5}, {"page": 2})
    state.append_state(rows, root, 1)
    state.append_state(rows, root, 1)
    assert state.read_state_log(spark, root).count() == 2
    state.purge_expired(spark, root, target, at("2026-01-01"))
    assert [r.page for r in state.read_state_log(spark, target).collect()] == [2]


def test_dead_letters(spark):
    tries = [{"page": 1, "status": "running", "seq": i} for i in range(5)] + [{"page": 1, "status": "failed", "seq": 9}]
    tries += [{"page": 2, "status": "running", "seq": i} for i in range(4)]
    tries += [{"page": 3, "status": "running", "seq": i} for i in range(6)] + [{"page": 3}]
    log = log_rows(spark, *tries)
    assert [(r.page, r.attempts) for r in state.dead_letters(log, at("2026-01-02")).collect()] == [(1, 5)]
    assert state.dead_letters(log, at("2026-02-02")).count() == 0


def test_bind_chain(spark):
    requests = spark.createDataFrame([("a", ""), ("b", DEFAULT_CHAIN_ID), ("c", "nope")], "job_id string, chain_id string")
    got = {r.job_id: r for r in job_ops.bind_chain(requests).collect()}
    assert [got[j].chain_id for j in "ab"] == [DEFAULT_CHAIN_ID] * 2
    assert [tuple(s) for s in got["a"].chain] == CHAIN and got["a"].bind_error is None
    assert got["c"].bind_error == "chain nope is not in the registry" and got["c"].chain == []


def test_frozen_chain_is_not_resolved_again(spark):
    jobs = job_rows(spark, {"job_id": "old", "chain": [], "chain_id": ""}, {"job_id": "new", "chain": CHAIN[:1]})
    got = {r.job_id: r.final_stage for r in job_ops.with_chain_ends(job_ops.effective_chain(jobs)).collect()}
    assert got == {"old": "enrich_transactions", "new": "gemini"}


def test_carry_over(spark):
    old = job_rows(
        spark,
        {"job_id": "a", "page_count": 3, "mode": "rendered", "error": "e", "result_uri": "r", "expires_at": 7},
        {"job_id": "keep", "page_count": 9},
    )
    new = spark.createDataFrame([("a", "in2", 5), ("fresh", "in3", 1)], "job_id string, input_uri string, page_count int")
    got = {r.job_id: r for r in job_ops.submit_jobs(old, new).collect()}
    a = got["a"]
    assert (a.status, a.input_uri, a.page_count, a.mode, a.error, a.result_uri, a.expires_at) == (
        "running", "in2", 5, "rendered", "", "", 0)
    assert [tuple(s) for s in a.chain] == CHAIN
    assert got["keep"].page_count == 9 and got["fresh"].chain == []

    failed = spark.createDataFrame([("a", "boom"), ("none", "lost")], "job_id string, error string")
    got = {r.job_id: r for r in job_ops.mark_failed_jobs(old, failed).collect()}
    a = got["a"]
    assert (a.status, a.error, a.input_uri, a.page_count, a.mode, a.result_uri) == ("failed", "boom", "in", 3, "rendered", "")
    assert (got["none"].status, got["none"].input_uri, got["none"].page_count) == ("failed", "", 0)

    merged = spark.createDataFrame([("a", "out", 4)], "job_id string, result_uri string, page_count int")
    a = {r.job_id: r for r in job_ops.commit_merged_jobs(old, merged).collect()}["a"]
    assert (a.status, a.result_uri, a.page_count, a.error, a.mode) == ("succeeded", "out", 4, "", "rendered")


def test_terminal_events(spark):
    jobs = job_rows(
        spark,
        {"job_id": "a", "status": "succeeded", "result_uri": "r", "error": "old", "updated_at": "2026-01-01T00:00:00Z"},
        {"job_id": "b", "status": "failed", "error": "boom", "result_uri": "r", "updated_at": "bad"},
        {"job_id": "c", "status": "created"},
    )
    got = {r.job_id: r for r in job_ops.terminal_events(jobs).collect()}
    assert (got["a"].event, got["a"].result_uri, got["a"].error, got["a"].at) == ("succeeded", "r", "", dt.datetime(2026, 1, 1))
    assert (got["b"].event, got["b"].result_uri, got["b"].error, got["b"].at) == ("failed", "", "boom", None)
    assert got["c"].event is None and "created" in got["c"].event_error


def test_validate(spark):
    jobs = job_rows(spark, {"job_id": "", "input_uri": "", "page_count": -1, "chain": []}, {"job_id": "ok"}).withColumn(
        "tenant_id", F.when(F.col("job_id") == "", "").otherwise("acme")
    )
    got = {r.job_id: r.errors for r in job_ops.validate_jobs(jobs).collect()}
    assert got["ok"] == []
    assert got[""] == ["empty job_id", "empty tenant_id", "empty input_uri", "negative page_count", "empty chain"]


RECORD = "job_id string, page int, status string, result_uri string"
BODY = "job_id string, page int, result string"


def run_merge(spark, count, records, bodies):
    jobs = spark.createDataFrame([("j", count)], "job_id string, page_count int")
    return merge.merge_jobs(jobs, spark.createDataFrame(records, RECORD), spark.createDataFrame(bodies, BODY), "b")


def test_merge_keeps_bodies_and_order(spark, tmp_path):
    records = [("j", p, "succeeded", "u") for p in (3, 1, 2)]
    merged = run_merge(spark, 3, records, [("j", p, f"{{ {p} }}") for p in (2, 3, 1)])
    assert tuple(merged.documents.first()) == ("j", 3, "s3://b/jobs/j/merged/v1/result.json")
    assert merged.rejects.count() == 0
    merge.write_merged(merged, str(tmp_path))
    stored = spark.read.parquet(str(tmp_path / "pages")).collect()
    assert [(r.page, r.result) for r in stored] == [(1, "{ 1 }"), (2, "{ 2 }"), (3, "{ 3 }")]


@pytest.mark.parametrize(
    "count,records,bodies,error",
    [
        (3, [("j", 1, "succeeded", "u")], [("j", 1, "x")], "only 1 of 3 pages were recorded by the last stage"),
        (1, [("j", 1, "running", "u")], [("j", 1, "x")], "page 1 has status running"),
        (1, [("j", 1, "succeeded", "")], [("j", 1, "x")], "page 1 has no result_uri"),
        (2, [("j", 2, "failed", "u"), ("j", 1, "succeeded", "u")], [("j", 2, "x")], "page 1 has no stored result"),
    ],
)
def test_merge_rejects(spark, count, records, bodies, error):
    merged = run_merge(spark, count, records, bodies)
    assert [r.error for r in merged.rejects.collect()] == [error]
    assert merged.pages.count() == 0 and merged.documents.count() == 0


def test_settled_keys_are_what_pending_work_leaves_out(spark):
    end = int(dt.datetime(2026, 1, 10, tzinfo=dt.timezone.utc).timestamp())
    rows = [{"page": 1, "status": "running", "seq": i} for i in range(5)]  # a dead letter
    rows += [{"page": 2, "status": "running", "seq": i} for i in range(4)]
    rows += [{"page": 3, "expires_at": end}, {"page": 4, "expires_at": end + 1}, {"page": 5}]
    rows += [{"page": 6, "status": "failed", "seq": 1}, {"page": 6}, {"page": 7, "status": None}, {"page": 8, "expires_at": None}]
    rows += [{"page": None}, {"page": 9, "ts": None}, {"page": 9, "status": "failed", "ts": dt.datetime(1960, 1, 1)}]
    rows += [{"page": 10, "status": "running", "seq": i} for i in range(6)] + [{"page": 10, "seq": 9, "expires_at": end}]
    log, now = log_rows(spark, *rows), at("2026-01-10")
    work = log.select(*state.KEY).distinct()
    newest = state.latest_state(log, "status", "expires_at")
    want = state.pending_work(work, newest, now, state.dead_letters(log, now)).collect()
    got = work.join(state.settled_keys(log, now), state.KEY, "left_anti").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sorted(r.page for r in got if r.page) == [2, 3, 6, 7, 8, 9, 10]


def test_ended_rows_are_the_rows_of_both_kinds(spark):
    ended = spark.createDataFrame(
        [("a", 1, "in", "out", "next", None, None), ("b", 2, "in", "out", "next", "bad", True), ("c", 3, None, None, None, None, True)],
        "job_id string, page int, input_uri string, result_uri string, next_stage string, error string, failed boolean",
    ).withColumns({"stage": F.lit(FINAL[0]), "version": F.lit(FINAL[1])})
    failed, now = F.col("failed").isNotNull(), at("2026-01-10")
    got = state.ended_rows(ended, failed, now, 7)
    want = state.succeeded_rows(ended.filter(~failed), now, 7).unionByName(state.failed_rows(ended.filter(failed), now, 7))
    assert got.schema.names == want.schema.names
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
