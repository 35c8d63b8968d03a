import datetime as dt
import json

import pandas as pd
from pyspark.sql import functions as F

from docspark.operators.state import latest_state, read_state_log
from docspark.plans.chain import StageStore, extract_stage, run_stage
from docspark.schema import CHAIN_REGISTRY, DEFAULT_CHAIN_ID, MESSAGE, STAGE_LOG
from docspark.streaming import completion, messages
from docspark.streaming import state as stream_state


def rows(*values):
    base = {"job_id": "j", "page": 1, "stage": "enrich_transactions", "version": "v1", "status": "running",
            "idempotency_key": "", "input_uri": "", "result_uri": "", "next_stage": "", "error": "", "expires_at": 0,
            "ts": dt.datetime(2026, 1, 1), "seq": 0}
    return [{**base, **v} for v in values]


BATCHES = [
    rows({"seq": 1}, {"seq": 2, "status": "failed"}, {"page": 2, "seq": 1}, {"page": 3, "status": "succeeded"}),
    rows({"seq": 3, "status": "succeeded"}, {"page": 2, "seq": 2, "status": "succeeded"}, {"page": 3, "seq": 5}),
    rows({"seq": 0, "status": "failed"}, {"page": 4, "seq": 1, "status": "queued"}),
]


def as_stream(spark, path):
    for i, batch in enumerate(BATCHES):
        spark.createDataFrame(batch, STAGE_LOG).coalesce(1).write.parquet(f"{path}/{i}")
    stream = spark.readStream.schema(STAGE_LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    return stream, spark.createDataFrame([r for b in BATCHES for r in b], STAGE_LOG)


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def test_stream_and_batch_agree_on_the_newest_row(spark, tmp_path):
    stream, batch = as_stream(spark, str(tmp_path / "in"))
    finish(stream_state.stream_latest_state(stream, str(tmp_path / "log"), str(tmp_path / "cp")))
    got = latest_state(read_state_log(spark, str(tmp_path / "log")))
    assert sorted(got.collect()) == sorted(latest_state(batch).collect())


WANT = {1: ("succeeded", 4), 2: ("succeeded", 2), 3: ("succeeded", 2), 4: ("queued", 1)}


def test_stream_and_batch_agree_on_key_life(spark, tmp_path):
    stream, batch = as_stream(spark, str(tmp_path / "in"))
    finish(stream_state.stream_key_life(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    stored = spark.read.schema(stream_state.STORED_LIFE).parquet(str(tmp_path / "out"))
    got = stream_state.latest_life(stored).collect()
    assert {r.page: (r.status, r.deliveries) for r in got} == WANT
    assert {r.page: (r.status, r.deliveries) for r in stream_state.key_life(batch).collect()} == WANT


def in_batches(spark, path, batches, schema=STAGE_LOG):
    """A stream that gives each batch to a micro-batch of its own, in order."""
    for i, batch in enumerate(batches):
        df = spark.createDataFrame(batch, schema).coalesce(1)
        df.write.parquet(f"{path}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def at(day, hour=0):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=day, hours=hour)


def until(day):
    return int(at(day + 14).replace(tzinfo=dt.timezone.utc).timestamp())


def row(day, status="running", page=1, **more):
    return {"page": page, "status": status, "ts": at(day), "seq": day, "expires_at": until(day), **more}


def test_keys_lapse_and_start_anew(spark, tmp_path):
    stream = in_batches(spark, str(tmp_path / "in"), [
        rows(row(0), row(0, page=2), row(0, page=3, expires_at=0), row(0, "succeeded", page=4)),
        # Page 1 slides its end; page 2 lapses; page 3 never does; page 4 is final and does not slide.
        rows(row(10, "failed"), row(10, page=4), row(20, page=3), row(14, page=2)),
        rows(row(20), row(2, "queued"), row(13, page=4), row(15, "failed", page=4)),
    ])
    finish(stream_state.stream_key_life(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    stored = spark.read.schema(stream_state.STORED_LIFE).parquet(str(tmp_path / "out"))
    got = {r.page: (r.status, r.deliveries, r.lives, r.expires_at) for r in stream_state.latest_life(stored).collect()}
    assert got == {
        1: ("running", 4, 1, until(20)),
        2: ("running", 1, 2, until(14)),
        3: ("running", 2, 1, until(20)),
        4: ("failed", 1, 2, until(15)),
    }


def test_life_is_written_under_the_checkpoint_own_name(spark, tmp_path):
    out = str(tmp_path / "out")
    for name in ("a", "b"):  # each begins with batch 0
        stream = in_batches(spark, str(tmp_path / name), [rows(row(0 if name == "a" else 5, page=1 if name == "a" else 2))])
        finish(stream_state.stream_key_life(stream, out, str(tmp_path / f"cp-{name}")))
    stored = spark.read.schema(stream_state.STORED_LIFE).parquet(out)
    assert sorted(r.page for r in stream_state.latest_life(stored).collect()) == [1, 2]


def test_redelivered_keys_pass_once_a_window(spark, tmp_path):
    days = [[0, 3, 13], [20, 14], [2, 21, 40], [1]]
    stream = in_batches(
        spark, str(tmp_path / "in"),
        [[("k", at(d), d) for d in batch] + [("late", at(0), 100)] * (i == 3) for i, batch in enumerate(days)],
        "idempotency_key string, ts timestamp, seq long",
    )
    out = str(tmp_path / "out")
    with stream_state.stateful(spark):
        query = (
            stream_state.drop_redelivered(stream, "ts").writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        )
    finish(query)
    # Day 14 is the first after the window of day 0; day 40 after that of day 14. A late key is not lost.
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == [0, 14, 40, 100]
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


JOBS = "job_id string, page_count int, chain_id string, chain array<struct<name:string,version:string,queue_name:string>>"


def test_job_is_reported_once_when_it_finishes(spark, tmp_path):
    stream, _ = as_stream(spark, str(tmp_path / "in"))
    jobs = spark.createDataFrame([("j", 2, "", []), ("other", 1, "", [])], JOBS)
    out = str(tmp_path / "out")
    finish(completion.stream_finished_jobs(stream, jobs, out, str(tmp_path / "cp"), until(0)))
    got = spark.read.parquet(out).collect()
    assert [(r.job_id, r.decision) for r in got] == [("j", "failed")]


def test_pages_that_lapse_do_not_finish_a_job(spark, tmp_path):
    jobs = spark.createDataFrame([("j", 2, "", []), ("k", 2, "", [])], JOBS)
    early = [row(0, "succeeded", 1), row(0, "succeeded", 0), row(0, "running", 2)]
    stream = in_batches(spark, str(tmp_path / "in"), [
        rows(*[{**r, "job_id": j} for r in early for j in "jk"]),
        rows(row(10, "succeeded", 2, job_id="j"), row(10, "succeeded", 2, job_id="k", stage="gemini")),
        rows(row(11, "succeeded", 1, job_id="j"), row(11, "failed", 2, job_id="k"), row(12, "succeeded", 1, job_id="k")),
    ])
    out = str(tmp_path / "out")
    # By the clock of day 15 what was written on day 0 has lapsed.
    finish(completion.stream_finished_jobs(stream, jobs, out, str(tmp_path / "cp"), until(1)))
    got = sorted((r.job_id, r.decision, r.succeeded_count, r.failed_count) for r in spark.read.parquet(out).collect())
    assert got == [("j", "succeeded", 2, 0), ("k", "failed", 1, 1)]


def test_messages(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    good = {"job_id": "j", "page": 2, "stage": "s", "version": "v1", "metadata": {"a": "b"},
            "chain": [{"name": "s", "version": "v1", "queue_name": "q"}]}
    (inbox / "a.jsonl").write_text(json.dumps(good) + "\n{broken\n")
    taken = str(tmp_path / "taken")

    def handle(work, batch_id):
        assert work.schema.fieldNames() == MESSAGE.fieldNames()
        work.write.mode("overwrite").parquet(f"{taken}/batch={batch_id}")

    finish(
        messages.stream_work(
            messages.decode_messages(messages.read_messages(spark, str(inbox))), handle,
            str(tmp_path / "rejected"), str(tmp_path / "cp"),
        )
    )
    work = spark.read.parquet(taken).first()
    assert (work.job_id, work.page, work.metadata, work.input_uri, work.chain_idx) == ("j", 2, {"a": "b"}, "", 0)
    assert [r.body for r in spark.read.parquet(str(tmp_path / "rejected")).collect()] == ["{broken"]


def test_message_stream_runs_each_page_once(spark, tmp_path):
    inbox, calls, nexts = tmp_path / "inbox", str(tmp_path / "calls"), str(tmp_path / "next")
    inbox.mkdir()
    chain = [dict(zip(("name", "version", "queue_name"), s)) for s in CHAIN_REGISTRY[DEFAULT_CHAIN_ID]]

    def message(page):
        return json.dumps({"job_id": "j", "page": page, "stage": "gemini", "version": "v1",
                           "input_uri": f"s3://in/{page}", "chain": chain})

    # Page 1 comes twice in one file and once more in the next.
    (inbox / "a.jsonl").write_text("\n".join([message(1), message(1), message(2)]))
    (inbox / "b.jsonl").write_text("\n".join([message(1), message(3)]))

    def extractor(batch: pd.DataFrame) -> pd.DataFrame:
        with open(calls, "a") as f:
            f.writelines(bytes(c).decode() + "\n" for c in batch["content"])
        return pd.DataFrame({"body": ["{}"] * len(batch), "provider": "t", "model": "t",
                             "input_tokens": 1, "output_tokens": 1, "error": None})

    docs = spark.createDataFrame([(f"s3://in/{p}", bytearray(b"%d" % p)) for p in (1, 2, 3)], "uri string, content binary")
    store = StageStore(spark, str(tmp_path / "stages"), "work")
    stage = extract_stage(docs, extractor)

    def handle(work, batch_id):
        following = run_stage(store, stage, work, F.lit("2026-01-01").cast("timestamp"), batch_id)
        following.drop("metadata", "chain").write.mode("overwrite").parquet(f"{nexts}/batch={batch_id}")

    finish(
        messages.stream_work(
            messages.decode_messages(messages.read_messages(spark, str(inbox), 1)), handle,
            str(tmp_path / "rejected"), str(tmp_path / "cp"),
        )
    )
    done = store.stored("done", "gemini", "v1").collect()
    assert sorted((r.page, r.run) for r in done) in ([(1, 0), (2, 0), (3, 1)], [(1, 0), (2, 1), (3, 0)])
    # The second delivery is sent on without being run.
    sent = spark.read.parquet(nexts).collect()
    assert sorted(r.page for r in sent) == [1, 1, 2, 3] and {r.stage for r in sent} == {"normalize_card_statement"}


def test_events_survive_a_receiver_and_a_crash(spark, tmp_path, monkeypatch):
    """Each kind on its own; a crash behind the delivery brings the events again."""
    from docspark.schema import JOB
    from docspark.streaming import events

    told = str(tmp_path / "told")

    def receiver(down):
        def notify(kind, batch):
            if kind == down and len(batch):
                raise ConnectionError("no answer")
            with open(told, "a") as f:
                f.writelines(f"{kind} {j}\n" for j in batch["job_id"])

        return notify

    def commit(name, *jobs):
        base = {f.name: None for f in JOB.fields} | {"page_count": 1, "updated_at": "2026-01-01T00:00:00Z", "error": ""}
        rows = [{**base, "job_id": j, "status": s} for j, s in jobs]
        spark.createDataFrame(rows, JOB).coalesce(1).write.parquet(str(tmp_path / "jobs" / name))

    def run(down):
        rows = spark.readStream.schema(JOB).option("recursiveFileLookup", True).parquet(str(tmp_path / "jobs"))
        query = events.stream_events(rows, str(tmp_path / "out"), receiver(down), str(tmp_path / "cp"), attempts=1)
        query.awaitTermination()

    commit("a", ("j1", "succeeded"), ("j2", "failed"), ("j3", "running"))
    run("failed")
    assert open(told).read().split("\n")[:-1] == ["succeeded j1"]
    commit("b", ("j1", "succeeded"), ("j4", "failed"))
    real = events.drop_parts
    monkeypatch.setattr(events, "drop_parts", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    try:
        run(None)
    except Exception:  # noqa: BLE001  the stream ends with the crash
        pass
    monkeypatch.setattr(events, "drop_parts", real)
    run(None)
    lines = open(told).read().split("\n")[:-1]
    assert set(lines) == {"succeeded j1", "failed j2", "failed j4"} and lines.count("succeeded j1") == 1
    delivered = spark.read.schema(events.DELIVERED).parquet(str(tmp_path / "out" / "delivered")).collect()
    assert sorted((r.job_id, r.event) for r in delivered) == [("j1", "succeeded"), ("j2", "failed"), ("j4", "failed")]


def test_messages_come_again_until_they_are_dead(spark, tmp_path):
    from docspark.operators.state import attempts, dead_letters, due_again
    from docspark.plans.chain import Stage, StageData
    from docspark.schema import TRANSACTION_ROW
    from test_reruns import message
    from test_reruns import messages as rows_of

    root, inbox = str(tmp_path), str(tmp_path / "inbox")
    store = StageStore(spark, f"{root}/stages", "work")
    sent = rows_of(spark, message("good", 1, ("s", "v1")), message("bad", 1, ("s", "v1")))
    messages.encode_messages(sent).write.text(f"{inbox}/new")

    def fn(work, data):
        bad = work.filter("job_id = 'bad'").select("job_id", "page", F.lit("boom").alias("error"))
        return StageData(transactions=spark.createDataFrame([], TRANSACTION_ROW), failed=bad)

    counts = []
    for i in range(4):
        at = F.lit(f"2026-01-01 0{i}:00:00").cast("timestamp")
        lines = messages.decode_messages(spark.readStream.option("recursiveFileLookup", True).text(inbox))
        finish(messages.stream_stage(lines, store, Stage("s", "v1", fn), lambda _, t=at: t, f"{root}/out", f"{root}/cp"))
        log = read_state_log(spark, store.log_root)
        soon, later = (F.lit(f"2026-01-01 0{i}:{m}:00").cast("timestamp") for m in ("09", "10"))
        assert due_again(log, soon, 3).count() == 0
        counts += [messages.redeliver(spark, log, sent, root, inbox, later, 3) for _ in range(2)]
    assert counts == [1, 0, 1, 0, 0, 0, 0, 0]
    assert {(r.job_id, r.attempts, r.done) for r in attempts(log).collect()} == {("good", 1, True), ("bad", 3, False)}
    assert [r.job_id for r in dead_letters(log, later, 3).collect()] == ["bad"]
    assert dead_letters(log, F.lit("2026-01-16").cast("timestamp"), 3).count() == 0


def test_keys_share_rows_of_the_state_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_state, "KEY_BUCKETS", 3, raising=False)
    stream = in_batches(
        spark, str(tmp_path / "in"),
        [[(f"k{i}", at(d), d * 100 + i) for i in range(40)] + [(None, at(d), d)] for d in (0, 3, 20)],
        "idempotency_key string, ts timestamp, seq long",
    )
    with stream_state.stateful(spark):
        query = (
            stream_state.drop_redelivered(stream, "ts").writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        )
    finish(query)
    got = sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted([*range(40), 0, *range(2000, 2040), 20])
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 3


def test_pages_of_a_job_share_rows_of_the_state_store(spark, tmp_path, monkeypatch):
    from docspark.streaming import state

    monkeypatch.setattr(state, "KEY_BUCKETS", 2, raising=False)
    names = [f"j{i}" for i in range(6)]
    jobs = spark.createDataFrame([(j, 300, "", []) for j in names], JOBS)
    pages = [row(0, "succeeded", p, job_id=j) for j in names for p in range(1, 301)]
    stream = in_batches(spark, str(tmp_path / "in"), [rows(*pages[:-1]), rows(pages[-1])])
    query = completion.stream_finished_jobs(stream, jobs, str(tmp_path / "out"), str(tmp_path / "cp"), until(-1))
    finish(query)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.job_id, r.decision, r.succeeded_count) for r in got) == [(j, "succeeded", 300) for j in names]
    # Two chunks a job and one row of counts a bucket.
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 2 * 6 + 2
