"""Noticing, batch by batch, that jobs have finished."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from docspark.functions.dates import DAY_SECONDS
from docspark.operators.jobs import check_jobs, effective_chain, with_chain_ends
from docspark.schema import FAILED, PENDING, RETENTION_DAYS, SUCCEEDED
from docspark.sources.tables import replace_part
from docspark.streaming.state import Bucket, bucketed, columns_of, stateful, stream_part

FINISHED = (
    T.StructType()
    .add("job_id", "string")
    .add("decision", "string")
    .add("succeeded_count", "long")
    .add("failed_count", "long")
)
NEVER = 1 << 62
CHUNK = 256
# What the counts need of a row, of a chunk of pages, and of a job.
COUNTED = ("job_id", "page", "status", "expires_at", "ts", "seq", "page_count")
PAGES = "page array<int>, status array<string>, expires_at array<long>, ts array<long>, seq array<long>"
COUNTS = (
    T.StructType()
    .add("job_id", "string")
    .add("succeeded", "long")
    .add("failed", "long")
    .add("lapses", "long")
    .add("told", "boolean")
    .add("chunks", T.ArrayType(T.IntegerType()))
)


def finished_jobs(jobs: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    decided = check_jobs(jobs, state, now).filter(F.col("decision") != PENDING)
    return decided.select(*[f.name for f in FINISHED.fields])


class PageCounts(StatefulProcessor):
    """Counts the finished pages of the jobs of a bucket, `CHUNK` pages' state at a time.

    The pages are a map of chunks in the state store, never in memory as a
    whole; the counts follow each change of a page. Only when the first page
    among them lapses are the job's chunks gone through.
    """

    def __init__(self, days: int, now: int | None):
        self.days, self.now = days, now

    def init(self, handle) -> None:
        ttl = self.days * DAY_SECONDS * 1000
        self.chunks = handle.getMapState("chunks", "job_id string, chunk int", PAGES, ttl)
        self.bucket = Bucket(handle, COUNTS, 1, self.days)

    def handleInputRows(self, key, rows, timerValues):
        at = timerValues.getCurrentProcessingTimeInMs()
        now = self.now if self.now is not None else at // 1000
        jobs, new, out = self.bucket.read(at), {}, []
        _, columns = columns_of(rows, [*COUNTED, "_bucket"])
        for job_id, page, *row in zip(*columns[: len(COUNTED)]):
            new.setdefault(job_id, {}).setdefault(page // CHUNK, []).append((page, *row))
        for job_id, arrived in new.items():
            ok, bad, lapses, told, known, _ = jobs.get((job_id,), (0, 0, NEVER, False, (), at))
            expected = 0
            for chunk, own in arrived.items():
                pages = self._read(job_id, chunk)
                for page, status, expires_at, ts, seq, page_count in own:
                    expected = page_count
                    held = pages.get(page)
                    if held is not None and (ts, seq) < (held[2], held[3]):
                        continue
                    if held is not None:
                        ok, bad = ok - (held[0] == SUCCEEDED), bad - (held[0] == FAILED)
                    pages[page] = (status, expires_at, ts, seq)
                    ok, bad = ok + (status == SUCCEEDED), bad + (status == FAILED)
                    lapses = min(lapses, expires_at or NEVER)
                self._write(job_id, chunk, pages)
            known = sorted({*known, *arrived})
            if lapses <= now:
                ok, bad, lapses = self._alive(job_id, known, now)
            decision = FAILED if bad else SUCCEEDED if expected and ok == expected else None
            if decision and not told:
                out.append((job_id, decision, ok, bad))
            jobs[job_id,] = (ok, bad, lapses, bool(told or decision), known, at)
        self.bucket.write(jobs)
        yield pd.DataFrame(out, columns=FINISHED.fieldNames(), dtype=object)

    def _read(self, job_id: str, chunk: int) -> dict[int, tuple]:
        columns = self.chunks.getValue((job_id, chunk))
        return {page: held for page, *held in zip(*columns)} if columns else {}

    def _write(self, job_id: str, chunk: int, pages: dict[int, tuple]) -> None:
        self.chunks.updateValue((job_id, chunk), tuple(list(c) for c in zip(*((p, *v) for p, v in pages.items()))))

    def _alive(self, job_id: str, known: list[int], now: int) -> tuple[int, int, int]:
        """Count anew, leaving out the pages that have lapsed.

        A lapsed page stays in its chunk until that is evicted, under a status
        that counts for nothing, so that older rows of it are still known as old.
        """
        ok = bad = 0
        lapses = NEVER
        for chunk in known:
            pages, gone = self._read(job_id, chunk), {}
            for page, (status, expires_at, ts, seq) in pages.items():
                if expires_at and expires_at <= now:
                    gone[page] = ("", 0, ts, seq)
                    continue
                ok, bad = ok + (status == SUCCEEDED), bad + (status == FAILED)
                lapses = min(lapses, expires_at or NEVER)
            if gone:
                self._write(job_id, chunk, {**pages, **gone})
        return ok, bad, lapses

    def close(self) -> None:
        pass


def final_stage_rows(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Page rows of the last stage of their job's own chain, with the page count."""
    ends = with_chain_ends(effective_chain(jobs)).select(
        "job_id", "page_count", F.col("final_stage").alias("stage"), F.col("final_version").alias("version")
    )
    expires_at = F.coalesce("expires_at", F.lit(0)).cast("long").alias("expires_at")
    named = rows.filter(F.col("page") > 0).select(
        "job_id", "page", "stage", "version", "status", expires_at, F.unix_micros("ts").alias("ts"), "seq"
    )
    return named.join(ends, ["job_id", "stage", "version"])


def stream_finished_jobs(
    rows: DataFrame, jobs: DataFrame, out_root: str, checkpoint: str,
    now: int | None = None, trigger: dict | None = None, days: int = RETENTION_DAYS,
) -> StreamingQuery:
    """Store each job once, in the micro-batch that finishes it.

    Counts per job are kept in the stream's own state; no log is read. The
    clock is that of each micro-batch, or `now` (epoch seconds) in a replay.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        replace_part(batch, out_root, "batch", stream_part(checkpoint, batch_id))

    with stateful(rows.sparkSession):
        return (
            bucketed(final_stage_rows(rows, jobs).select(*COUNTED), "job_id")
            .groupBy("_bucket")
            .transformWithStateInPandas(PageCounts(days, now), FINISHED, "update", "ProcessingTime")
            .writeStream.outputMode("update")
            .foreachBatch(each)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
