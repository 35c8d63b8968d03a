"""Stage and job state kept as an append-only log; the newest row counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.dates import expires_at
from docspark.functions.keys import stage_key
from docspark.schema import (
    DEAD_LETTER_DAYS,
    FAILED,
    MAX_DELIVERIES,
    RETENTION_DAYS,
    RUNNING,
    STAGE_KEY_COLUMNS,
    STAGE_LOG,
    SUCCEEDED,
    VISIBILITY_SECONDS,
)
from docspark.sources.tables import read_or_empty, replace_part

KEY = list(STAGE_KEY_COLUMNS)
LOG_BUCKETS = 16
#: Files a task holds open; without it each task sorts its rows by their buckets.
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def newest(log: DataFrame, keys: list[str]) -> DataFrame:
    """Newest row per key by (ts, seq).

    An aggregate, so rows of a busy key are folded before the shuffle.
    """
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("_row")
    ).select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in log.columns])


def latest_state(log: DataFrame, *columns: str) -> DataFrame:
    """Newest row per stage key; name columns to carry only those along."""
    if columns:
        order = [c for c in ("ts", "seq") if c not in columns]
        return newest(log.select(*KEY, *columns, *order), KEY).drop(*order)
    return newest(log, KEY)


def latest_jobs(log: DataFrame) -> DataFrame:
    return newest(log, ["job_id"])


def stages_for(state: DataFrame, stage: str, version: str) -> DataFrame:
    """Page-level records of one stage; job-level rows are left out."""
    return state.filter(
        (F.col("stage") == stage) & (F.col("version") == version) & (F.col("page") > 0)
    )


def unexpired(df: DataFrame, now: Column) -> DataFrame:
    return df.filter((F.col("expires_at") == 0) | (F.col("expires_at") > F.unix_timestamp(now)))


def succeeded_keys(state: DataFrame, now: Column) -> DataFrame:
    return unexpired(state.filter(F.col("status") == SUCCEEDED), now)


def pending_work(work: DataFrame, state: DataFrame, now: Column, dead: DataFrame | None = None) -> DataFrame:
    """Work whose own key has not succeeded, or has but lapsed since.

    Keys among the `dead` letters are left out as long as they are kept there.
    """
    rest = work.join(succeeded_keys(state, now).select(*KEY), KEY, "left_anti")
    return rest if dead is None else rest.join(dead.select(*KEY), KEY, "left_anti")


def settled_keys(
    log: DataFrame, now: Column, deliveries: int = MAX_DELIVERIES, days: int = DEAD_LETTER_DAYS
) -> DataFrame:
    """The keys that `pending_work` leaves out, dead letters among them, by one look at the log."""
    row = F.max_by(F.struct("status", "expires_at"), F.struct("ts", "seq")).alias("_row")
    seen = log.groupBy(*KEY).agg(row, *_counts())
    alive = (F.col("_row.expires_at") == 0) | (F.col("_row.expires_at") > F.unix_timestamp(now))
    succeeded = F.coalesce((F.col("_row.status") == SUCCEEDED) & alive, F.lit(False))
    return seen.filter(succeeded | _is_dead(now, deliveries, days)).select(*KEY)


def _rows(df: DataFrame, status: str | Column, now: Column, seq: int, values: dict, days: int):
    out = {
        "status": F.lit(status) if isinstance(status, str) else status,
        "idempotency_key": stage_key(*[F.col(c) for c in KEY]),
        "expires_at": expires_at(now, days),
        "ts": now,
        "seq": F.lit(seq).cast("long"),
    }
    out.update({k: F.coalesce(F.col(v), F.lit("")) for k, v in values.items()})
    return df.select(
        *[
            (F.col(f.name) if f.name in KEY else out.get(f.name, F.lit("")))
            .cast(f.dataType)
            .alias(f.name)
            for f in STAGE_LOG.fields
        ]
    )


def running_rows(work: DataFrame, now: Column, seq: int, days: int = RETENTION_DAYS) -> DataFrame:
    """`seq` orders rows of the same instant; later writes take higher ones."""
    return _rows(work, RUNNING, now, seq, {"input_uri": "input_uri"}, days)


def succeeded_rows(done: DataFrame, now: Column, seq: int, days: int = RETENTION_DAYS) -> DataFrame:
    """`done` has result_uri and next_stage; the input is not kept."""
    values = {"result_uri": "result_uri", "next_stage": "next_stage"}
    return _rows(done, SUCCEEDED, now, seq, values, days)


def failed_rows(failed: DataFrame, now: Column, seq: int, days: int = RETENTION_DAYS) -> DataFrame:
    values = {"input_uri": "input_uri", "error": "error"}
    return _rows(failed, FAILED, now, seq, values, days)


def ended_rows(ended: DataFrame, failed: Column, now: Column, seq: int, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows of both kinds at once: those that `failed` as of `failed_rows`, the others as of `succeeded_rows`."""
    of = {"result_uri": ~failed, "next_stage": ~failed, "input_uri": failed, "error": failed}
    status = F.when(failed, FAILED).otherwise(SUCCEEDED)
    rows = ended.withColumns({"_status": status, **{k: F.when(kind, F.col(k)) for k, kind in of.items()}})
    return _rows(rows, F.col("_status"), now, seq, {k: k for k in of}, days)


def log_bucket(job_id: str = "job_id") -> Column:
    return F.pmod(F.xxhash64(job_id), F.lit(LOG_BUCKETS)).cast("int")


def append_state(rows: DataFrame, root: str, batch: int | str) -> None:
    """Append state rows; repeating a batch replaces what it wrote before.

    `batch` names the write, so it must be no one else's. The log is laid out
    by stage, version and bucket of the job, so a stage reads its own rows, and
    of those the buckets its work is in. A bucket that holds most of the rows
    is written by several tasks.
    """
    place = ("stage", "version", "bucket")
    placed = rows.withColumn("bucket", log_bucket()).hint("rebalance", *place)
    conf, before = placed.sparkSession.conf, placed.sparkSession.conf.get(OPEN_FILES, None)
    conf.set(OPEN_FILES, str(LOG_BUCKETS))
    try:
        replace_part(placed, root, "batch", batch, *place)
    finally:
        conf.unset(OPEN_FILES) if before is None else conf.set(OPEN_FILES, before)


def read_state_log(spark: SparkSession, root: str, work: DataFrame | None = None) -> DataFrame:
    """The log, or of it the buckets that `work` is in; empty where nothing was written yet."""
    log = read_or_empty(spark, root, T.StructType([*STAGE_LOG.fields, T.StructField("bucket", T.IntegerType())]))
    if work is not None:
        buckets = [r[0] for r in work.select(log_bucket().alias("bucket")).distinct().collect()]
        log = log.filter(F.col("bucket").isin(buckets)) if len(buckets) < LOG_BUCKETS else log
    return log.drop("bucket")


def purge_expired(spark: SparkSession, root: str, target: str, now: Column) -> None:
    """Write the rows still alive to `target`, a new version of the log."""
    kept = unexpired(read_state_log(spark, root), now)
    append_state(kept, target, f"base-{uuid.uuid4().hex}")


def attempts(log: DataFrame) -> DataFrame:
    """Per key how often it was started, when last, and whether it succeeded."""
    return log.groupBy(*KEY).agg(*_counts())


def _counts() -> list[Column]:
    return [
        F.count_if(F.col("status") == RUNNING).alias("attempts"),
        F.max("ts").alias("last_ts"),
        (F.count_if(F.col("status") == SUCCEEDED) > 0).alias("done"),
    ]


def _is_dead(now: Column, deliveries: int, days: int) -> Column:
    kept = expires_at(F.col("last_ts"), days) > F.unix_timestamp(now)
    return (F.col("attempts") >= deliveries) & ~F.col("done") & kept


def dead_letters(
    log: DataFrame, now: Column, deliveries: int = MAX_DELIVERIES, days: int = DEAD_LETTER_DAYS
) -> DataFrame:
    """Keys started that often without success, while they are kept aside."""
    return attempts(log).filter(_is_dead(now, deliveries, days)).drop("done")


def due_again(
    log: DataFrame, now: Column, deliveries: int = MAX_DELIVERIES, hidden: int = VISIBILITY_SECONDS
) -> DataFrame:
    """Keys to be delivered once more: started, not done, visible again, and not too often yet.

    `delivery` is the number of the next delivery, `visible_at` the second
    from which the key may be taken again.
    """
    visible_at = F.unix_timestamp("last_ts") + hidden
    waiting = attempts(log).filter((F.col("attempts") > 0) & ~F.col("done") & (F.col("attempts") < deliveries))
    return waiting.filter(visible_at <= F.unix_timestamp(now)).select(
        *KEY, (F.col("attempts") + 1).alias("delivery"), visible_at.alias("visible_at")
    )
