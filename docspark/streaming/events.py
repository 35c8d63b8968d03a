"""Telling the outside that jobs are finished, once per job."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docspark.operators.jobs import terminal_events
from docspark.schema import FAILED, RETENTION_DAYS, SUCCEEDED
from docspark.sources.tables import drop_parts, kept_part, read_or_empty, replace_part
from docspark.streaming.state import drop_redelivered, stateful, stream_part

log = logging.getLogger(__name__)

DELIVERED = T.StructType().add("job_id", "string").add("event", "string")

# Called in the tasks with a frame of events of one kind, "succeeded" or
# "failed". A job may come again after a crash, so receivers drop job ids
# they have seen.
Notifier = Callable[[str, pd.DataFrame], None]


def silent(kind: str, events: pd.DataFrame) -> None:
    """The default receiver: none."""


def deliver(events: DataFrame, notifier: Notifier) -> DataFrame:
    """Hand events to the notifier; returns the keys of what it took."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind, rows in batch.groupby("event"):
                notifier(kind, rows)
            yield batch[["job_id", "event"]]

    return events.mapInPandas(run, DELIVERED)


def notify_finished(jobs: DataFrame, delivered_root: str, notifier: Notifier, run: int) -> None:
    """Deliver the events of finished jobs that were not delivered yet."""
    known = read_or_empty(jobs.sparkSession, delivered_root, DELIVERED)
    finished = terminal_events(jobs).filter(F.col("event_error").isNull()).drop("event_error")
    fresh = finished.join(known, ["job_id", "event"], "left_anti")
    replace_part(deliver(fresh, notifier), delivered_root, "run", run)


EVENT = (
    T.StructType()
    .add("job_id", "string")
    .add("event", "string")
    .add("chain_id", "string")
    .add("result_uri", "string")
    .add("page_count", "integer")
    .add("error", "string")
    .add("at", "timestamp")
)


def finished_events(rows: DataFrame, days: int = RETENTION_DAYS) -> DataFrame:
    """Events of a stream of committed job rows, each once per retention window."""
    events = terminal_events(rows).filter(F.col("event_error").isNull()).select(*EVENT.fieldNames())
    keyed = events.withColumn("_key", F.concat_ws(":", "job_id", "event")).withColumn(
        "_time", F.coalesce("at", F.timestamp_seconds(F.lit(0)))
    )
    return drop_redelivered(keyed, "_time", days, "_key").drop("_key", "_time")


def stream_events(
    rows: DataFrame, root: str, notifier: Notifier, checkpoint: str, attempts: int = 5,
    trigger: dict | None = None, days: int = RETENTION_DAYS,
) -> StreamingQuery:
    """Deliver the event of every job row that a stream of committed rows brings.

    The rows are the outbox: an event exists once its job is committed, and
    nothing of it is lost in between. The two kinds are tried apart; one whose
    receiver fails `attempts` times waits under `root`/waiting for the next
    micro-batch, and the job stays as it is. A crash between a delivery and the
    commit of its micro-batch brings its events again, under the same job_id.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, part = batch.sparkSession, stream_part(checkpoint, batch_id)
        waiting = read_or_empty(spark, f"{root}/waiting", WAITING).filter(~F.col("batch").startswith(part)).drop("batch")
        fresh = kept_part(batch.unionByName(waiting).distinct(), f"{root}/outbox", "batch", part)
        for kind in (SUCCEEDED, FAILED):
            own, name = fresh.filter(F.col("event") == kind), f"{part}-{kind}"
            for _ in range(attempts):
                try:
                    replace_part(deliver(own, notifier), f"{root}/delivered", "batch", name)
                    break
                except Exception:
                    log.exception("the receiver of %s events failed", kind)
            else:
                replace_part(own, f"{root}/waiting", "batch", name)
        # What waited before is in this micro-batch's outbox now.
        drop_parts(spark, f"{root}/waiting", "batch", lambda v: not v.startswith(part))
        drop_parts(spark, f"{root}/outbox", "batch", lambda v: v != part)

    with stateful(rows.sparkSession):
        return (
            finished_events(rows, days)
            .writeStream.outputMode("append")
            .foreachBatch(each)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


WAITING = T.StructType([*EVENT.fields, T.StructField("batch", T.StringType())])
