"""Work messages as a stream, and the page stream through a chain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docspark.operators.state import KEY, due_again
from docspark.plans.chain import Stage, StageStore, run_stage
from docspark.schema import EXTRACT_STAGE, MAX_DELIVERIES, MESSAGE, VISIBILITY_SECONDS
from docspark.sources.tables import claim_number, read_or_empty, replace_part
from docspark.streaming.state import stream_part


def read_messages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of message texts from a folder of line files."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def decode_messages(lines: DataFrame, body: str = "value") -> DataFrame:
    """Message columns, with `decode_error` on bodies that are none.

    Works on a batch or a stream; `body` may come from any source.
    """
    shape = T.StructType([*MESSAGE.fields, T.StructField("_bad", T.StringType())])
    read = lines.withColumn(
        "_m", F.from_json(body, shape, {"columnNameOfCorruptRecord": "_bad"})
    )
    broken = F.col("_m").isNull() | F.col("_m._bad").isNotNull()
    values = []
    for f in MESSAGE.fields:
        c = F.col(f"_m.{f.name}")
        if isinstance(f.dataType, T.StringType):
            c = F.coalesce(c, F.lit(""))
        elif isinstance(f.dataType, T.IntegerType):
            c = F.coalesce(c, F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(c, F.array().cast(f.dataType))
        values.append(c.alias(f.name))
    return read.select(
        F.col(body).alias("body"),
        *values,
        F.when(broken, "message is not valid JSON").alias("decode_error"),
    )


def stream_work(
    messages: DataFrame,
    handle: Callable[[DataFrame, int], None],
    rejected_root: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Hand each micro-batch of good messages to `handle(work, batch_id)`.

    `handle` gets the batch id as run number, so a repeated batch writes over
    its own output. Bodies that cannot be read are set aside, under a name of
    this checkpoint's own: batch ids begin anew in a new one.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        bad = batch.filter(F.col("decode_error").isNotNull()).select("body", "decode_error")
        replace_part(bad, rejected_root, "batch", stream_part(checkpoint, batch_id))
        good = batch.filter(F.col("decode_error").isNull()).drop("body", "decode_error")
        handle(good, batch_id)

    return (
        messages.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def encode_messages(work: DataFrame) -> DataFrame:
    """Work rows as message texts, as `decode_messages` reads them."""
    return work.select(F.to_json(F.struct(*MESSAGE.fieldNames())).alias("value"))


def stream_stage(
    messages: DataFrame,
    store: StageStore,
    stage: Stage,
    clock: Callable[[int], Column],
    out_root: str,
    checkpoint: str,
    previous: tuple[str, str] | None = None,
    header_stage: tuple[str, str] = EXTRACT_STAGE,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run one stage on a stream of decoded messages.

    Every micro-batch is an attempt of its own in the store, at the time that
    `clock(batch_id)` gives. Its next work goes to `out_root`/next as message
    lines, under a name of this checkpoint, so a repeated batch writes over
    what it wrote. Pages that are done are passed on without being run, so a
    new checkpoint may read the same messages again.
    """

    def handle(work: DataFrame, batch_id: int) -> None:
        following = run_stage(store, stage, work, clock(batch_id), batch_id, previous, header_stage)
        part = stream_part(checkpoint, batch_id)
        encode_messages(following).write.mode("overwrite").text(f"{out_root}/next/{part}")

    return stream_work(messages, handle, f"{out_root}/rejected", checkpoint, trigger)


RETRY = (
    T.StructType()
    .add("job_id", "string")
    .add("page", "integer")
    .add("stage", "string")
    .add("version", "string")
    .add("delivery", "long")
    .add("visible_at", "long")
)


def redeliver(
    spark: SparkSession,
    log: DataFrame,
    sent: DataFrame,
    root: str,
    inbox: str,
    now: Column,
    deliveries: int = MAX_DELIVERIES,
    hidden: int = VISIBILITY_SECONDS,
) -> int:
    """Put messages that were started but not done back into the inbox; returns how many.

    `sent` are the work rows ever sent, `log` the state rows of their stages.
    The table of retries under `root` has each delivery once, however often
    this is called; keys with all their deliveries behind them stay out, they
    are the dead letters. The lines are written first: a crash before the
    table is written sends them again, which the stage passes over.
    """
    before = read_or_empty(spark, f"{root}/retries", RETRY).select(*KEY, "delivery")
    due = due_again(log, now, deliveries, hidden).join(before, [*KEY, "delivery"], "left_anti")
    write = claim_number(spark, f"{root}/claims", now)
    replace_part(due, f"{root}/due", "run", write)
    due = read_or_empty(spark, f"{root}/due/run={write}", RETRY)
    again = sent.dropDuplicates(KEY).join(due.select(*KEY), KEY, "left_semi")
    encode_messages(again).write.mode("overwrite").text(f"{inbox}/retry-{write}")
    replace_part(due, f"{root}/retries", "run", write)
    return due.count()
