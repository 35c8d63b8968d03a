"""State rows as a stream: newest row, redelivery, life of a stage key.

Streams that remember keys keep them in Spark's state store, on RocksDB, with
a time to live that starts anew at each write: what has lapsed is evicted, so
state is bounded by the keys of one retention window. Whether a key has lapsed
is told by the times in the rows, so a replay gives what the first run gave.

Each call of the state store from Python costs far more than a row, so keys are
dealt to `KEY_BUCKETS` buckets, and a bucket's keys lie in one value of the
store: a micro-batch asks the store once for each bucket that its rows are in.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from docspark.functions.dates import DAY_SECONDS
from docspark.operators.state import KEY, append_state
from docspark.schema import RETENTION_DAYS, SUCCEEDED
from docspark.sources.tables import replace_part

MICROS = 1_000_000
# Fixed value, as state lies by it. Where a window has tens of millions of keys,
# a value of the store holds some ten thousand.
KEY_BUCKETS = 1 << 11

STATEFUL = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Eviction waits for the next rows; without this a query never runs out of batches.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}

KEY_SCHEMA = (
    T.StructType().add("job_id", "string").add("page", "integer").add("stage", "string").add("version", "string")
)
LIFE = (
    T.StructType(list(KEY_SCHEMA.fields))
    .add("status", "string")
    .add("deliveries", "long")
    .add("lives", "long")
    .add("expires_at", "long")
    .add("ts", "timestamp")
    .add("seq", "long")
)


def stream_part(checkpoint: str, batch_id: int) -> str:
    """Name of a micro-batch's part: batch numbers begin anew in a new checkpoint."""
    return f"{zlib.crc32(checkpoint.encode()):08x}-{batch_id}"


def stream_latest_state(rows: DataFrame, log_root: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append each micro-batch to the log, every delivery of a key a row.

    Newest-row-wins can be folded in any order, so no state is kept here;
    readers fold the log, and count its deliveries.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        append_state(batch, log_root, stream_part(checkpoint, batch_id))

    return (
        rows.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def key_life(rows: DataFrame) -> DataFrame:
    """Where each stage key stands: success is final, else the newest status.

    On a batch, without regard to expiry; rows of a busy key are folded before
    they are shuffled. `stream_key_life` lets keys lapse.
    """
    order = F.struct((F.col("status") == SUCCEEDED).alias("done"), "ts", "seq")
    return (
        rows.groupBy(*KEY)
        .agg(
            F.max_by(F.struct("status", "ts", "seq"), order).alias("_last"),
            F.count("*").alias("deliveries"),
        )
        .select(*KEY, "_last.status", "deliveries", "_last.ts", "_last.seq")
    )


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Settings of streams with state of their own; a query keeps what held when it began."""
    before = {k: spark.conf.get(k, None) for k in STATEFUL}
    for k, v in STATEFUL.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def has_lapsed(expires_at: int, at: int) -> bool:
    """Is `expires_at`, in seconds, over at a time in microseconds? 0 never is."""
    return expires_at != 0 and at >= expires_at * MICROS


class Life(NamedTuple):
    """What is kept of a key; a row of it is a life of its own."""

    status: str
    deliveries: int
    lives: int
    expires_at: int
    ts: int
    seq: int


def lived(life: Life | None, row: Life) -> Life:
    """A key's life after one more row.

    A lapsed key starts anew. Success is final until it lapses, and later
    deliveries of it are only counted: they write nothing, so they do not put
    off its end. Of other rows the newest counts, and each writes anew.
    """
    if life is None or has_lapsed(life.expires_at, row.ts):
        return row._replace(deliveries=1, lives=1 if life is None else life.lives + 1)
    done = life.status == SUCCEEDED
    newer = row.status == SUCCEEDED or (row.ts, row.seq) > (life.ts, life.seq)
    kept = life if done or not newer else row
    return kept._replace(deliveries=life.deliveries + 1, lives=life.lives)


def bucketed(rows: DataFrame, *key: str) -> DataFrame:
    """Add `_bucket`, the group of keys that a row's key is kept with."""
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(KEY_BUCKETS)).cast("int"))


def columns_of(pdfs: Iterator[pd.DataFrame], names: list[str]) -> tuple[pd.DataFrame, list[list]]:
    """All rows of a bucket, and their columns as lists; what is missing is None."""
    rows = pd.concat(pdfs, ignore_index=True)
    rows.columns = names  # they come without
    objects = rows.astype(object)
    return rows, [objects[c].where(rows[c].notna(), None).tolist() for c in rows.columns]


class Bucket:
    """The state of a bucket's keys: a column each of keys, values and times of writing.

    A key that was not written for `days` is gone, and its place given up when
    its bucket is written next; a bucket that is not written is evicted.
    """

    def __init__(self, handle, fields: T.StructType, n_key: int, days: int):
        self.ttl, self.n_key = days * DAY_SECONDS * 1000, n_key
        columns = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields.fields]
        written = T.StructField("_written", T.ArrayType(T.LongType()))
        self.state = handle.getValueState("keys", T.StructType([*columns, written]), ttlDurationMs=self.ttl)

    def read(self, now: int) -> dict[tuple, tuple]:
        """Key to values and time of writing, of what is alive at `now` in milliseconds."""
        columns = self.state.get()
        kept = zip(*columns) if columns else ()
        return {r[: self.n_key]: r[self.n_key :] for r in kept if now < r[-1] + self.ttl}

    def write(self, kept: dict[tuple, tuple]) -> None:
        self.state.update(tuple(list(c) for c in zip(*(k + v for k, v in kept.items()))))


class KeyLife(StatefulProcessor):
    """Where each stage key stands, carried from micro-batch to micro-batch."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle) -> None:
        self.bucket = Bucket(handle, LIVES, len(KEY), self.days)

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        kept, new = self.bucket.read(now), {}
        _, columns = columns_of(rows, [*NAMED, "_bucket"])
        for job_id, page, stage, version, status, expires_at, ts, seq in zip(*columns[: len(NAMED)]):
            new.setdefault((job_id, page, stage, version), []).append(Life(status, 1, 1, expires_at, ts, seq))
        out = []
        for stage_key, own in new.items():
            held = kept.get(stage_key)
            life, changes = (None, 0) if held is None else (Life(*held[:-2]), held[-2])
            for row in sorted(own, key=lambda r: (r.ts, r.seq)):
                life = lived(life, row)
            kept[stage_key] = (*life, changes + 1, now)
            out.append((*stage_key, *life, changes + 1))
        self.bucket.write(kept)
        yield pd.DataFrame(out, columns=LIVES.fieldNames(), dtype=object)

    def close(self) -> None:
        pass


NAMED = (*KEY, "status", "expires_at", "ts", "seq")
LIFE_NAMES = [f.name for f in LIFE.fields if f.name not in KEY]
STORED_LIFE = T.StructType([*LIFE.fields, T.StructField("change", T.LongType())])
# Inside the state store times are microseconds, which no time zone shifts.
LIVES = T.StructType(
    [T.StructField("ts", T.LongType()) if f.name == "ts" else f for f in STORED_LIFE.fields]
)


def stream_key_life(
    rows: DataFrame, root: str, checkpoint: str, trigger: dict | None = None, days: int = RETENTION_DAYS
) -> StreamingQuery:
    """Store the keys that a micro-batch changed as a part of its own.

    `change` counts the micro-batches that changed a key, so the newest row of
    a key is known whatever its part is called. Rows of one bucket in one
    micro-batch are put in order in one task; triggers bound a micro-batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        timed = batch.withColumn("ts", F.timestamp_micros("ts"))
        replace_part(timed, root, "batch", stream_part(checkpoint, batch_id))

    expires_at = F.coalesce("expires_at", F.lit(0)).cast("long").alias("expires_at")
    named = rows.select(*KEY, "status", expires_at, F.unix_micros("ts").alias("ts"), "seq").select(*NAMED)
    with stateful(rows.sparkSession):
        return (
            bucketed(named, *KEY)
            .groupBy("_bucket")
            .transformWithStateInPandas(KeyLife(days), LIVES, "update", "ProcessingTime")
            .writeStream.outputMode("update")
            .foreachBatch(each)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def latest_life(stored: DataFrame) -> DataFrame:
    """Newest stored row per key of `stream_key_life`.

    A new checkpoint remembers nothing, so the time of the row goes before
    the count of changes.
    """
    return (
        stored.groupBy(*KEY)
        .agg(F.max_by(F.struct(*LIFE_NAMES), F.struct("ts", "seq", "change")).alias("_row"))
        .select(*KEY, *[f"_row.{c}" for c in LIFE_NAMES])
    )


class FirstDelivery(StatefulProcessor):
    """Lets a key through once per retention window."""

    def __init__(self, days: int, names: list[str]):
        self.days, self.names = days, names

    def init(self, handle) -> None:
        fields = T.StructType().add("key", "string").add("until", "long")
        self.bucket = Bucket(handle, fields, 1, self.days)

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        ends, passed = self.bucket.read(now), []
        whole, columns = columns_of(rows, self.names)
        arrived = zip(columns[self.names.index("_key_text")], columns[self.names.index("_at")])
        for own_key, at, i in sorted(((k, at, i) for i, (k, at) in enumerate(arrived)), key=lambda r: r[1]):
            until = ends[own_key,][0] if (own_key,) in ends else None
            if until is None or has_lapsed(until, at):
                ends[own_key,] = (at // MICROS + self.days * DAY_SECONDS, now)
                passed.append(i)
        if passed:
            self.bucket.write(ends)
        yield whole.iloc[passed]

    def close(self) -> None:
        pass


def drop_redelivered(
    rows: DataFrame, time: str, days: int = RETENTION_DAYS, key: str = "idempotency_key"
) -> DataFrame:
    """Stream without repeated stage keys inside the retention window.

    A key that comes after its window has lapsed runs as new. Late rows are
    not dropped for being late: only a delivery before them can hold them
    back. Start the stream inside `stateful`.
    """
    # Times go as microseconds, as pandas holds fewer years than Spark.
    times = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.TimestampType)]
    timed = rows.withColumns(
        {"_at": F.unix_micros(time), "_key_text": F.col(key).cast("string"), **{c: F.unix_micros(c) for c in times}}
    )
    dealt = bucketed(timed, "_key_text")
    once = dealt.groupBy("_bucket").transformWithStateInPandas(
        FirstDelivery(days, dealt.columns), dealt.schema, "append", "ProcessingTime"
    )
    return once.withColumns({c: F.timestamp_micros(c) for c in times}).drop("_at", "_key_text", "_bucket")
