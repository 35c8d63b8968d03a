"""One pointer per store below which all writes have lapsed.

Every write has a number and a time of its own (`claim_number`). The pointer
goes forward first; from then on readers pass over all tables' rows of the
writes below it, whichever of them are deleted already. So results, headers,
state and merged documents of one age vanish together.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.dates import DAY_SECONDS
from docspark.schema import RETENTION_DAYS
from docspark.sources.tables import CLAIM, drop_parts, read_or_empty, replace_part

POINTER = T.StructType().add("pointer", "integer")


def live_from(spark: SparkSession, root: str) -> int:
    """The lowest write number that has not lapsed."""
    return read_or_empty(spark, f"{root}/retention", POINTER).agg(F.max("pointer")).first()[0] or 0


def lapse(spark: SparkSession, root: str, now: Column, days: int = RETENTION_DAYS) -> int:
    """Move the pointer up to the first write that is still alive.

    A write without a time does not lapse, and nothing does for `days` <= 0.
    """
    alive = F.col("at").isNull() | F.lit(days <= 0) | (F.col("at") + days * DAY_SECONDS > F.unix_timestamp(now))
    claims = read_or_empty(spark, f"{root}/claims", CLAIM)
    first, last = claims.agg(F.min(F.when(alive, F.col("number"))), F.max("number")).first()
    pointer = first if first is not None else (-1 if last is None else last) + 1
    before = live_from(spark, root)
    if pointer > before:
        row = spark.range(1).select(F.lit(pointer).alias("pointer"))
        replace_part(row.coalesce(1), f"{root}/retention", "at", pointer)
    return max(pointer, before)


def drop_below(spark: SparkSession, root: str, tables: dict[str, str], pointer: int, per_write: int = 1) -> None:
    """Delete the parts of writes below the pointer.

    `tables` maps each table's folder to the name of its part; a write has
    `per_write` numbers of its own there. Parts with other names stay.
    """
    for table, part in tables.items():
        drop_parts(
            spark, f"{root}/{table}", part, lambda v: v.isdigit() and int(v) // per_write < pointer
        )
