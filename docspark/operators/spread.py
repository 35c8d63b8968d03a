"""Joins and ranks that stay even when one job owns most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.schema import PAGES_PER_BLOCK

# A side of at most this many rows (names, a code, a few labels each) may be
# broadcast; callers pass the row count they know.
BROADCAST_ROWS = 200_000
SALTS = 32


def page_block(page: Column) -> Column:
    return F.floor(page / PAGES_PER_BLOCK).cast("int")


def join_per_job(
    rows: DataFrame,
    per_job: DataFrame,
    how: str = "inner",
    max_page: str = "max_page",
) -> DataFrame:
    """Join page-level rows with one row per job.

    The job's row is repeated once per block of pages it owns (known from
    its highest page number), and the join runs on job and block.
    """
    side = per_job.withColumn(
        "_block",
        F.explode(F.sequence(F.lit(0), page_block(F.greatest(F.col(max_page), F.lit(0))))),
    ).drop(max_page)
    keyed = rows.withColumn("_block", page_block(F.col("page")))
    return keyed.join(side, ["job_id", "_block"], how).drop("_block")


def left_join_lookup(
    rows: DataFrame, lookup: DataFrame, lookup_rows: int, key: str, spread_by: Sequence[str]
) -> DataFrame:
    """Left join on `key`, by broadcast while the lookup is small.

    Beyond the bound the lookup is repeated per salt and the rows carry a
    salt from `spread_by`, so a frequent key is split over `SALTS` tasks.
    """
    if lookup_rows <= BROADCAST_ROWS:
        return rows.join(F.broadcast(lookup), key, "left")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")


def with_content(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows with the `content` of the document at their `uri`, NULL where there is none.

    The bytes stay where they are read: the rows, a uri and a few labels each,
    go to the documents, as long as there are few enough to be broadcast. Rows
    without a document are found by the uris alone.
    """
    docs = documents.select("uri", "content")
    if rows.count() > BROADCAST_ROWS:
        return rows.join(docs, "uri", "left")
    found = docs.join(F.broadcast(rows), "uri")
    missing = rows.join(documents.select("uri"), "uri", "left_anti")
    return found.unionByName(missing.withColumn("content", F.lit(None).cast("binary")))


def rank_in_group(
    df: DataFrame, group: str, order: str, name: str, width: int = 1 << 16
) -> DataFrame:
    """1-based rank of each row inside its group by a whole-number column.

    Rows are ranked inside stretches of `width` order values and shifted by
    the sizes of the stretches before, in two levels, so no window holds a
    whole group. Equal order values are ranked in any order.
    """
    far, near = "_far", "_near"
    cut = df.withColumn(near, F.floor(F.col(order) / width)).withColumn(
        far, F.floor(F.col(near) / width)
    )
    sizes = cut.groupBy(group, far, near).agg(F.count("*").alias("_n"))
    before = Window.orderBy(near).rowsBetween(Window.unboundedPreceding, -1)
    near_shift = sizes.withColumn(
        "_near_shift",
        F.coalesce(F.sum("_n").over(before.partitionBy(group, far)), F.lit(0)),
    )
    far_before = (
        Window.partitionBy(group).orderBy(far).rowsBetween(Window.unboundedPreceding, -1)
    )
    far_shift = (
        sizes.groupBy(group, far)
        .agg(F.sum("_n").alias("_m"))
        .withColumn("_far_shift", F.coalesce(F.sum("_m").over(far_before), F.lit(0)))
        .drop("_m")
    )
    shifts = near_shift.join(far_shift, [group, far]).select(
        group, near, (F.col("_near_shift") + F.col("_far_shift")).alias("_shift")
    )
    inside = Window.partitionBy(group, near).orderBy(order)
    return (
        cut.withColumn("_rank", F.row_number().over(inside))
        .join(shifts, [group, near])
        .withColumn(name, (F.col("_rank") + F.col("_shift")).cast("int"))
        .drop(far, near, "_rank", "_shift")
    )
