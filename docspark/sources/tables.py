"""Small helpers around stored tables."""

from __future__ import annotations

import random
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")
CLAIM = T.StructType().add("number", "integer").add("id", "string").add("at", "long")


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or no rows where nothing was written yet.

    The schema is given, not inferred, so that folder names such as 007 or
    2.10 stay text where their column is text.
    """
    try:
        stored = spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in MISSING:
            return spark.createDataFrame([], schema).limit(0)  # which the planner sees to be empty
        raise
    return stored.select(*schema.fieldNames())


def replace_part(df: DataFrame, path: str, part: str, number: int | str, *partitions: str) -> None:
    """Write rows as `part`=number, in place of all that this part held.

    A part written without rows is empty afterwards, whatever was there.
    """
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(*partitions)
        .parquet(f"{path}/{part}={number}")
    )


def kept_part(df: DataFrame, path: str, part: str, number: int | str) -> DataFrame:
    """Write rows as one part and read them back, which cuts their lineage."""
    replace_part(df, path, part, number)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{part}={number}")


def claim_number(spark: SparkSession, path: str, at: Column | None = None) -> int:
    """A write number above all that were claimed in this folder before, claimed at `at`.

    Numbers of callers may come again with other work, so they cannot name
    what is written. A claim is a row under its number with an id of its own;
    it holds if no other id is there once it is written. Of claims that meet,
    none holds, and each goes on to a higher number; what a claimant that died
    left behind is passed over.
    """
    number = -1
    while True:
        last = read_or_empty(spark, path, CLAIM).agg(F.max("number")).first()[0]
        number = max(number, -1 if last is None else last) + 1
        own = uuid.uuid4().hex
        at_seconds = F.lit(None) if at is None else F.unix_timestamp(at)
        claim = spark.range(1).select(
            F.lit(number).alias("number"), F.lit(own).alias("id"), at_seconds.cast("long").alias("at")
        )
        claim.coalesce(1).write.mode("append").parquet(f"{path}/claim={number}")
        ids = [r.id for r in read_or_empty(spark, f"{path}/claim={number}", CLAIM).collect()]
        if ids == [own]:
            return number
        number += random.randrange(len(ids) + 1)


def drop_parts(spark: SparkSession, path: str, part: str, lapsed: Callable[[str], bool]) -> list[str]:
    """Delete the folders `part`=value of a table whose value has lapsed, at any depth of partitions.

    Folders are listed, not files; a table that was never written has none.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    dropped, level = [], [root] if files.exists(root) else []
    while level:
        below = []
        for folder in level:
            for status in files.listStatus(folder):
                name = status.getPath().getName()
                if not status.isDirectory() or "=" not in name:
                    continue
                key, value = name.split("=", 1)
                if key != part:
                    below.append(status.getPath())
                elif lapsed(value):
                    files.delete(status.getPath(), True)
                    dropped.append(value)
        level = below
    return dropped
