"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import docspark
from docspark.session import work_dir

# Functions of this package travel to the tasks whole: executors need no copy.
cloudpickle.register_pickle_by_value(docspark)

SPLIT_SETTINGS = (
    "spark.sql.files.maxPartitionBytes",
    "spark.sql.files.openCostInBytes",
    "spark.sql.files.minPartitionNum",
    "spark.sql.files.maxPartitionNum",
)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows under the shared checkpoint folder and read them back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Splits:
    """Holds how files are cut into partitions, for operators that read a table again.

    Unless it is set, Spark takes the number of partitions from the cores it
    has just then, so a lost or a new executor would deal the rows anew.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.values = {k: spark.conf.get(k, None) for k in SPLIT_SETTINGS}
        least = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
        if self.values["spark.sql.files.minPartitionNum"] is None:
            self.values["spark.sql.files.minPartitionNum"] = str(least)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """As `stored`, with files cut as they were when this was made."""
        before = {k: self.spark.conf.get(k, None) for k in SPLIT_SETTINGS}
        self._set(self.values)
        try:
            return stored(df, name)
        finally:
            self._set(before)

    def _set(self, values: dict[str, str | None]) -> None:
        for k, v in values.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one if a column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; `lower` does it where the text is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def fold(doc_id: Column, parts: int) -> Column:
    """The remainder that tells training documents from held-out ones."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def salted_rank(df: DataFrame, key: str, order: str, rank: str, rows: int) -> DataFrame:
    """Number the rows of each key from 0, with no window over a whole key.

    Rows of a key are dealt over salts by a hash of `order`, which is unique;
    a window numbers each (key, salt), and sums of the few counts per key give
    where each salt begins. `rows`: about how many rows there are, which sets
    the number of salts so that a window holds some hundred thousand at most.
    """
    from pyspark.sql import Window

    salts = max(64, rows // 200_000)
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    starts = (
        dealt.groupBy(key, "_salt")
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_from",
            F.sum("_n").over(
                Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select(F.col(key).alias("_key"), F.col("_salt").alias("_at"), F.coalesce("_from", F.lit(0)).alias("_from"))
    )
    within = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(order)) - 1
    return (
        dealt.withColumn("_i", within)
        .join(starts, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_at")))
        .withColumn(rank, F.col("_i") + F.col("_from"))
        .drop("_salt", "_i", "_key", "_at", "_from")
    )
