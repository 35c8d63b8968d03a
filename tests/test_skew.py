"""One job holds a third of the rows; results stay whole and spread out."""

from pyspark.sql import functions as F

from docspark.operators.pages import number_pages
from docspark.operators.spread import join_per_job
from docspark.operators.state import latest_state
from docspark.schema import STAGE_LOG

ROWS = 90_000
HOT = ROWS // 3


def job_column():
    return F.when(F.col("id") < HOT, "hot").otherwise(F.concat(F.lit("job_"), (F.col("id") % 20_000).cast("string")))


def test_numbering_of_a_long_job(spark):
    files = spark.range(ROWS).select(
        job_column().alias("job_id"), F.concat(F.lit("input_"), F.col("id") * 3 + 1).alias("name"), "id"
    )
    got = number_pages(files).cache()
    assert got.count() == ROWS
    assert got.filter("job_id = 'hot' AND page != id + 1").count() == 0
    assert got.groupBy("job_id").agg((F.max("page") != F.count("*")).alias("bad")).filter("bad").count() == 0
    got.unpersist()


def test_join_of_a_long_job_uses_several_tasks(spark):
    rows = spark.range(ROWS).select(
        job_column().alias("job_id"), F.when(F.col("id") < HOT, F.col("id") + 1).otherwise(1).cast("int").alias("page")
    )
    side = rows.groupBy("job_id").agg(F.max("page").alias("max_page")).withColumn("v", F.lit(1))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = join_per_job(rows, side).withColumn("task", F.spark_partition_id())
        tasks = got.filter("job_id = 'hot'").groupBy("task").count().collect()
        assert sum(r["count"] for r in tasks) == HOT
        assert len(tasks) >= 4
        assert got.count() == ROWS
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_newest_row_of_a_busy_key(spark):
    values = {"job_id": F.when(F.col("id") < HOT, "hot").otherwise(F.col("id").cast("string")), "page": F.lit(1),
              "ts": F.timestamp_seconds(F.col("id") % 1000), "seq": F.col("id"), "expires_at": F.lit(0)}
    log = spark.range(ROWS).select(
        *[values.get(f.name, F.lit("x")).cast(f.dataType).alias(f.name) for f in STAGE_LOG.fields]
    )
    got = latest_state(log)
    assert got.count() == ROWS - HOT + 1
    last = got.filter("job_id = 'hot'").first()
    assert last.seq == HOT - 1
