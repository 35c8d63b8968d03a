"""Joining the page results of finished jobs into documents.

A merged document is one header row per job plus its page rows, ordered by
page. The pages of a job are never gathered into one value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions.keys import merged_key, uri_for
from docspark.operators.spread import join_per_job
from docspark.schema import SUCCEEDED

KEY = ["job_id", "page"]


@dataclass(frozen=True)
class Merged:
    documents: DataFrame  # job_id, page_count, result_uri
    pages: DataFrame  # job_id, page, result
    rejects: DataFrame  # job_id, error


def _checked(records: DataFrame, bodies: DataFrame) -> DataFrame:
    """Final-stage records with their bodies and what is wrong with each."""
    page = F.col("page").cast("string")
    error = (
        F.when(
            F.col("status") != SUCCEEDED,
            F.concat(F.lit("page "), page, F.lit(" has status "), "status"),
        )
        .when(F.col("result_uri") == "", F.concat(F.lit("page "), page, F.lit(" has no result_uri")))
        .when(F.col("_has").isNull(), F.concat(F.lit("page "), page, F.lit(" has no stored result")))
    )
    have = bodies.select(*KEY, "result", F.lit(True).alias("_has"))
    return records.join(have, KEY, "left").select(
        *KEY, "result", error.alias("page_error")
    )


def merge_verdicts(jobs: DataFrame, checked: DataFrame) -> DataFrame:
    """Per job: number of page records and the first thing that is wrong."""
    found = checked.groupBy("job_id").agg(
        F.count("*").alias("records"),
        F.max("page").alias("max_page"),
        F.min_by("page_error", F.when(F.col("page_error").isNotNull(), F.col("page"))).alias(
            "first_error"
        ),
    )
    joined = jobs.select("job_id", "page_count").join(found, "job_id", "left")
    records = F.coalesce("records", F.lit(0).cast("long"))
    short = (F.col("page_count") > 0) & (records < F.col("page_count"))
    return joined.select(
        "job_id",
        records.cast("int").alias("records"),
        F.coalesce("max_page", F.lit(0)).alias("max_page"),
        F.when(
            short,
            F.concat(
                F.lit("only "), records.cast("string"), F.lit(" of "),
                F.col("page_count").cast("string"), F.lit(" pages were recorded by the last stage"),
            ),
        )
        .otherwise(F.col("first_error"))
        .alias("error"),
    )


def merge_jobs(jobs: DataFrame, records: DataFrame, bodies: DataFrame, bucket: str) -> Merged:
    """Merge the jobs given, each with its `page_count`.

    `records` are the page records of the final stage, `bodies` its stored
    results (job_id, page, result).
    """
    checked = _checked(records, bodies)
    verdicts = merge_verdicts(jobs, checked)
    accepted = verdicts.filter(F.col("error").isNull())
    documents = accepted.select(
        "job_id",
        F.col("records").alias("page_count"),
        uri_for(bucket, merged_key(F.col("job_id"))).alias("result_uri"),
    )
    pages = join_per_job(checked, accepted.select("job_id", "max_page")).select(*KEY, "result")
    return Merged(documents, pages, verdicts.filter(F.col("error").isNotNull()).select("job_id", "error"))


def write_merged(merged: Merged, root: str, as_json: bool = False) -> None:
    """Store page rows sorted by job and page, then the header rows.

    Sorting is by range, so one long job fills several files in page order.
    """
    pages = merged.pages.repartitionByRange("job_id", "page").sortWithinPartitions("job_id", "page")
    for name, df in (("pages", pages), ("documents", merged.documents)):
        writer = df.write.mode("overwrite")
        writer.json(f"{root}/{name}") if as_json else writer.parquet(f"{root}/{name}")
