"""Answers for callers: gated results, one job or all of them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators.rollup import aggregate, aggregate_rows, resolve_filter
from docspark.operators.spread import join_per_job
from docspark.schema import FAILED, SUCCEEDED, JobFailed, JobNotReady, NotFound
from docspark.sources.pages import decode_pages


def result_gate(jobs: DataFrame) -> DataFrame:
    """Add `gate`: NULL where a result may be read, else the error kind."""
    ready = (F.col("status") == SUCCEEDED) & (F.col("result_uri") != "")
    return jobs.withColumn(
        "gate",
        F.when(F.col("status") == FAILED, "job_failed").when(~ready, "job_not_ready"),
    )


def read_merged(jobs: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page rows of readable jobs, refused jobs with kind and message).

    `pages` are stored merged pages (job_id, page, result).
    """
    gated = result_gate(jobs)
    # Pages may be numbered beyond the job's page count.
    last = pages.groupBy("job_id").agg(F.max("page").alias("max_page"))
    open_jobs = gated.filter(F.col("gate").isNull()).select("job_id").join(last, "job_id")
    message = F.when(F.col("gate") == "job_failed", F.col("error")).otherwise(
        F.concat(F.lit("no result while the job is "), F.col("status"))
    )
    refused = gated.filter(F.col("gate").isNotNull()).select(
        "job_id", F.col("gate").alias("kind"), message.alias("message")
    )
    return join_per_job(pages, open_jobs), refused


def job_result(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Typed pages of all readable jobs, `error` set on unreadable ones."""
    rows, _ = read_merged(jobs, pages)
    return decode_pages(rows, "result")


def require_ready(jobs: DataFrame, job_id: str) -> None:
    """Raise unless the one job named has a result to read."""
    row = result_gate(jobs.filter(F.col("job_id") == job_id)).select("gate", "status", "error").first()
    if row is None:
        raise NotFound(f"job {job_id!r} does not exist")
    if row["gate"] == "job_failed":
        raise JobFailed(row["error"])
    if row["gate"] == "job_not_ready":
        raise JobNotReady(f"no result while job {job_id!r} is {row['status']}")


def aggregate_job(
    jobs: DataFrame, tx: DataFrame, job_id: str, params: Mapping[str, str]
) -> tuple[DataFrame, DataFrame]:
    """(total, breakdown) of one job for a one-filter request."""
    key, value = resolve_filter(params)
    require_ready(jobs, job_id)
    own = tx.filter(F.col("job_id") == job_id)
    one = jobs.filter(F.col("job_id") == job_id)
    return aggregate(own, key, value, jobs=one), aggregate_rows(own, key, value)
