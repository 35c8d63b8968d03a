"""Handing archived documents to an index service."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.dates import format_rfc3339
from docspark.functions.keys import sidecar_key, uri_for
from docspark.functions.outcomes import index_outcome
from docspark.operators.archive import not_yet_done
from docspark.schema import INDEX_RESPONSE, RESULT_TYPE, SCHEMA_VERSION

REQUEST = ("job_id", "tenant_id", "result_uri", "result_type", "schema_version")

REPLY = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
        *INDEX_RESPONSE.fields,
    ]
)

# Called with a frame of requests, returns a frame with the columns of REPLY.
Sender = Callable[[pd.DataFrame], pd.DataFrame]


def index_requests(inputs: DataFrame, manifests: DataFrame, jobs: DataFrame) -> DataFrame:
    """One request per (job_id, tenant_id) asked for, or the `error`.

    The job must exist and its manifest must name an archive and the same
    tenant.
    """
    known = jobs.select("job_id", F.lit(True).alias("_job"))
    found = manifests.select(
        "job_id",
        F.lit(True).alias("_manifest"),
        F.col("tenant_id").alias("_tenant"),
        F.coalesce("results.transactions", F.lit("")).alias("result_uri"),
        "archived_at",
    )
    joined = inputs.join(known, "job_id", "left").join(found, "job_id", "left")
    error = (
        F.when(F.col("job_id") == "", "empty job_id")
        .when(F.col("tenant_id") == "", "empty tenant_id")
        .when(F.col("_job").isNull(), "job not found")
        .when(F.col("_manifest").isNull(), "manifest not found")
        .when(F.col("result_uri") == "", "manifest has no archive uri")
        .when((F.col("_tenant") != "") & (F.col("_tenant") != F.col("tenant_id")), "tenant mismatch")
    )
    return joined.select(
        "job_id",
        "tenant_id",
        F.coalesce("result_uri", F.lit("")).alias("result_uri"),
        F.lit(RESULT_TYPE).alias("result_type"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.coalesce("archived_at", F.lit("")).alias("archived_at"),
        error.alias("error"),
    )


def pending_index(requests: DataFrame, sidecars: DataFrame) -> DataFrame:
    return not_yet_done(requests.filter(F.col("error").isNull()), sidecars)


def indexed_view(inputs: DataFrame, sidecars: DataFrame, bucket: str) -> DataFrame:
    """Replies stored before, for jobs that are asked for again."""
    stored = sidecars.select("job_id", "response.*")
    return inputs.select("job_id").join(stored, "job_id").select(
        "job_id",
        F.lit(False).alias("indexed"),
        "collection",
        "index_job_id",
        "vector_count",
        "embedding_model",
        "indexed_at",
        uri_for(bucket, sidecar_key(F.col("job_id"))).alias("sidecar_uri"),
    )


def send_requests(requests: DataFrame, send: Sender) -> DataFrame:
    """Requests with their replies and `outcome`.

    `send` runs in the tasks, one call per batch. Partitions bound how many
    calls run at once; repartition the requests to change that.
    """
    columns = [f.name for f in REPLY.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Two tenants may ask for one job; a reply belongs to each request of it.
            replies = send(batch[list(REQUEST)])[columns].drop_duplicates("job_id")
            out = batch.merge(replies, on="job_id", how="left")
            yield out

    schema = T.StructType(
        [*requests.select(*REQUEST, "archived_at").schema.fields, *REPLY.fields[1:]]
    )
    sent = requests.select(*REQUEST, "archived_at").mapInPandas(run, schema)
    return sent.withColumn(
        "outcome", F.coalesce(index_outcome(F.col("http_status")), F.lit("transient"))
    )


def build_sidecars(sent: DataFrame, now: Column) -> DataFrame:
    """Request and reply of each accepted request."""
    return sent.filter(F.col("outcome") == "ok").select(
        "job_id",
        "tenant_id",
        "result_uri",
        "archived_at",
        format_rfc3339(now).alias("indexed_at"),
        "schema_version",
        "result_type",
        F.struct(*[f.name for f in INDEX_RESPONSE.fields]).alias("response"),
        F.struct(*REQUEST).alias("request"),
    )
