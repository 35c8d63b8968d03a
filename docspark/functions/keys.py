"""Keys and URIs of state rows and stored objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Content type by lower-case extension.
CONTENT_TYPES = {
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".webp": "image/webp",
    ".pdf": "application/pdf",
}
PAGE_DEFAULT_TYPE = "image/png"
DOCUMENT_DEFAULT_TYPE = "application/octet-stream"

# Fixed value: characters a tenant id may use.
TENANT = r"\A[a-zA-Z0-9_\-]+\z"

URI = r"\As3://([^/]+)/(.+)\z"


def padded_page(page: Column) -> Column:
    """Six digits at least; longer numbers keep all their digits."""
    text = page.cast("string")
    return F.lpad(text, F.greatest(F.lit(6), F.length(text)), F.lit("0"))


def stage_key(job_id: Column, page: Column, stage: Column, version: Column) -> Column:
    colon = F.lit(":")
    tail = F.concat(colon, stage, colon, version)
    return F.when(page > 0, F.concat(job_id, F.lit(":page:"), padded_page(page), tail)).otherwise(
        F.concat(job_id, tail)
    )


def page_key(job_id: Column, page: Column, stage: Column, version: Column) -> Column:
    return F.concat(
        F.lit("jobs/"), job_id, F.lit("/pages/"), padded_page(page), F.lit("/"),
        stage, F.lit("/"), version, F.lit("/result.json"),
    )


def merged_key(job_id: Column) -> Column:
    return F.concat(F.lit("jobs/"), job_id, F.lit("/merged/v1/result.json"))


def archive_key(tenant: Column, year: Column, month: Column, slug: Column) -> Column:
    return F.concat(
        F.lit("results/transactions/tenant="), tenant, F.lit("/year="), year,
        F.lit("/month="), month, F.lit("/"), slug, F.lit(".json"),
    )


def raw_key(issuer: Column, year: Column, month: Column) -> Column:
    return F.concat(
        F.lit("raw/card-statements/"), issuer, F.lit("/"), year, F.lit("/"), month,
        F.lit("/original.pdf"),
    )


def manifest_key(job_id: Column) -> Column:
    return F.concat(F.lit("manifests/jobs/"), job_id, F.lit(".json"))


def sidecar_key(job_id: Column) -> Column:
    return F.concat(F.lit("index/jobs/"), job_id, F.lit(".json"))


def uri_for(bucket: str, key: Column) -> Column:
    return F.concat(F.lit(f"s3://{bucket}/"), key)


def parse_uri(uri: Column) -> tuple[Column, Column]:
    """(bucket, key); both NULL unless the URI names a bucket and a key."""
    empty = F.lit("")
    return (
        F.nullif(F.regexp_extract(uri, URI, 1), empty),
        F.nullif(F.regexp_extract(uri, URI, 2), empty),
    )


def mime_from_uri(uri: Column, default: str = PAGE_DEFAULT_TYPE) -> Column:
    extension = F.lower(F.regexp_extract(uri, r"\.[^./]*\z", 0))
    out = F.lit(default)
    for ext, kind in CONTENT_TYPES.items():
        out = F.when(extension == ext, kind).otherwise(out)
    return out


def tenant_safe(c: Column) -> Column:
    return c.rlike(TENANT)
