"""Flattening merged jobs into the permanent archive.

A document of the archive is a header row, its header fields as rows and its
transactions as rows in (page, pos) order, laid out by tenant, year, month.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.dates import format_rfc3339, year_month
from docspark.functions.keys import archive_key, manifest_key, raw_key, tenant_safe, uri_for
from docspark.functions.text import card_slug, issuer_slug
from docspark.functions.variants import is_empty_value, text_value
from docspark.operators.spread import join_per_job, with_content
from docspark.schema import SOURCE_KIND
from docspark.sources.tables import drop_parts, kept_part, read_or_empty, replace_part

# Header fields the archive layout is built from.
ISSUER_KEYS = ("issuer_name", "issuer")
CARD_KEYS = ("card_name", "card")
DATE_KEYS = ("statement_date",)

PARTITIONS = ("tenant", "year", "month")


def flatten_fields(pages: DataFrame) -> DataFrame:
    """First non-empty value of each header field of a job, as JSON text."""
    spark = pages.sparkSession
    cells = pages.select("job_id", "page", "fields").lateralJoin(
        spark.tvf.variant_explode(F.col("fields").outer())
    )
    filled = cells.filter(~is_empty_value(F.col("value"))).select(
        "job_id", "page", "key", F.to_json("value").alias("value")
    )
    return filled.groupBy("job_id", "key").agg(F.min_by("value", "page").alias("value"))


def document_headers(pages: DataFrame) -> DataFrame:
    """Per job: first document type, issuer, card name and statement date.

    A field's first non-empty value counts even if it is no text, and is then
    passed over, as a number is no name. One aggregation for all of them.
    """
    names = [*ISSUER_KEYS, *CARD_KEYS, *DATE_KEYS]
    page = F.col("page")
    values = pages.select(
        "job_id",
        "page",
        "document_type",
        *[F.try_variant_get("fields", f"$['{n}']", "variant").alias(n) for n in names],
    )
    cells = values.select(
        "job_id",
        "page",
        "document_type",
        *[is_empty_value(F.col(n)).alias(f"{n}_empty") for n in names],
        *[text_value(F.col(n)).alias(n) for n in names],
    )
    firsts = cells.groupBy("job_id").agg(
        F.min_by("document_type", F.when(F.col("document_type") != "", page)).alias("document_type"),
        F.max("page").alias("max_page"),
        *[F.min_by(n, F.when(~F.col(f"{n}_empty"), page)).alias(n) for n in names],
    )
    empty = F.lit("")
    return firsts.select(
        "job_id",
        F.coalesce("document_type", empty).alias("document_type"),
        "max_page",
        F.coalesce(*ISSUER_KEYS, empty).alias("issuer"),
        F.coalesce(*CARD_KEYS, empty).alias("card_name"),
        F.coalesce(*DATE_KEYS, empty).alias("statement_date"),
    )


def archive_targets(
    headers: DataFrame, jobs: DataFrame, now: Column, bucket: str
) -> DataFrame:
    """Where each job's document goes, with `error` on jobs that cannot go.

    `jobs` are job rows with a tenant_id. A job without an input has no raw
    copy.
    """
    joined = jobs.join(headers, "job_id", "left").fillna(
        {"document_type": "", "issuer": "", "card_name": "", "statement_date": "", "max_page": 0}
    )
    year, month = year_month(F.col("statement_date"), now)
    error = (
        F.when(F.col("tenant_id") == "", "empty tenant_id")
        .when(~tenant_safe(F.col("tenant_id")), "tenant_id may hold letters, digits, - and _ only")
        .when(F.col("result_uri") == "", "nothing was merged for the job")
    )
    placed = (
        joined.withColumn("tenant", F.col("tenant_id"))
        .withColumn("year", year)
        .withColumn("month", month)
        .withColumn("issuer_slug", issuer_slug(F.col("issuer")))
        .withColumn("card_slug", card_slug(F.col("issuer_slug"), F.col("card_name"), F.col("job_id")))
    )
    return placed.select(
        "job_id",
        *PARTITIONS,
        "issuer_slug",
        "card_slug",
        "document_type",
        "issuer",
        "card_name",
        "chain_id",
        "chain",
        "input_uri",
        "max_page",
        uri_for(bucket, archive_key(F.col("tenant"), F.col("year"), F.col("month"), F.col("card_slug"))).alias(
            "archive_uri"
        ),
        F.when(
            F.col("input_uri") != "",
            uri_for(bucket, raw_key(F.col("issuer_slug"), F.col("year"), F.col("month"))),
        )
        .otherwise("")
        .alias("raw_uri"),
        uri_for(bucket, manifest_key(F.col("job_id"))).alias("manifest_uri"),
        error.alias("error"),
    )


def not_yet_done(df: DataFrame, markers: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows whose marker does not exist yet."""
    return df.join(markers.select(key), key, "left_anti")


def pending_archives(targets: DataFrame, manifests: DataFrame) -> DataFrame:
    return not_yet_done(targets.filter(F.col("error").isNull()), manifests)


def archived_view(targets: DataFrame, manifests: DataFrame) -> DataFrame:
    """Jobs archived before: their stored URIs, not the ones of today."""
    stored = manifests.select(
        "job_id",
        F.col("results.transactions").alias("archive_uri"),
        F.col("source.raw_uri").alias("raw_uri"),
    )
    return (
        targets.filter(F.col("error").isNull())
        .select("job_id", "manifest_uri")
        .join(stored, "job_id")
        .select("job_id", F.lit(False).alias("archived"), "archive_uri", "raw_uri", "manifest_uri")
    )


def build_manifests(targets: DataFrame, now: Column) -> DataFrame:
    return targets.select(
        "job_id",
        F.col("tenant").alias("tenant_id"),
        F.struct(
            F.lit(SOURCE_KIND).alias("kind"), "issuer", "card_name", "raw_uri"
        ).alias("source"),
        F.struct(F.col("archive_uri").alias("transactions")).alias("results"),
        F.struct(
            F.col("chain_id").alias("id"),
            F.transform("chain", lambda s: s["name"]).alias("stages"),
        ).alias("chain"),
        format_rfc3339(now).alias("archived_at"),
    )


def archive_winners(targets: DataFrame, written: str | None = None) -> DataFrame:
    """Of jobs that share one archive key, the one written last.

    `written` names the column of the write time; equal times fall to the
    higher job id. Folded as an aggregate, as one card may own many jobs.
    """
    order = F.struct(written, "job_id") if written else F.struct("job_id")
    return targets.groupBy("archive_uri").agg(
        F.max_by("job_id", order).alias("job_id"), F.count("*").alias("jobs")
    )


def archived_transactions(tx: DataFrame, targets: DataFrame) -> DataFrame:
    """Transactions with the partition and card they are stored under."""
    side = targets.select("job_id", *PARTITIONS, "card_slug", "max_page")
    return join_per_job(tx, side)


MANIFEST = (
    T.StructType()
    .add("job_id", "string")
    .add("tenant_id", "string")
    .add(
        "source",
        T.StructType()
        .add("kind", "string")
        .add("issuer", "string")
        .add("card_name", "string")
        .add("raw_uri", "string"),
    )
    .add("results", T.StructType().add("transactions", "string"))
    .add(
        "chain",
        T.StructType()
        .add("id", "string")
        .add("stages", T.ArrayType(T.StringType())),
    )
    .add("archived_at", "string")
)
STORED_MANIFEST = T.StructType([*MANIFEST.fields, T.StructField("run", T.IntegerType())])
POINTER = (
    T.StructType()
    .add("archive_uri", "string")
    .add("tenant_id", "string")
    .add("archived_at", "string")
    .add("run", "integer")
    .add("job_id", "string")
)
SNAPSHOT = T.StructType([*POINTER.fields, T.StructField("upto", T.IntegerType())])
FOLDED = T.StructType().add("folded", "integer").add("upto", "integer")
TABLES = ("documents", "fields", "transactions")


@dataclass(frozen=True)
class ArchiveRoots:
    """Folders of the tables an archive run writes."""

    root: str

    @property
    def transactions(self) -> str:
        return f"{self.root}/results/transactions"

    @property
    def fields(self) -> str:
        return f"{self.root}/results/fields"

    @property
    def documents(self) -> str:
        return f"{self.root}/results/documents"

    @property
    def raw(self) -> str:
        return f"{self.root}/raw/card-statements"

    @property
    def manifests(self) -> str:
        return f"{self.root}/manifests"

    @property
    def snapshots(self) -> str:
        return f"{self.root}/snapshots/pointers"

    @property
    def folded(self) -> str:
        return f"{self.root}/snapshots/folded"

    @property
    def sidecars(self) -> str:
        return f"{self.root}/index"


def _placed(rows: DataFrame, *place: str) -> DataFrame:
    """Rows of one folder in few tasks, those of a large one in several."""
    return rows.hint("rebalance", *place)


def write_archive(
    targets: DataFrame, tx: DataFrame, fields: DataFrame, roots: ArchiveRoots, run: int
) -> None:
    """Write headers, header fields and transactions of the targets.

    None of it is read before a manifest of the same run vouches for it.
    """
    headers = targets.select(*PARTITIONS, "job_id", "issuer_slug", "card_slug", "document_type", "archive_uri")
    replace_part(_placed(headers, *PARTITIONS), roots.documents, "run", run, *PARTITIONS)
    side = targets.select("job_id", *PARTITIONS, "card_slug")
    replace_part(_placed(fields.join(side, "job_id"), *PARTITIONS), roots.fields, "run", run, *PARTITIONS)
    rows = archived_transactions(tx, targets)
    replace_part(_placed(rows, *PARTITIONS), roots.transactions, "run", run, *PARTITIONS)


def write_raw_catalog(targets: DataFrame, documents: DataFrame, roots: ArchiveRoots, run: int) -> None:
    """Copy source bytes by issuer and month; jobs without an input are skipped."""
    wanted = targets.filter(F.col("input_uri") != "").select(
        "job_id", "issuer_slug", "year", "month", F.col("input_uri").alias("uri")
    )
    copied = with_content(wanted, documents).filter(F.col("content").isNotNull())
    replace_part(copied, roots.raw, "run", run, "issuer_slug", "year", "month")


def write_manifests(manifests: DataFrame, roots: ArchiveRoots, run: int) -> None:
    """The markers; to be written only after the bodies."""
    replace_part(manifests, roots.manifests, "run", run)


def _newest(pointers: DataFrame) -> DataFrame:
    """Of the documents under one archive key, the one archived last."""
    last = F.max(F.struct("archived_at", "run", "job_id", "tenant_id")).alias("_last")
    return pointers.groupBy("archive_uri").agg(last).select("archive_uri", "_last.*").select(*POINTER.fieldNames())


def current_documents(spark: SparkSession, roots: ArchiveRoots) -> DataFrame:
    """Per archive key the document that counts: who wrote it, in which run, when.

    Manifests alone make documents current, as they are written last; a run cut
    short before them leaves all as it was. Of manifests that the newest
    snapshot has folded, the snapshot's pointers stand.
    """
    manifests = read_or_empty(spark, roots.manifests, STORED_MANIFEST)
    folded = read_or_empty(spark, roots.folded, FOLDED)
    upto = folded.agg(F.max("upto")).first()[0]
    if upto is not None:
        runs = folded.filter(F.col("upto") == upto).select(F.col("folded").alias("run"))
        manifests = manifests.join(runs, "run", "left_anti")
    pointers = manifests.filter(F.col("results.transactions") != "").select(
        F.col("results.transactions").alias("archive_uri"), "tenant_id", "archived_at", "run", "job_id"
    )
    if upto is not None:
        base = read_or_empty(spark, roots.snapshots, SNAPSHOT).filter(F.col("upto") == upto).drop("upto")
        pointers = pointers.unionByName(base)
    return _newest(pointers)


def read_current_archive(spark: SparkSession, roots: ArchiveRoots, table: str, tenant: str | None = None) -> DataFrame:
    """Rows of the documents that are current under their archive key, of one tenant or of all.

    A document is current as one run wrote it: rows that an earlier run left
    behind, of the same job or another one, are not read. For one tenant only
    the folders of that tenant, in the runs that hold its documents, are read.
    """
    current = current_documents(spark, roots)
    rows = _partitioned(spark, getattr(roots, table))
    if tenant is not None:
        current = current.filter(F.col("tenant_id") == tenant)
        runs = [r.run for r in current.select("run").distinct().collect()]
        rows = rows.filter((F.col("tenant") == tenant) & F.col("run").isin(runs))
    return rows.join(current.select("job_id", "run"), ["job_id", "run"], "left_semi")


def compact_archive(spark: SparkSession, roots: ArchiveRoots, number: int) -> None:
    """Write all current documents as one run, and a snapshot that points there.

    `number` is a write number claimed for this. The list of the runs that
    were folded comes last: until it is there readers follow the manifests,
    and manifests of other runs count beside it. Superseded rows stay until
    `drop_superseded`.
    """
    manifests = read_or_empty(spark, roots.manifests, STORED_MANIFEST)
    before = read_or_empty(spark, roots.folded, FOLDED)
    runs = manifests.select("run").union(before.select("folded")).union(before.select("upto")).distinct()
    runs = kept_part(runs.toDF("folded"), f"{roots.root}/snapshots/runs", "upto", number)
    # A manifest that comes meanwhile is left for the next time.
    current = current_documents(spark, roots).join(runs, F.col("run") == F.col("folded"), "left_semi")
    current = kept_part(current, f"{roots.root}/snapshots/current", "upto", number)
    for table in TABLES:
        path = getattr(roots, table)
        rows = _partitioned(spark, path).join(current.select("job_id", "run"), ["job_id", "run"], "left_semi")
        replace_part(_placed(rows.drop("run"), *PARTITIONS), path, "run", number, *PARTITIONS)
    replace_part(current.withColumn("run", F.lit(number)), roots.snapshots, "upto", number)
    replace_part(runs, roots.folded, "upto", number)


def drop_superseded(spark: SparkSession, roots: ArchiveRoots) -> None:
    """Delete the rows of folded runs, once nobody reads by an older snapshot any more."""
    folded = read_or_empty(spark, roots.folded, FOLDED)
    upto = folded.agg(F.max("upto")).first()[0]
    runs = {str(r.folded) for r in folded.filter(F.col("upto") == upto).collect()}
    for table in TABLES:
        drop_parts(spark, getattr(roots, table), "run", lambda v: v in runs)
    drop_parts(spark, roots.snapshots, "upto", lambda v: v in runs)


def _partitioned(spark: SparkSession, path: str) -> DataFrame:
    """A table whose partition columns are text, but for the run's number."""
    inferred = spark.read.parquet(path).schema
    text = (*PARTITIONS, "issuer_slug")
    fields = [T.StructField(f.name, T.StringType()) if f.name in text else f for f in inferred.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)
