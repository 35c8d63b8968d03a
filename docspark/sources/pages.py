"""Page results and documents: reading, typed decoding, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.keys import DOCUMENT_DEFAULT_TYPE, mime_from_uri
from docspark.schema import TRANSACTION_FIELDS
from docspark.sources.tables import read_or_empty

RESULT_PATH = r"/jobs/([^/]+)/pages/([0-9]+)/([^/]+)/([^/]+)/result\.json\z"

# Types of a page, keys in order, of which each has the wanted type or is absent.
CLEAN_ROW = rf"OBJECT<(?:(?:{'|'.join(sorted(TRANSACTION_FIELDS, reverse=True))}): (?:STRING|VOID)(?:, )?)*+>"
CLEAN_PAGE = (
    r"\AOBJECT<(?:document_type: (?:STRING|VOID)(?:, |(?=>)))?(?:fields: (?:VOID|OBJECT<[^<>]*+>)(?:, |(?=>)))?"
    rf"(?:text: (?:STRING|VOID)(?:, |(?=>)))?(?:transactions: (?:VOID|ARRAY<(?:VOID|{CLEAN_ROW})>))?>\z"
)

TYPED_ROWS = "array<struct<" + ",".join(f"{f}:string" for f in TRANSACTION_FIELDS) + ">>"
UNTYPED_ROWS = "array<struct<" + ",".join(f"{f}:variant" for f in TRANSACTION_FIELDS) + ">>"


def read_page_results(spark: SparkSession, root: str, stage: str, version: str) -> DataFrame:
    """JSON page results of one stage; the key parts come from the path.

    Files in folders that are no page number are not page results. The files
    are found by listing; `write_page_results` keeps a table that needs none.
    """
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return (
        spark.read.text(
            f"{root}/jobs/*/pages/*/{stage}/{version}/result.json", wholetext=True
        )
        .select(F.col("value").alias("body"), path.alias("_path"))
        .select(
            F.regexp_extract("_path", RESULT_PATH, 1).alias("job_id"),
            F.regexp_extract("_path", RESULT_PATH, 2).try_cast("int").alias("page"),
            F.regexp_extract("_path", RESULT_PATH, 3).alias("stage"),
            F.regexp_extract("_path", RESULT_PATH, 4).alias("version"),
            "body",
        )
        .filter(F.col("page").isNotNull())
    )


def read_documents(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Source files as (uri, mime, content)."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
        .select(
            F.col("path").alias("uri"),
            mime_from_uri(F.col("path"), DOCUMENT_DEFAULT_TYPE).alias("mime"),
            "content",
        )
    )


def _kind(value: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def _is(kind: Column, wanted: str) -> Column:
    """Absent, null or of the wanted type."""
    return kind.isNull() | (kind == "VOID") | kind.startswith(wanted)


def decode_pages(df: DataFrame, body: str = "body") -> DataFrame:
    """Typed page columns from JSON text, with `error` NULL on good pages.

    One value of a wrong type fails its whole page. Unknown keys are ignored;
    of a repeated key the last value counts.
    """
    kept = [c for c in df.columns if c != body]
    # The exploded one-element array keeps filters on the results from
    # repeating the parse.
    parsed = df.select(
        *kept,
        F.explode(F.array(F.try_parse_json(F.col(body)))).alias("_page"),
    )
    page = F.col("_page")
    # Most pages show by the types of all their values at once that nothing is
    # wrong; only the others are looked at value by value.
    whole = F.schema_of_variant(page)
    clean = whole.rlike(CLEAN_PAGE)
    row_kinds = _kind(page, "$.transactions")
    plain = row_kinds.isNull() | row_kinds.rlike(r"\A(?:VOID|ARRAY<(?:VOID|OBJECT<.*>)>)\z")
    exact = F.schema_of_variant(
        F.to_variant_object(F.try_variant_get(page, "$.transactions", UNTYPED_ROWS))
    )
    # Kinds of the known keys are looked at one by one only where some value
    # of the rows, known or not, is no text.
    odd = row_kinds.rlike(": (?!STRING|VOID)")
    bad_rows = ~plain | (odd & F.coalesce(exact.rlike(": (?!STRING|VOID)"), F.lit(True)))
    error = (
        F.when(clean, F.lit(None).cast("string"))
        .when(page.isNull(), "not valid JSON")
        .when(~_is(whole, "OBJECT"), "page is not an object")
        .when(~_is(_kind(page, "$.text"), "STRING"), "text is not a string")
        .when(~_is(_kind(page, "$.document_type"), "STRING"), "document_type is not a string")
        .when(~_is(_kind(page, "$.fields"), "OBJECT"), "fields is not an object")
        .when(bad_rows, "transactions have a wrong type")
    )
    return parsed.select(
        *kept,
        F.coalesce(F.try_variant_get(page, "$.text", "string"), F.lit("")).alias("text"),
        F.coalesce(F.try_variant_get(page, "$.document_type", "string"), F.lit("")).alias(
            "document_type"
        ),
        F.try_variant_get(page, "$.fields", "variant").alias("fields"),
        F.try_variant_get(page, "$.transactions", TYPED_ROWS).alias("transactions"),
        error.alias("error"),
    )


def good_pages(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("error").isNull()).drop("error")


def failed_pages(decoded: DataFrame) -> DataFrame:
    """(job_id, page, error) of the pages that could not be read."""
    return decoded.filter(F.col("error").isNotNull()).select("job_id", "page", "error")


RESULT_KEY = T.StructType(
    [T.StructField("stage", T.StringType()), T.StructField("version", T.StringType()), T.StructField("run", T.IntegerType())]
)


def write_page_results(df: DataFrame, root: str, run: int) -> None:
    """Store stage results; repeating a run replaces what it wrote before.

    `df` has stage and version columns. Rows of other runs stay; readers take
    the newest run of a page. The table is also the catalogue of what there
    is: readers go to the folders of one stage and version and list no page.
    """
    (
        df.withColumn("run", F.lit(run))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("stage", "version", "run")
        .parquet(root)
    )


def latest_page_results(
    spark: SparkSession, root: str, stage: str, version: str, schema: T.StructType | None = None
) -> DataFrame:
    """Stored rows of one stage, of each page's newest run only.

    `schema` is that of the rows without stage, version and run; if not given
    it is taken from the files. Stage and version stay text, whatever they
    look like.
    """
    place = RESULT_KEY.fieldNames()
    if schema is None:
        schema = spark.read.parquet(root).schema
    fields = [f for f in schema.fields if f.name not in place]
    rows = read_or_empty(spark, root, T.StructType([*fields, *RESULT_KEY.fields]))
    stored = rows.filter((F.col("stage") == stage) & (F.col("version") == version))
    newest = stored.groupBy("job_id", "page").agg(F.max("run").alias("run"))
    return stored.join(newest, ["job_id", "page", "run"], "left_semi").drop("run")
