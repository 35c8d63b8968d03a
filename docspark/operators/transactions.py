"""Flat transaction rows and the two built-in cleaning stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions.amounts import amount_is_zero
from docspark.functions.text import (
    canonical_issuer,
    fill_category,
    fill_country,
    normalise_alias,
)
from docspark.functions.variants import string_field
from docspark.operators.spread import left_join_lookup
from docspark.schema import TRANSACTION_FIELDS
from docspark.sources.dictionary import Dictionary

ROW_KEY = ("job_id", "page", "pos")


def page_issuer(pages: DataFrame) -> DataFrame:
    """Add the issuer a page names in its header fields."""
    return pages.withColumn("issuer", string_field(F.col("fields"), "issuer_name", "issuer"))


def explode_transactions(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per (job, page, position); missing values become ''."""
    return pages.select(
        "job_id", "page", *keep, F.posexplode("transactions").alias("pos", "_t")
    ).select(
        "job_id",
        "page",
        F.col("pos").cast("long").alias("pos"),
        *keep,
        *[F.coalesce(F.col(f"_t.{f}"), F.lit("")).alias(f) for f in TRANSACTION_FIELDS],
    )


def drop_issuer_rows(tx: DataFrame, issuer: str = "issuer") -> DataFrame:
    """Drop rows that only repeat the page's issuer, if it names one."""
    # One comparison, so each side is evaluated once; without an issuer or a
    # merchant it is NULL.
    repeats = canonical_issuer(F.col("merchant")) == F.nullif(canonical_issuer(F.col(issuer)), F.lit(""))
    return tx.filter(~F.coalesce(repeats, F.lit(False)))


def drop_zero_amounts(tx: DataFrame) -> DataFrame:
    return tx.filter(~amount_is_zero(F.col("amount")))


def normalize_card_statement(tx: DataFrame, issuer: str = "issuer") -> DataFrame:
    """Version v1 of the normalize stage; kept rows are unchanged."""
    return drop_issuer_rows(drop_zero_amounts(tx), issuer)


def enrich_transactions(tx: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Version v1 of the enrich stage: name, category and country.

    Rows the dictionary does not know pass through, with the country taken
    from their settlement currency.
    """
    lookup = dictionary.aliases.select(
        "alias_key",
        F.col("canonical").alias("_name"),
        F.col("category").alias("_category"),
        F.col("country").alias("_country"),
    )
    keyed = tx.withColumn("alias_key", normalise_alias(F.col("merchant")))
    joined = left_join_lookup(keyed, lookup, dictionary.rows, "alias_key", ROW_KEY)
    filled = {
        "category": fill_category(F.col("category"), F.col("_category")),
        "country": fill_country(F.col("_country"), F.col("country"), F.col("foreign_currency")),
        "merchant_normalized": F.coalesce(F.col("_name"), F.col("merchant_normalized")),
    }
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in tx.columns])
