"""The merchant dictionary: one row per alias, checked for conflicts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.text import normalise_alias
from docspark.schema import DictionaryError

ENTRY_SCHEMA = (
    "entry_no int, canonical string, category string, country string, aliases array<string>"
)

# The seed dictionary.
SEED = [
    {
        "canonical": "FamilyMart",
        "category": "convenience_store",
        "aliases": [
            "ファミリーマート",
            "Family Mart",
            "FAMILY MART",
            "ﾌｧﾐﾘｰﾏｰﾄ",
            "PAYPAY *ファミリーマート",
        ],
    },
    {
        "canonical": "Starbucks",
        "category": "cafe",
        "aliases": [
            "スターバックス コーヒー",
            "スターバックスコーヒージャパン",
            "STARBUCKS",
        ],
    },
    {
        "canonical": "Rehan Restaurant",
        "category": "restaurant",
        "country": "MY",
        "aliases": ["REHAN RESTAURANT"],
    },
    {
        "canonical": "Restoran Nasi Kandar",
        "category": "restaurant",
        "country": "MY",
        "aliases": ["RESTORAN NASI KANDAR"],
    },
]


@dataclass(frozen=True)
class Dictionary:
    """Alias rows and how many there are (the bound for a broadcast)."""

    aliases: DataFrame
    rows: int


def alias_rows(entries: DataFrame) -> DataFrame:
    """One row per (alias key, entry); a name is its own alias."""
    names = F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))
    return (
        entries.withColumn("alias", F.explode(names))
        .withColumn("alias_key", normalise_alias(F.col("alias")))
        .filter(F.coalesce(F.col("alias_key"), F.lit("")) != "")
    )


def build_dictionary(entries: DataFrame) -> Dictionary:
    """Check the entries and fold them to one row per alias.

    An entry without a name, or an alias of two names, is an error. Where a
    name occurs twice, its later entry counts.
    """
    filled = entries.fillna("", ["canonical", "category", "country"])
    folded = (
        alias_rows(filled)
        .groupBy("alias_key")
        .agg(
            F.min("canonical").alias("_first"),
            F.max_by(F.struct("canonical", "category", "country"), "entry_no").alias("e"),
            F.max("canonical").alias("_last"),
        )
    )
    clash = F.col("_first") != F.col("_last")
    found = folded.agg(
        F.count("*").alias("rows"),
        F.min_by(F.struct("alias_key", "_first", "_last"), F.when(clash, F.col("alias_key"))).alias(
            "clash"
        ),
    ).first()
    unnamed = filled.filter(F.col("canonical") == "").agg(F.min("entry_no").alias("n")).first()["n"]
    if unnamed is not None:
        raise DictionaryError(f"entry {unnamed} has an empty canonical name")
    if found["clash"] is not None:
        alias, one, two = found["clash"]
        raise DictionaryError(f"alias {alias!r} maps to both {one!r} and {two!r}")
    return Dictionary(folded.select("alias_key", "e.*"), found["rows"])


def dictionary_from_entries(spark: SparkSession, entries: Iterable[Mapping]) -> Dictionary:
    rows = [
        (
            i,
            e.get("canonical") or "",
            e.get("category") or "",
            e.get("country") or "",
            list(e.get("aliases") or []),
        )
        for i, e in enumerate(entries)
    ]
    return build_dictionary(spark.createDataFrame(rows, ENTRY_SCHEMA))


def seed_dictionary(spark: SparkSession) -> Dictionary:
    return dictionary_from_entries(spark, SEED)


def load_dictionary(spark: SparkSession, path: str) -> Dictionary:
    """Dictionary from a YAML list, or from a table for a large one.

    A path ending in .yaml or .yml is read on the driver; anything else is a
    Parquet table with the columns of `ENTRY_SCHEMA`.
    """
    if not path.endswith((".yaml", ".yml")):
        return build_dictionary(spark.read.schema(ENTRY_SCHEMA).parquet(path))
    try:
        import yaml
    except ImportError as exc:
        raise RuntimeError("reading a YAML dictionary needs the yaml package") from exc
    with open(path, encoding="utf-8") as f:
        entries = yaml.safe_load(f) or []
    if not isinstance(entries, list) or not all(isinstance(e, Mapping) for e in entries):
        raise DictionaryError(f"{path} is not a list of entries")
    return dictionary_from_entries(spark, entries)
