"""Reading the free-form header fields, whose value types matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.text import unicode_trim


def text_value(value: Column) -> Column:
    """The value if it is a JSON string, else NULL."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def string_field(fields: Column, *keys: str) -> Column:
    """First of `keys` whose value is a JSON string, else the empty string.

    A number or object under a key is passed over; an empty string is not.
    """
    found = [text_value(F.try_variant_get(fields, f"$['{k}']", "variant")) for k in keys]
    return F.coalesce(*found, F.lit(""))


def is_empty_value(value: Column) -> Column:
    """True for a missing value, JSON null and blank text only."""
    kind = F.schema_of_variant(value)
    blank = (kind == "STRING") & (unicode_trim(F.try_variant_get(value, "$", "string")) == "")
    return value.isNull() | (kind == "VOID") | blank
