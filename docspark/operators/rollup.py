"""Count and sum of the rows that share one value of one dimension."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.amounts import AMOUNT_TYPE, format_amount, parse_amount
from docspark.functions.text import WHITE_SPACE, effective_merchant, unicode_trim
from docspark.schema import TRANSACTION_FIELDS, BadFilter

# Fixed value: the currency of an amount that names none.
HOME_CURRENCY = "JPY"
FOREIGN = "foreign_currency"

DIMENSIONS = tuple(sorted(TRANSACTION_FIELDS))


def _known(key: str) -> str:
    if key not in TRANSACTION_FIELDS:
        raise BadFilter(f"unknown filter {key!r}; supported: {', '.join(DIMENSIONS)}")
    return key


def resolve_filter(params: Mapping[str, str]) -> tuple[str, str]:
    """The one filter of a request. Unknown names fail before anything else."""
    for key in params:
        _known(key)
    given = {k: v.strip(WHITE_SPACE) for k, v in params.items() if v.strip(WHITE_SPACE)}
    if not given:
        raise BadFilter(f"one filter is required; supported: {', '.join(DIMENSIONS)}")
    if len(given) > 1:
        raise BadFilter(f"only one filter allowed, got {', '.join(sorted(given))}")
    return next(iter(given.items()))


def _printed(key: str) -> str:
    """The column that holds the amount that a filter by this key adds up."""
    return "foreign_amount" if key == FOREIGN else "amount"


def _amount(key: str) -> Column:
    return parse_amount(F.col(_printed(key)))


def _dimension(key: str, effective_currency: bool) -> Column:
    if key == "currency" and effective_currency:
        return F.when(F.col(key) == "", HOME_CURRENCY).otherwise(F.col(key))
    return F.col(key)


def filter_dimension(
    tx: DataFrame, key: str, value: str, effective_currency: bool = False
) -> DataFrame:
    """Rows whose column equals the trimmed value exactly.

    With `effective_currency`, a row without a currency counts as domestic.
    """
    key, value = resolve_filter({_known(key): value})
    return tx.filter(_dimension(key, effective_currency) == value)


def _totals(key: str) -> list[Column]:
    """Count and sum; a sum beyond the type is NULL, no amounts at all are 0."""
    amount = F.col("_amount")
    nothing = F.count(amount) == 0
    return [
        F.count(amount).alias("row_count"),
        F.when(nothing, F.lit(0).cast(AMOUNT_TYPE)).otherwise(F.try_sum(amount)).alias("total_amount"),
    ]


def _labelled(df: DataFrame, key: str, value: Column) -> DataFrame:
    currency = value if key in (FOREIGN, "currency") else F.lit(HOME_CURRENCY)
    return df.select(
        "job_id",
        F.lit(key).alias("filter_key"),
        value.alias("filter_value"),
        "row_count",
        "total_amount",
        format_amount(F.col("total_amount"), key == FOREIGN).alias("total"),
        currency.alias("currency"),
    )


def aggregate(
    tx: DataFrame,
    key: str,
    value: str,
    effective_currency: bool = False,
    jobs: DataFrame | None = None,
) -> DataFrame:
    """Per job: rows that match and have a readable amount, and their sum.

    With `jobs`, every job named there has a row, with count and sum 0 where
    nothing matches.
    """
    key, value = resolve_filter({_known(key): value})
    matched = filter_dimension(tx, key, value, effective_currency).select(
        "job_id", _amount(key).alias("_amount")
    )
    totals = matched.groupBy("job_id").agg(*_totals(key))
    if jobs is not None:
        none = F.col("row_count").isNull()
        totals = (
            jobs.select("job_id")
            .join(totals, "job_id", "left")
            .withColumn("total_amount", F.when(none, F.lit(0).cast(AMOUNT_TYPE)).otherwise(F.col("total_amount")))
            .withColumn("row_count", F.coalesce("row_count", F.lit(0).cast("long")))
        )
    return _labelled(totals, key, F.lit(value))


def aggregate_by(tx: DataFrame, key: str) -> DataFrame:
    """`aggregate` for every job and every value a filter could ask for."""
    # Behind the one-element explode the value is there; a filter would repeat how it is made.
    printed = F.col(_printed(key)).alias("_printed")
    valued = tx.select("job_id", F.explode(F.array(F.col(_known(key)))).alias("_value"), printed)
    value = F.col("_value")
    rows = valued.filter((value != "") & (value == unicode_trim(value))).select(
        "job_id", "_value", parse_amount(F.col("_printed")).alias("_amount")
    )
    return _labelled(rows.groupBy("job_id", "_value").agg(*_totals(key)), key, F.col("_value"))


def aggregate_rows(
    tx: DataFrame, key: str, value: str, effective_currency: bool = False
) -> DataFrame:
    """The rows behind `aggregate`, in page and row order."""
    return (
        filter_dimension(tx, key, value, effective_currency)
        .filter(_amount(key).isNotNull())
        .select("job_id", "page", "pos", *TRANSACTION_FIELDS)
        .orderBy("job_id", "page", "pos")
    )


def merchant_totals(tx: DataFrame) -> DataFrame:
    """Count and sum per job and merchant, by its canonical name if it has one."""
    rows = tx.select(
        "job_id",
        effective_merchant(F.col("merchant_normalized"), F.col("merchant")).alias("merchant"),
        parse_amount(F.col("amount")).alias("_amount"),
    )
    return (
        rows.groupBy("job_id", "merchant")
        .agg(*_totals("merchant"))
        .withColumn("total", format_amount(F.col("total_amount"), foreign=False))
    )
