"""Statement months, retention stamps and RFC 3339 text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the first year and month of a printed statement date.
YEAR_MONTH = r"([0-9]{4})[-/年]([0-9]{1,2})"

RFC3339 = "yyyy-MM-dd'T'HH:mm:ss'Z'"
RFC3339_SHAPE = (
    r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?"
    r"(Z|[+-][0-9]{2}:[0-9]{2})\z"
)
DAY_SECONDS = 86_400


def year_month(statement_date: Column, now: Column) -> tuple[Column, Column]:
    """(year, two-digit month) of a printed date, else those of `now` in UTC.

    The month is taken as printed; "2026-99" gives "99".
    """
    year = F.nullif(F.regexp_extract(statement_date, YEAR_MONTH, 1), F.lit(""))
    month = F.nullif(F.regexp_extract(statement_date, YEAR_MONTH, 2), F.lit(""))
    return (
        F.coalesce(year, F.date_format(now, "yyyy")),
        F.coalesce(F.lpad(month, 2, "0"), F.date_format(now, "MM")),
    )


def expires_at(now: Column, retention_days: int) -> Column:
    """Epoch second at which a row written at `now` lapses; 0 means never."""
    if retention_days <= 0:
        return F.lit(0).cast("long")
    return F.unix_timestamp(now) + F.lit(retention_days * DAY_SECONDS).cast("long")


def format_rfc3339(ts: Column) -> Column:
    return F.date_format(ts, RFC3339)


def parse_rfc3339(c: Column) -> Column:
    """Instant of RFC 3339 text; NULL stands for the zero time of bad text."""
    return F.when(c.rlike(RFC3339_SHAPE), F.try_to_timestamp(c))
