"""Printed amounts. They stay text; these read them on demand.

Sums are exact decimals. A number written in hexadecimal, an infinity or a
value of 10^32 and above is not an amount here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.text import WHITE_SPACE

AMOUNT_TYPE = "decimal(38,6)"

# Each pattern reads a whole printed amount without its commas, so a column is
# evaluated once even where the optimizer repeats the expression in a filter.
_SPACE = f"[{WHITE_SPACE}]*"
_EXPONENT = r"(?:[eE][+-]?[0-9]+)?"
NUMBER = rf"\A{_SPACE}([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+){_EXPONENT}){_SPACE}\z"

# Fixed value: the currency word that may end a printed amount.
YEN_WORD = "円"
ZERO = rf"\A{_SPACE}(?:[+-]?(?:0+\.?0*|\.0+){_EXPONENT})?{_SPACE}(?:{YEN_WORD})?\z"


def _without_commas(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def parse_amount(c: Column) -> Column:
    """Decimal value of a printed amount, NULL if it is not a number."""
    return F.regexp_extract(_without_commas(c), NUMBER, 1).try_cast(AMOUNT_TYPE)


def amount_is_zero(c: Column) -> Column:
    """True for an unfilled amount or any spelling of zero.

    The currency word counts only at the very end, so "0円 " is no zero.
    """
    return _without_commas(c).rlike(ZERO)


def format_amount(total: Column, foreign: bool) -> Column:
    """Text of a total: two places for foreign sums, none otherwise.

    Ties go to the even digit, and a negative total that rounds away keeps
    its sign.
    """
    rounded = F.bround(total, 2 if foreign else 0)
    sign = F.when((total < 0) & (rounded == 0), "-").otherwise("")
    return F.concat(sign, rounded.cast("string"))
