"""Trimming, merchant names, slugs and the fill rules of the enrich stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.schema import DOCUMENT_TYPES

# The Unicode White_Space characters.
WHITE_SPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Company suffixes of an issuer name. The short one may be
# written twice in front of the long one.
ISSUER_SUFFIX = rf"(?:\(株\)){{0,2}}(?:株式会社)?[{WHITE_SPACE}]*\z"

SUFFIX_ENDS = (*WHITE_SPACE, ")", "社")

# Country by settlement currency; no currency means domestic.
CURRENCY_COUNTRY = {"": "JP", "MYR": "MY", "SGD": "SG", "THB": "TH", "USD": "US"}

UNKNOWN = "unknown"


def blank_to(c: Column, other: Column) -> Column:
    """`other` where `c` is NULL or the empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def unicode_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def normalise_alias(c: Column) -> Column:
    return F.lower(unicode_trim(c))


def canonical_issuer(c: Column) -> Column:
    # Only a text that ends like a suffix goes through the pattern.
    bare = F.when(F.right(c, F.lit(1)).isin(*SUFFIX_ENDS), F.regexp_replace(c, ISSUER_SUFFIX, "")).otherwise(c)
    return normalise_alias(bare)


def country_from_currency(c: Column) -> Column:
    """Looked up, so the code is taken from the text once."""
    known = F.create_map(*[F.lit(x) for pair in CURRENCY_COUNTRY.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.upper(unicode_trim(c))), F.lit(""))


def fill_category(upstream: Column, dictionary: Column) -> Column:
    """The page's own category wins; the dictionary only fills a gap."""
    return F.coalesce(F.nullif(upstream, F.lit("")), dictionary, F.lit(""))


def fill_country(dictionary: Column, upstream: Column, foreign_currency: Column) -> Column:
    """The dictionary's country wins, then the page's, then the currency's."""
    empty = F.lit("")
    return F.coalesce(
        F.nullif(dictionary, empty),
        F.nullif(upstream, empty),
        country_from_currency(foreign_currency),
    )


def effective_merchant(normalized: Column, printed: Column) -> Column:
    return blank_to(normalized, printed)


def known_document_type(c: Column) -> Column:
    """Is the type one of the agreed ones? Decoding does not ask."""
    return c.isin(*DOCUMENT_TYPES)


def slugify(c: Column) -> Column:
    kept = F.regexp_replace(F.lower(unicode_trim(c)), r"[^a-z0-9 \-_\t]", "")
    return F.btrim(F.regexp_replace(kept, r"[ \-_\t]+", "-"), F.lit("-"))


def issuer_slug(issuer: Column) -> Column:
    return blank_to(slugify(issuer), F.lit(UNKNOWN))


def card_slug(issuer_slug_col: Column, card_name: Column, job_id: Column) -> Column:
    """issuer-card, card, issuer, or the end of the job id, whichever exists."""
    card = slugify(card_name)
    issuer = F.nullif(F.nullif(issuer_slug_col, F.lit("")), F.lit(UNKNOWN))
    return F.coalesce(
        F.nullif(F.concat_ws("-", issuer, F.nullif(card, F.lit(""))), F.lit("")),
        F.right(job_id, F.lit(12)),
    )
