"""Scalar functions: native Column expressions, one module per topic."""

from docspark.functions.amounts import amount_is_zero, format_amount, parse_amount
from docspark.functions.chains import (
    chain_final,
    chain_head,
    chain_literal,
    decode_chain,
    encode_chain,
    next_stage,
)
from docspark.functions.dates import expires_at, format_rfc3339, parse_rfc3339, year_month
from docspark.functions.keys import (
    archive_key,
    manifest_key,
    merged_key,
    mime_from_uri,
    page_key,
    parse_uri,
    raw_key,
    sidecar_key,
    stage_key,
    tenant_safe,
    uri_for,
)
from docspark.functions.outcomes import index_outcome
from docspark.functions.text import (
    blank_to,
    canonical_issuer,
    card_slug,
    country_from_currency,
    effective_merchant,
    fill_category,
    fill_country,
    issuer_slug,
    known_document_type,
    normalise_alias,
    slugify,
    unicode_trim,
)
from docspark.functions.variants import is_empty_value, string_field

__all__ = [n for n in dir() if not n.startswith("_")]
