"""The ordered stage list a job is bound to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.schema import CHAIN


def chain_literal(stages: Sequence[tuple[str, str, str]]) -> Column:
    """Array column from (name, version, queue name) triples."""
    rows = [
        F.struct(F.lit(n).alias("name"), F.lit(v).alias("version"), F.lit(q).alias("queue_name"))
        for n, v, q in stages
    ]
    return F.array(*rows).cast(CHAIN)


def chain_head(chain: Column) -> Column:
    return F.try_element_at(chain, F.lit(1))


def chain_final(chain: Column) -> Column:
    return F.try_element_at(chain, F.lit(-1))


def next_stage(chain: Column, chain_idx: Column) -> Column:
    """Stage after position `chain_idx` (from 0), NULL behind the last."""
    return F.try_element_at(chain, chain_idx + 2)


def encode_chain(chain: Column) -> Column:
    return F.when(F.size(chain) > 0, F.to_json(chain)).otherwise("")


def decode_chain(text: Column) -> Column:
    """Array from its JSON text; empty or broken text gives an empty chain."""
    return F.coalesce(F.from_json(text, CHAIN), F.array().cast(CHAIN))
