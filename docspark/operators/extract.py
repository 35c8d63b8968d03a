"""The extract stage: documents to page JSON by a plugged-in function."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.keys import mime_from_uri
from docspark.functions.text import blank_to
from docspark.operators.spread import with_content
from docspark.schema import USAGE

DEFAULT_PROFILE = "default"
PROFILES = {
    DEFAULT_PROFILE: (
        "Return one JSON object for the page with its full text, its document type, "
        "its header fields and its transactions, amounts and dates as printed."
    ),
}

# Gets a frame with mime, content and instructions; returns one row per input
# row with body, the usage columns, and error where extraction failed.
Extractor = Callable[[pd.DataFrame], pd.DataFrame]

EXTRACTED = T.StructType(
    [
        T.StructField("body", T.StringType()),
        *USAGE.fields,
        T.StructField("error", T.StringType()),
    ]
)

# "2026/06/22  SOME SHOP  1,680"
PRINTED_ROW = re.compile(r"^\s*(\d{2,4}[-/]\d{1,2}[-/]\d{1,2})\s+(\S.*?)\s+(-?[\d,]+(?:\.\d+)?)\s*$")


def rule_extractor(batch: pd.DataFrame) -> pd.DataFrame:
    """Reads plain text pages: every printed row becomes a transaction."""
    bodies = []
    for content in batch["content"]:
        text = bytes(content).decode("utf-8", "replace")
        rows = [m.groups() for m in map(PRINTED_ROW.match, text.splitlines()) if m]
        page = {
            "text": text,
            "document_type": "receipt" if rows else "other",
            "transactions": [{"date": d, "merchant": m, "amount": a} for d, m, a in rows],
        }
        bodies.append(json.dumps(page, ensure_ascii=False))
    size = batch["content"].map(len).astype("int32")
    return pd.DataFrame(
        {
            "body": bodies,
            "provider": "rules",
            "model": "rules-v1",
            "input_tokens": size,
            "output_tokens": 0,
            "error": None,
        }
    )


def _called(extractor: Extractor, given: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    """The extractor's rows; an exception becomes the error of its page.

    A batch that raises is tried page by page, so one page fails alone.
    """
    try:
        return extractor(given)[columns]
    except Exception as exc:  # noqa: BLE001  the function is the user's
        if len(given) == 1:
            failed = dict.fromkeys(columns) | {"error": str(exc) or type(exc).__name__}
            return pd.DataFrame([failed], columns=columns, dtype=object)
    return pd.concat(
        [_called(extractor, given.iloc[i : i + 1].reset_index(drop=True), columns) for i in range(len(given))],
        ignore_index=True,
    )


def extract_pages(
    work: DataFrame,
    documents: DataFrame,
    extractor: Extractor = rule_extractor,
    profiles: Mapping[str, str] = PROFILES,
) -> DataFrame:
    """Page JSON and usage per work row, `error` set where there is none.

    A row reads its input, or without one the result of the stage before.
    `documents` has uri and content. The function is called once per batch.
    """
    source = blank_to(F.col("input_uri"), F.coalesce("previous_uri", F.lit("")))
    profile = blank_to(F.col("prompt_profile_id"), F.lit(DEFAULT_PROFILE))
    instructions = F.lit(None).cast("string")
    for name, text in profiles.items():
        instructions = F.when(profile == name, text).otherwise(instructions)
    asked = work.select(
        "job_id", "page", source.alias("uri"), instructions.alias("instructions")
    ).withColumn("mime", mime_from_uri(F.col("uri")))
    found = with_content(asked, documents).withColumn(
        "error",
        F.when(F.col("uri") == "", "no input or previous uri")
        .when(F.col("content").isNull(), "document not found")
        .when(F.col("instructions").isNull(), "unknown prompt profile"),
    )
    columns = [f.name for f in EXTRACTED.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["job_id", "page"]].reset_index(drop=True)
            ready = batch["error"].isna().to_numpy()
            for c in columns:
                out[c] = pd.Series([None] * len(out), dtype=object)
            out["error"] = batch["error"].to_numpy()
            if ready.any():
                given = batch.loc[ready, ["mime", "content", "instructions"]]
                made = _called(extractor, given.reset_index(drop=True), columns)
                out.loc[ready, columns] = made.astype(object).to_numpy()
            yield out

    schema = T.StructType([*found.select("job_id", "page").schema.fields, *EXTRACTED.fields])
    return found.mapInPandas(run, schema)
