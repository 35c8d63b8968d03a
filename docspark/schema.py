"""Row shapes, status labels and error types shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of the string fields of one transaction, in record order.
TRANSACTION_FIELDS = (
    "date",
    "merchant",
    "description",
    "amount",
    "currency",
    "foreign_amount",
    "foreign_currency",
    "exchange_rate",
    "exchange_date",
    "category",
    "merchant_normalized",
    "country",
)

# Status labels.
QUEUED, RUNNING, SUCCEEDED, FAILED = "queued", "running", "succeeded", "failed"
CREATED, PENDING = "created", "pending"

# Workflow modes.
PASSTHROUGH, RENDERED = "passthrough", "rendered"

# Document types a page may carry.
DOCUMENT_TYPES = ("receipt", "credit_card_statement", "invoice", "bill", "other")

# Labels of the archive and of index requests.
SOURCE_KIND = "card_statement"
RESULT_TYPE = "transactions"
SCHEMA_VERSION = "transactions.v1"

# The default chain (id and stages in order).
DEFAULT_CHAIN_ID = "card-statement-v1"
EXTRACT_STAGE = ("gemini", "v1")
NORMALIZE_STAGE = ("normalize_card_statement", "v1")
ENRICH_STAGE = ("enrich_transactions", "v1")

CHAIN_REGISTRY = {
    DEFAULT_CHAIN_ID: [
        (name, version, name)
        for name, version in (EXTRACT_STAGE, NORMALIZE_STAGE, ENRICH_STAGE)
    ],
}

RETENTION_DAYS = 14
DEAD_LETTER_DAYS = 14
MAX_DELIVERIES = 5
VISIBILITY_SECONDS = 600

# Pages are spread over blocks of this many consecutive page numbers wherever
# a per-job value meets page rows, so one very long job fills many tasks.
PAGES_PER_BLOCK = 4096


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


STAGE_SPEC = T.StructType(_strings("name", "version", "queue_name"))
CHAIN = T.ArrayType(STAGE_SPEC)

TRANSACTION = T.StructType(_strings(*TRANSACTION_FIELDS))

TRANSACTION_ROW = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("pos", T.LongType()),
        *TRANSACTION.fields,
    ]
)

STAGE_LOG = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("page", T.IntegerType()),
        *_strings(
            "stage",
            "version",
            "status",
            "idempotency_key",
            "input_uri",
            "result_uri",
            "next_stage",
            "error",
        ),
        T.StructField("expires_at", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)

JOB = T.StructType(
    [
        *_strings("job_id", "status", "input_uri", "result_uri"),
        T.StructField("page_count", T.IntegerType()),
        *_strings("error", "mode", "chain_id"),
        T.StructField("chain", CHAIN),
        T.StructField("expires_at", T.LongType()),
        T.StructField("updated_at", T.StringType()),
    ]
)

MESSAGE = T.StructType(
    [
        *_strings("job_id", "document_id"),
        T.StructField("page", T.IntegerType()),
        *_strings("stage", "version", "input_uri", "previous_uri", "prompt_profile_id"),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("chain", CHAIN),
        T.StructField("chain_idx", T.IntegerType()),
    ]
)

USAGE = T.StructType(
    [
        *_strings("provider", "model"),
        T.StructField("input_tokens", T.IntegerType()),
        T.StructField("output_tokens", T.IntegerType()),
    ]
)

INDEX_RESPONSE = T.StructType(
    [
        *_strings("status", "collection", "index_job_id"),
        T.StructField("vector_count", T.IntegerType()),
        *_strings("embedding_model", "indexed_at"),
    ]
)

STAGE_KEY_COLUMNS = ("job_id", "page", "stage", "version")


class QueryError(Exception):
    """Base of the errors a per-job query reports to its caller."""

    kind = "internal_error"


class BadFilter(QueryError):
    kind = "bad_request"


class NotFound(QueryError):
    kind = "not_found"


class JobNotReady(QueryError):
    kind = "job_not_ready"


class JobFailed(QueryError):
    kind = "job_failed"


class DictionaryError(ValueError):
    """The merchant dictionary contradicts itself or lacks a name."""
