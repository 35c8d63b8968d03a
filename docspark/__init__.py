"""Document-transaction processing as Spark jobs.

Pages of extracted documents become flat transaction rows, pass through
versioned stages, and end in a partitioned archive that status, result and
rollup queries read. Every operator takes and returns DataFrames and covers
all jobs at once.
"""

from docspark.schema import (
    BadFilter,
    DictionaryError,
    JobFailed,
    JobNotReady,
    NotFound,
    TRANSACTION_FIELDS,
)

__all__ = [
    "BadFilter",
    "DictionaryError",
    "JobFailed",
    "JobNotReady",
    "NotFound",
    "TRANSACTION_FIELDS",
]
