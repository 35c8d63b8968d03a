"""Meaning of the status code an index service answers with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_outcome(status: Column) -> Column:
    return (
        F.when(status.between(200, 299), "ok")
        .when(status == 400, "schema")
        .when((status == 429) | (status >= 500), "transient")
        .otherwise("unexpected")
    )
