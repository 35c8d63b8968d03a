"""Connected components of a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component): each linked id with the smallest id it reaches.

    `links` has columns a and b. Every round takes the smallest label of the
    neighbours, folded before the shuffle so that a hub costs no more than its
    links, then the label of the label; paths halve, and rounds end when no
    label changes. Labels are written out each round.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a <> b").distinct(), "links")
    labels = stored(
        both.groupBy(F.col("a").alias("id"))
        .agg(F.min("b").alias("_least"))
        .select("id", F.least("id", "_least").alias("component")),
        "labels",
    )
    while True:
        of_b = labels.select(F.col("id").alias("b"), F.col("component").alias("_near"))
        near = both.join(of_b, "b").groupBy(F.col("a").alias("id")).agg(F.min("_near").alias("_near"))
        hooked = stored(
            labels.join(near, "id").select(
                "id", F.least("component", "_near").alias("component"), F.col("component").alias("_was")
            ),
            "labels",
        )
        above = hooked.select(F.col("id").alias("component"), F.col("component").alias("_above"))
        jumped = stored(
            hooked.join(above, "component").select("id", F.col("_above").alias("component"), "_was"), "labels"
        )
        if jumped.where("component <> _was").isEmpty():
            return jumped.select("id", "component")
        labels = jumped.select("id", "component")
