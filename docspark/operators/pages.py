"""From documents to page work, and from stage to stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.chains import chain_head, next_stage
from docspark.operators.spread import rank_in_group
from docspark.schema import MESSAGE

# Largest page suffix a split file may carry.
MAX_SUFFIX_DIGITS = 19


def page_suffix(name: Column) -> Column:
    """Number behind the last underscore of a file name without extension.

    NULL where there is none or it is below 1.
    """
    stem = F.regexp_replace(F.regexp_extract(name, r"[^/]*\z", 0), r"\.[^.]*\z", "")
    digits = F.regexp_extract(stem, r"_\+?0*([0-9]{1,%d})\z" % MAX_SUFFIX_DIGITS, 1)
    number = digits.try_cast("long")
    return F.when(number >= 1, number)


def number_pages(files: DataFrame, name: str = "name") -> DataFrame:
    """Page number of each split file: its rank by numeric suffix.

    One file without a suffix fails its whole job: `page_error` is set, and
    the page NULL, on all of the job's files.
    """
    read = files.withColumn("_suffix", page_suffix(F.col(name)))
    broken = read.filter(F.col("_suffix").isNull()).select("job_id").distinct()
    whole = read.join(broken, "job_id", "left_anti")
    good = rank_in_group(whole, "job_id", "_suffix", "page")
    good = good.withColumn("page_error", F.lit(None).cast("string"))
    bad = (
        read.join(broken, "job_id", "left_semi")
        .withColumn("page", F.lit(None).cast("int"))
        .withColumn("page_error", F.lit("no valid page suffix"))
    )
    return good.unionByName(bad).drop("_suffix")


def fan_out_pages(jobs: DataFrame) -> DataFrame:
    """One work row per entry of `pages`, for the first stage of the chain."""
    head = chain_head(F.col("chain"))
    rows = jobs.select("job_id", "chain", F.posexplode("pages").alias("_i", "_uri"))
    values = {
        "job_id": F.col("job_id"),
        "page": F.col("_i") + 1,
        "stage": head["name"],
        "version": head["version"],
        "input_uri": F.col("_uri"),
        "chain": F.col("chain"),
        "chain_idx": F.lit(0),
        "metadata": F.create_map(),
    }
    return rows.select(
        *[values.get(f.name, F.lit("")).cast(f.dataType).alias(f.name) for f in MESSAGE.fields]
    )


def route_next(
    done: DataFrame, fallback: tuple[str, str] | None = None, result_uri: str = "result_uri"
) -> DataFrame:
    """Work rows for the stage after the one that is done.

    Rows with a chain follow it; rows without one go to `fallback`. Rows at
    the end of their chain leave.
    """
    chained = F.size("chain") > 0
    following = next_stage(F.col("chain"), F.col("chain_idx"))
    name, version = following["name"], following["version"]
    if fallback:
        name = F.when(chained, name).otherwise(fallback[0])
        version = F.when(chained, version).otherwise(fallback[1])
    routed = (
        done.withColumn("stage", name)
        .withColumn("version", version)
        .withColumn("previous_uri", F.col(result_uri))
        .withColumn("chain_idx", F.col("chain_idx") + 1)
        .filter(F.col("stage").isNotNull())
    )
    return routed.select(*[F.col(f.name).cast(f.dataType) for f in MESSAGE.fields])
