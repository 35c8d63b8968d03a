"""Job rows: chain binding, progress, terminal states and events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.chains import chain_final, chain_head, chain_literal
from docspark.functions.dates import parse_rfc3339
from docspark.functions.keys import tenant_safe
from docspark.functions.text import blank_to
from docspark.operators.state import unexpired
from docspark.schema import (
    CHAIN,
    CHAIN_REGISTRY,
    CREATED,
    DEFAULT_CHAIN_ID,
    FAILED,
    JOB,
    PASSTHROUGH,
    PENDING,
    RENDERED,
    RUNNING,
    SUCCEEDED,
)

Registry = Mapping[str, Sequence[tuple[str, str, str]]]

# Columns of the old row that survive each kind of job write.
CARRY_ON_SUBMIT = ("mode", "chain_id", "chain")
CARRY_ON_MERGE = ("input_uri", "mode", "chain_id", "chain")
CARRY_ON_FAILURE = ("input_uri", "page_count", "mode", "chain_id", "chain")

# Fixed value: the message of a job that failed because of its pages.
PAGE_FAILURE = "one or more page stages reported status=failed"


def _resolved_id(chain_id: Column, default: str) -> Column:
    return blank_to(chain_id, F.lit(default))


def _registry_chain(chain_id: Column, registry: Registry, default: str) -> Column:
    """Stages of a chain id, NULL if the registry does not have it."""
    out = F.lit(None).cast(CHAIN)
    for name, stages in registry.items():
        out = F.when(chain_id == name, chain_literal(stages)).otherwise(out)
    return out


def bind_chain(
    requests: DataFrame, registry: Registry = CHAIN_REGISTRY, default: str = DEFAULT_CHAIN_ID
) -> DataFrame:
    """Resolve `chain_id` and freeze its stages as column `chain`.

    `bind_error` is set, and the chain empty, where the id is unknown.
    """
    resolved = _resolved_id(F.col("chain_id"), default)
    stages = _registry_chain(resolved, registry, default)
    unknown = ~resolved.isin(list(registry))
    return (
        requests.withColumn(
            "bind_error",
            F.when(unknown, F.concat(F.lit("chain "), resolved, F.lit(" is not in the registry"))),
        )
        .withColumn("chain", F.coalesce(stages, F.array().cast(CHAIN)))
        .withColumn("chain_id", resolved)
    )


def effective_chain(
    jobs: DataFrame, registry: Registry = CHAIN_REGISTRY, default: str = DEFAULT_CHAIN_ID
) -> DataFrame:
    """The frozen chain; rows written without one ask the registry."""
    fallback = _registry_chain(_resolved_id(F.col("chain_id"), default), registry, default)
    return jobs.withColumn(
        "chain", F.when(F.size("chain") > 0, F.col("chain")).otherwise(fallback)
    )


def with_chain_ends(jobs: DataFrame) -> DataFrame:
    head, final = chain_head(F.col("chain")), chain_final(F.col("chain"))
    return (
        jobs.withColumn("first_stage", head["name"])
        .withColumn("first_version", head["version"])
        .withColumn("first_queue", head["queue_name"])
        .withColumn("final_stage", final["name"])
        .withColumn("final_version", final["version"])
    )


def page_uris(input_uri: Column, mode: Column, pages: Column) -> Column:
    """Split pages in rendered mode, else the document as its only page."""
    return F.when(mode == RENDERED, pages).otherwise(F.array(input_uri))


def validate_jobs(jobs: DataFrame) -> DataFrame:
    """Add `errors`, the list of what keeps a job from being run."""
    checks = [
        (F.coalesce("job_id", F.lit("")) == "", "empty job_id"),
        (F.coalesce("tenant_id", F.lit("")) == "", "empty tenant_id"),
        (
            (F.coalesce("tenant_id", F.lit("")) != "") & ~tenant_safe(F.col("tenant_id")),
            "tenant_id may hold letters, digits, - and _ only",
        ),
        (F.coalesce("input_uri", F.lit("")) == "", "empty input_uri"),
        (F.col("page_count") < 0, "negative page_count"),
        (F.coalesce(F.size("chain"), F.lit(0)) <= 0, "empty chain"),
    ]
    found = F.array(*[F.when(bad, F.lit(text)) for bad, text in checks])
    return jobs.withColumn("errors", F.array_compact(found))


def stage_counts(state: DataFrame, now: Column) -> DataFrame:
    """Succeeded and failed pages per (job, stage, version)."""
    live = unexpired(state, now).filter(F.col("page") > 0)
    return live.groupBy("job_id", "stage", "version").agg(
        F.count_if(F.col("status") == SUCCEEDED).alias("succeeded_count"),
        F.count_if(F.col("status") == FAILED).alias("failed_count"),
    )


def _counted(jobs: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """Jobs with the page counts of their final stage, one row per job."""
    counts = (
        stage_counts(state, now)
        .withColumnRenamed("stage", "final_stage")
        .withColumnRenamed("version", "final_version")
    )
    ends = with_chain_ends(effective_chain(jobs))
    joined = ends.join(counts, ["job_id", "final_stage", "final_version"], "left").fillna(
        0, ["succeeded_count", "failed_count"]
    )
    done = F.col("succeeded_count") + F.col("failed_count")
    return joined.withColumn(
        "pending_count", F.greatest(F.col("page_count") - done, F.lit(0).cast("long"))
    )


def job_status(jobs: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """Progress of every job: status, counts and its own context columns."""
    expires = F.when(F.col("expires_at") > 0, F.timestamp_seconds("expires_at"))
    return _counted(jobs, state, now).select(
        "job_id",
        "status",
        "page_count",
        "succeeded_count",
        "failed_count",
        "pending_count",
        "input_uri",
        "result_uri",
        "error",
        "updated_at",
        F.coalesce(F.date_format(expires, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")).alias(
            "expires_at"
        ),
    )


def decision(succeeded: Column, failed: Column, page_count: Column) -> Column:
    """Any failed page fails the job; all pages must have succeeded."""
    return (
        F.when(failed > 0, FAILED)
        .when((page_count > 0) & (succeeded == page_count), SUCCEEDED)
        .otherwise(PENDING)
    )


def check_jobs(jobs: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """The gate: is a job finished, and how."""
    return _counted(jobs, state, now).select(
        "job_id",
        decision(F.col("succeeded_count"), F.col("failed_count"), F.col("page_count")).alias(
            "decision"
        ),
        "succeeded_count",
        "failed_count",
        "pending_count",
    )


def _job_defaults() -> dict[str, Column]:
    zero = {"page_count": F.lit(0), "expires_at": F.lit(0).cast("long")}
    out = {f.name: zero.get(f.name, F.lit("")) for f in JOB.fields}
    out["chain"] = F.array().cast(CHAIN)
    return out


def upsert_jobs(existing: DataFrame, incoming: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Write whole job rows over the old ones, keeping the `carry` columns.

    Columns `incoming` does not have are reset; jobs it does not name stay.
    """
    defaults = _job_defaults()
    old = existing.select("job_id", F.struct(*defaults).alias("_old"))
    values = [
        F.coalesce(F.col(c), d).alias(c) if c in incoming.columns else d.alias(c)
        for c, d in defaults.items()
    ]
    new = incoming.select("job_id", F.struct(*values).alias("_new"))
    both = old.join(new, "job_id", "full_outer")
    out = [F.col("job_id")]
    for f in JOB.fields:
        if f.name == "job_id":
            continue
        before, after = F.col(f"_old.{f.name}"), F.col(f"_new.{f.name}")
        written = F.coalesce(before, defaults[f.name]) if f.name in carry else after
        out.append(
            F.when(F.col("_new").isNull(), before).otherwise(written).cast(f.dataType).alias(f.name)
        )
    return both.select(*out)


def checked_jobs(requests: DataFrame, registry: Registry = CHAIN_REGISTRY) -> DataFrame:
    """The requests with `errors`, what keeps each from being run."""
    bound = bind_chain(requests, registry).withColumn("page_count", F.lit(0))
    unknown = F.col("bind_error").isNotNull()
    errors = F.when(unknown, F.array_append(F.array_remove("errors", "empty chain"), F.col("bind_error")))
    found = validate_jobs(bound).withColumn("errors", errors.otherwise(F.col("errors")))
    return found.select(*[F.col(c) for c in requests.columns if c not in ("chain_id", "chain")], "chain_id", "errors")


def rejected_jobs(requests: DataFrame, registry: Registry = CHAIN_REGISTRY) -> DataFrame:
    """(job_id, tenant_id, errors) of the requests that cannot be run."""
    return checked_jobs(requests, registry).filter(F.size("errors") > 0).select("job_id", "tenant_id", "errors")


def created_jobs(requests: DataFrame, updated_at: str, registry: Registry = CHAIN_REGISTRY) -> DataFrame:
    """New job rows of requests whose chain was bound."""
    bound = bind_chain(requests, registry).filter(F.col("bind_error").isNull())
    values = _job_defaults()
    values.update(
        job_id=F.col("job_id"),
        status=F.lit(CREATED),
        input_uri=F.col("input_uri"),
        mode=blank_to(F.col("mode"), F.lit(PASSTHROUGH)),
        chain_id=F.col("chain_id"),
        chain=F.col("chain"),
        updated_at=F.lit(updated_at),
    )
    return bound.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in JOB.fields])


def submit_jobs(existing: DataFrame, submitted: DataFrame) -> DataFrame:
    """Jobs handed to the stages: running, with their page count."""
    rows = submitted.withColumn("status", F.lit(RUNNING))
    return upsert_jobs(existing, rows, CARRY_ON_SUBMIT)


def mark_failed_jobs(existing: DataFrame, failed: DataFrame) -> DataFrame:
    """Commit failures (job_id, error), keeping what is known of each job."""
    rows = failed.withColumn("status", F.lit(FAILED))
    return upsert_jobs(existing, rows, CARRY_ON_FAILURE)


def commit_merged_jobs(existing: DataFrame, merged: DataFrame) -> DataFrame:
    """Commit successes (job_id, result_uri, page_count)."""
    rows = merged.withColumn("status", F.lit(SUCCEEDED))
    return upsert_jobs(existing, rows, CARRY_ON_MERGE)


def terminal_events(jobs: DataFrame) -> DataFrame:
    """One event per finished job; `event_error` marks jobs that are not."""
    ok, bad = F.col("status") == SUCCEEDED, F.col("status") == FAILED
    return jobs.select(
        "job_id",
        F.when(ok | bad, F.col("status")).alias("event"),
        "chain_id",
        F.when(ok, F.col("result_uri")).otherwise("").alias("result_uri"),
        "page_count",
        F.when(bad, F.col("error")).otherwise("").alias("error"),
        parse_rfc3339(F.col("updated_at")).alias("at"),
        F.when(
            ~(ok | bad),
            F.concat(F.lit("job is "), F.col("status"), F.lit(", want succeeded or failed")),
        ).alias("event_error"),
    )
