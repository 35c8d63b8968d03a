"""The whole way of a batch of jobs, from documents to events."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.dates import expires_at, format_rfc3339
from docspark.operators import archive, index, merge
from docspark.operators import jobs as job_ops
from docspark.operators.pages import fan_out_pages
from docspark.operators.retention import drop_below, lapse, live_from
from docspark.operators.state import latest_jobs, latest_state, read_state_log, unexpired
from docspark.plans.chain import Stage, StageStore, run_stage
from docspark.schema import (
    CHAIN_REGISTRY,
    EXTRACT_STAGE,
    FAILED,
    JOB,
    RETENTION_DAYS,
    RUNNING,
    SUCCEEDED,
    TRANSACTION_ROW,
)
from docspark.sources.tables import claim_number, kept_part, read_or_empty, replace_part
from docspark.streaming.events import Notifier, notify_finished, silent

log = logging.getLogger(__name__)

STEPS = 10  # numbers of a run's job writes
# Tables under the root of a workspace that have a part per run.
RUN_TABLES = (
    "requests", "rejected", "tenants", "decisions", "ready", "verdicts/good", "verdicts/bad",
    "merged/pages", "merged/transactions", "merged/documents", "notified",
    "archive/asked", "archive/targets", "archive/sent",
)

TENANT = T.StructType().add("job_id", "string").add("tenant_id", "string").add("run", "integer")
REJECTED = (
    T.StructType()
    .add("job_id", "string")
    .add("tenant_id", "string")
    .add("errors", T.ArrayType(T.StringType()))
    .add("run", "integer")
)
MERGED = {
    "documents": T.StructType().add("job_id", "string").add("page_count", "integer").add("run", "integer"),
    "pages": (
        T.StructType()
        .add("job_id", "string")
        .add("page", "integer")
        .add("text", "string")
        .add("document_type", "string")
        .add("fields", "string")
        .add("run", "integer")
    ),
    "transactions": T.StructType(list(TRANSACTION_ROW.fields)).add("run", "integer"),
}
SIDECAR_KEY = T.StructType().add("job_id", "string")
JOB_LOG = T.StructType(list(JOB.fields)).add("ts", "timestamp").add("seq", "long")
@dataclass(frozen=True)
class Workspace:
    """Folders of one deployment."""

    spark: SparkSession
    root: str
    work_bucket: str
    archive_bucket: str

    @property
    def stages(self) -> StageStore:
        root = f"{self.root}/stages"
        return StageStore(self.spark, root, self.work_bucket, live_from(self.spark, root))

    @property
    def archive(self) -> archive.ArchiveRoots:
        return archive.ArchiveRoots(f"{self.root}/archive")

    def jobs(self, now: Column) -> DataFrame:
        """Newest row of every job that has not lapsed."""
        newest = latest_jobs(read_or_empty(self.spark, f"{self.root}/jobs", JOB_LOG))
        return unexpired(newest, now).drop("ts", "seq")

    def write_jobs(self, rows: DataFrame, now: Column, step: int) -> None:
        """Every write starts the retention of its job anew."""
        stamped = rows.withColumn("updated_at", format_rfc3339(now)).withColumn(
            "expires_at", expires_at(now, RETENTION_DAYS)
        )
        numbered = stamped.withColumn("ts", now).withColumn("seq", F.lit(step).cast("long"))
        replace_part(numbered, f"{self.root}/jobs", "step", step)

    def claim(self, now: Column | None = None) -> int:
        """A number of its own for all that one run writes, above all before."""
        return claim_number(self.spark, f"{self.root}/claims", now)

    def purge(self, now: Column, days: int = RETENTION_DAYS) -> None:
        """Let go of all that was written more than `days` ago, but for the archive."""
        self.stages.purge(now, days)
        pointer = lapse(self.spark, self.root, now, days)
        drop_below(self.spark, self.root, dict.fromkeys(RUN_TABLES, "run"), pointer)
        drop_below(self.spark, self.root, {"jobs": "step"}, pointer, per_write=STEPS)
        drop_below(self.spark, self.root, {"claims": "claim"}, pointer - 1)

    def keep(self, df: DataFrame, table: str, run: int) -> DataFrame:
        return kept_part(df, f"{self.root}/{table}", "run", run)

    def merged(self, table: str) -> DataFrame:
        """Merged rows, of each job's newest merge only.

        `documents` is written last, so a merge cut short is not read.
        """
        alive = F.col("run") >= live_from(self.spark, self.root)
        read = lambda name: read_or_empty(self.spark, f"{self.root}/merged/{name}", MERGED[name]).filter(alive)
        newest = read("documents").groupBy("job_id").agg(F.max("run").alias("run"))
        return read(table).join(newest, ["job_id", "run"], "left_semi").drop("run")

    def tenants(self) -> DataFrame:
        """(job_id, tenant_id): who asked for a job last."""
        asked = read_or_empty(self.spark, f"{self.root}/tenants", TENANT)
        newest = asked.groupBy("job_id").agg(F.max(F.struct("run", "tenant_id")).alias("_last"))
        return newest.select("job_id", "_last.tenant_id")

    def rejected(self) -> DataFrame:
        """Requests that could not be run, and why."""
        return read_or_empty(self.spark, f"{self.root}/rejected", REJECTED)


def _changed(written: DataFrame, keys: DataFrame) -> DataFrame:
    """Of the rewritten job table, only the rows that were written."""
    return written.join(keys.select("job_id"), "job_id", "left_semi")


def submit(
    space: Workspace, requests: DataFrame, now: Column, run: int, registry: job_ops.Registry = CHAIN_REGISTRY
) -> DataFrame:
    """Create and start jobs; returns their page work.

    `requests` has job_id, tenant_id, input_uri, mode, chain_id and `pages`,
    the URIs a split document came apart into. Those that cannot be run are
    set aside with their errors.
    """
    # Told apart row by row: neither a NULL job_id nor one that a good request has too goes the wrong way.
    checked = space.keep(job_ops.checked_jobs(requests, registry), "requests", run)
    space.keep(checked.filter(F.size("errors") > 0).select("job_id", "tenant_id", "errors"), "rejected", run)
    requests = checked.filter(F.size("errors") == 0).drop("errors")
    replace_part(requests.select("job_id", "tenant_id").distinct(), f"{space.root}/tenants", "run", run)
    created = job_ops.created_jobs(requests, "", registry)
    space.write_jobs(created, now, STEPS * run)
    bound = space.jobs(now).select("job_id", "mode", "chain").join(
        requests.select("job_id", "input_uri", "pages"), "job_id"
    )
    ready = bound.withColumn(
        "pages", job_ops.page_uris(F.col("input_uri"), F.col("mode"), F.col("pages"))
    ).withColumn("page_count", F.size("pages"))
    space.write_jobs(_changed(job_ops.submit_jobs(space.jobs(now), ready), ready), now, STEPS * run + 1)
    return fan_out_pages(ready)


def finish(space: Workspace, headers: tuple[str, str], now: Column, run: int) -> None:
    """Merge the jobs whose pages are all done, and fail those that cannot be.

    Each job is merged from the final stage of its own chain.
    """
    store = space.stages
    running = space.jobs(now).filter(F.col("status") == RUNNING)
    state = latest_state(read_state_log(space.spark, store.log_root), "status", "expires_at")
    decided = space.keep(job_ops.check_jobs(running, state, now), "decisions", run)

    ok = decided.filter(F.col("decision") == SUCCEEDED).select("job_id")
    ready = job_ops.with_chain_ends(job_ops.effective_chain(running.join(ok, "job_id", "left_semi")))
    ready = space.keep(ready.select("job_id", "final_stage", "final_version"), "ready", run)
    finals = [tuple(r) for r in ready.select("final_stage", "final_version").distinct().collect()]
    records, rows = [], []
    for final in finals or [headers]:  # one per stage that ends a chain
        at_end = (F.col("final_stage") == final[0]) & (F.col("final_version") == final[1])
        own = ready.filter(at_end).select("job_id")
        records.append(store.state(*final, own).join(own, "job_id", "left_semi"))
        rows.append(store.rows_of("transactions", *final, store.finished_runs(*final, own)))
    bodies = store.rows_of("headers", *headers, store.finished_runs(*headers, ready)).select(
        "job_id", "page", F.struct("text", "document_type", "fields").alias("result")
    )
    merged = merge.merge_jobs(
        running.join(ok, "job_id", "left_semi"),
        reduce(DataFrame.unionByName, records),
        bodies,
        space.work_bucket,
    )
    # The verdicts are asked several times below, so they are stored once.
    documents = space.keep(merged.documents, "verdicts/good", run)
    rejects = space.keep(merged.rejects, "verdicts/bad", run)
    pages = merged.pages.select("job_id", "page", "result.*")
    replace_part(pages, f"{space.root}/merged/pages", "run", run)
    good_rows = reduce(DataFrame.unionByName, rows).join(documents, "job_id", "left_semi")
    replace_part(
        good_rows.select(*[f.name for f in TRANSACTION_ROW.fields]), f"{space.root}/merged/transactions", "run", run
    )
    replace_part(
        documents.select("job_id", F.col("page_count").cast("int")), f"{space.root}/merged/documents", "run", run
    )
    committed = _changed(job_ops.commit_merged_jobs(space.jobs(now), documents), documents)
    space.write_jobs(committed, now, STEPS * run + 2)

    bad = decided.filter(F.col("decision") == FAILED).select(
        "job_id", F.lit(job_ops.PAGE_FAILURE).alias("error")
    )
    failures = bad.unionByName(rejects)
    space.write_jobs(
        _changed(job_ops.mark_failed_jobs(space.jobs(now), failures), failures), now, STEPS * run + 3
    )


def archive_finished(space: Workspace, documents: DataFrame, now: Column, run: int) -> None:
    """Archive succeeded jobs that are not archived yet; the manifest goes last.

    Jobs that finished in an earlier run, and those whose archive failed
    then, are archived now.
    """
    roots = space.archive
    known = read_or_empty(space.spark, roots.manifests, archive.MANIFEST)
    jobs = space.jobs(now).filter(F.col("status") == SUCCEEDED).join(space.tenants(), "job_id")
    jobs = space.keep(archive.not_yet_done(jobs, known), "archive/asked", run)
    new = jobs.select("job_id")
    pages = space.merged("pages").join(new, "job_id", "left_semi").withColumn("fields", F.try_parse_json("fields"))
    targets = archive.archive_targets(archive.document_headers(pages), jobs, now, space.archive_bucket)
    fresh = space.keep(archive.pending_archives(targets, known), "archive/targets", run)
    rows = space.merged("transactions").join(new, "job_id", "left_semi")
    archive.write_archive(fresh, rows, archive.flatten_fields(pages), roots, run)
    archive.write_raw_catalog(fresh, documents, roots, run)
    archive.write_manifests(archive.build_manifests(fresh, now), roots, run)


def index_archived(space: Workspace, send: index.Sender, now: Column, run: int) -> DataFrame:
    """Offer archived jobs that the index does not have; returns the sent requests."""
    roots = space.archive
    manifests = read_or_empty(space.spark, roots.manifests, archive.MANIFEST)
    sidecars = read_or_empty(space.spark, roots.sidecars, SIDECAR_KEY)
    asked = space.tenants().join(manifests.select("job_id"), "job_id", "left_semi")
    pending = index.pending_index(index.index_requests(asked, manifests, space.jobs(now)), sidecars)
    sent = space.keep(index.send_requests(pending, send), "archive/sent", run)
    replace_part(index.build_sidecars(sent, now), roots.sidecars, "run", run)
    return sent


def run_jobs(
    space: Workspace,
    requests: DataFrame,
    documents: DataFrame,
    stages: Sequence[Stage],
    now: Column,
    run: int,
    send: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    notifier: Notifier = silent,
    registry: job_ops.Registry = CHAIN_REGISTRY,
) -> None:
    """Submit, run every stage, gate, merge or fail, archive, index, notify.

    `requests` also has tenant_id. `stages` are all that the chains name, each
    before those that may follow it; a page takes those of its own chain.
    `run` is the caller's name for the run and may come again: what is written
    is numbered by the workspace. Trouble in the archive or the index is
    logged, leaves the jobs' own success alone and is made up for by a later
    run.
    """
    write = space.claim(now)
    work = submit(space, requests, now, write, registry)
    header_stage = (stages[0].name, stages[0].version) if stages else EXTRACT_STAGE
    for stage in stages:
        work = run_stage(space.stages, stage, work, now, run, header_stage=header_stage)
    finish(space, header_stage, now, write)
    try:
        archive_finished(space, documents, now, write)
        if send is not None:
            index_archived(space, send, now, write)
    except Exception:
        log.exception("archive or index of run %s failed; its jobs stay as they are", run)
    notify_finished(space.jobs(now), f"{space.root}/notified", notifier, write)
