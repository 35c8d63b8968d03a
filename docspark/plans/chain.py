"""Stages, chains of stages, and running one stage against stored state."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.chains import next_stage
from docspark.functions.keys import page_key, uri_for
from docspark.functions.variants import string_field
from docspark.operators.extract import Extractor, extract_pages, rule_extractor
from docspark.operators.pages import route_next
from docspark.operators.retention import drop_below, lapse
from docspark.operators.state import (
    append_state,
    ended_rows,
    latest_state,
    read_state_log,
    running_rows,
    settled_keys,
    stages_for,
    succeeded_keys,
)
from docspark.operators.transactions import (
    enrich_transactions,
    explode_transactions,
    normalize_card_statement,
)
from docspark.schema import (
    ENRICH_STAGE,
    EXTRACT_STAGE,
    MESSAGE,
    NORMALIZE_STAGE,
    RETENTION_DAYS,
    SUCCEEDED,
    TRANSACTION_ROW,
)
from docspark.sources.dictionary import Dictionary
from docspark.sources.pages import decode_pages, failed_pages, good_pages
from docspark.sources.tables import claim_number, kept_part, read_or_empty

PAGE = ["job_id", "page"]
NO_PREVIOUS = "no result of the stage before"
# Metadata of a work row: the writes that hold the result before it, and the page headers.
RESULT_WRITE, HEADER_WRITE = "docspark.result_write", "docspark.header_write"


def _stored_schema(*fields: T.StructField) -> T.StructType:
    place = [T.StructField(c, T.StringType()) for c in ("stage", "version")]
    return T.StructType([*fields, *place, T.StructField("run", T.IntegerType())])


KEY_FIELDS = (T.StructField("job_id", T.StringType()), T.StructField("page", T.IntegerType()))
HEADER_FIELDS = tuple(
    T.StructField(c, T.StringType()) for c in ("text", "document_type", "fields")
)
STORED = {
    "work": _stored_schema(*[f for f in MESSAGE.fields if f.name not in ("stage", "version")]),
    "headers": _stored_schema(*KEY_FIELDS, *HEADER_FIELDS),
    "transactions": _stored_schema(*TRANSACTION_ROW.fields),
    "failed": _stored_schema(*KEY_FIELDS, T.StructField("error", T.StringType())),
    "done": _stored_schema(*KEY_FIELDS),
}

@dataclass(frozen=True)
class StageData:
    """Rows between stages. Header fields travel as JSON text.

    `failed` has job_id, page and error. None means unchanged.
    """

    headers: DataFrame | None = None
    transactions: DataFrame | None = None
    failed: DataFrame | None = None


@dataclass(frozen=True)
class Stage:
    """A versioned step. `fn` gets the work rows and the data so far."""

    name: str
    version: str
    fn: Callable[[DataFrame, StageData], StageData]


@dataclass(frozen=True)
class Chain:
    """Stages in order; adding one changes none of the others."""

    stages: Sequence[Stage]

    def run(self, work: DataFrame, data: StageData) -> StageData:
        """All stages as one plan, without stored state."""
        failed = data.failed
        for stage in self.stages:
            out = stage.fn(work, data)
            data = StageData(out.headers or data.headers, out.transactions or data.transactions)
            if out.failed is not None:
                failed = out.failed if failed is None else failed.unionByName(out.failed)
        return StageData(data.headers, data.transactions, failed)


def extract_stage(documents: DataFrame, extractor: Extractor = rule_extractor) -> Stage:
    def fn(work: DataFrame, _: StageData) -> StageData:
        made = extract_pages(work, documents, extractor)
        unread = made.filter(F.col("error").isNotNull()).select(*PAGE, "error")
        decoded = decode_pages(made.filter(F.col("error").isNull()).select(*PAGE, "body"))
        good = good_pages(decoded)
        return StageData(
            good.select(*PAGE, "text", "document_type", F.to_json("fields").alias("fields")),
            explode_transactions(good),
            unread.unionByName(failed_pages(decoded)),
        )

    return Stage(*EXTRACT_STAGE, fn)


def normalize_stage() -> Stage:
    def fn(_: DataFrame, data: StageData) -> StageData:
        fields = F.try_parse_json("fields")
        issuers = data.headers.select(
            *PAGE, string_field(fields, "issuer_name", "issuer").alias("issuer")
        ).filter(F.col("issuer") != "")
        rows = data.transactions.join(issuers, PAGE, "left")
        return StageData(transactions=normalize_card_statement(rows).drop("issuer"))

    return Stage(*NORMALIZE_STAGE, fn)


def enrich_stage(dictionary: Dictionary) -> Stage:
    def fn(_: DataFrame, data: StageData) -> StageData:
        return StageData(transactions=enrich_transactions(data.transactions, dictionary))

    return Stage(*ENRICH_STAGE, fn)


@dataclass(frozen=True)
class StageStore:
    """Folder with the state log and the stored rows of all stages."""

    spark: SparkSession
    root: str
    bucket: str
    live_from: int = 0  # writes below this number have lapsed

    @property
    def log_root(self) -> str:
        return f"{self.root}/state"

    def state(self, name: str, version: str, work: DataFrame | None = None, columns: Sequence[str] = ()) -> DataFrame:
        """Newest page records of one stage, read from its own partition; of `work`'s jobs if given.

        Name columns to carry only those beside the key.
        """
        log = read_state_log(self.spark, self.log_root, work)
        return latest_state(stages_for(log, name, version), *columns)

    def claim(self, now: Column | None = None) -> int:
        """A write number of its own: what is stored under it is one attempt."""
        return claim_number(self.spark, f"{self.root}/claims", now)

    def save(self, table: str, df: DataFrame, name: str, version: str, write: int) -> None:
        place = f"stage={quote(name)}/version={quote(version)}/run={write}"
        df.drop("stage", "version").write.mode("overwrite").parquet(f"{self.root}/{table}/{place}")

    def stored(self, table: str, name: str, version: str) -> DataFrame:
        rows = read_or_empty(self.spark, f"{self.root}/{table}", STORED[table])
        own = (F.col("stage") == name) & (F.col("version") == version)
        return rows.filter(own & (F.col("run") >= self.live_from))

    def load(self, table: str, name: str, version: str) -> DataFrame:
        """Stored rows of one stage, of each page's newest finished run."""
        newest = (
            self.stored("done", name, version).groupBy(*PAGE).agg(F.max("run").alias("run"))
        )
        return (
            self.stored(table, name, version)
            .join(newest, [*PAGE, "run"], "left_semi")
            .drop("run", "stage", "version")
        )

    def rows_of(self, table: str, name: str, version: str, keys: DataFrame) -> DataFrame:
        """Stored rows of (job_id, page, run), read from the partitions of those runs alone."""
        runs = [r.run for r in keys.select("run").distinct().collect()]
        rows = self.stored(table, name, version).filter(F.col("run").isin(runs))
        return rows.join(keys, [*PAGE, "run"], "left_semi").drop("run", "stage", "version")

    def finished_runs(self, name: str, version: str, jobs: DataFrame) -> DataFrame:
        """(job_id, page, run): the write that holds each succeeded page of these jobs."""
        done = self.state(name, version, jobs, ("status", "seq")).filter(F.col("status") == SUCCEEDED)
        runs = done.select(*PAGE, write_of(F.col("seq")).alias("run"))
        return runs.join(jobs.select("job_id").distinct(), "job_id", "left_semi")

    def purge(self, now: Column, days: int = RETENTION_DAYS) -> int:
        """Let go of all writes older than `days`, in every table at once."""
        pointer = lapse(self.spark, self.root, now, days)
        tables = dict.fromkeys((*STORED, "taken", "routed"), "run")
        drop_below(self.spark, self.root, tables, pointer)
        drop_below(self.spark, self.root, {"state": "batch"}, pointer, per_write=2)
        drop_below(self.spark, self.root, {"claims": "claim"}, pointer - 1)
        return pointer


def write_of(seq: Column) -> Column:
    """The write that a state row of `run_stage` belongs to: two rows a write, begun and ended."""
    return F.shiftright(seq, 1).cast("int")


def run_stage(
    store: StageStore,
    stage: Stage,
    work: DataFrame,
    now: Column,
    run: int,
    previous: tuple[str, str] | None = None,
    header_stage: tuple[str, str] = EXTRACT_STAGE,
    days: int = RETENTION_DAYS,
    fallback: tuple[str, str] | None = None,
) -> DataFrame:
    """Run one stage on its work that is not done, and return the next work.

    Work of other stages is passed on as it is. The stage before a row is the
    one before it in its chain; `previous` is that of rows without a chain, as
    `fallback` is the stage after them. A page without a result of the stage
    before fails.

    A row's metadata names the write that holds the result before it, so that
    a micro-batch reads the partitions of those writes, however many others
    there are. Rows that come without are looked up among the finished pages.

    What is done is asked of the state log alone, key by key. Results are
    stored first, under a write number of this attempt, then the state rows
    that vouch for them, so an attempt cut short leaves nothing that is read.
    `run` is the caller's name for the attempt and may come again.
    """
    write = store.claim(now)
    work = work.select(*[F.col(f.name).cast(f.dataType) for f in MESSAGE.fields])
    # Stored first: the plan that made the work runs once, whatever is asked of it.
    work = kept_part(work, f"{store.root}/taken", "run", write)
    mine = (F.col("stage") == stage.name) & (F.col("version") == stage.version)
    one_each = [*PAGE, "stage", "version"]
    _execute(store, stage, work.filter(mine), one_each, now, write, previous, header_stage, days)
    # Work at the end of its chain leaves, so the log is not asked about it.
    following = next_stage(F.col("chain"), F.col("chain_idx"))["name"]
    goes_on = F.when(F.size("chain") > 0, following).otherwise(fallback[0]) if fallback else following
    onward = work.filter(mine).filter(goes_on.isNotNull())
    log = stages_for(read_state_log(store.spark, store.log_root, onward), stage.name, stage.version)
    finished = succeeded_keys(latest_state(log, "status", "expires_at", "result_uri", "seq"), now)
    written = finished.select(*PAGE, "result_uri", write_of(F.col("seq")).alias("_write"))
    holders = [RESULT_WRITE, HEADER_WRITE] if (stage.name, stage.version) == header_stage else [RESULT_WRITE]
    carried = _carrying(work.filter(mine).dropDuplicates(one_each).filter(goes_on.isNotNull()).join(written, PAGE), *holders)
    # Stored, as plans that read one folder at two times may share one scan.
    return kept_part(route_next(carried, fallback).unionByName(work.filter(~mine)), f"{store.root}/routed", "run", write)


def _carrying(work: DataFrame, *holders: str) -> DataFrame:
    """Work whose metadata names `_write` under each of the names."""
    given = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    rest = F.map_filter(given, lambda k, _: ~k.isin(*holders))
    named = F.create_map(*[x for h in holders for x in (F.lit(h), F.col("_write").cast("string"))])
    return work.withColumn("metadata", F.map_concat(rest, named)).drop("_write")


def _with_previous(work: DataFrame, previous: tuple[str, str] | None) -> DataFrame:
    """Add `_before`, the stage before in the row's chain, and the writes its metadata names."""
    before = F.when(F.col("chain_idx") > 0, F.get("chain", F.col("chain_idx") - 1))
    own = F.when(before.isNotNull(), F.struct(before["name"].alias("name"), before["version"].alias("version")))
    for name, column in ((RESULT_WRITE, "_result"), (HEADER_WRITE, "_headers")):
        work = work.withColumn(column, F.try_element_at("metadata", F.lit(name)).try_cast("int"))
    if previous is None:
        return work.withColumn("_before", own)
    given = F.struct(F.lit(previous[0]).alias("name"), F.lit(previous[1]).alias("version"))
    return work.withColumn("_before", F.when(F.size("chain") > 0, own).otherwise(given))


def _runs(store: StageStore, work: DataFrame, column: str, name: str, version: str, known: bool) -> DataFrame:
    """(job_id, page, run): the write that each row names, or else the newest finished one."""
    named = work.filter(F.col(column).isNotNull()).select(*PAGE, F.col(column).alias("run"))
    if known:
        return named
    asked = work.filter(F.col(column).isNull()).select(*PAGE)
    newest = store.stored("done", name, version).join(asked, PAGE, "left_semi")
    return named.unionByName(newest.groupBy(*PAGE).agg(F.max("run").alias("run")))


def _input(store: StageStore, work: DataFrame, header_stage: tuple[str, str], write: int) -> tuple[StageData, DataFrame]:
    """(rows of the stages before, work that has none to go on from)."""
    named = work.where("_before IS NOT NULL").groupBy("_before.name", "_before.version").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("_result").isNull()).alias("loose"),
        F.count_if(F.col("_headers").isNull()).alias("headless"),
    )
    headers, rows, done = [], [], []
    for name, version, n, loose, headless in named.collect():  # one per stage that chains name
        own = work.filter((F.col("_before.name") == name) & (F.col("_before.version") == version))
        # Stored, as it is asked for several times.
        runs = kept_part(_runs(store, own, "_result", name, version, not loose), f"{store.root}/asked", "run", f"{write}-{len(rows)}")
        rows.append(store.rows_of("transactions", name, version, runs).select(*TRANSACTION_ROW.fieldNames()))
        # Of rows that name no write, those found among the finished pages are finished.
        done.append(runs.select(*PAGE) if loose == n else store.rows_of("done", name, version, runs).select(*PAGE))
        alike = (name, version) == header_stage and loose == headless == n
        held = runs if alike else _runs(store, own, "_headers", *header_stage, not headless)
        headers.append(store.rows_of("headers", *header_stage, held))
    if not rows:
        return StageData(), work.limit(0)
    missing = work.filter(F.col("_before").isNotNull()).join(reduce(DataFrame.unionByName, done), PAGE, "left_anti")
    return StageData(reduce(DataFrame.unionByName, headers), reduce(DataFrame.unionByName, rows)), missing


def _execute(
    store: StageStore,
    stage: Stage,
    work: DataFrame,
    one_each: list[str],
    now: Column,
    write: int,
    previous: tuple[str, str] | None,
    header_stage: tuple[str, str],
    days: int,
) -> None:
    name, version = stage.name, stage.version

    def kept(table: str) -> DataFrame:
        return store.stored(table, name, version).filter(F.col("run") == write).drop("run")

    log = stages_for(read_state_log(store.spark, store.log_root, work), name, version)
    pending = work.dropDuplicates(one_each).join(settled_keys(log, now), one_each, "left_anti")
    store.save("work", pending, name, version, write)
    todo = kept("work")
    if todo.isEmpty():
        return
    started, ended_at = 2 * write, 2 * write + 1
    append_state(running_rows(todo, now, started, days), store.log_root, started)

    linked = _with_previous(todo, previous)
    data, missing = _input(store, linked, header_stage, write)
    missing = missing.select(*PAGE, F.lit(NO_PREVIOUS).alias("error"))
    ready = todo.join(missing.select(*PAGE), PAGE, "left_anti")
    out = stage.fn(ready, data)
    if out.headers is not None:
        store.save("headers", out.headers, name, version, write)
    store.save("transactions", out.transactions, name, version, write)
    failures = missing if out.failed is None else missing.unionByName(out.failed.select(*PAGE, "error"))
    store.save("failed", failures, name, version, write)
    failed = kept("failed").select(*PAGE, "error")
    store.save("done", todo.select(*PAGE).join(failed, PAGE, "left_anti"), name, version, write)

    following = F.coalesce(next_stage(F.col("chain"), F.col("chain_idx"))["name"], F.lit(""))
    key = page_key(*[F.col(c) for c in (*PAGE, "stage", "version")])
    ended = todo.join(failed.withColumn("_failed", F.lit(True)), PAGE, "left")
    ended = ended.withColumn("result_uri", uri_for(store.bucket, key)).withColumn("next_stage", following)
    append_state(ended_rows(ended, F.col("_failed").isNotNull(), now, ended_at, days), store.log_root, ended_at)
