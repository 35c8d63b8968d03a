"""The registered queries: each operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import (
    chain_literal,
    decode_chain,
    encode_chain,
    expires_at,
    format_rfc3339,
    mime_from_uri,
    parse_uri,
    slugify,
    string_field,
    tenant_safe,
    unicode_trim,
    uri_for,
)
from docspark.functions.keys import DOCUMENT_DEFAULT_TYPE
from docspark.operators import archive, extract, index, merge, results, rollup, state
from docspark.operators import jobs as job_ops
from docspark.operators import pages as page_ops
from docspark.operators.transactions import (
    enrich_transactions,
    explode_transactions,
    normalize_card_statement,
    page_issuer,
)
from docspark.plans import adapters as view
from docspark.plans import run as runs
from docspark.plans.chain import Stage, StageData, StageStore, enrich_stage, extract_stage, normalize_stage, run_stage
from docspark.plans.run import Workspace, run_jobs
from docspark.schema import (
    CHAIN,
    CHAIN_REGISTRY,
    DEFAULT_CHAIN_ID,
    ENRICH_STAGE,
    EXTRACT_STAGE,
    MAX_DELIVERIES,
    MESSAGE,
    RETENTION_DAYS,
    TRANSACTION_ROW,
    VISIBILITY_SECONDS,
)
from docspark.session import configure, work_dir
from docspark.sources.dictionary import seed_dictionary
from docspark.sources.pages import decode_pages, failed_pages, good_pages, latest_page_results, write_page_results
from docspark.sources.tables import kept_part, read_or_empty, replace_part
from docspark.streaming import completion, messages
from docspark.streaming import state as stream_state
from docspark.streaming.events import DELIVERED, silent
from docspark.streaming.events import stream_events as stream_events_of

# What the gate and the skip rule read of a state row.
PROGRESS = ("status", "expires_at")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_card_statement(view.transactions(spark, sf_dir))


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_transactions(_normalized(spark, sf_dir), seed_dictionary(spark))


@query
def normalize_rows(spark, sf_dir):
    return _normalized(spark, sf_dir).select(
        "job_id", "page", "pos", "issuer", "merchant", "amount", "date"
    )


@query
def enrich_rows(spark, sf_dir):
    rows = enrich_transactions(view.transactions(spark, sf_dir), seed_dictionary(spark))
    return rows.select(
        "job_id", "page", "pos", "merchant", "amount", "foreign_currency",
        "category", "merchant_normalized", "country",
    )


@query
def effective_merchant_totals(spark, sf_dir):
    return rollup.merchant_totals(_enriched(spark, sf_dir))


@query
def aggregate_merchant(spark, sf_dir):
    return rollup.aggregate(view.transactions(spark, sf_dir), "merchant", " STARBUCKS ")


@query
def aggregate_foreign_currency(spark, sf_dir):
    return rollup.aggregate(view.transactions(spark, sf_dir), "foreign_currency", "MYR")


@query
def aggregate_currency(spark, sf_dir):
    return rollup.aggregate(view.transactions(spark, sf_dir), "currency", "USD")


@query
def aggregate_effective_currency(spark, sf_dir):
    return rollup.aggregate(
        view.transactions(spark, sf_dir), "currency", "JPY", effective_currency=True
    )


@query
def aggregate_by_merchant(spark, sf_dir):
    return rollup.aggregate_by(view.transactions(spark, sf_dir), "merchant")


@query
def aggregate_by_foreign_currency(spark, sf_dir):
    return rollup.aggregate_by(view.transactions(spark, sf_dir), "foreign_currency")


@query
def aggregate_by_country(spark, sf_dir):
    return rollup.aggregate_by(_enriched(spark, sf_dir), "country")


@query
def aggregate_rows(spark, sf_dir):
    return rollup.aggregate_rows(view.transactions(spark, sf_dir), "foreign_currency", "SGD")


@query
def latest_state(spark, sf_dir):
    newest = state.latest_state(view.state_log(spark, sf_dir))
    return newest.withColumn("ts", format_rfc3339(F.col("ts")))


@query
def stages_final(spark, sf_dir):
    newest = state.latest_state(view.state_log(spark, sf_dir), "status", "result_uri", "error")
    return state.stages_for(newest, *ENRICH_STAGE).select(
        "job_id", "page", "status", "result_uri", "error"
    )


@query
def unexpired_state(spark, sf_dir):
    newest = state.latest_state(view.state_log(spark, sf_dir), "idempotency_key", "status", "expires_at")
    return state.unexpired(newest, view.now()).select(
        "idempotency_key", "status", "expires_at"
    )


@query
def stage_log_after_purge(spark, sf_dir):
    """The log purged of what has lapsed, and written to once more."""
    root = work_dir(spark, "purge")
    rows = view.state_log(spark, sf_dir)
    state.append_state(rows, f"{root}/log", 0)
    state.purge_expired(spark, f"{root}/log", f"{root}/kept", view.now())
    state.append_state(rows.limit(0), f"{root}/kept", 0)
    return state.read_state_log(spark, f"{root}/kept").select(
        "idempotency_key", "seq", "status", "expires_at"
    )


def _enriched_twice(spark: SparkSession, sf_dir: str, name: str, had_result) -> StageStore:
    """The enrich stage over stored rows, twice under one run number."""
    store = StageStore(spark, work_dir(spark, name), "work")
    tx = view.transactions(spark, sf_dir).select(*TRANSACTION_ROW.fieldNames())
    write = store.claim()
    store.save("transactions", tx, *EXTRACT_STAGE, write)
    kept = store.stored("transactions", *EXTRACT_STAGE)
    pages = kept_part(kept.select("job_id", "page").distinct(), f"{store.root}/pages", "run", write)
    store.save("done", pages.filter(had_result), *EXTRACT_STAGE, write)
    values = {
        "job_id": F.col("job_id"),
        "page": F.col("page"),
        "stage": F.lit(ENRICH_STAGE[0]),
        "version": F.lit(ENRICH_STAGE[1]),
        "chain": F.array().cast(CHAIN),
        "chain_idx": F.lit(0),
        "metadata": F.create_map(),
    }
    work = pages.select(*[values.get(f.name, F.lit("")).cast(f.dataType).alias(f.name) for f in MESSAGE.fields])
    stage = enrich_stage(seed_dictionary(spark))
    for _ in range(2):
        run_stage(store, stage, work, view.now(), 0, previous=EXTRACT_STAGE)
    return store


@query
def stage_run_twice(spark, sf_dir):
    store = _enriched_twice(spark, sf_dir, "run-twice", F.lit(True))
    return store.load("transactions", *ENRICH_STAGE).select(
        "job_id", "page", "pos", "merchant", "amount", "foreign_currency", "category", "merchant_normalized", "country"
    )


@query
def failed_without_previous(spark, sf_dir):
    store = _enriched_twice(spark, sf_dir, "no-previous", F.col("page") % 3 != 0)
    return store.state(*ENRICH_STAGE, columns=("status", "error")).select("job_id", "page", "status", "error")


@query
def retention_stamps(spark, sf_dir):
    rows = view.state_log(spark, sf_dir)
    return rows.select(
        "seq",
        expires_at(F.col("ts"), RETENTION_DAYS).alias("kept_until"),
        expires_at(F.col("ts"), 0).alias("kept_forever"),
    )


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (job, page, stage) ever delivered, as work to be looked at."""
    return view.state_log(spark, sf_dir).select("job_id", "page", "stage", "version").distinct()


@query
def pending_work(spark, sf_dir):
    newest = state.latest_state(view.state_log(spark, sf_dir), *PROGRESS)
    return state.pending_work(_work(spark, sf_dir), newest, view.now())


@query
def route_next(spark, sf_dir):
    """Succeeded rows of the log, sent on by position in the default chain."""
    stages = CHAIN_REGISTRY[DEFAULT_CHAIN_ID]
    newest = state.latest_state(view.state_log(spark, sf_dir), "status", "input_uri", "result_uri")
    position = F.array_position(F.array(*[F.lit(s[0]) for s in stages]), F.col("stage"))
    done = newest.filter(F.col("status") == "succeeded").select(
        "job_id", "page", "stage", "version", "input_uri", "result_uri",
        F.lit("").alias("document_id"),
        F.lit("").alias("previous_uri"),
        F.lit("").alias("prompt_profile_id"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        F.when(F.col("version") == "v1", chain_literal(stages))
        .otherwise(F.array().cast(CHAIN))
        .alias("chain"),
        (position - 1).cast("int").alias("chain_idx"),
    )
    return page_ops.route_next(done, ("audit", "v1")).select(
        "job_id", "page", "stage", "version", "previous_uri", "chain_idx"
    )


@query
def job_status(spark, sf_dir):
    newest = state.latest_state(view.state_log(spark, sf_dir), *PROGRESS)
    return job_ops.job_status(view.jobs(spark, sf_dir), newest, view.now())


@query
def check_jobs(spark, sf_dir):
    newest = state.latest_state(view.state_log(spark, sf_dir), *PROGRESS)
    return job_ops.check_jobs(view.jobs(spark, sf_dir), newest, view.now())


@query
def bind_chain(spark, sf_dir):
    bound = job_ops.bind_chain(view.jobs(spark, sf_dir))
    return bound.select(
        "job_id", "chain_id", encode_chain(F.col("chain")).alias("chain_json"), "bind_error"
    )


@query
def effective_chain(spark, sf_dir):
    stored = view.jobs(spark, sf_dir).withColumn(
        "chain", decode_chain(encode_chain(F.col("chain")))
    )
    return job_ops.with_chain_ends(job_ops.effective_chain(stored)).select(
        "job_id", "first_stage", "first_queue", "final_stage", "final_version",
        F.array_join(F.transform("chain", lambda s: s["name"]), ",").alias("stages"),
    )


def _job_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "job_id", "status", "input_uri", "result_uri", "page_count", "error", "mode",
        "chain_id", F.size("chain").alias("chain_length"), "expires_at", "updated_at",
    )


@query
def upsert_jobs(spark, sf_dir):
    """Jobs seen in the events and the conversations, submitted over the orders."""
    seen = view.state_log(spark, sf_dir).groupBy("job_id").agg(F.max("page").alias("page_count"))
    spoken = view.conversation_jobs(spark, sf_dir).select("job_id", "page_count")
    submitted = seen.unionByName(spoken).withColumn(
        "input_uri", F.concat(F.lit("s3://inbox/jobs/"), "job_id", F.lit("/again.pdf"))
    )
    return _job_columns(job_ops.submit_jobs(view.jobs(spark, sf_dir), submitted))


@query
def mark_failed_jobs(spark, sf_dir):
    newest = state.latest_state(view.state_log(spark, sf_dir), *PROGRESS)
    jobs = view.jobs(spark, sf_dir)
    failed = job_ops.check_jobs(jobs, newest, view.now()).filter(F.col("decision") == "failed")
    spoken = view.conversation_jobs(spark, sf_dir).filter(F.col("status") == "failed")
    rows = failed.select("job_id").unionByName(spoken.select("job_id"))
    return _job_columns(
        job_ops.mark_failed_jobs(jobs, rows.withColumn("error", F.lit(job_ops.PAGE_FAILURE)))
    )


@query
def commit_merged_jobs(spark, sf_dir):
    merged = _merged(spark, sf_dir)
    return _job_columns(
        job_ops.commit_merged_jobs(
            view.jobs(spark, sf_dir).unionByName(
                view.conversation_jobs(spark, sf_dir), allowMissingColumns=True
            ),
            merged.documents,
        )
    )


@query
def validate_jobs(spark, sf_dir):
    checked = job_ops.validate_jobs(view.jobs(spark, sf_dir))
    return checked.select("job_id", F.array_join("errors", "; ").alias("errors"))


@query
def tenant_checks(spark, sf_dir):
    jobs = view.jobs(spark, sf_dir)
    return jobs.select("job_id", "tenant_id", tenant_safe(F.col("tenant_id")).alias("safe"))


@query
def fan_out_pages(spark, sf_dir):
    jobs = job_ops.effective_chain(view.jobs(spark, sf_dir)).filter(F.size("chain") > 0)
    numbers = F.filter(F.sequence(F.lit(0), F.col("page_count")), lambda i: i > 0)
    split = F.transform(
        numbers,
        lambda i: uri_for(view.BUCKET, F.concat(F.col("job_id"), F.lit("/"), i.cast("string"))),
    )
    pages = job_ops.page_uris(F.col("input_uri"), F.col("mode"), split)
    return page_ops.fan_out_pages(jobs.withColumn("pages", pages)).select(
        "job_id", "page", "stage", "version", "input_uri", "chain_idx"
    )


@query
def number_pages(spark, sf_dir):
    return page_ops.number_pages(view.conversation_files(spark, sf_dir)).select(
        "job_id", "name", "page", "page_error"
    )


def _merged(spark: SparkSession, sf_dir: str) -> merge.Merged:
    jobs, records, bodies = view.conversation_records(spark, sf_dir)
    return merge.merge_jobs(jobs, records, bodies, view.BUCKET)


@query
def merge_jobs(spark, sf_dir):
    return _merged(spark, sf_dir).pages


@query
def merge_documents(spark, sf_dir):
    return _merged(spark, sf_dir).documents


@query
def merge_rejects(spark, sf_dir):
    return _merged(spark, sf_dir).rejects


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_pages(view.line_pages(spark, sf_dir))


@query
def decode_rows(spark, sf_dir):
    """Decoded pages as flat transaction rows with the page's issuer."""
    pages = page_issuer(good_pages(_decoded(spark, sf_dir)))
    return explode_transactions(pages, ("document_type", "issuer")).select(
        "job_id", "page", "pos", "document_type", "issuer", "date", "merchant", "amount", "country"
    )


@query
def decode_pages_header(spark, sf_dir):
    pages = good_pages(_decoded(spark, sf_dir))
    return pages.select(
        "job_id",
        "page",
        "text",
        "document_type",
        string_field(F.col("fields"), "issuer_name", "issuer").alias("issuer"),
        F.coalesce(F.size("transactions"), F.lit(0)).alias("row_count"),
    )


@query
def page_results_roundtrip(spark, sf_dir):
    """Page results stored under versions that look like numbers, rewritten in part, and read back."""
    root = work_dir(spark, "page-results")
    pages = view.line_pages(spark, sf_dir).select("job_id", "page").distinct().select(
        "job_id", "page", F.length("job_id").alias("size"), F.lit("gemini").alias("stage"),
        view.pick(F.col("page") % 3, "2.10", "2.1", "007").alias("version"),
    )
    write_page_results(pages, root, 0)
    again = pages.filter((F.col("page") % 2 == 0)).withColumn("size", -F.col("size"))
    write_page_results(again, root, 1)
    read = [latest_page_results(spark, root, "gemini", v) for v in ("2.10", "2.1", "007")]
    rows = read[0].unionByName(read[1]).unionByName(read[2])
    return rows.groupBy("version", "page").agg(
        F.count("*").alias("pages"), F.min("size").alias("least"), F.max("size").alias("most")
    )


@query
def failed_page_rows(spark, sf_dir):
    return failed_pages(_decoded(spark, sf_dir))


def _conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return good_pages(decode_pages(view.conversation_pages(spark, sf_dir), "result"))


@query
def flatten_fields(spark, sf_dir):
    return archive.flatten_fields(_conversation_pages(spark, sf_dir))


@query
def document_headers(spark, sf_dir):
    return archive.document_headers(_conversation_pages(spark, sf_dir)).drop("max_page")


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive_targets(
        archive.document_headers(_conversation_pages(spark, sf_dir)),
        view.conversation_jobs(spark, sf_dir),
        view.archive_now(),
        view.ARCHIVE_BUCKET,
    )


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests an earlier run is taken to have left for the receipts."""
    good = _targets(spark, sf_dir).filter(F.col("error").isNull())
    return archive.build_manifests(
        good.filter(F.col("document_type") == "receipt"), view.now()
    )


@query
def archive_targets(spark, sf_dir):
    return _targets(spark, sf_dir).select(
        "job_id", "tenant", "year", "month", "issuer_slug", "card_slug", "document_type",
        "archive_uri", "raw_uri", "manifest_uri", "error",
    )


@query
def archive_documents(spark, sf_dir):
    """Transactions of the documents still to be archived, with their place."""
    pending = archive.pending_archives(_targets(spark, sf_dir), _manifests(spark, sf_dir))
    rows = explode_transactions(_conversation_pages(spark, sf_dir))
    return archive.archived_transactions(rows, pending).select(
        "job_id", "tenant", "year", "month", "card_slug", "page", "pos", "date", "merchant", "amount"
    )


@query
def archived_before(spark, sf_dir):
    return archive.archived_view(_targets(spark, sf_dir), _manifests(spark, sf_dir))


@query
def archive_collisions(spark, sf_dir):
    good = _targets(spark, sf_dir).filter(F.col("error").isNull())
    return archive.archive_winners(good)


def _archived(
    spark: SparkSession, roots: archive.ArchiveRoots, sf_dir: str, targets: DataFrame, at: str, run: int,
    vouched: bool = True,
) -> None:
    """Archive targets in one run; one that is not vouched for ends before its manifests."""
    pages = _conversation_pages(spark, sf_dir)
    archive.write_archive(targets, explode_transactions(pages), archive.flatten_fields(pages), roots, run)
    if vouched:
        archive.write_manifests(archive.build_manifests(targets, F.lit(at).cast("timestamp")), roots, run)


def _stored_manifests(spark: SparkSession, roots: archive.ArchiveRoots) -> DataFrame:
    return read_or_empty(spark, roots.manifests, archive.MANIFEST)


def _current(spark: SparkSession, roots: archive.ArchiveRoots) -> DataFrame:
    """Current documents with the number of their stored rows."""
    rows = archive.read_current_archive(spark, roots, "transactions").groupBy("job_id").agg(F.count("*").alias("rows"))
    headers = archive.read_current_archive(spark, roots, "documents")
    return headers.join(rows, "job_id", "left").select(
        "archive_uri", "job_id", "tenant", "year", "month", "card_slug", F.coalesce("rows", F.lit(0)).alias("row_count")
    )


@query
def archive_after_crash(spark, sf_dir):
    """Receipts archived whole, then a run that dies before the manifests of the rest."""
    roots = archive.ArchiveRoots(work_dir(spark, "archive-crash"))
    good = _targets(spark, sf_dir).filter(F.col("error").isNull())
    receipt = F.col("document_type") == "receipt"
    _archived(spark, roots, sf_dir, good.filter(receipt), view.NOW, 0)
    _archived(spark, roots, sf_dir, good.filter(~receipt), view.ARCHIVE_NOW, 1, vouched=False)
    return _current(spark, roots)


@query
def archive_rerun(spark, sf_dir):
    """As above, then run again, and once more with nothing left to do; compacted in between."""
    roots = archive.ArchiveRoots(work_dir(spark, "archive-rerun"))
    good = _targets(spark, sf_dir).filter(F.col("error").isNull())
    receipt = F.col("document_type") == "receipt"
    _archived(spark, roots, sf_dir, good.filter(receipt), view.NOW, 0)
    _archived(spark, roots, sf_dir, good.filter(~receipt), view.ARCHIVE_NOW, 1, vouched=False)
    for run in (2, 4):
        pending = archive.pending_archives(good, _stored_manifests(spark, roots))
        _archived(spark, roots, sf_dir, pending, view.ARCHIVE_NOW, run)
        archive.compact_archive(spark, roots, run + 1)
    archive.drop_superseded(spark, roots)
    return _current(spark, roots)


@query
def archive_last_write(spark, sf_dir):
    """Two runs that share archive keys; the one with the later time was written first."""
    roots = archive.ArchiveRoots(work_dir(spark, "archive-last"))
    good = _targets(spark, sf_dir).filter(F.col("error").isNull())
    receipt = F.col("document_type") == "receipt"
    _archived(spark, roots, sf_dir, good.filter(receipt), view.ARCHIVE_NOW, 0)
    archive.compact_archive(spark, roots, 1)
    _archived(spark, roots, sf_dir, good.filter(~receipt), view.NOW, 2)
    return _current(spark, roots)


@query
def manifests(spark, sf_dir):
    good = _targets(spark, sf_dir).filter(F.col("error").isNull())
    return archive.build_manifests(good, view.archive_now()).select(
        "job_id",
        "tenant_id",
        F.col("source.kind").alias("kind"),
        F.col("source.issuer").alias("issuer"),
        F.col("source.card_name").alias("card_name"),
        F.col("source.raw_uri").alias("raw_uri"),
        F.col("results.transactions").alias("archive_uri"),
        F.col("chain.id").alias("chain_id"),
        F.array_join("chain.stages", ",").alias("stages"),
        "archived_at",
    )


def _index_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for every conversation; one tenant in three is not its own."""
    jobs = view.conversation_jobs(spark, sf_dir)
    asked = jobs.select(
        "job_id",
        F.when(F.col("page_count") % 3 == 0, "acme").otherwise(F.col("tenant_id")).alias("tenant_id"),
    )
    return index.index_requests(asked, _manifests(spark, sf_dir), jobs)


@query
def index_requests(spark, sf_dir):
    return _index_requests(spark, sf_dir)


def _reply(batch):
    """A stand-in index service: the answer depends on the job number."""
    number = batch["job_id"].str.rsplit("_", n=1).str[-1].astype(int)
    codes = [200, 201, 400, 429, 503, 302, 204]
    return batch[["job_id"]].assign(
        http_status=[codes[n % 7] for n in number],
        status="indexed",
        collection="transactions",
        index_job_id="idx_" + batch["job_id"],
        vector_count=number % 100,
        embedding_model="model-a",
        indexed_at="2026-07-02T00:00:00Z",
    )


@query
def index_outcomes(spark, sf_dir):
    good = _targets(spark, sf_dir).filter(F.col("error").isNull())
    made = archive.build_manifests(good, view.archive_now())
    asked = good.select("job_id", F.col("tenant").alias("tenant_id"))
    requests = index.index_requests(asked, made, good.select("job_id"))
    before = index.build_sidecars(
        index.send_requests(_index_requests(spark, sf_dir).filter(F.col("error").isNull()), _reply),
        view.archive_now(),
    )
    sent = index.send_requests(index.pending_index(requests, before), _reply)
    return sent.select(
        "job_id", "tenant_id", "result_uri", "http_status", "outcome",
        F.when(F.col("outcome") == "ok", F.col("index_job_id")).alias("index_job_id"),
    )


@query
def indexed_before(spark, sf_dir):
    requests = _index_requests(spark, sf_dir).filter(F.col("error").isNull())
    before = index.build_sidecars(index.send_requests(requests, _reply), view.archive_now())
    asked = view.conversation_jobs(spark, sf_dir).select("job_id")
    return index.indexed_view(asked, before, view.ARCHIVE_BUCKET)


@query
def terminal_events(spark, sf_dir):
    events = job_ops.terminal_events(view.jobs(spark, sf_dir))
    return events.withColumn("at", format_rfc3339(F.col("at")))


@query
def uri_parts(spark, sf_dir):
    pages = view.table(spark, sf_dir, "pages")
    key = F.col("page_id")
    ending = view.pick(key % 7, ".PNG", ".jpg", ".jpeg", ".webp", ".Pdf", ".", "")
    uri = F.concat(
        F.when(key % 10 == 0, "file://").otherwise("s3://"),
        F.regexp_replace("url", "^https?://", ""),
        ending,
    )
    bucket, stored_key = parse_uri(F.col("uri"))
    return pages.select("page_id", uri.alias("uri")).select(
        "page_id",
        bucket.alias("bucket"),
        stored_key.alias("stored_key"),
        mime_from_uri(F.col("uri")).alias("page_type"),
        mime_from_uri(F.col("uri"), DOCUMENT_DEFAULT_TYPE).alias("document_type"),
    )


@query
def text_slugs(spark, sf_dir):
    """Slugs and trimmed text of whole documents."""
    docs = view.table(spark, sf_dir, "documents")
    padded = F.concat(F.lit("　 "), F.col("text"), F.lit("  "))
    return docs.select(
        "doc_id",
        slugify(padded).alias("slug"),
        unicode_trim(padded).alias("trimmed"),
    )


@query
def job_result(spark, sf_dir):
    pages = results.job_result(
        view.conversation_jobs(spark, sf_dir), view.conversation_pages(spark, sf_dir)
    )
    return pages.select(
        "job_id", "page", "text", "document_type",
        F.coalesce(F.size("transactions"), F.lit(0)).alias("row_count"), "error",
    )


@query
def refused_results(spark, sf_dir):
    _, refused = results.read_merged(
        view.conversation_jobs(spark, sf_dir), view.conversation_pages(spark, sf_dir)
    )
    return refused


@query
def extract_pages(spark, sf_dir):
    """Every document as a text page, through the rule extractor."""
    docs = view.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("s3://inbox/doc_"), "doc_id", F.lit(".png")).alias("uri"),
        F.concat(F.lit("doc_"), "doc_id").alias("job_id"),
        F.encode("text", "UTF-8").alias("content"),
        (F.col("doc_id") % 9).alias("kind"),
    )
    work = docs.select(
        "job_id",
        F.lit(1).alias("page"),
        F.when(F.col("kind") == 0, "").otherwise(F.col("uri")).alias("input_uri"),
        F.when(F.col("kind") == 0, F.col("uri")).otherwise("").alias("previous_uri"),
        F.when(F.col("kind") == 1, "no-such-profile").otherwise("").alias("prompt_profile_id"),
    )
    made = extract.extract_pages(work, docs.select("uri", "content"))
    text = F.try_variant_get(F.try_parse_json("body"), "$.text", "string")
    return made.select(
        "job_id", "page", text.alias("text"), "model", "input_tokens", "output_tokens", "error"
    )


def _passed_on(batch):
    """An extractor for pages that are JSON already."""
    bodies = [bytes(c).decode("utf-8", "replace") for c in batch["content"]]
    return batch[[]].assign(
        body=bodies, provider="none", model="none", input_tokens=0, output_tokens=0, error=None
    )


def _run_all(spark: SparkSession, sf_dir: str, space: Workspace, requests: DataFrame, now) -> None:
    contents = view.conversation_contents(spark, sf_dir)
    stages = [extract_stage(contents, _passed_on), normalize_stage(), enrich_stage(seed_dictionary(spark))]
    run_jobs(space, requests, contents, stages, now, 0, _reply)


@query
def end_to_end_run(spark, sf_dir):
    """Conversations as jobs, from request to index: what became of each, run twice."""
    space = Workspace(spark, work_dir(spark, "run"), view.BUCKET, view.ARCHIVE_BUCKET)
    asked = view.conversation_requests(spark, sf_dir)
    for requests in (asked, asked.limit(0)):
        _run_all(spark, sf_dir, space, requests, view.archive_now())
    rows = space.merged("transactions").groupBy("job_id").agg(
        F.count("*").alias("row_count"), F.sum(F.col("amount").cast("long")).alias("total"),
        F.min("merchant_normalized").alias("merchant"), F.min("country").alias("country"),
    )
    archived = read_or_empty(spark, space.archive.manifests, archive.MANIFEST).select(
        "job_id", F.col("results.transactions").alias("archive_uri")
    )
    indexed = read_or_empty(spark, space.archive.sidecars, runs.SIDECAR_KEY).withColumn("indexed", F.lit(True))
    told = read_or_empty(spark, f"{space.root}/notified", DELIVERED).select("job_id", F.col("event").alias("told"))
    jobs = space.jobs(view.archive_now()).select("job_id", "status", "page_count", "error")
    out = jobs
    for side in (rows, archived, indexed, told):
        out = out.join(side, "job_id", "left")
    rejected = space.rejected().select(
        "job_id", F.lit("rejected").alias("status"), F.lit(0).alias("page_count"),
        F.array_join(F.array_sort("errors"), "; ").alias("error"),
    )
    return out.unionByName(rejected, allowMissingColumns=True).fillna({"row_count": 0, "total": 0, "indexed": False})


@query
def purged_artifacts(spark, sf_dir):
    """Two runs, of which the first has lapsed: what is left in every table."""
    space = Workspace(spark, work_dir(spark, "purge-run"), view.BUCKET, view.ARCHIVE_BUCKET)
    asked = view.conversation_requests(spark, sf_dir).filter(F.col("job_id").isNotNull())
    odd = F.pmod(F.split_part("job_id", F.lit("_"), F.lit(2)).cast("long"), F.lit(2)) == 1
    old, late = "2024-01-05 00:00:00", "2024-01-25 00:00:00"
    _run_all(spark, sf_dir, space, asked.filter(odd), F.lit(old).cast("timestamp"))
    _run_all(spark, sf_dir, space, asked.filter(~odd), F.lit(late).cast("timestamp"))
    space.purge(view.now())
    store = space.stages
    tables = {
        "log": state.read_state_log(spark, store.log_root),
        "headers": store.stored("headers", *EXTRACT_STAGE),
        "rows": store.stored("transactions", *ENRICH_STAGE),
        "merged": space.merged("documents"),
        "jobs": read_or_empty(spark, f"{space.root}/jobs", runs.JOB_LOG),
        "manifests": read_or_empty(spark, space.archive.manifests, archive.MANIFEST),
    }
    counted = [
        df.groupBy("job_id").agg(F.count("*").alias("rows")).withColumn("part", F.lit(name)) for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def _finish(stream) -> None:
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A pattern, as a stream takes no path of a single file.
    schema = view.table(spark, sf_dir, "events").schema
    return view.state_of(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]"))


@query
def stream_latest_state(spark, sf_dir):
    root = work_dir(spark, "stream-latest-state")
    _finish(
        stream_state.stream_latest_state(
            _event_stream(spark, sf_dir), f"{root}/log", f"{root}/checkpoint"
        )
    )
    newest = state.latest_state(state.read_state_log(spark, f"{root}/log"))
    return newest.withColumn("ts", format_rfc3339(F.col("ts")))


def _in_slices(spark: SparkSession, sf_dir: str, root: str, start: Callable) -> None:
    """Run a stream once for each stretch of events, from where it stopped before."""
    for i, events in enumerate(view.event_slices(spark, sf_dir)):
        events.write.parquet(f"{root}/inbox/{i}")
        inbox = spark.readStream.schema(events.schema).option("recursiveFileLookup", True)
        _finish(start(view.state_of(inbox.parquet(f"{root}/inbox"))))


@query
def stream_key_life(spark, sf_dir):
    """Stage keys carried over three arrivals of events; keys lapse in between and start anew."""
    root = work_dir(spark, "stream-key-life")
    _in_slices(
        spark, sf_dir, root,
        lambda rows: stream_state.stream_key_life(rows, f"{root}/keys", f"{root}/checkpoint"),
    )
    stored = read_or_empty(spark, f"{root}/keys", stream_state.STORED_LIFE)
    return stream_state.latest_life(stored).withColumn("ts", format_rfc3339(F.col("ts")))


@query
def stream_dedup(spark, sf_dir):
    """Deliveries that get through a stream which drops those of a key's last 14 days."""
    root = work_dir(spark, "stream-dedup")

    def start(rows: DataFrame):
        keys = rows.select("idempotency_key", "ts", "seq")
        with stream_state.stateful(spark):
            return (
                stream_state.drop_redelivered(keys, "ts")
                .writeStream.format("parquet")
                .option("checkpointLocation", f"{root}/checkpoint")
                .trigger(availableNow=True)
                .start(f"{root}/keys")
            )

    _in_slices(spark, sf_dir, root, start)
    return spark.read.parquet(f"{root}/keys").select("idempotency_key", "seq")


@query
def stream_finished_jobs(spark, sf_dir):
    """Jobs in the arrival of events that finished them, by counts kept in the stream."""
    root = work_dir(spark, "stream-finished-jobs")
    now = int(spark.sql(f"SELECT unix_timestamp(TIMESTAMP '{view.NOW}')").first()[0])
    _in_slices(
        spark, sf_dir, root,
        lambda rows: completion.stream_finished_jobs(
            rows, view.jobs(spark, sf_dir), f"{root}/finished", f"{root}/checkpoint", now
        ),
    )
    return read_or_empty(spark, f"{root}/finished", completion.FINISHED)


@query
def dead_letters(spark, sf_dir):
    found = state.dead_letters(view.state_log(spark, sf_dir), view.now())
    return found.withColumn("last_ts", format_rfc3339(F.col("last_ts")))


@query
def due_again(spark, sf_dir):
    return state.due_again(view.state_log(spark, sf_dir), view.now())


def _lines(spark: SparkSession, inbox: str) -> DataFrame:
    lines = spark.readStream.option("recursiveFileLookup", True).text(inbox)
    return messages.decode_messages(lines)


def _deaf(kind, rows):
    """A receiver that is down for jobs that failed."""
    if kind == "failed" and len(rows):
        raise ConnectionError("no answer")


@query
def stream_events(spark, sf_dir):
    """Events of committed jobs; the receiver of failures is down at first, and rows come twice."""
    root = work_dir(spark, "stream-events")
    committed = view.jobs(spark, sf_dir).drop("tenant_id")
    late = F.col("page_count") < 3
    for name, rows, receiver in (("a", committed.filter(~late), _deaf), ("b", committed, silent)):
        rows.write.parquet(f"{root}/jobs/{name}")
        outbox = spark.readStream.schema(committed.schema).option("recursiveFileLookup", True).parquet(f"{root}/jobs")
        _finish(stream_events_of(outbox, root, receiver, f"{root}/checkpoint", attempts=2))
    return read_or_empty(spark, f"{root}/delivered", DELIVERED)


@query
def stream_stages(spark, sf_dir):
    """Messages to stored pages, through two checkpoints that read the same inbox."""
    root = work_dir(spark, "stream-stages")
    store = StageStore(spark, f"{root}/stages", view.BUCKET)
    stage = extract_stage(view.conversation_contents(spark, sf_dir), _passed_on)
    sent = view.conversation_messages(spark, sf_dir, every_page=True)
    odd = F.col("page") % 2 == 1
    for name, part in (("first", sent.filter(odd)), ("second", sent.filter(~odd))):
        messages.encode_messages(part).write.text(f"{root}/inbox/{name}")
        _finish(
            messages.stream_stage(
                _lines(spark, f"{root}/inbox"), store, stage, lambda _: view.now(), f"{root}/{name}", f"{root}/cp-{name}"
            )
        )
    stored = store.stored("headers", *EXTRACT_STAGE).select("job_id", "page", "document_type", F.lit("").alias("error"))
    failed = store.stored("failed", *EXTRACT_STAGE).select("job_id", "page", F.lit("").alias("document_type"), "error")
    passed = spark.read.option("recursiveFileLookup", True).text(f"{root}/second/next").select(
        F.get_json_object("value", "$.job_id").alias("job_id"), F.get_json_object("value", "$.page").cast("int").alias("page")
    )
    return stored.unionByName(failed.distinct()).join(
        passed.groupBy("job_id", "page").agg(F.count("*").alias("sent_on")), ["job_id", "page"], "left"
    ).fillna({"sent_on": 0})


@query
def redelivered_messages(spark, sf_dir):
    """A message that fails comes again until it succeeds or is set aside after five deliveries."""
    root = work_dir(spark, "redelivered")
    store = StageStore(spark, f"{root}/stages", view.BUCKET)
    sent = view.conversation_messages(spark, sf_dir, every_page=False)
    messages.encode_messages(sent).write.text(f"{root}/inbox/new")
    none = spark.createDataFrame([], TRANSACTION_ROW)
    failures = F.split_part("job_id", F.lit("_"), F.lit(2)).cast("long") % 7
    start = F.unix_timestamp(view.now())
    for i in range(MAX_DELIVERIES + 1):
        now = F.timestamp_seconds(start + i * 2 * VISIBILITY_SECONDS)

        def fails(work: DataFrame, _: StageData, i: int = i) -> StageData:
            bad = work.filter(failures > i).select("job_id", "page", F.lit("not yet").alias("error"))
            return StageData(transactions=none, failed=bad)

        stage = Stage(*EXTRACT_STAGE, fails)
        _finish(
            messages.stream_stage(
                _lines(spark, f"{root}/inbox"), store, stage, lambda _, t=now: t, f"{root}/out", f"{root}/checkpoint"
            )
        )
        later = F.timestamp_seconds(F.unix_timestamp(now) + VISIBILITY_SECONDS)
        log = state.read_state_log(spark, store.log_root)
        if not messages.redeliver(spark, log, sent, root, f"{root}/inbox", later):
            break
    log = state.read_state_log(spark, store.log_root)
    dead = state.dead_letters(log, later).select("job_id", F.lit(True).alias("dead"))
    return state.attempts(log).select("job_id", F.col("attempts").alias("deliveries"), "done").join(
        dead, "job_id", "left"
    ).fillna({"dead": False})


@query
def stream_messages(spark, sf_dir):
    """Jobs as line messages, some broken, read back as a stream of work."""
    root = work_dir(spark, "stream-messages")
    jobs = view.jobs(spark, sf_dir)
    sound = F.to_json(
        F.struct(
            "job_id", F.col("page_count").alias("page"), F.lit("gemini").alias("stage"),
            F.lit("v1").alias("version"), "input_uri", "chain", F.lit(0).alias("chain_idx"),
        )
    )
    broken = F.concat(F.lit('{"job_id":'), F.col("job_id"))
    jobs.select(F.when(F.col("tenant_id") == "acme", broken).otherwise(sound).alias("value")).write.text(
        f"{root}/inbox"
    )

    def keep(work: DataFrame, batch_id: int) -> None:
        replace_part(work.drop("metadata"), f"{root}/work", "batch", batch_id)

    _finish(
        messages.stream_work(
            messages.decode_messages(messages.read_messages(spark, f"{root}/inbox")),
            keep, f"{root}/rejected", f"{root}/checkpoint",
        )
    )
    work = spark.read.parquet(f"{root}/work").select(
        "job_id", "page", "stage", "input_uri", F.size("chain").alias("chain_length"),
        F.lit("").alias("decode_error"),
    )
    rejected = spark.read.parquet(f"{root}/rejected").select(
        F.col("body").alias("job_id"), F.lit(0).alias("page"), F.lit("").alias("stage"),
        F.lit("").alias("input_uri"), F.lit(0).alias("chain_length"), "decode_error",
    )
    return work.unionByName(rejected)
