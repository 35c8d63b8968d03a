"""Views of the given tables in the shapes the operators take.

The given tables hold no statements, so these derive one row of documents,
jobs, state or pages from each of their rows. Only integer arithmetic and
text is used; the comparison SQL repeats it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.chains import chain_literal
from docspark.functions.dates import DAY_SECONDS, format_rfc3339
from docspark.functions.keys import merged_key, page_key, stage_key, uri_for
from docspark.operators.jobs import PAGE_FAILURE
from docspark.schema import (
    CHAIN,
    DEFAULT_CHAIN_ID,
    ENRICH_STAGE,
    EXTRACT_STAGE,
    MESSAGE,
    NORMALIZE_STAGE,
    RETENTION_DAYS,
    STAGE_LOG,
)

BUCKET = "work"
ARCHIVE_BUCKET = "vault"
NOW = "2024-02-01 00:00:00"
ARCHIVE_NOW = "2026-07-02 00:00:00"
# Events arrive in this many stretches of time, one after another.
SLICES = ("2024-01-11 00:00:00", "2024-01-21 00:00:00")
SHORT_CHAIN = [(*EXTRACT_STAGE, EXTRACT_STAGE[0]), (*NORMALIZE_STAGE, NORMALIZE_STAGE[0])]


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def archive_now() -> Column:
    return F.lit(ARCHIVE_NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, *values: str) -> Column:
    """Text chosen by a row's remainder."""
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(index == i, v).otherwise(out)
    return out


def text(number: Column) -> Column:
    return number.cast("string")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per line item, with its page's issuer."""
    li = table(spark, sf_dir, "lineitem")
    part, supp, order = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    line = F.col("l_linenumber")
    plain = F.format_number(F.floor("l_extendedprice"), 0)
    kind = part % 16
    amount = (
        F.when(kind == 0, "0")
        .when(kind == 1, "0円")
        .when(kind == 2, "")
        .when(kind == 3, "0.00")
        .when(kind == 4, "n/a")
        .when(kind == 5, F.concat(plain, F.lit("円")))
        .when(kind == 6, F.concat(F.lit(" "), plain, F.lit("　")))
        .when(kind == 7, "1e3")
        .otherwise(plain)
    )
    cents = F.floor(F.col("l_extendedprice") * 100)
    currency = pick(supp % 6, "", "MYR", "SGD", "THB", "USD", "EUR")
    foreign = F.concat(
        text(F.floor(cents / 100)), F.lit("."), F.lpad(text(cents % 100), 2, "0")
    )
    ship = F.col("l_shipdate")
    date = (
        F.when(part % 3 == 0, F.date_format(ship, "yyyy-MM-dd"))
        .when(part % 3 == 1, F.date_format(ship, "yyyy/MM/dd"))
        .otherwise(
            F.concat(
                text(F.year(ship)), F.lit("年"), text(F.month(ship)), F.lit("月"),
                text(F.day(ship)), F.lit("日"),
            )
        )
    )
    merchant = pick(
        supp % 8,
        "　ファミリーマート ",
        "family mart",
        "STARBUCKS",
        " Starbucks　",
        "REHAN RESTAURANT",
        "スターバックス コーヒー",
        "",
    )
    supplier = F.concat(F.lit("Supplier#"), F.lpad(text(supp), 9, "0"))
    issuer = pick(
        (order + line) % 4, "ファミリーマート株式会社 ", "Starbucks(株)(株)", "", "SomeBank"
    )
    # Exploded as one element, so that filters on these read finished text
    # as they would from a stored table.
    printed = F.struct(
        issuer.alias("issuer"),
        F.when(merchant == "", supplier).otherwise(merchant).alias("merchant"),
        amount.alias("amount"),
    )
    return li.withColumn("_printed", F.explode(F.array(printed))).select(
        F.concat(F.lit("job_"), text(order)).alias("job_id"),
        line.alias("page"),
        part.alias("pos"),
        "_printed.issuer",
        date.alias("date"),
        "_printed.merchant",
        F.col("l_returnflag").alias("description"),
        "_printed.amount",
        pick(supp % 5, "JPY", "USD", "").alias("currency"),
        F.when(currency == "", "").otherwise(foreign).alias("foreign_amount"),
        currency.alias("foreign_currency"),
        F.when(currency == "", "").otherwise("31.5").alias("exchange_rate"),
        F.when(currency == "", "").otherwise(date).alias("exchange_date"),
        F.when(part % 10 == 0, "business_meal").otherwise("").alias("category"),
        F.lit("").alias("merchant_normalized"),
        F.when(part % 25 == 0, "XX").otherwise("").alias("country"),
    )


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON page per line item, in sound and broken spellings."""
    li = table(spark, sf_dir, "lineitem")
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    kind = part % 12
    price = text(F.floor("l_extendedprice"))
    name = F.concat(F.lit("Supplier#"), text(F.col("l_suppkey")))

    def row(amount: Column, extra: str = "") -> Column:
        return F.concat(
            F.lit('{"date":"'), F.date_format("l_shipdate", "yyyy-MM-dd"),
            F.lit('","merchant":"'), name, F.lit('","amount":'), amount, F.lit(extra + "}"),
        )

    quoted = F.concat(F.lit('"'), price, F.lit('"'))
    rows = (
        F.when(kind == 1, F.concat(F.lit("["), row(price), F.lit("]")))
        .when(kind == 4, "null")
        .when(kind == 5, F.concat(F.lit("["), row(quoted, ',"extra":{"date":1}'), F.lit("]")))
        .when(kind == 8, "{}")
        .otherwise(
            F.concat(F.lit("["), row(quoted), F.lit(","), row(F.lit("null")), F.lit("]"))
        )
    )
    fields = (
        F.when(kind == 2, '{"issuer_name":5,"issuer":"Fallback"}')
        .when(kind == 3, '{"issuer_name":"","issuer":"Hidden"}')
        .when(kind == 9, "[1]")
        .when(kind == 10, "null")
        .otherwise(F.concat(F.lit('{"issuer_name":"Issuer '), text(line), F.lit('"}')))
    )
    kind_text = F.when(kind == 7, '"document_type":"bill","document_type":"receipt"').otherwise(
        '"document_type":"invoice"'
    )
    whole = F.concat(
        F.lit('{"text":'), F.when(kind == 11, "17").otherwise('"line"'), F.lit(","), kind_text,
        F.lit(',"fields":'), fields, F.lit(',"transactions":'), rows, F.lit("}"),
    )
    body = F.when(kind == 0, F.lit('{"text":"cut')).when(kind == 6, F.concat(F.lit("["), whole, F.lit("]"))).otherwise(whole)
    return li.select(
        F.concat_ws("_", F.lit("line"), text(F.col("l_orderkey")), text(part), text(F.col("l_suppkey"))).alias(
            "job_id"
        ),
        line.alias("page"),
        body.alias("body"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per order, with a tenant."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    job_id = F.concat(F.lit("job_"), text(key))
    status = (
        F.when(F.col("o_orderstatus") == "F", "failed")
        .when(F.col("o_orderstatus") == "O", "running")
        .otherwise("succeeded")
    )
    stored = (F.col("o_orderstatus") == "P") & (key % 11 != 0)
    return o.select(
        job_id.alias("job_id"),
        status.alias("status"),
        F.when(key % 7 == 0, "")
        .otherwise(uri_for("inbox", F.concat(F.lit("jobs/"), job_id, F.lit("/input.pdf"))))
        .alias("input_uri"),
        F.when(stored, uri_for(BUCKET, merged_key(job_id))).otherwise("").alias("result_uri"),
        (key % 8).cast("int").alias("page_count"),
        F.when(F.col("o_orderstatus") == "F", PAGE_FAILURE).otherwise("").alias("error"),
        pick(key % 4, "", "passthrough", "rendered").alias("mode"),
        pick(key % 3, "", DEFAULT_CHAIN_ID, "receipt-v9").alias("chain_id"),
        F.when(key % 2 == 0, chain_literal(SHORT_CHAIN)).otherwise(F.array().cast(CHAIN)).alias("chain"),
        F.when(key % 5 == 0, F.lit(0).cast("long"))
        .otherwise(F.unix_timestamp("o_orderdate") + RETENTION_DAYS * DAY_SECONDS)
        .alias("expires_at"),
        F.when(key % 13 == 0, "not a time")
        .otherwise(format_rfc3339(F.col("o_orderdate")))
        .alias("updated_at"),
        pick(key % 6, "tenant-a", "tenant_b", "bad tenant", "", "acme", "a=b").alias("tenant_id"),
    )


def state_of(events: DataFrame) -> DataFrame:
    """One state row per event; works on a stream as well."""
    event = F.col("event_id")
    job_id = F.concat(F.lit("job_"), text(F.col("user_id")))
    page = (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 11).cast("int")
    stage = pick(event % 3, EXTRACT_STAGE[0], NORMALIZE_STAGE[0], ENRICH_STAGE[0])
    version = F.when(event % 50 == 0, "v2").otherwise("v1")
    status = (
        F.when(F.col("event_type") == "view", "queued")
        .when(F.col("event_type") == "purchase", "succeeded")
        .when(F.col("event_type") == "error", "failed")
        .otherwise("running")
    )
    named = events.select(
        job_id.alias("job_id"),
        page.alias("page"),
        stage.alias("stage"),
        version.alias("version"),
        status.alias("status"),
        F.when(event % 4 == 0, F.lit(0).cast("long"))
        .otherwise(F.unix_timestamp("ts") + RETENTION_DAYS * DAY_SECONDS)
        .alias("expires_at"),
        "ts",
        event.alias("seq"),
    )
    key = [F.col(c) for c in ("job_id", "page", "stage", "version")]
    ok, bad = F.col("status") == "succeeded", F.col("status") == "failed"
    values = {
        "idempotency_key": stage_key(*key),
        "input_uri": F.when(ok, "").otherwise(
            F.concat(F.lit("s3://inbox/jobs/"), "job_id", F.lit("/input.pdf"))
        ),
        "result_uri": F.when(ok, uri_for(BUCKET, page_key(*key))).otherwise(""),
        "next_stage": F.lit(""),
        "error": F.when(bad, F.concat(F.col("stage"), F.lit(": page not readable"))).otherwise(""),
    }
    return named.select(
        *[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in STAGE_LOG.fields]
    )


def state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_of(table(spark, sf_dir, "events"))


def event_slices(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The events, cut by time."""
    events = table(spark, sf_dir, "events")
    cuts = [F.lit(c).cast("timestamp") for c in SLICES]
    out = [events.filter(F.col("ts") < cuts[0])]
    out += [events.filter((F.col("ts") >= a) & (F.col("ts") < b)) for a, b in zip(cuts, cuts[1:])]
    return [*out, events.filter((F.col("ts") >= cuts[-1]) | F.col("ts").isNull())]


def conversation_key() -> Column:
    return F.col("conv_id") * 7 + F.col("turn")


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One split file per turn; the number grows with the turn."""
    c = table(spark, sf_dir, "conversations")
    turn = F.col("turn")
    name = (
        F.when(conversation_key() % 31 == 0, "cover.pdf")
        .when(conversation_key() % 37 == 0, "input_0.pdf")
        .otherwise(F.concat(F.lit("split/input_"), text(turn * 7 + 2), F.lit(".pdf")))
    )
    return c.select(F.concat(F.lit("conv_"), text(F.col("conv_id"))).alias("job_id"), turn, name.alias("name"))


def conversation_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, final-stage page records, stored bodies) for the merge."""
    c = table(spark, sf_dir, "conversations")
    job_id = F.concat(F.lit("conv_"), text(F.col("conv_id")))
    page = (F.col("turn") + 1).cast("int")
    key = conversation_key()
    records = c.select(
        job_id.alias("job_id"),
        page.alias("page"),
        F.when(key % 17 == 0, "failed").otherwise("succeeded").alias("status"),
        F.when(key % 23 == 0, "")
        .otherwise(uri_for(BUCKET, page_key(job_id, page, *[F.lit(x) for x in ENRICH_STAGE])))
        .alias("result_uri"),
    )
    bodies = c.filter(key % 29 != 0).select(
        job_id.alias("job_id"), page.alias("page"), F.col("text").alias("result")
    )
    owed = c.groupBy("conv_id").agg(F.count("*").alias("n"))
    job_rows = owed.select(
        job_id.alias("job_id"),
        (F.col("n") + F.when(F.col("conv_id") % 10 == 0, 1).otherwise(0)).cast("int").alias("page_count"),
    )
    return job_rows, records, bodies


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON page per turn, with header fields of many kinds."""
    c = table(spark, sf_dir, "conversations")
    k = conversation_key()
    issuer_name = pick(
        k % 5, "", '"issuer_name":""', '"issuer_name":"Acme Bank"', '"issuer_name":5', '"issuer_name":"  "'
    )
    issuer = pick(k % 3, '"issuer":"SMBC"', "")
    card = pick(k % 4, '"card_name":"Platinum Preferred"', '"card_name":null', "", '"card_name":"ゴールド"')
    date = pick(
        k % 6,
        '"statement_date":"2026-06-10"',
        '"statement_date":"2026/7/1"',
        '"statement_date":"2026年8月3日"',
        '"statement_date":"June 2026"',
        "",
        '"statement_date":""',
    )
    total = pick(k % 7, '"total":0', '"total":false', '"total":[]', '"total":{}', '"total":1234')
    empty = F.lit("")
    fields = F.concat_ws(",", *[F.nullif(x, empty) for x in (issuer_name, issuer, card, date, total)])
    row = F.concat(
        F.lit('{"date":"2026-06-01","merchant":"STARBUCKS","amount":"'), text(F.col("turn") + 1), F.lit('"}')
    )
    rows = F.concat_ws(",", F.array_repeat(row, (F.col("turn") % 3).cast("int")))
    kind = pick(k % 3, "", "credit_card_statement", "receipt")
    spoken = F.to_json(F.struct("text"))
    body = F.concat(
        F.left(spoken, F.length(spoken) - 1),
        F.lit(',"document_type":"'), kind, F.lit('","fields":{'), fields,
        F.lit('},"transactions":['), rows, F.lit("]}"),
    )
    return c.select(
        F.concat(F.lit("conv_"), text(F.col("conv_id"))).alias("job_id"),
        (F.col("turn") + 1).cast("int").alias("page"),
        body.alias("result"),
    )


def conversation_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per conversation, with a tenant, in all end states."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    conv = F.col("conv_id")
    job_id = F.concat(F.lit("conv_"), text(conv))
    return c.select(
        job_id.alias("job_id"),
        pick(conv % 4, "succeeded", "succeeded", "failed", "running").alias("status"),
        F.when(conv % 7 == 0, "")
        .otherwise(uri_for("inbox", F.concat(F.lit("jobs/"), job_id, F.lit("/input.pdf"))))
        .alias("input_uri"),
        F.when((conv % 4 < 2) & (conv % 11 != 0), uri_for(BUCKET, merged_key(job_id)))
        .otherwise("")
        .alias("result_uri"),
        F.col("n").cast("int").alias("page_count"),
        F.when(conv % 4 == 2, PAGE_FAILURE).otherwise("").alias("error"),
        F.lit(DEFAULT_CHAIN_ID).alias("chain_id"),
        chain_literal(SHORT_CHAIN).alias("chain"),
        pick(conv % 5, "tenant-a", "tenant_b", "bad tenant", "", "acme").alias("tenant_id"),
    )


def conversation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per conversation: one page per turn, tenants good and bad, one without a job id."""
    jobs = conversation_jobs(spark, sf_dir)
    conv = F.split_part("job_id", F.lit("_"), F.lit(2)).cast("long")
    page = lambda i: F.concat(F.lit("s3://inbox/"), F.col("job_id"), F.lit("/"), i.cast("string"))
    return jobs.select(
        F.when(conv % 13 != 0, F.col("job_id")).alias("job_id"),
        uri_for("inbox", F.concat(F.lit("jobs/"), "job_id", F.lit("/input.pdf"))).alias("input_uri"),
        F.lit("rendered").alias("mode"),
        F.when(conv % 9 == 0, "receipt-v9").otherwise("").alias("chain_id"),
        "tenant_id",
        F.transform(F.sequence(F.lit(1), F.greatest("page_count", F.lit(1))), page).alias("pages"),
    )


def conversation_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uri, content) of the pages that `conversation_requests` names; some cannot be read."""
    pages = conversation_pages(spark, sf_dir)
    number = F.split_part("job_id", F.lit("_"), F.lit(2)).cast("long")
    broken = (number % 8 == 0) & (F.col("page") == 2)
    body = F.when(broken, "{cut").otherwise(F.col("result"))
    uri = F.concat(F.lit("s3://inbox/"), "job_id", F.lit("/"), F.col("page").cast("string"))
    return pages.select(uri.alias("uri"), F.encode(body, "UTF-8").alias("content"))


def conversation_messages(spark: SparkSession, sf_dir: str, every_page: bool) -> DataFrame:
    """Work for the extract stage: all pages of each conversation, or its first."""
    pages = conversation_pages(spark, sf_dir).select("job_id", "page")
    rows = pages if every_page else pages.filter(F.col("page") == 1)
    uri = F.concat(F.lit("s3://inbox/"), "job_id", F.lit("/"), F.col("page").cast("string"))
    values = {
        "job_id": F.col("job_id"),
        "page": F.col("page"),
        "stage": F.lit(EXTRACT_STAGE[0]),
        "version": F.lit(EXTRACT_STAGE[1]),
        "input_uri": uri,
        "chain": chain_literal(SHORT_CHAIN),
        "chain_idx": F.lit(0),
        "metadata": F.create_map(),
    }
    return rows.select(*[values.get(f.name, F.lit("")).cast(f.dataType).alias(f.name) for f in MESSAGE.fields])
