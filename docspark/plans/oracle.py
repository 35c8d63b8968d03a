"""Comparison SQL for the registered queries, in DuckDB's dialect.

Written from the rules, not from the operators: views repeat the adapters,
and each statement states the expected rows in plain SQL.
"""

from __future__ import annotations

from docspark.functions.text import WHITE_SPACE
from docspark.operators.jobs import PAGE_FAILURE
from docspark.plans.adapters import ARCHIVE_NOW, NOW, SLICES

DAY = 86400
KEPT = 14 * DAY
DEFAULT = "card-statement-v1"
LONG_STAGES = "gemini,normalize_card_statement,enrich_transactions"
LONG_CHAIN = (
    '[{"name":"gemini","version":"v1","queue_name":"gemini"},'
    '{"name":"normalize_card_statement","version":"v1","queue_name":"normalize_card_statement"},'
    '{"name":"enrich_transactions","version":"v1","queue_name":"enrich_transactions"}]'
)


def trim(x: str) -> str:
    return f"trim({x}, '{WHITE_SPACE}')"


def alias_key(x: str) -> str:
    return f"lower({trim(x)})"


def issuer_key(x: str) -> str:
    out = f"regexp_replace({trim(x)}, '株式会社$', '')"
    for _ in range(2):
        out = f"regexp_replace({out}, '\\(株\\)$', '')"
    return f"lower({trim(out)})"


def is_zero(x: str) -> str:
    bare = f"replace({x}, ',', '')"
    cut = f"CASE WHEN ends_with({bare}, '円') THEN left({bare}, length({bare}) - 1) ELSE {bare} END"
    text = trim(f"({cut})")
    return f"({text} = '' OR coalesce(try_cast({text} AS DOUBLE) = 0, false))"


def amount(x: str) -> str:
    text = trim(f"replace({x}, ',', '')")
    shape = "[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
    return (
        f"CASE WHEN regexp_full_match({text}, '{shape}') "
        f"THEN try_cast({text} AS DECIMAL(38,6)) END"
    )


def whole(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS DECIMAL(38,0)) AS VARCHAR)"


def cents(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 2) AS DECIMAL(38,2)) AS VARCHAR)"


def country(x: str) -> str:
    code = f"upper({trim(x)})"
    return (
        f"CASE {code} WHEN '' THEN 'JP' WHEN 'MYR' THEN 'MY' WHEN 'SGD' THEN 'SG' "
        f"WHEN 'THB' THEN 'TH' WHEN 'USD' THEN 'US' ELSE '' END"
    )


def slug(x: str) -> str:
    kept = f"regexp_replace(lower({trim(x)}), '[^a-z0-9 \\-_\\t]', '', 'g')"
    return f"trim(regexp_replace({kept}, '[ \\-_\\t]+', '-', 'g'), '-')"


def rfc3339(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%SZ')"


def epoch(x: str) -> str:
    return f"CAST(floor(epoch({x})) AS BIGINT)"


def pick(index: str, *values: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {index} {whens} ELSE '{values[-1]}' END"


def padded(page: str) -> str:
    return f"CASE WHEN length({page}::VARCHAR) < 6 THEN lpad({page}::VARCHAR, 6, '0') ELSE {page}::VARCHAR END"


FOREIGN_CODE = pick("l_suppkey % 6", "", "MYR", "SGD", "THB", "USD", "EUR")
PLAIN = "format('{:,}', CAST(floor(l_extendedprice) AS BIGINT))"
PRINTED_DATE = (
    "CASE l_partkey % 3 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') "
    "WHEN 1 THEN strftime(l_shipdate, '%Y/%m/%d') "
    "ELSE year(l_shipdate) || '年' || month(l_shipdate) || '月' || day(l_shipdate) || '日' END"
)
SUPPLIER = "'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0')"

V_TX = f"""v_tx AS (
  SELECT 'job_' || l_orderkey AS job_id, l_linenumber AS page, l_partkey AS pos,
    {pick("(l_orderkey + l_linenumber) % 4", "ファミリーマート株式会社 ", "Starbucks(株)(株)", "", "SomeBank")} AS issuer,
    {PRINTED_DATE} AS date,
    CASE l_suppkey % 8 WHEN 0 THEN '　ファミリーマート ' WHEN 1 THEN 'family mart' WHEN 2 THEN 'STARBUCKS'
      WHEN 3 THEN ' Starbucks　' WHEN 4 THEN 'REHAN RESTAURANT' WHEN 5 THEN 'スターバックス コーヒー'
      ELSE {SUPPLIER} END AS merchant,
    l_returnflag AS description,
    CASE l_partkey % 16 WHEN 0 THEN '0' WHEN 1 THEN '0円' WHEN 2 THEN '' WHEN 3 THEN '0.00' WHEN 4 THEN 'n/a'
      WHEN 5 THEN {PLAIN} || '円' WHEN 6 THEN ' ' || {PLAIN} || '　' WHEN 7 THEN '1e3' ELSE {PLAIN} END AS amount,
    {pick("l_suppkey % 5", "JPY", "USD", "")} AS currency,
    CASE WHEN l_suppkey % 6 = 0 THEN '' ELSE CAST(floor(l_extendedprice * 100) AS BIGINT) // 100 || '.' ||
      lpad((CAST(floor(l_extendedprice * 100) AS BIGINT) % 100)::VARCHAR, 2, '0') END AS foreign_amount,
    {FOREIGN_CODE} AS foreign_currency,
    CASE WHEN l_suppkey % 6 = 0 THEN '' ELSE '31.5' END AS exchange_rate,
    CASE WHEN l_suppkey % 6 = 0 THEN '' ELSE {PRINTED_DATE} END AS exchange_date,
    CASE WHEN l_partkey % 10 = 0 THEN 'business_meal' ELSE '' END AS category,
    '' AS merchant_normalized,
    CASE WHEN l_partkey % 25 = 0 THEN 'XX' ELSE '' END AS country
  FROM lineitem)"""

V_NORMAL = f"""v_normal AS (
  SELECT * FROM v_tx
  WHERE NOT ({issuer_key('issuer')} <> '' AND {issuer_key('merchant')} = {issuer_key('issuer')})
    AND NOT {is_zero('amount')})"""

V_ALIAS = """v_alias(alias_key, canonical, dict_category, dict_country) AS (VALUES
  ('familymart', 'FamilyMart', 'convenience_store', ''),
  ('ファミリーマート', 'FamilyMart', 'convenience_store', ''),
  ('family mart', 'FamilyMart', 'convenience_store', ''),
  ('ﾌｧﾐﾘｰﾏｰﾄ', 'FamilyMart', 'convenience_store', ''),
  ('paypay *ファミリーマート', 'FamilyMart', 'convenience_store', ''),
  ('starbucks', 'Starbucks', 'cafe', ''),
  ('スターバックス コーヒー', 'Starbucks', 'cafe', ''),
  ('スターバックスコーヒージャパン', 'Starbucks', 'cafe', ''),
  ('rehan restaurant', 'Rehan Restaurant', 'restaurant', 'MY'),
  ('restoran nasi kandar', 'Restoran Nasi Kandar', 'restaurant', 'MY'))"""


def enriched(source: str, name: str) -> str:
    return f"""{name} AS (
  SELECT t.* EXCLUDE (category, merchant_normalized, country),
    CASE WHEN category <> '' THEN category ELSE coalesce(dict_category, '') END AS category,
    coalesce(canonical, merchant_normalized) AS merchant_normalized,
    CASE WHEN coalesce(dict_country, '') <> '' THEN dict_country WHEN country <> '' THEN country
      ELSE {country('foreign_currency')} END AS country
  FROM {source} t LEFT JOIN v_alias a ON a.alias_key = {alias_key('t.merchant')})"""


V_STATE = f"""v_named AS (
  SELECT 'job_' || user_id AS job_id,
    CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 11 AS INTEGER) AS page,
    {pick("event_id % 3", "gemini", "normalize_card_statement", "enrich_transactions")} AS stage,
    CASE WHEN event_id % 50 = 0 THEN 'v2' ELSE 'v1' END AS version,
    CASE event_type WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed'
      ELSE 'running' END AS status,
    CASE WHEN event_id % 4 = 0 THEN 0 ELSE {epoch('ts')} + {KEPT} END AS expires_at,
    ts, event_id AS seq
  FROM events),
v_state AS (
  SELECT job_id, page, stage, version, status,
    CASE WHEN page > 0 THEN job_id || ':page:' || {padded('page')} || ':' || stage || ':' || version
      ELSE job_id || ':' || stage || ':' || version END AS idempotency_key,
    CASE WHEN status = 'succeeded' THEN '' ELSE 's3://inbox/jobs/' || job_id || '/input.pdf' END AS input_uri,
    CASE WHEN status = 'succeeded' THEN 's3://work/jobs/' || job_id || '/pages/' || {padded('page')} || '/' ||
      stage || '/' || version || '/result.json' ELSE '' END AS result_uri,
    '' AS next_stage,
    CASE WHEN status = 'failed' THEN stage || ': page not readable' ELSE '' END AS error,
    expires_at, ts, seq
  FROM v_named),
v_latest AS (
  SELECT * FROM v_state
  QUALIFY row_number() OVER (PARTITION BY job_id, page, stage, version ORDER BY ts DESC, seq DESC) = 1)"""

LAPSED = f"(l.expires_at <> 0 AND {epoch('r.ts')} >= l.expires_at)"
# A stage key's rows in order, folded one after another: a lapsed key starts anew, success is final.
V_ROWS = f"""v_rows AS (
  SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY ts, seq) AS i FROM v_state),
v_life AS (
  SELECT job_id, page, stage, version, idempotency_key, i, status, 1::BIGINT AS deliveries, 1::BIGINT AS lives,
    expires_at, ts, seq FROM v_rows WHERE i = 1
  UNION ALL
  SELECT r.job_id, r.page, r.stage, r.version, r.idempotency_key, r.i,
    CASE WHEN NOT {LAPSED} AND l.status = 'succeeded' THEN l.status ELSE r.status END,
    CASE WHEN {LAPSED} THEN 1 ELSE l.deliveries + 1 END,
    CASE WHEN {LAPSED} THEN l.lives + 1 ELSE l.lives END,
    CASE WHEN NOT {LAPSED} AND l.status = 'succeeded' THEN l.expires_at ELSE r.expires_at END,
    CASE WHEN NOT {LAPSED} AND l.status = 'succeeded' THEN l.ts ELSE r.ts END,
    CASE WHEN NOT {LAPSED} AND l.status = 'succeeded' THEN l.seq ELSE r.seq END
  FROM v_life l JOIN v_rows r ON r.idempotency_key = l.idempotency_key AND r.i = l.i + 1)"""

# Conversations as jobs of a run: which requests are good, which have a page that cannot be read.
V_RUN = """v_run AS (
  SELECT conv_id, job_id, page_count, conv_id % 8 = 0 AND page_count >= 2 AS cut,
    concat_ws('; ', CASE WHEN conv_id % 9 = 0 THEN 'chain receipt-v9 is not in the registry' END,
      CASE WHEN conv_id % 13 = 0 THEN 'empty job_id' END, CASE WHEN conv_id % 5 = 3 THEN 'empty tenant_id' END,
      CASE WHEN conv_id % 5 = 2 THEN 'tenant_id may hold letters, digits, - and _ only' END) AS errors
  FROM v_cjob),
v_sum AS (
  SELECT conv_id, count(*) FILTER (turn <> 1 OR conv_id % 8 <> 0) AS read,
    CAST(sum(turn % 3) AS BIGINT) AS row_count, CAST(sum(turn % 3 * (turn + 1)) AS BIGINT) AS total,
    CAST(sum(CASE WHEN turn <> 1 OR conv_id % 8 <> 0 THEN turn % 3 ELSE 0 END) AS BIGINT) AS rows_read
  FROM conversations GROUP BY conv_id)"""

ALIVE = f"(expires_at = 0 OR expires_at > {epoch(f'TIMESTAMP {chr(39)}{NOW}{chr(39)}')})"

V_JOB = f"""v_job AS (
  SELECT 'job_' || o_orderkey AS job_id,
    CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'succeeded' END AS status,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 's3://inbox/jobs/job_' || o_orderkey || '/input.pdf' END AS input_uri,
    CASE WHEN o_orderstatus = 'P' AND o_orderkey % 11 <> 0
      THEN 's3://work/jobs/job_' || o_orderkey || '/merged/v1/result.json' ELSE '' END AS result_uri,
    CAST(o_orderkey % 8 AS INTEGER) AS page_count,
    CASE WHEN o_orderstatus = 'F' THEN '{PAGE_FAILURE}' ELSE '' END AS error,
    {pick("o_orderkey % 4", "", "passthrough", "rendered")} AS mode,
    {pick("o_orderkey % 3", "", DEFAULT, "receipt-v9")} AS chain_id,
    o_orderkey % 2 = 0 AS short_chain,
    CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE {epoch('o_orderdate')} + {KEPT} END AS expires_at,
    CASE WHEN o_orderkey % 13 = 0 THEN 'not a time' ELSE {rfc3339('o_orderdate')} END AS updated_at,
    {pick("o_orderkey % 6", "tenant-a", "tenant_b", "bad tenant", "", "acme", "a=b")} AS tenant_id,
    CASE WHEN o_orderkey % 2 = 0 THEN 'normalize_card_statement'
      WHEN o_orderkey % 3 = 2 THEN NULL ELSE 'enrich_transactions' END AS final_stage
  FROM orders)"""

V_COUNTED = f"""v_counts AS (
  SELECT job_id, stage, count(*) FILTER (status = 'succeeded') AS s, count(*) FILTER (status = 'failed') AS f
  FROM v_latest WHERE page > 0 AND version = 'v1' AND {ALIVE} GROUP BY ALL),
v_counted AS (
  SELECT j.*, coalesce(s, 0) AS succeeded_count, coalesce(f, 0) AS failed_count,
    greatest(page_count - coalesce(s, 0) - coalesce(f, 0), 0) AS pending_count
  FROM v_job j LEFT JOIN v_counts c ON c.job_id = j.job_id AND c.stage = j.final_stage)"""

K = "(conv_id * 7 + turn)"

V_RECORD = f"""v_record AS (
  SELECT conv_id, 'conv_' || conv_id AS job_id, CAST(turn + 1 AS INTEGER) AS page, text,
    CASE WHEN {K} % 17 = 0 THEN 'page ' || (turn + 1) || ' has status failed'
      WHEN {K} % 23 = 0 THEN 'page ' || (turn + 1) || ' has no result_uri'
      WHEN {K} % 29 = 0 THEN 'page ' || (turn + 1) || ' has no stored result' END AS page_error
  FROM conversations),
v_verdict AS (
  SELECT job_id, CAST(count(*) AS INTEGER) AS n,
    CASE WHEN any_value(conv_id) % 10 = 0
      THEN 'only ' || count(*) || ' of ' || (count(*) + 1) || ' pages were recorded by the last stage'
      ELSE arg_min(page_error, page) FILTER (page_error IS NOT NULL) END AS error
  FROM v_record GROUP BY job_id)"""

V_CPAGE = f"""v_cpage AS (
  SELECT 'conv_' || conv_id AS job_id, CAST(turn + 1 AS INTEGER) AS page, text, turn,
    {pick(f"{K} % 3", "", "credit_card_statement", "receipt")} AS document_type,
    CASE {K} % 5 WHEN 1 THEN '""' WHEN 2 THEN '"Acme Bank"' WHEN 3 THEN '5' WHEN 4 THEN '"  "' END AS issuer_name,
    CASE {K} % 3 WHEN 0 THEN '"SMBC"' END AS issuer,
    CASE {K} % 4 WHEN 0 THEN '"Platinum Preferred"' WHEN 1 THEN 'null' WHEN 3 THEN '"ゴールド"' END AS card_name,
    CASE {K} % 6 WHEN 0 THEN '"2026-06-10"' WHEN 1 THEN '"2026/7/1"' WHEN 2 THEN '"2026年8月3日"'
      WHEN 3 THEN '"June 2026"' WHEN 5 THEN '""' END AS statement_date,
    CASE {K} % 7 WHEN 0 THEN '0' WHEN 1 THEN 'false' WHEN 2 THEN '[]' WHEN 3 THEN '{{}}' ELSE '1234' END AS total
  FROM conversations),
v_field AS (
  SELECT job_id, key, arg_min(value, page) AS value FROM (
    UNPIVOT (SELECT job_id, page, issuer_name, issuer, card_name, statement_date, total FROM v_cpage)
    ON issuer_name, issuer, card_name, statement_date, total INTO NAME key VALUE value)
  WHERE value <> 'null' AND trim(value, '" ') <> '' GROUP BY ALL),
v_text AS (
  SELECT job_id, key, trim(value, '"') AS value FROM v_field WHERE starts_with(value, '"')),
v_header AS (
  SELECT p.job_id,
    coalesce(arg_min(document_type, page) FILTER (document_type <> ''), '') AS document_type,
    coalesce((SELECT value FROM v_text t WHERE t.job_id = p.job_id AND key = 'issuer_name'),
      (SELECT value FROM v_text t WHERE t.job_id = p.job_id AND key = 'issuer'), '') AS issuer,
    coalesce((SELECT value FROM v_text t WHERE t.job_id = p.job_id AND key = 'card_name'), '') AS card_name,
    coalesce((SELECT value FROM v_text t WHERE t.job_id = p.job_id AND key = 'statement_date'), '') AS statement_date
  FROM v_cpage p GROUP BY p.job_id)"""

V_CJOB = f"""v_cjob AS (
  SELECT conv_id, 'conv_' || conv_id AS job_id,
    {pick("conv_id % 4", "succeeded", "succeeded", "failed", "running")} AS status,
    CASE WHEN conv_id % 7 = 0 THEN '' ELSE 's3://inbox/jobs/conv_' || conv_id || '/input.pdf' END AS input_uri,
    CASE WHEN conv_id % 4 < 2 AND conv_id % 11 <> 0
      THEN 's3://work/jobs/conv_' || conv_id || '/merged/v1/result.json' ELSE '' END AS result_uri,
    CAST(count(*) AS INTEGER) AS page_count,
    CASE WHEN conv_id % 4 = 2 THEN '{PAGE_FAILURE}' ELSE '' END AS error,
    {pick("conv_id % 5", "tenant-a", "tenant_b", "bad tenant", "", "acme")} AS tenant_id
  FROM conversations GROUP BY conv_id)"""

YEAR = "regexp_extract(statement_date, '([0-9]{4})[-/年]([0-9]{1,2})', 1)"
MONTH = "regexp_extract(statement_date, '([0-9]{4})[-/年]([0-9]{1,2})', 2)"

V_TARGET = f"""v_place AS (
  SELECT j.*, h.document_type, h.issuer, h.card_name, j.tenant_id AS tenant,
    CASE WHEN {YEAR} <> '' THEN {YEAR} ELSE '{ARCHIVE_NOW[:4]}' END AS year,
    CASE WHEN {YEAR} <> '' THEN lpad({MONTH}, 2, '0') ELSE '{ARCHIVE_NOW[5:7]}' END AS month,
    CASE WHEN {slug('issuer')} = '' THEN 'unknown' ELSE {slug('issuer')} END AS issuer_slug,
    {slug('card_name')} AS card
  FROM v_cjob j JOIN v_header h USING (job_id)),
v_slugged AS (
  SELECT *, CASE WHEN issuer_slug <> 'unknown' AND card <> '' THEN issuer_slug || '-' || card
      WHEN card <> '' THEN card WHEN issuer_slug <> 'unknown' THEN issuer_slug
      ELSE right(job_id, 12) END AS card_slug
  FROM v_place),
v_target AS (
  SELECT *,
    's3://vault/results/transactions/tenant=' || tenant || '/year=' || year || '/month=' || month || '/' ||
      card_slug || '.json' AS archive_uri,
    CASE WHEN input_uri = '' THEN '' ELSE 's3://vault/raw/card-statements/' || issuer_slug || '/' || year || '/' ||
      month || '/original.pdf' END AS raw_uri,
    's3://vault/manifests/jobs/' || job_id || '.json' AS manifest_uri,
    CASE WHEN tenant = '' THEN 'empty tenant_id'
      WHEN NOT regexp_full_match(tenant, '[a-zA-Z0-9_-]+') THEN 'tenant_id may hold letters, digits, - and _ only'
      WHEN result_uri = '' THEN 'nothing was merged for the job' END AS target_error
  FROM v_slugged)"""

V_ASKED = """v_asked AS (
  SELECT job_id, CASE WHEN page_count % 3 = 0 THEN 'acme' ELSE tenant_id END AS tenant_id FROM v_cjob),
v_old AS (SELECT * FROM v_target WHERE target_error IS NULL AND document_type = 'receipt'),
v_request AS (
  SELECT a.job_id, a.tenant_id, coalesce(o.archive_uri, '') AS result_uri,
    CASE WHEN a.tenant_id = '' THEN 'empty tenant_id' WHEN o.job_id IS NULL THEN 'manifest not found'
      WHEN o.tenant_id <> a.tenant_id THEN 'tenant mismatch' END AS error,
    CASE WHEN o.job_id IS NULL THEN '' ELSE '{now}' END AS archived_at
  FROM v_asked a LEFT JOIN v_old o ON o.job_id = a.job_id)""".replace(
    "{now}", NOW.replace(" ", "T") + "Z"
)

LINE = "l_partkey % 12"
LINE_ID = "'line_' || l_orderkey || '_' || l_partkey || '_' || l_suppkey"
LINE_GOOD = f"{LINE} NOT IN (0, 1, 6, 9, 11)"
LINE_ISSUER = (
    f"CASE {LINE} WHEN 2 THEN 'Fallback' WHEN 3 THEN '' WHEN 10 THEN '' "
    f"ELSE 'Issuer ' || l_linenumber END"
)
LINE_TYPE = f"CASE {LINE} WHEN 7 THEN 'receipt' ELSE 'invoice' END"
LINE_KIND = f"CASE {LINE} WHEN 4 THEN 0 WHEN 8 THEN -1 WHEN 5 THEN 1 ELSE 2 END"


def rolled(source: str, key: str, value: str | None, amount_column: str, text, dimension=None) -> str:
    column = dimension or key
    if value is None:
        where = f"{column} <> '' AND {column} = {trim(column)}"
        label, group = key, f"job_id, {key}"
    else:
        where, label, group = f"{column} = '{value}'", f"'{value}'", "job_id"
    currency = label if key in ("currency", "foreign_currency") else "'JPY'"
    return f"""SELECT job_id, '{key}' AS filter_key, {label} AS filter_value, count(a) AS row_count,
    coalesce(sum(a), 0::DECIMAL(38,6)) AS total_amount, {text('coalesce(sum(a), 0::DECIMAL(38,6))')} AS total,
    {currency} AS currency
  FROM (SELECT *, {amount(amount_column)} AS a FROM {source}) WHERE {where} GROUP BY {group}"""


def sql(*parts: str) -> str:
    *views, body = parts
    return (f"WITH {', '.join(views)}\n" if views else "") + body


V_ROWCOUNT = "v_rowcount AS (SELECT job_id, CAST(sum(turn % 3) AS BIGINT) AS row_count FROM v_cpage GROUP BY job_id)"


def current(where: str, order: str) -> str:
    """The document under each archive key that comes last by `order`."""
    return f"""SELECT archive_uri, job_id, tenant, year, month, card_slug, row_count
  FROM v_target JOIN v_rowcount USING (job_id) WHERE target_error IS NULL AND {where}
  QUALIFY row_number() OVER (PARTITION BY archive_uri ORDER BY {order} DESC) = 1"""


JOB_LIST = "status, input_uri, result_uri, page_count, error, mode, chain_id, chain_length, expires_at, updated_at"
V_JOBROW = """v_jobrow AS (
  SELECT job_id, status, input_uri, result_uri, page_count, error, mode, chain_id,
    CASE WHEN short_chain THEN 2 ELSE 0 END AS chain_length, expires_at, updated_at FROM v_job)"""

ENRICHED_VIEWS = (V_TX, V_NORMAL, V_ALIAS, enriched("v_normal", "v_rich"))
TARGET_VIEWS = (V_CPAGE, V_CJOB, V_TARGET)

LATEST_LIST = (
    "job_id, page, stage, version, status, idempotency_key, input_uri, result_uri, next_stage, error, "
    f"expires_at, {rfc3339('ts')} AS ts, seq"
)

REPLY = (
    "CASE n % 7 WHEN 0 THEN 200 WHEN 1 THEN 201 WHEN 2 THEN 400 WHEN 3 THEN 429 WHEN 4 THEN 503 "
    "WHEN 5 THEN 302 ELSE 204 END"
)

ORACLE: dict[str, str] = {
    "normalize_rows": sql(
        V_TX, V_NORMAL, "SELECT job_id, page, pos, issuer, merchant, amount, date FROM v_normal"
    ),
    "enrich_rows": sql(
        V_TX, V_ALIAS, enriched("v_tx", "v_rich"),
        "SELECT job_id, page, pos, merchant, amount, foreign_currency, category, merchant_normalized, country FROM v_rich",
    ),
    "effective_merchant_totals": sql(
        *ENRICHED_VIEWS,
        f"""SELECT job_id, m AS merchant, count(a) AS row_count, coalesce(sum(a), 0::DECIMAL(38,6)) AS total_amount,
    {whole('coalesce(sum(a), 0::DECIMAL(38,6))')} AS total
  FROM (SELECT job_id, CASE WHEN merchant_normalized <> '' THEN merchant_normalized ELSE merchant END AS m,
    {amount('amount')} AS a FROM v_rich) GROUP BY job_id, m""",
    ),
    "aggregate_merchant": sql(V_TX, rolled("v_tx", "merchant", "STARBUCKS", "amount", whole)),
    "aggregate_foreign_currency": sql(
        V_TX, rolled("v_tx", "foreign_currency", "MYR", "foreign_amount", cents)
    ),
    "aggregate_currency": sql(V_TX, rolled("v_tx", "currency", "USD", "amount", whole)),
    "aggregate_effective_currency": sql(
        V_TX,
        rolled("v_tx", "currency", "JPY", "amount", whole, "(CASE WHEN currency = '' THEN 'JPY' ELSE currency END)"),
    ),
    "aggregate_by_merchant": sql(V_TX, rolled("v_tx", "merchant", None, "amount", whole)),
    "aggregate_by_foreign_currency": sql(
        V_TX, rolled("v_tx", "foreign_currency", None, "foreign_amount", cents)
    ),
    "aggregate_by_country": sql(*ENRICHED_VIEWS, rolled("v_rich", "country", None, "amount", whole)),
    "aggregate_rows": sql(
        V_TX,
        f"""SELECT * EXCLUDE (issuer) FROM v_tx
  WHERE foreign_currency = 'SGD' AND ({amount('foreign_amount')}) IS NOT NULL""",
    ),
    "latest_state": sql(V_STATE, f"SELECT {LATEST_LIST} FROM v_latest"),
    "stages_final": sql(
        V_STATE,
        """SELECT job_id, page, status, result_uri, error FROM v_latest
  WHERE stage = 'enrich_transactions' AND version = 'v1' AND page > 0""",
    ),
    "unexpired_state": sql(
        V_STATE, f"SELECT idempotency_key, status, expires_at FROM v_latest WHERE {ALIVE}"
    ),
    "stage_log_after_purge": sql(
        V_STATE, f"SELECT idempotency_key, seq, status, expires_at FROM v_state WHERE {ALIVE}"
    ),
    "failed_without_previous": sql(
        V_TX,
        """SELECT DISTINCT job_id, page, CASE WHEN page % 3 = 0 THEN 'failed' ELSE 'succeeded' END AS status,
    CASE WHEN page % 3 = 0 THEN 'no result of the stage before' ELSE '' END AS error FROM v_tx""",
    ),
    "stage_run_twice": sql(
        V_TX, V_ALIAS, enriched("v_tx", "v_rich"),
        "SELECT job_id, page, pos, merchant, amount, foreign_currency, category, merchant_normalized, country FROM v_rich",
    ),
    "retention_stamps": f"""SELECT event_id AS seq, {epoch('ts')} + {KEPT} AS kept_until, 0::BIGINT AS kept_forever
  FROM events""",
    "pending_work": sql(
        V_STATE,
        f"""SELECT job_id, page, stage, version FROM v_latest WHERE NOT (status = 'succeeded' AND {ALIVE})""",
    ),
    "route_next": sql(
        V_STATE,
        """SELECT job_id, page,
    CASE WHEN version = 'v2' THEN 'audit' WHEN stage = 'gemini' THEN 'normalize_card_statement'
      ELSE 'enrich_transactions' END AS stage,
    'v1' AS version, result_uri AS previous_uri,
    CASE stage WHEN 'gemini' THEN 1 WHEN 'normalize_card_statement' THEN 2 ELSE 3 END AS chain_idx
  FROM v_latest WHERE status = 'succeeded' AND (version = 'v2' OR stage <> 'enrich_transactions')""",
    ),
    "job_status": sql(
        V_STATE, V_JOB, V_COUNTED,
        f"""SELECT job_id, status, page_count, succeeded_count, failed_count, pending_count, input_uri, result_uri,
    error, updated_at,
    CASE WHEN expires_at > 0 THEN {rfc3339('make_timestamp(expires_at * 1000000)')} ELSE '' END AS expires_at
  FROM v_counted""",
    ),
    "check_jobs": sql(
        V_STATE, V_JOB, V_COUNTED,
        """SELECT job_id, CASE WHEN failed_count > 0 THEN 'failed'
      WHEN page_count > 0 AND succeeded_count = page_count THEN 'succeeded' ELSE 'pending' END AS decision,
    succeeded_count, failed_count, pending_count FROM v_counted""",
    ),
    "bind_chain": sql(
        V_JOB,
        f"""SELECT job_id, CASE WHEN chain_id = '' THEN '{DEFAULT}' ELSE chain_id END AS chain_id,
    CASE WHEN chain_id = 'receipt-v9' THEN '' ELSE '{LONG_CHAIN}' END AS chain_json,
    CASE WHEN chain_id = 'receipt-v9' THEN 'chain receipt-v9 is not in the registry' END AS bind_error
  FROM v_job""",
    ),
    "effective_chain": sql(
        V_JOB,
        f"""SELECT job_id, CASE WHEN final_stage IS NOT NULL THEN 'gemini' END AS first_stage,
    CASE WHEN final_stage IS NOT NULL THEN 'gemini' END AS first_queue, final_stage,
    CASE WHEN final_stage IS NOT NULL THEN 'v1' END AS final_version,
    CASE WHEN short_chain THEN 'gemini,normalize_card_statement'
      WHEN final_stage IS NOT NULL THEN '{LONG_STAGES}' END AS stages
  FROM v_job""",
    ),
    "upsert_jobs": sql(
        V_STATE, V_JOB, V_JOBROW, V_CJOB,
        f"""SELECT job_id,
    CASE WHEN n.job_id IS NULL THEN o.status ELSE 'running' END AS status,
    CASE WHEN n.job_id IS NULL THEN o.input_uri ELSE 's3://inbox/jobs/' || job_id || '/again.pdf' END AS input_uri,
    CASE WHEN n.job_id IS NULL THEN o.result_uri ELSE '' END AS result_uri,
    CASE WHEN n.job_id IS NULL THEN o.page_count ELSE n.page_count END AS page_count,
    CASE WHEN n.job_id IS NULL THEN o.error ELSE '' END AS error,
    coalesce(o.mode, '') AS mode, coalesce(o.chain_id, '') AS chain_id, coalesce(o.chain_length, 0) AS chain_length,
    CASE WHEN n.job_id IS NULL THEN o.expires_at ELSE 0 END AS expires_at,
    CASE WHEN n.job_id IS NULL THEN o.updated_at ELSE '' END AS updated_at
  FROM v_jobrow o FULL JOIN (
    SELECT job_id, max(page) AS page_count FROM v_state GROUP BY 1
    UNION ALL SELECT job_id, page_count FROM v_cjob) n USING (job_id)""",
    ),
    "mark_failed_jobs": sql(
        V_STATE, V_JOB, V_COUNTED, V_JOBROW, V_CJOB,
        f"""SELECT job_id,
    CASE WHEN n.bad IS NULL THEN o.status ELSE 'failed' END AS status,
    coalesce(o.input_uri, '') AS input_uri,
    CASE WHEN n.bad IS NULL THEN o.result_uri ELSE '' END AS result_uri,
    coalesce(o.page_count, 0) AS page_count,
    CASE WHEN n.bad IS NULL THEN o.error ELSE '{PAGE_FAILURE}' END AS error,
    coalesce(o.mode, '') AS mode, coalesce(o.chain_id, '') AS chain_id, coalesce(o.chain_length, 0) AS chain_length,
    CASE WHEN n.bad IS NULL THEN o.expires_at ELSE 0 END AS expires_at,
    CASE WHEN n.bad IS NULL THEN o.updated_at ELSE '' END AS updated_at
  FROM v_jobrow o FULL JOIN (
    SELECT job_id, true AS bad FROM v_counted WHERE failed_count > 0
    UNION ALL SELECT job_id, true FROM v_cjob WHERE status = 'failed') n USING (job_id)""",
    ),
    "commit_merged_jobs": sql(
        V_JOB, V_JOBROW, V_CJOB, V_RECORD,
        f"""SELECT job_id, CASE WHEN n.n IS NULL THEN status ELSE 'succeeded' END AS status, input_uri,
    CASE WHEN n.n IS NULL THEN result_uri ELSE 's3://work/jobs/' || job_id || '/merged/v1/result.json' END AS result_uri,
    CASE WHEN n.n IS NULL THEN page_count ELSE n.n END AS page_count,
    CASE WHEN n.n IS NULL THEN o.error ELSE '' END AS error,
    CASE WHEN n.n IS NULL THEN mode ELSE coalesce(mode, '') END AS mode, chain_id, chain_length,
    CASE WHEN n.n IS NULL THEN expires_at ELSE 0 END AS expires_at,
    CASE WHEN n.n IS NULL THEN updated_at ELSE '' END AS updated_at
  FROM (SELECT job_id, {JOB_LIST} FROM v_jobrow UNION ALL
    SELECT job_id, status, input_uri, result_uri, page_count, error, NULL, '{DEFAULT}', 2, NULL, NULL FROM v_cjob) o
  LEFT JOIN (SELECT job_id, n FROM v_verdict WHERE error IS NULL) n USING (job_id)""",
    ),
    "validate_jobs": sql(
        V_JOB,
        """SELECT job_id, concat_ws('; ',
    CASE WHEN tenant_id = '' THEN 'empty tenant_id' END,
    CASE WHEN tenant_id IN ('bad tenant', 'a=b') THEN 'tenant_id may hold letters, digits, - and _ only' END,
    CASE WHEN input_uri = '' THEN 'empty input_uri' END,
    CASE WHEN NOT short_chain THEN 'empty chain' END) AS errors
  FROM v_job""",
    ),
    "tenant_checks": sql(
        V_JOB,
        "SELECT job_id, tenant_id, regexp_full_match(tenant_id, '[a-zA-Z0-9_-]+') AS safe FROM v_job",
    ),
    "fan_out_pages": sql(
        V_JOB,
        """SELECT job_id, CAST(i AS INTEGER) AS page, 'gemini' AS stage, 'v1' AS version,
    CASE WHEN mode = 'rendered' THEN 's3://work/' || job_id || '/' || i ELSE input_uri END AS input_uri,
    0 AS chain_idx
  FROM (SELECT *, unnest(range(1, CASE WHEN mode = 'rendered' THEN page_count + 1 ELSE 2 END)) AS i FROM v_job
    WHERE final_stage IS NOT NULL)""",
    ),
    "number_pages": f"""SELECT job_id, name,
    CASE WHEN bad THEN NULL ELSE CAST(row_number() OVER (PARTITION BY job_id ORDER BY turn) AS INTEGER) END AS page,
    CASE WHEN bad THEN 'no valid page suffix' END AS page_error
  FROM (SELECT job_id, turn, name, bool_or(bad) OVER (PARTITION BY job_id) AS bad FROM (SELECT 'conv_' || conv_id AS job_id, turn, {K} % 31 = 0 OR {K} % 37 = 0 AS bad,
    CASE WHEN {K} % 31 = 0 THEN 'cover.pdf' WHEN {K} % 37 = 0 THEN 'input_0.pdf'
      ELSE 'split/input_' || (turn * 7 + 2) || '.pdf' END AS name FROM conversations))""",
    "merge_jobs": sql(
        V_RECORD,
        """SELECT r.job_id, page, text AS result FROM v_record r JOIN v_verdict v USING (job_id)
  WHERE v.error IS NULL""",
    ),
    "merge_documents": sql(
        V_RECORD,
        """SELECT job_id, n AS page_count, 's3://work/jobs/' || job_id || '/merged/v1/result.json' AS result_uri
  FROM v_verdict WHERE error IS NULL""",
    ),
    "merge_rejects": sql(V_RECORD, "SELECT job_id, error FROM v_verdict WHERE error IS NOT NULL"),
    "decode_rows": f"""SELECT {LINE_ID} AS job_id, l_linenumber AS page, pos, {LINE_TYPE} AS document_type,
    {LINE_ISSUER} AS issuer, strftime(l_shipdate, '%Y-%m-%d') AS date, 'Supplier#' || l_suppkey AS merchant,
    CASE WHEN pos = 0 THEN CAST(floor(l_extendedprice) AS BIGINT)::VARCHAR ELSE '' END AS amount, '' AS country
  FROM (SELECT *, unnest(range(0, greatest({LINE_KIND}, 0))) AS pos FROM lineitem WHERE {LINE_GOOD})""",
    "decode_pages_header": f"""SELECT {LINE_ID} AS job_id, l_linenumber AS page, 'line' AS text,
    {LINE_TYPE} AS document_type, {LINE_ISSUER} AS issuer, greatest({LINE_KIND}, 0) AS row_count
  FROM lineitem WHERE {LINE_GOOD} AND {LINE} <> 8""",
    "failed_page_rows": f"""SELECT {LINE_ID} AS job_id, l_linenumber AS page,
    CASE {LINE} WHEN 0 THEN 'not valid JSON' WHEN 6 THEN 'page is not an object' WHEN 9 THEN 'fields is not an object'
      WHEN 11 THEN 'text is not a string' ELSE 'transactions have a wrong type' END AS error
  FROM lineitem WHERE NOT ({LINE_GOOD}) OR {LINE} = 8""",
    "flatten_fields": sql(V_CPAGE, "SELECT job_id, key, value FROM v_field"),
    "document_headers": sql(
        V_CPAGE, "SELECT job_id, document_type, issuer, card_name, statement_date FROM v_header"
    ),
    "archive_targets": sql(
        *TARGET_VIEWS,
        """SELECT job_id, tenant, year, month, issuer_slug, card_slug, document_type, archive_uri, raw_uri,
    manifest_uri, target_error AS error FROM v_target""",
    ),
    "archive_documents": sql(
        *TARGET_VIEWS,
        """SELECT t.job_id, tenant, year, month, card_slug, p.page, pos, '2026-06-01' AS date,
    'STARBUCKS' AS merchant, (turn + 1)::VARCHAR AS amount
  FROM (SELECT *, unnest(range(0, turn % 3)) AS pos FROM v_cpage) p JOIN v_target t USING (job_id)
  WHERE target_error IS NULL AND t.document_type <> 'receipt'""",
    ),
    "archived_before": sql(
        *TARGET_VIEWS,
        """SELECT job_id, false AS archived, archive_uri, raw_uri, manifest_uri FROM v_target
  WHERE target_error IS NULL AND document_type = 'receipt'""",
    ),
    "archive_collisions": sql(
        *TARGET_VIEWS,
        """SELECT archive_uri, max(job_id) AS job_id, count(*) AS jobs FROM v_target
  WHERE target_error IS NULL GROUP BY archive_uri""",
    ),
    "archive_after_crash": sql(
        *TARGET_VIEWS, V_ROWCOUNT,
        current("document_type = 'receipt'", "job_id"),
    ),
    "archive_rerun": sql(
        *TARGET_VIEWS, V_ROWCOUNT,
        current("true", "(document_type <> 'receipt', job_id)"),
    ),
    "archive_last_write": sql(
        *TARGET_VIEWS, V_ROWCOUNT,
        current("true", "(document_type = 'receipt', job_id)"),
    ),
    "page_results_roundtrip": f"""SELECT version, page, count(*) AS pages, min(size) AS least, max(size) AS most
  FROM (SELECT DISTINCT {pick("l_linenumber % 3", "2.10", "2.1", "007")} AS version, l_linenumber AS page,
    {LINE_ID} AS job_id, CAST(CASE l_linenumber % 2 WHEN 0 THEN -strlen({LINE_ID}) ELSE strlen({LINE_ID}) END AS INTEGER) AS size
    FROM lineitem) GROUP BY ALL""",
    "end_to_end_run": sql(
        *TARGET_VIEWS, V_RUN,
        """SELECT CASE WHEN conv_id % 13 <> 0 THEN job_id END AS job_id,
    CASE WHEN errors <> '' THEN 'rejected' WHEN cut THEN 'running' ELSE 'succeeded' END AS status,
    CASE WHEN errors = '' THEN page_count ELSE 0 END AS page_count, errors AS error,
    CASE WHEN errors = '' AND NOT cut THEN row_count ELSE 0 END AS row_count,
    CASE WHEN errors = '' AND NOT cut THEN total ELSE 0 END AS total,
    CASE WHEN errors = '' AND NOT cut AND row_count > 0 THEN 'Starbucks' END AS merchant,
    CASE WHEN errors = '' AND NOT cut AND row_count > 0 THEN 'JP' END AS country,
    CASE WHEN errors = '' AND NOT cut THEN archive_uri END AS archive_uri,
    errors = '' AND NOT cut AND conv_id % 7 IN (0, 1, 6) AS indexed,
    CASE WHEN errors = '' AND NOT cut THEN 'succeeded' END AS told
  FROM v_run JOIN v_sum USING (conv_id) JOIN (SELECT conv_id, archive_uri FROM v_target) USING (conv_id)""",
    ),
    "purged_artifacts": sql(
        V_CJOB, V_RUN,
        """v_left AS (SELECT * FROM v_run JOIN v_sum USING (conv_id) WHERE errors = ''),
v_parts AS (
  SELECT job_id, 'log' AS part, 2 * page_count + 4 * read AS rows FROM v_left WHERE conv_id % 2 = 0
  UNION ALL SELECT job_id, 'headers', read FROM v_left WHERE conv_id % 2 = 0
  UNION ALL SELECT job_id, 'rows', rows_read FROM v_left WHERE conv_id % 2 = 0
  UNION ALL SELECT job_id, 'merged', 1 FROM v_left WHERE conv_id % 2 = 0 AND NOT cut
  UNION ALL SELECT job_id, 'jobs', CASE WHEN cut THEN 2 ELSE 3 END FROM v_left WHERE conv_id % 2 = 0
  UNION ALL SELECT job_id, 'manifests', 1 FROM v_left WHERE NOT cut)""",
        "SELECT job_id, part, CAST(rows AS BIGINT) AS rows FROM v_parts WHERE rows > 0",
    ),
    "manifests": sql(
        *TARGET_VIEWS,
        f"""SELECT job_id, tenant_id, 'card_statement' AS kind, issuer, card_name, raw_uri, archive_uri,
    '{DEFAULT}' AS chain_id, 'gemini,normalize_card_statement' AS stages,
    '{ARCHIVE_NOW.replace(" ", "T")}Z' AS archived_at FROM v_target WHERE target_error IS NULL""",
    ),
    "index_requests": sql(
        *TARGET_VIEWS, V_ASKED,
        """SELECT job_id, tenant_id, result_uri, 'transactions' AS result_type, 'transactions.v1' AS schema_version,
    archived_at, error FROM v_request""",
    ),
    "index_outcomes": sql(
        *TARGET_VIEWS, V_ASKED,
        f"""SELECT job_id, tenant_id, archive_uri AS result_uri, {REPLY} AS http_status,
    CASE n % 7 WHEN 2 THEN 'schema' WHEN 3 THEN 'transient' WHEN 4 THEN 'transient' WHEN 5 THEN 'unexpected'
      ELSE 'ok' END AS outcome,
    CASE WHEN n % 7 IN (0, 1, 6) THEN 'idx_' || job_id END AS index_job_id
  FROM (SELECT *, conv_id AS n FROM v_target WHERE target_error IS NULL)
  WHERE NOT (n % 7 IN (0, 1, 6) AND job_id IN (SELECT job_id FROM v_request WHERE error IS NULL))""",
    ),
    "indexed_before": sql(
        *TARGET_VIEWS, V_ASKED,
        """SELECT job_id, false AS indexed, 'transactions' AS collection, 'idx_' || job_id AS index_job_id,
    CAST(n % 100 AS INTEGER) AS vector_count, 'model-a' AS embedding_model, '2026-07-02T00:00:00Z' AS indexed_at,
    's3://vault/index/jobs/' || job_id || '.json' AS sidecar_uri
  FROM (SELECT job_id, CAST(split_part(job_id, '_', 2) AS BIGINT) AS n FROM v_request WHERE error IS NULL)
  WHERE n % 7 IN (0, 1, 6)""",
    ),
    "terminal_events": sql(
        V_JOB,
        """SELECT job_id, CASE WHEN status <> 'running' THEN status END AS event, chain_id,
    CASE WHEN status = 'succeeded' THEN result_uri ELSE '' END AS result_uri, page_count,
    CASE WHEN status = 'failed' THEN error ELSE '' END AS error,
    CASE WHEN updated_at <> 'not a time' THEN updated_at END AS at,
    CASE WHEN status = 'running' THEN 'job is running, want succeeded or failed' END AS event_error
  FROM v_job""",
    ),
    "uri_parts": f"""SELECT page_id,
    CASE WHEN page_id % 10 <> 0 THEN split_part(rest, '/', 1) END AS bucket,
    CASE WHEN page_id % 10 <> 0 THEN substr(rest, position('/' IN rest) + 1) END AS stored_key,
    coalesce(kind, 'image/png') AS page_type, coalesce(kind, 'application/octet-stream') AS document_type
  FROM (SELECT page_id, regexp_replace(url, '^https?://', '') ||
      {pick("page_id % 7", ".PNG", ".jpg", ".jpeg", ".webp", ".Pdf", ".", "")} AS rest,
    CASE page_id % 7 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/jpeg'
      WHEN 3 THEN 'image/webp' WHEN 4 THEN 'application/pdf' END AS kind FROM pages)""",
    "text_slugs": f"""SELECT doc_id, {slug('text')} AS slug, {trim('text')} AS trimmed FROM documents""",
    "job_result": sql(
        V_CPAGE, V_CJOB,
        """SELECT p.job_id, page, text, document_type, CAST(turn % 3 AS INTEGER) AS row_count, NULL::VARCHAR AS error
  FROM v_cpage p JOIN v_cjob j USING (job_id) WHERE status = 'succeeded' AND result_uri <> ''""",
    ),
    "refused_results": sql(
        V_CJOB,
        """SELECT job_id, CASE WHEN status = 'failed' THEN 'job_failed' ELSE 'job_not_ready' END AS kind,
    CASE WHEN status = 'failed' THEN error ELSE 'no result while the job is ' || status END AS message
  FROM v_cjob WHERE status <> 'succeeded' OR result_uri = ''""",
    ),
    "extract_pages": f"""SELECT 'doc_' || doc_id AS job_id, 1 AS page,
    CASE WHEN doc_id % 9 <> 1 THEN text END AS text, CASE WHEN doc_id % 9 <> 1 THEN 'rules-v1' END AS model,
    CASE WHEN doc_id % 9 <> 1 THEN CAST(strlen(text) AS INTEGER) END AS input_tokens,
    CASE WHEN doc_id % 9 <> 1 THEN 0 END AS output_tokens,
    CASE WHEN doc_id % 9 = 1 THEN 'unknown prompt profile' END AS error
  FROM documents""",
    "stream_latest_state": sql(V_STATE, f"SELECT {LATEST_LIST} FROM v_latest"),
    "stream_key_life": sql(
        f"RECURSIVE {V_STATE}", V_ROWS,
        f"""SELECT job_id, page, stage, version, status, deliveries, lives, expires_at, {rfc3339("ts")} AS ts, seq
  FROM (SELECT * FROM v_life QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY i DESC) = 1)""",
    ),
    "stream_dedup": sql(
        f"RECURSIVE {V_STATE}", V_ROWS,
        f"""v_pass AS (
  SELECT idempotency_key, i, seq, true AS passed, {epoch('ts')} + {KEPT} AS until FROM v_rows WHERE i = 1
  UNION ALL
  SELECT r.idempotency_key, r.i, r.seq, {epoch('r.ts')} >= p.until,
    CASE WHEN {epoch('r.ts')} >= p.until THEN {epoch('r.ts')} + {KEPT} ELSE p.until END
  FROM v_pass p JOIN v_rows r ON r.idempotency_key = p.idempotency_key AND r.i = p.i + 1)""",
        "SELECT idempotency_key, seq FROM v_pass WHERE passed",
    ),
    "stream_finished_jobs": sql(
        V_STATE, V_JOB,
        f"""v_cut AS (SELECT unnest([{', '.join(f"TIMESTAMP '{c}'" for c in (*SLICES, '9999-01-01 00:00:00'))}]) AS cut),
v_then AS (
  SELECT * FROM v_state JOIN v_cut ON ts < cut WHERE page > 0 AND version = 'v1'
  QUALIFY row_number() OVER (PARTITION BY cut, job_id, page, stage ORDER BY ts DESC, seq DESC) = 1),
v_seen AS (
  SELECT cut, job_id, stage, count(*) FILTER (status = 'succeeded') AS s, count(*) FILTER (status = 'failed') AS f
  FROM v_then WHERE {ALIVE} GROUP BY ALL)""",
        """SELECT job_id, CASE WHEN f > 0 THEN 'failed' ELSE 'succeeded' END AS decision,
    s AS succeeded_count, f AS failed_count
  FROM v_job j JOIN v_seen c USING (job_id)
  WHERE c.stage = j.final_stage AND (f > 0 OR (page_count > 0 AND s = page_count))
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY cut) = 1""",
    ),
    "dead_letters": sql(
        V_STATE,
        f"""SELECT job_id, page, stage, version, attempts, {rfc3339('last_ts')} AS last_ts
  FROM (SELECT job_id, page, stage, version, count(*) FILTER (status = 'running') AS attempts,
      count(*) FILTER (status = 'succeeded') AS done, max(ts) AS last_ts FROM v_state GROUP BY ALL)
  WHERE attempts >= 5 AND done = 0 AND {epoch('last_ts')} + {KEPT} > {epoch(f"TIMESTAMP '{NOW}'")}""",
    ),
    "due_again": sql(
        V_STATE,
        f"""SELECT job_id, page, stage, version, attempts + 1 AS delivery, {epoch('last_ts')} + 600 AS visible_at
  FROM (SELECT job_id, page, stage, version, count(*) FILTER (status = 'running') AS attempts,
      count(*) FILTER (status = 'succeeded') AS done, max(ts) AS last_ts FROM v_state GROUP BY ALL)
  WHERE attempts BETWEEN 1 AND 4 AND done = 0 AND {epoch('last_ts')} + 600 <= {epoch(f"TIMESTAMP '{NOW}'")}""",
    ),
    "stream_events": sql(V_JOB, "SELECT job_id, status AS event FROM v_job WHERE status <> 'running'"),
    "stream_stages": sql(
        V_CPAGE,
        """SELECT job_id, page, CASE WHEN cut THEN '' ELSE document_type END AS document_type,
    CASE WHEN cut THEN 'not valid JSON' ELSE '' END AS error, CAST(CASE WHEN cut THEN 0 ELSE 1 END AS BIGINT) AS sent_on
  FROM (SELECT *, page = 2 AND CAST(split_part(job_id, '_', 2) AS BIGINT) % 8 = 0 AS cut FROM v_cpage)""",
    ),
    "redelivered_messages": """SELECT 'conv_' || conv_id AS job_id, least(conv_id % 7 + 1, 5) AS deliveries,
    conv_id % 7 < 5 AS done, conv_id % 7 >= 5 AS dead
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE turn = 0)""",
    "stream_messages": sql(
        V_JOB,
        """SELECT CASE WHEN tenant_id = 'acme' THEN '{"job_id":' || job_id ELSE job_id END AS job_id,
    CASE WHEN tenant_id = 'acme' THEN 0 ELSE page_count END AS page,
    CASE WHEN tenant_id = 'acme' THEN '' ELSE 'gemini' END AS stage,
    CASE WHEN tenant_id = 'acme' THEN '' ELSE input_uri END AS input_uri,
    CASE WHEN tenant_id = 'acme' OR NOT short_chain THEN 0 ELSE 2 END AS chain_length,
    CASE WHEN tenant_id = 'acme' THEN 'message is not valid JSON' ELSE '' END AS decode_error
  FROM v_job""",
    ),
}
