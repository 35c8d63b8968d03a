import re
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docspark import functions as fn
from docspark.functions.keys import DOCUMENT_DEFAULT_TYPE
from docspark.functions.text import WHITE_SPACE

SLOW = settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def evaluate(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    rows = df.select("i", *[c.alias(f"c{n}") for n, c in enumerate(columns)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in rows]



def x():
    return F.col("x")


def test_trim_removes_all_unicode_space(spark):
    cases = {"\u3000\u00a0a b\u2003\u2028": "a b", "\tx\n\v": "x", "\u200ba\u0085": "\u200ba"}
    assert evaluate(spark, list(cases), fn.unicode_trim(x())) == list(cases.values())


def test_canonical_issuer(spark):
    cases = {
        "PayPay株式会社": "paypay",
        " PayPay Card ": "paypay card",
        "X(株)(株)": "x",
        "X(株)(株)(株)": "x(株)",
        "X(株)株式会社": "x",
        "X株式会社(株)": "x株式会社",
        "X（株）": "x（株）",
        "X 株式会社": "x",
        "": "",
    }
    assert evaluate(spark, list(cases), fn.canonical_issuer(x())) == list(cases.values())


ZEROS = {
    "0": True, "0円": True, "": True, "0.00": True, "1,234": False, "0円 ": False,
    "1,234円": False, " 0 円": True, "-0": True, ".0": True, "0.": True, "0e9": True,
    ".": False, "n/a": False, "0x0": False, "00,0": True, "円": True, "0.0000000001": False,
}


def test_amount_is_zero(spark):
    assert evaluate(spark, list(ZEROS), fn.amount_is_zero(x())) == list(ZEROS.values())


def test_parse_amount(spark):
    cases = {
        "1,680": "1680", " 12.50 ": "12.5", "1e3": "1000", ".5": "0.5", "5.": "5", "-3": "-3",
        "1,234円": None, "1.5d": None, "１２": None, "": None, "NaN": None, "abc": None, "+7": "7",
    }
    got = evaluate(spark, list(cases), fn.parse_amount(x()))
    assert got == [None if v is None else Decimal(v) for v in cases.values()]


@pytest.mark.parametrize(
    "foreign,cases",
    [
        (True, {"23.93": "23.93", "0.125": "0.12", "0.135": "0.14", "-0.001": "-0.00", "2": "2.00"}),
        (False, {"2231": "2231", "2.5": "2", "3.5": "4", "-0.4": "-0", "0": "0"}),
    ],
)
def test_format_amount(spark, foreign, cases):
    got = evaluate(spark, list(cases), fn.format_amount(x().cast("decimal(38,6)"), foreign))
    assert got == list(cases.values())


def test_country_from_currency(spark):
    cases = {"": "JP", " myr ": "MY", "SGD": "SG", "THB": "TH", "USD": "US", "EUR": ""}
    assert evaluate(spark, list(cases), fn.country_from_currency(x())) == list(cases.values())


def test_slugs(spark):
    cases = {
        "Travel Plus": "travel-plus", "  KAWA--Card_1\t2 ": "kawa-card-1-2",
        "三井住友": "", "-a-": "a", "a é b": "a-b", "A&B": "ab",
    }
    assert evaluate(spark, list(cases), fn.slugify(x())) == list(cases.values())


def test_document_types(spark):
    cases = {"receipt": True, "bill": True, "contract": False, "": False}
    assert evaluate(spark, list(cases), fn.known_document_type(x())) == list(cases.values())


def test_card_slug(spark):
    def slug(issuer, card, job):
        return fn.card_slug(fn.issuer_slug(F.lit(issuer)), F.lit(card), F.lit(job)).alias("s")

    rows = spark.range(1).select(
        *[
            slug(*c).alias(f"c{i}")
            for i, c in enumerate(
                [
                    ("KAWA", "Travel Plus", "j"),
                    ("KAWA", "", "j"),
                    ("", "Gold", "j"),
                    ("Unknown", "", "upload-2031-000123456789"),
                    ("", "", "short"),
                ]
            )
        ]
    )
    assert tuple(rows.first()) == ("kawa-travel-plus", "kawa", "gold", "000123456789", "short")


def test_year_month(spark):
    now = F.lit("2026-07-02 00:00:00").cast("timestamp")
    cases = {
        "2026-06-10": ("2026", "06"), "2026/6/1": ("2026", "06"), "2026年6月10日": ("2026", "06"),
        "": ("2026", "07"), "June 2026": ("2026", "07"), "2026-99": ("2026", "99"),
    }
    assert evaluate(spark, list(cases), *fn.year_month(x(), now)) == list(cases.values())


def test_keys(spark):
    def key(page, stage, version):
        return fn.stage_key(F.lit("job_123"), F.lit(page), F.lit(stage), F.lit(version))

    row = spark.range(1).select(
        key(17, "mock", "v1").alias("a"), key(0, "merge", "v1").alias("b"),
        key(17, "mock", "v2").alias("c"), key(1234567, "m", "v1").alias("d"),
    ).first()
    assert tuple(row) == (
        "job_123:page:000017:mock:v1", "job_123:merge:v1",
        "job_123:page:000017:mock:v2", "job_123:page:1234567:m:v1",
    )


def test_uris(spark):
    cases = {
        "s3://b/k/x.pdf": ("b", "k/x.pdf"), "s3://b/": (None, None), "s3:///k": (None, None),
        "file:///a": (None, None), "s3://b": (None, None),
    }
    assert evaluate(spark, list(cases), *fn.parse_uri(x())) == list(cases.values())


def test_mime(spark):
    cases = {
        "a.PNG": "image/png", "a.jpg": "image/jpeg", "a.b/c": None, "x.webp": "image/webp",
        "x.jpeg": "image/jpeg", "x.pdf": "application/pdf", "x": None, "x.txt": None,
    }
    got = evaluate(spark, list(cases), fn.mime_from_uri(x()), fn.mime_from_uri(x(), DOCUMENT_DEFAULT_TYPE))
    assert got == [(v or "image/png", v or DOCUMENT_DEFAULT_TYPE) for v in cases.values()]


def test_string_field_takes_the_first_text(spark):
    fields = F.try_parse_json(x())
    cases = {
        '{"issuer_name":"A","issuer":"B"}': "A", '{"issuer_name":5,"issuer":"B"}': "B",
        '{"issuer_name":"","issuer":"B"}': "", '{"issuer_name":null,"issuer":"B"}': "B", "{}": "",
    }
    got = evaluate(spark, list(cases), fn.string_field(fields, "issuer_name", "issuer"))
    assert got == list(cases.values())


def test_is_empty_value(spark):
    cases = {'""': True, '"  "': True, "null": True, "0": False, "false": False, "[]": False, "{}": False, '"a"': False}
    assert evaluate(spark, list(cases), fn.is_empty_value(F.try_parse_json(x()))) == list(cases.values())


def test_chain_text(spark):
    chain = fn.decode_chain(x())
    text = '[{"name":"a","version":"v1","queue_name":"q"}]'
    got = evaluate(spark, ["", "{bad", text], F.size(chain), fn.encode_chain(chain))
    assert got == [(0, ""), (0, ""), (1, text)]


def test_index_outcome(spark):
    codes = {"200": "ok", "204": "ok", "400": "schema", "429": "transient", "500": "transient", "404": "unexpected", "302": "unexpected"}
    assert evaluate(spark, list(codes), fn.index_outcome(x().cast("int"))) == list(codes.values())


def test_rfc3339(spark):
    cases = {"2026-06-10T01:02:03Z": "2026-06-10T01:02:03Z", "2026-06-10T01:02:03+09:00": "2026-06-09T16:02:03Z", "x": None, "": None, "2026-13-40T01:02:03Z": None}
    assert evaluate(spark, list(cases), fn.format_rfc3339(fn.parse_rfc3339(x()))) == list(cases.values())


def test_tenant_safe(spark):
    cases = {"acme": True, "a-b_1": True, "": False, "a b": False, "a=b": False, "a\n": False, "../x": False}
    assert evaluate(spark, list(cases), fn.tenant_safe(x())) == list(cases.values())


# Plain-Python models, compared on random text.


def model_zero(s):
    s = s.replace(",", "")
    s = s.removesuffix("円").strip(WHITE_SPACE)
    if s == "":
        return True
    return bool(re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", s)) and not re.search(
        "[1-9]", re.split("[eE]", s)[0]
    )


def model_slug(s):
    out = []
    for ch in s.strip(WHITE_SPACE).lower():
        if ch in "abcdefghijklmnopqrstuvwxyz0123456789":
            out.append(ch)
        elif ch in " -_\t" and out and out[-1] != "-":
            out.append("-")
    return "".join(out).rstrip("-")


def model_month(s):
    m = re.search(r"([0-9]{4})[-/年]([0-9]{1,2})", s)
    return (m[1], m[2].zfill(2)) if m else ("2026", "07")


AMOUNTS = st.lists(st.text("0123456789.,-+eE円 　x", max_size=8), min_size=40, max_size=80)
SLUGS = st.lists(st.text("aZ9 -_\té三&", max_size=12), min_size=40, max_size=80)
DATES = st.lists(st.text("0129-/年月 ", max_size=12), min_size=40, max_size=80)


@SLOW
@given(AMOUNTS)
def test_amounts_match_the_model(spark, values):
    got = evaluate(spark, values, fn.amount_is_zero(x()), fn.parse_amount(x()).isNotNull())
    assert [g[0] for g in got] == [model_zero(v) for v in values]
    shape = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,1})?"
    for v, (_, parsed) in zip(values, got):
        if re.fullmatch(shape, v.replace(",", "").strip(WHITE_SPACE)):
            assert parsed, v
        elif not re.search("[eE]", v):
            assert not parsed, v


@SLOW
@given(SLUGS)
def test_slugs_match_the_model(spark, values):
    assert evaluate(spark, values, fn.slugify(x())) == [model_slug(v) for v in values]


@SLOW
@given(DATES)
def test_months_match_the_model(spark, values):
    now = F.lit("2026-07-02 00:00:00").cast("timestamp")
    assert evaluate(spark, values, *fn.year_month(x(), now)) == [model_month(v) for v in values]
