import pytest
from pyspark.sql import functions as F

from docspark.operators import rollup
from docspark.operators.results import aggregate_job
from docspark.operators.spread import left_join_lookup
from docspark.operators.transactions import enrich_transactions, normalize_card_statement
from docspark.schema import BadFilter, DictionaryError, JobFailed, JobNotReady, NotFound
from docspark.sources.dictionary import dictionary_from_entries, load_dictionary, seed_dictionary


def row(merchant, amount="", **more):
    return {"merchant": merchant, "amount": amount, **more}


@pytest.mark.parametrize(
    "issuer,rows,kept",
    [
        ("Kawa Bank", [("books", "77")], ["77"]),
        ("kawa bank株式会社", [("rent", "52,000"), (" KAWA BANK", "9"), ("Kawa Bank(株)", "8")], ["52,000"]),
        ("Kawa(株)(株)株式会社", [("kawa", "31"), ("kawa(株)", "32"), ("kawa（株）", "33")], ["33"]),
        ("", [("", "6"), ("tea", ".0")], ["6"]),
        ("Z", [("p", "-0.0"), ("q", "0e9"), ("r", "00,000円"), ("s", "0.01"), ("t", "0円 "), ("u", "5円")], ["0.01", "0円 ", "5円"]),
        ("Kawa", [(None, "12"), ("kawa", "13")], ["12"]),
    ],
)
def test_normalize(tx, issuer, rows, kept):
    df = tx(*[row(m, a) for m, a in rows], issuer=issuer)
    got = normalize_card_statement(df).orderBy("pos").collect()
    assert [r.amount for r in got] == kept


ENRICH = [
    (row("スターバックス コーヒー"), ("Starbucks", "cafe", "JP")),
    (row("Night market 7", foreign_currency=" sgd"), ("", "", "SG")),
    (row("tram ticket", "3"), ("", "", "JP")),
    (row("\trehan restaurant\n", foreign_currency="USD"), ("Rehan Restaurant", "restaurant", "MY")),
    (row("Starbucks", category="gift"), ("Starbucks", "gift", "JP")),
    (row("　starbucks "), ("Starbucks", "cafe", "JP")),
    (row("familymart", country="XX"), ("FamilyMart", "convenience_store", "XX")),
    (row("Rehan Restaurant", country="XX"), ("Rehan Restaurant", "restaurant", "MY")),
    (row(""), ("", "", "JP")),
    (row("x", foreign_currency="EUR"), ("", "", "")),
]


def test_enrich(spark, tx):
    df = enrich_transactions(tx(*[r for r, _ in ENRICH]), seed_dictionary(spark))
    got = [
        (r.merchant_normalized, r.category, r.country) for r in df.orderBy("pos").collect()
    ]
    assert got == [want for _, want in ENRICH]


def test_enrich_twice_changes_nothing(spark, tx):
    seed = seed_dictionary(spark)
    once = enrich_transactions(tx(*[r for r, _ in ENRICH]), seed)
    assert sorted(enrich_transactions(once, seed).collect()) == sorted(once.collect())


def test_large_lookup_is_salted_and_gives_the_same(spark, tx):
    rows = tx(*[row("k") for _ in range(50)], row("other"))
    keyed = rows.withColumn("alias_key", F.col("merchant"))
    lookup = spark.createDataFrame([("k", "K")], "alias_key string, name string")
    small = left_join_lookup(keyed, lookup, 1, "alias_key", ["job_id", "page", "pos"])
    large = left_join_lookup(keyed, lookup, 10**9, "alias_key", ["job_id", "page", "pos"])
    columns = small.columns
    assert sorted(small.collect()) == sorted(large.select(*columns).collect())


def test_dictionary_conflicts(spark):
    with pytest.raises(DictionaryError, match="same"):
        dictionary_from_entries(
            spark, [{"canonical": "A", "aliases": ["SAME"]}, {"canonical": "B", "aliases": ["same "]}]
        )
    with pytest.raises(DictionaryError, match="empty"):
        dictionary_from_entries(spark, [{"canonical": "A"}, {"canonical": "", "aliases": ["x"]}])


def test_dictionary_repeated_name_takes_the_later_entry(spark):
    d = dictionary_from_entries(
        spark,
        [
            {"canonical": "A", "category": "old", "aliases": ["x", " "]},
            {"canonical": "A", "category": "new", "aliases": ["x"]},
        ],
    )
    got = {r.alias_key: r.category for r in d.aliases.collect()}
    assert got == {"a": "new", "x": "new"} and d.rows == 2


def test_dictionary_from_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "m.yaml"
    path.write_text("- canonical: Shop\n  category: c\n  aliases: [SHOP 1, ' Shop 2 ']\n", encoding="utf-8")
    got = load_dictionary(spark, str(path))
    assert sorted(r.alias_key for r in got.aliases.collect()) == ["shop", "shop 1", "shop 2"]


PURCHASES = [
    row("bakery", "7", page=3),
    row("kiosk", "61", page=1),
    row("bakery", "-2", page=1),
    row("bakery", "1,005", page=2),
    row("bakery", "about 5", page=2),
]
FOREIGN = [
    row("a", "1", foreign_amount="0.335", foreign_currency="THB"),
    row("b", "1", foreign_amount="8", foreign_currency="SGD"),
    row("c", "1", foreign_amount="1,000.21", foreign_currency="THB"),
    row("d", "999"),
]


def test_rollup_by_merchant(tx):
    got = rollup.aggregate(tx(*PURCHASES), "merchant", " bakery ").first()
    assert (got.row_count, got.total, got.currency) == (3, "1010", "JPY")
    rows = rollup.aggregate_rows(tx(*PURCHASES), "merchant", "bakery").collect()
    assert [(r.page, r.amount) for r in rows] == [(1, "-2"), (2, "1,005"), (3, "7")]


def test_rollup_by_foreign_currency(tx):
    got = rollup.aggregate(tx(*FOREIGN), "foreign_currency", "THB").first()
    assert (got.row_count, got.total, got.currency) == (2, "1000.54", "THB")


def test_rollup_by_every_value(tx):
    rows = rollup.aggregate_by(tx(*PURCHASES, row(" padded ", "1"), row("", "5")), "merchant").collect()
    assert {r.filter_value: (r.row_count, r.total) for r in rows} == {
        "bakery": (3, "1010"), "kiosk": (1, "61"),
    }


def test_home_currency_is_exact_unless_asked(tx):
    df = tx(row("a", "1", currency="JPY"), row("b", "2"))
    assert rollup.aggregate(df, "currency", "JPY").first().total == "1"
    assert rollup.aggregate(df, "currency", "JPY", effective_currency=True).first().total == "3"


@pytest.mark.parametrize(
    "params", [{}, {"merchant": " "}, {"merchant": "a", "date": "b"}, {"merchent": "a"}, {"merchent": "", "date": "x"}]
)
def test_bad_filters(params):
    with pytest.raises(BadFilter):
        rollup.resolve_filter(params)


def test_filter_is_trimmed_and_blank_ones_ignored():
    assert rollup.resolve_filter({"merchant": " a　", "date": ""}) == ("merchant", "a")


def test_aggregate_of_one_job(spark, tx):
    jobs = spark.createDataFrame(
        [
            ("job_1", "succeeded", "s3://w/x", 2, ""),
            ("job_2", "running", "", 1, ""),
            ("job_3", "failed", "", 1, "boom"),
            ("job_4", "succeeded", "", 1, ""),
        ],
        "job_id string, status string, result_uri string, page_count int, error string",
    )
    total, rows = aggregate_job(jobs, tx(*PURCHASES), "job_1", {"merchant": "bakery"})
    assert total.first().total == "1010" and rows.count() == 3
    for job, error in (("job_2", JobNotReady), ("job_3", JobFailed), ("job_4", JobNotReady), ("nope", NotFound)):
        with pytest.raises(error):
            aggregate_job(jobs, tx(*PURCHASES), job, {"merchant": "a"})
    with pytest.raises(BadFilter):
        aggregate_job(jobs, tx(*PURCHASES), "nope", {"merchnt": "a"})
