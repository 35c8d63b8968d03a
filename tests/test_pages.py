import json

from pyspark.sql import functions as F

from docspark.functions import chain_literal
from docspark.operators import extract
from docspark.operators.pages import fan_out_pages, number_pages, route_next
from docspark.operators.spread import join_per_job, rank_in_group
from docspark.operators.transactions import explode_transactions, page_issuer
from docspark.schema import CHAIN_REGISTRY, DEFAULT_CHAIN_ID, MESSAGE
from docspark.sources.pages import (
    decode_pages,
    failed_pages,
    good_pages,
    latest_page_results,
    read_documents,
    read_page_results,
    write_page_results,
)


def decoded(spark, bodies):
    rows = [("job_1", i, b) for i, b in enumerate(bodies, 1)]
    return decode_pages(spark.createDataFrame(rows, "job_id string, page int, body string"))


def test_decode_errors(spark):
    cases = {
        '{"text":"a","document_type":"bill","fields":{"k":1},"transactions":[{"date":"d"}]}': None,
        "{}": None,
        "null": None,
        '{"text":null,"fields":null,"transactions":null}': None,
        '{"transactions":[]}': None,
        '{"transactions":[null,{"merchant":"m"}]}': None,
        '{"transactions":[{"amount":"1","other":{"amount":5}}]}': None,
        '{"other":[1,"x"]}': None,
        '{"text":"a","text":"b"}': None,
        "{bad": "not valid JSON",
        "": "not valid JSON",
        "[1]": "page is not an object",
        '"x"': "page is not an object",
        '{"text":1}': "text is not a string",
        '{"document_type":[]}': "document_type is not a string",
        '{"fields":[1]}': "fields is not an object",
        '{"transactions":{"date":"d"}}': "transactions have a wrong type",
        '{"transactions":[{"amount":1680}]}': "transactions have a wrong type",
        '{"transactions":[{"amount":"1"},{"amount":2}]}': "transactions have a wrong type",
        '{"transactions":[{"country":{"a":"b"}}]}': "transactions have a wrong type",
        '{"transactions":["x"]}': "transactions have a wrong type",
        '{"transactions":[{"date":"d"},5]}': "transactions have a wrong type",
        '{"transactions":"x"}': "transactions have a wrong type",
    }
    got = {r.page: r.error for r in decoded(spark, list(cases)).collect()}
    assert [got[i] for i in range(1, len(cases) + 1)] == list(cases.values())


def test_decode_values(spark):
    body = {
        "text": "t",
        "fields": {"issuer_name": 5, "issuer": "B", "n": 12345678901234567890},
        "transactions": [{"date": "d", "merchant": "m", "amount": "1,680"}, {"merchant": None}],
    }
    pages = decoded(spark, [json.dumps(body), '{"text":"a","text":"b"}'])
    first, second = page_issuer(good_pages(pages)).orderBy("page").collect()
    assert (first.text, first.document_type, first.issuer) == ("t", "", "B")
    assert second.text == "b"
    rows = explode_transactions(page_issuer(good_pages(pages)), ("issuer",)).orderBy("pos").collect()
    assert [(r.page, r.pos, r.merchant, r.amount, r.country, r.issuer) for r in rows] == [
        (1, 0, "m", "1,680", "", "B"),
        (1, 1, "", "", "", "B"),
    ]


def test_one_bad_page_leaves_the_others(spark):
    pages = decoded(spark, ["{bad", '{"text":"x"}'])
    assert [r.page for r in failed_pages(pages).collect()] == [1]
    assert [r.page for r in good_pages(pages).collect()] == [2]


def test_page_files(spark, tmp_path):
    for job, page, stage in (("job_1", 1, "gemini"), ("job 2+3%", 12, "gemini"), ("job_1", 1, "mock")):
        path = tmp_path / f"jobs/{job}/pages/{page:06d}/{stage}/v1"
        path.mkdir(parents=True)
        (path / "result.json").write_text('{\n"text":"x"}')
    got = read_page_results(spark, str(tmp_path), "gemini", "v1").collect()
    assert sorted((r.job_id, r.page, r.stage, r.version) for r in got) == [
        ("job 2+3%", 12, "gemini", "v1"),
        ("job_1", 1, "gemini", "v1"),
    ]
    assert all(json.loads(r.body) == {"text": "x"} for r in got)


def test_documents(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"pdf")
    (tmp_path / "b.txt").write_bytes(b"txt")
    got = {r.uri.rsplit("/", 1)[1]: (r.mime, bytes(r.content)) for r in read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.PDF": ("application/pdf", b"pdf"), "b.txt": ("application/octet-stream", b"txt")}


def test_page_results_of_a_repeated_run_replace_themselves(spark, tmp_path):
    def rows(*values):
        return spark.createDataFrame(
            [("j", p, t, "s", "v1") for p, t in values], "job_id string, page int, text string, stage string, version string"
        )

    root = str(tmp_path / "results")
    write_page_results(rows((1, "a"), (2, "b")), root, 1)
    write_page_results(rows((1, "a"), (2, "b")), root, 1)
    write_page_results(rows((2, "new")), root, 2)
    got = latest_page_results(spark, root, "s", "v1").collect()
    assert sorted((r.page, r.text) for r in got) == [(1, "a"), (2, "new")]


def test_number_pages(spark):
    names = ["input_10.pdf", "dir_9/input_2.pdf", "input_1.pdf", "input.pdf", "input_.pdf", "input_0.pdf", "input_x.pdf", "a_b_07.pdf"]
    names += ["big_9223372036854775807.pdf"]
    bad = {"input.pdf", "input_.pdf", "input_0.pdf", "input_x.pdf"}
    rows = [("good", n) for n in names if n not in bad]
    rows += [(n, m) for n in bad for m in (n, "input_1.pdf")]
    df = spark.createDataFrame(rows, "job_id string, name string")
    got = {(r.job_id, r.name): r.page for r in number_pages(df).collect()}
    sound = {"input_1.pdf": 1, "dir_9/input_2.pdf": 2, "a_b_07.pdf": 3, "input_10.pdf": 4, names[-1]: 5}
    # One bad file fails all files of its job.
    assert got == {("good", n): p for n, p in sound.items()} | {r: None for r in rows if r[0] != "good"}


def test_rank_in_group_over_many_stretches(spark):
    values = [(g, v) for g in ("a", "b") for v in (1, 3, 4, 17, 18, 90, 91, 400, 5000)]
    df = spark.createDataFrame(values, "g string, v long")
    got = rank_in_group(df, "g", "v", "r", width=4).collect()
    for g in ("a", "b"):
        assert [r.r for r in sorted((r for r in got if r.g == g), key=lambda r: r.v)] == list(range(1, 10))


def test_join_per_job_spreads_long_jobs(spark):
    rows = spark.createDataFrame([("a", p) for p in (1, 4095, 4096, 9000)] + [("b", 1), ("c", 1)], "job_id string, page int")
    side = spark.createDataFrame([("a", 9000, "x"), ("b", 1, "y")], "job_id string, max_page int, v string")
    got = join_per_job(rows, side).collect()
    assert sorted((r.job_id, r.page, r.v) for r in got) == [
        ("a", 1, "x"), ("a", 4095, "x"), ("a", 4096, "x"), ("a", 9000, "x"), ("b", 1, "y"),
    ]


def work_rows(spark, *rows):
    full = [
        {"job_id": "j", "document_id": "d", "page": 1, "stage": "gemini", "version": "v1", "input_uri": "in",
         "previous_uri": "", "prompt_profile_id": "", "metadata": {"k": "v"}, "chain": [], "chain_idx": 0, **r}
        for r in rows
    ]
    return spark.createDataFrame(full, MESSAGE)


def test_fan_out(spark):
    chain = CHAIN_REGISTRY[DEFAULT_CHAIN_ID]
    jobs = spark.createDataFrame([("a", ["u1", "u2"]), ("b", [])], "job_id string, pages array<string>")
    got = fan_out_pages(jobs.withColumn("chain", chain_literal(chain))).orderBy("page").collect()
    assert [(r.job_id, r.page, r.stage, r.input_uri, r.chain_idx) for r in got] == [
        ("a", 1, "gemini", "u1", 0), ("a", 2, "gemini", "u2", 0),
    ]


def test_route_next(spark):
    chain = CHAIN_REGISTRY[DEFAULT_CHAIN_ID]
    done = work_rows(spark, {"chain": chain}, {"chain": chain, "chain_idx": 2, "page": 2}, {"page": 3}).withColumn("result_uri", F.lit("out"))
    got = route_next(done).collect()
    assert [(r.page, r.stage, r.previous_uri, r.input_uri, r.chain_idx, r.metadata) for r in got] == [
        (1, "normalize_card_statement", "out", "in", 1, {"k": "v"})
    ]
    assert {(r.page, r.stage) for r in route_next(done, ("x", "v9")).collect()} == {
        (1, "normalize_card_statement"), (3, "x"),
    }


def test_extract(spark):
    work = work_rows(
        spark,
        {"page": 1, "input_uri": "a.png"},
        {"page": 2, "input_uri": "", "previous_uri": "b.png"},
        {"page": 3, "input_uri": ""},
        {"page": 4, "input_uri": "missing"},
        {"page": 5, "input_uri": "a.png", "prompt_profile_id": "nope"},
    )
    docs = spark.createDataFrame(
        [("a.png", bytearray("card\n2026/06/22  SOME SHOP  1,680\n".encode())), ("b.png", bytearray(b"plain"))],
        "uri string, content binary",
    )
    got = {r.page: r for r in extract.extract_pages(work, docs).collect()}
    page = json.loads(got[1].body)
    assert page["transactions"] == [{"date": "2026/06/22", "merchant": "SOME SHOP", "amount": "1,680"}]
    assert json.loads(got[2].body)["document_type"] == "other"
    assert [got[p].error for p in (1, 2, 3, 4, 5)] == [
        None, None, "no input or previous uri", "document not found", "unknown prompt profile",
    ]
    assert (got[1].provider, got[1].output_tokens) == ("rules", 0)
