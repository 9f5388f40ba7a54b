from veilframe.functions.checks import luhn
from veilframe.operators import protect as P
from veilframe.operators import scan as S
from veilframe.session import cut

TEXTS = [(1, "card 4111-1111-1111-1111, mail a@example.com"), (2, "TLP:RED memo"), (3, None), (4, "plain"), (5, "ü a@example.com ü b@example.org")]


def test_guard_redacts_and_blocks(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string")
    got = {r.doc_id: r for r in P.guard(docs, S.scan(docs)).collect()}
    assert got[1].redacted_text == "card XXXXXXXXXXXXXXXXXXX, mail XXXXXXXXXXXXX" and got[1].status == "ok"
    assert got[2].status == "blocked" and got[2].classification == 4
    assert got[3].redacted_text is None and got[4].is_clean
    assert len(got[5].redacted_text.encode()) == len(TEXTS[4][1].encode())


def test_tokens_round_trip(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string")
    hidden, vault = P.tokenize(docs, cut(S.scan(docs)), b"k")
    hidden = cut(hidden)
    assert not any("example" in (r.text or "") for r in hidden.collect())
    back = {r.doc_id: r.text for r in P.detokenize(hidden, vault).collect()}
    assert back == dict(TEXTS)


def test_fake_values_keep_shape(spark):
    docs = spark.createDataFrame(TEXTS[:1] * 2, "doc_id int, text string")
    made = [r.text for r in P.obfuscate(docs, cut(S.scan(docs.limit(1)))).collect()]
    assert made[0] == made[1] and made[0] != TEXTS[0][1]
    assert luhn(made[0][5:24]) and made[0][5] == "4"


def test_lists(spark):
    df = spark.createDataFrame([("198.51.100.77", "a/b/c.PDF", "x.corp.example"), ("198.51.101.1", "a/c.txt", "notcorp.example")], "ip string, path string, host string")
    got = df.select(P.list_predicate("cidr", "198.51.100.0/24", df.ip).alias("c"), P.list_predicate("path", "**/*.pdf", df.path).alias("p"), P.list_predicate("domain", "corp.example", df.host).alias("d")).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, False, False)]
    assert P.resolve_categories() is None and "Card Track Data" in P.resolve_categories(["pci_dss"])


def test_categories_that_a_summary_leaves_out(spark):
    from veilframe.operators.findings import lost_categories

    rows = [(1, [("b",), ("a",), ("b",)], ["b"]), (2, [("a",)], ["a"]), (3, None, None), (4, [("c",)], None), (5, [(None,)], [])]
    df = spark.createDataFrame(rows, "id int, findings array<struct<category:string>>, categories_found array<string>")
    assert {r.id: r.lost for r in lost_categories(df).collect()} == {1: ["a"], 4: ["c"]}


def test_dates_of_documents_and_paths(spark):
    from pyspark.sql import functions as F

    from veilframe.functions import text as T

    rows = [("D:20240131120000+02'00'", "2024-01-31T10:00:00Z"), ("D:20240131120000-0130", "2024-01-31T13:30:00Z"), ("D:2024", "2024-01-01T00:00:00Z"), ("D:20241399", None), ("no", None), (None, None), ("20240229235959Z", "2024-02-29T23:59:59Z")]
    df = spark.createDataFrame(rows, "d string, want string").withColumn("got", T.pdf_time(F.col("d")))
    assert all(r.got == r.want for r in df.collect())
    paths = spark.createDataFrame([("/data/a.txt", True), ("/data/../etc", False), ("/database/x", False), ("/data/a..b", True), ("/data/a\nb", False), (None, False)], "p string, want boolean")
    assert all(r.got == r.want for r in paths.withColumn("got", T.safe_path(F.col("p"), "/data")).collect())
