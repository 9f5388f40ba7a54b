import pytest

from veilframe.operators import enrich as E
from veilframe.operators import settings as C
from veilframe.operators.scan import ScanConfig, scan


def docs(spark):
    return spark.createDataFrame([(1, "call 555 now, recall 777"), (2, None), (3, ""), (4, "555")], "doc_id int, text string")


def test_hits_matches_and_windows(spark):
    words = spark.createDataFrame([("call",), ("recall",)], "keyword string")
    hits = {(r.doc_id, r.keyword, r.pos) for r in E.keyword_hits(docs(spark), words).collect()}
    assert hits == {(1, "call", 0), (1, "recall", 14)}
    found = {(r.doc_id, r.match, r.start, r.has_context) for r in E.with_context(E.matches_of(docs(spark), "[0-9]{3}"), E.keyword_hits(docs(spark), words), 6).collect()}
    assert found == {(1, "555", 5, True), (1, "777", 21, False), (4, "555", 0, False)}
    assert E.keyword_hits(docs(spark), words.limit(0)).count() == 0


def test_exact_registry(spark):
    values = spark.createDataFrame([("id", "AB-12 345"), ("id", "ab12345"), ("mail", "A@example.com"), ("id", None)], "category string, value string")
    registry = E.register_values(None, values, b"k")
    assert registry.count() == 2
    df = spark.createDataFrame([(1, "mail a@example.com or b@example.com")], "doc_id int, text string")
    got = E.exact_matches(df, registry, b"k").collect()
    assert [(r.category, r.match) for r in got] == [("EDM: mail", "a@example.com")]
    assert E.exact_matches(df, E.remove_category(registry, "mail"), b"k").count() == 0


def test_card_prefix_and_recall(spark):
    f = spark.createDataFrame([("Credit Card Numbers", "4111 1111", 0.98), ("Other", "4111 1111", 0.98)], "category string, text string, confidence double")
    p = spark.createDataFrame([(411111, "Visa", "credit", "US", "A")], "bin int, brand string, card_type string, country string, issuer string")
    assert [(r.brand, r.confidence) for r in E.with_card_prefix(f, p).orderBy("category").collect()] == [("Visa", 1.0), (None, 0.98)]
    want = spark.createDataFrame([(1, "s", "abc"), (2, "s", "x")], "doc_id int, sub_category string, text string")
    got = spark.createDataFrame([(1, "s", "xabcx"), (1, "s", "q")], "doc_id int, sub_category string, text string")
    assert [tuple(r) for r in E.recall(want, got).collect()] == [("s", 2, 1)]


def test_close_words_are_exact_at_distance_one(spark):
    w = spark.createDataFrame([("lable",), ("label",), ("labels",), ("table",), ("abel",)], "word string")
    v = spark.createDataFrame([("label",)], "entry string")
    assert {(r.word, r.distance) for r in E.close_words(w, v, 1).collect()} == {("label", 0), ("labels", 1), ("abel", 1)}


def test_overrides_and_policies(spark):
    o = C.read_overrides('{"version": 1, "disabled_patterns": [{"category": "Contact Information", "sub_category": "Email Address"}], "pattern_overrides": {"Credit Card Numbers/Visa": {"specificity": 0.1}}, "custom_categories": [{"name": "T", "patterns": [{"name": "t", "regex": "T-[0-9]+"}]}]}')
    config = C.apply_overrides(ScanConfig(categories=frozenset(["Credit Card Numbers", "Contact Information"])), o)
    df = spark.createDataFrame([(1, "4111-1111-1111-1111 a@example.com T-77")], "doc_id int, text string")
    assert [(r.sub_category, r.confidence) for r in scan(df, config).collect()] == [("Visa", 0.1)]
    assert [r.match for r in E.custom_pattern_findings(df, list(o.custom)).collect()] == ["T-77"]
    with pytest.raises(ValueError):
        C.read_overrides('{"version": 99}')
    p = C.read_policy('name = "p"\n[scan]\npresets = ["pci_dss"]\naction = "explode"\n[[rules]]\nname = "r"\nmatch_categories = ["Credit Card Numbers"]\npriority = 3\n')
    assert p.action == "redact" and p.warnings and "Credit Card Numbers" in p.config.categories and p.rules_frame(spark).count() == 1
    assert C.profile("FULL_SCAN")[0].categories is None and C.may("admin", "audit") and not C.may("viewer", "scan")
    plugins = C.Plugins()
    plugins.register(lambda f: f.where("missing_column = 1"))
    plugins.register(lambda f: f.limit(1))
    assert plugins.apply(df).count() == 1 and len(plugins.failures) == 1


def test_close_words_are_exact_at_distance_two(spark):
    import random

    rnd = random.Random(2)
    names = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 7))) for _ in range(60)]
    w, v = (spark.createDataFrame([(x,) for x in set(part)], f"{name} string") for part, name in ((names[:40], "word"), (names[30:], "entry")))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = {(a, b, distance(a, b)) for a in set(names[:40]) for b in set(names[30:]) if distance(a, b) <= 2}
    assert {(r.word, r.entry, r.distance) for r in E.close_words(w, v, 2).collect()} == want


def test_registry_is_kept_and_values_are_found_in_any_form(spark, tmp_path):
    values = spark.createDataFrame([("id", "ＡＢ-12"), ("id", None), ("name", "Ann Lee")], "category string, value string")
    E.save_registry(E.register_values(None, values, b"k"), str(tmp_path / "r"))
    held = E.load_registry(spark, str(tmp_path / "r"))
    assert {(r.category, r.n) for r in E.registry_sizes(held).collect()} == {("id", 1), ("name", 1)}
    asked = spark.createDataFrame([("id", "ab 12"), ("id", "ab13"), ("name", "ANN LEE")], "category string, value string")
    assert {r.value for r in E.registered(asked, held, b"k").collect()} == {"ab 12", "ANN LEE"}


def test_too_many_keywords_raise(spark):
    import pytest

    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    with pytest.raises(ValueError):
        E.keyword_hits(docs, spark.createDataFrame([("a",), ("b",)], "keyword string"), most=1)


def test_hot_keys_are_cut_into_parts(spark):
    from pyspark.sql import functions as F

    from veilframe import session as S

    df = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(90)] + [(None, 1)], "k string, v int")
    for few in (100, 0):
        parts = S.with_parts(df, ["k"], 10, ["v"], few=few)
        assert {(r.k, r.parts) for r in parts.select("k", "parts").distinct().collect()} >= {("hot", 6), ("k0", 1)}
        assert parts.count() == 91
        left, right = S.spread_over(parts, ["v"]), S.in_parts(parts)
        met = left.select("k", "part", F.col("v").alias("a")).join(right.select("k", "part", F.col("v").alias("b")), ["k", "part"])
        assert met.count() == 60 * 60 + 30
    import pytest

    with pytest.raises(ValueError):
        S.checkpoint_folder(None, "spark://host:7077")
    assert S.checkpoint_folder("/shared", "yarn") == "/shared"
