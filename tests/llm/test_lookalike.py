import pyarrow as pa

from veilframe.llm import lookalike as K

SAME = [("café", "café"), ("ＡＢＣ　１", "ABC 1"), ("ﬁle", "file"), ("a​b­c", "abc"), ("a b", "a b"), ("раураl", "paypal"), ("ｶﾞ", "ガ"), ("е́", "é"), ("Ⅳ", "IV"), ("Gerӓt", "Gerät"), ("а\u0308", "ä"), ("𝐀𝐁", "AB"), ("𝚊", "a"), ("ℌ", "H"), ("㎏", "kg"), ("Ꮪꓢ", "SS"), ("ά", "á"), ("⼀", "一")]
APART = [("a", "A"), ("e", "é"), ("2", "²"), ("1", "l"), ("a b", "ab"), ("10", "11"), ("O", "0"), ("①", "1"), ("½", "1/2"), ("ſ", "s"), ("й", "и")]


def forms(*texts):
    return K.uniform(pa.array(list(texts), pa.string())).to_pylist()


def test_same_and_apart():
    for x, y in SAME:
        assert len(set(forms(x, y))) == 1, (x, y)
    for x, y in APART:
        assert len(set(forms(x, y))) == 2, (x, y)
    assert forms(None, "", "a") == [None, "", "a"]


def test_stable():
    texts = [x for pair in SAME + APART for x in pair]
    once = forms(*texts)
    assert forms(*once) == once


def test_pairs_against_brute_force(spark):
    rows = [(i, t, "c") for i, t in enumerate([*(x for p in SAME for x in p), "abc", "abc", None, "", "", "abc​"])]
    df = spark.createDataFrame(rows + rows[:3], "rid bigint, text string, form string")
    got = {(r.id_a, r.id_b) for r in K.same_look_pairs(df, "rid").collect()}
    made = dict(zip([r[0] for r in rows], forms(*(r[1] for r in rows))))
    want = {(a, b) for a, x, _ in rows for b, y, _ in rows if a < b and x is not None and y is not None and x != y and made[a] == made[b]}
    assert got == want
    assert K.same_look_pairs(df.limit(0), "rid").count() == 0


def test_hot_looks_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(K, "COPIES", 3)
    rows = [(i, "same look" + "\u200b" * (i % 9), "ab"[i % 2]) for i in range(60)]
    got = {(r.origin, r.id_a, r.id_b) for r in K.same_look_pairs(spark.createDataFrame(rows, "rid int, text string, origin string"), "rid", origin="origin").collect()}
    assert got == {(o, a, b) for a, x, o in rows for b, y, p in rows if a < b and x != y and o == p}


def test_extra_columns_keep(spark):
    df = spark.createDataFrame([(1, "ＡＢ", "old")], "rid int, text string, uniform_text string")
    assert [tuple(r) for r in K.with_form(df).collect()] == [(1, "ＡＢ", "AB")]
