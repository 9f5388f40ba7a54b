import random

import numpy as np

from veilframe.llm import neardup as N

ENTRY = "doc_id string, text string, signature array<bigint>, extra string"


def runs(t):
    w = t.lower().split()
    return {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(rows, threshold):
    out = {}
    for a, ta, *_ in rows:
        for b, tb, *_ in rows:
            if a is not None and b is not None and a < b and ta and tb and runs(ta) and runs(tb):
                s = len(runs(ta) & runs(tb)) / len(runs(ta) | runs(tb))
                if s >= threshold:
                    out[a, b] = max(s, out.get((a, b), 0))
    return out


def corpus(seed=1, bases=12, copies=4):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for b in range(bases):
        base = [rnd.choice(words) for _ in range(80)]
        for c in range(copies):
            edited = list(base)
            for _ in range(rnd.choice([0, 1, 2, 6, 20])):
                edited[rnd.randrange(80)] = rnd.choice(words)
            rows.append((f"d{b:02}-{c}", " ".join(edited), None, "x"))
    return rows


def test_bit_sliced_distances_are_exact():
    rnd = np.random.default_rng(0)
    sketch = rnd.integers(0, 1 << 63, (300, N.SKETCH_WORDS), dtype=np.uint64)
    for i in range(0, 300, 7):
        sketch[i] = sketch[0] ^ (rnd.integers(0, 1 << 63, N.SKETCH_WORDS, dtype=np.uint64) & rnd.integers(0, 1 << 63, N.SKETCH_WORDS, dtype=np.uint64) & rnd.integers(0, 1 << 63, N.SKETCH_WORDS, dtype=np.uint64))
    low, high = np.arange(300) + 1, np.full(300, 300)
    low[250:], high[250:] = 0, 0
    for radius in (0, 20, 60, 130):
        a, b = N.within(sketch, low, high, radius)
        want = {(i, j) for i in range(250) for j in range(i + 1, 300) if sum(int(x).bit_count() for x in sketch[i] ^ sketch[j]) <= radius}
        assert set(zip(a.tolist(), b.tolist())) == want


def test_pairs_equal_brute_force(spark):
    rows = corpus() + [("dup", corpus()[0][1], None, "x"), ("dup", corpus()[0][1], None, "y"), ("none", None, None, None), (None, "a b c d", None, None), ("empty", "", None, None), ("two", "only two", None, None), ("zwei", "only two", None, None)]
    df = spark.createDataFrame(rows, ENTRY)
    got = {(r.doc_id_a, r.doc_id_b): r.similarity for r in N.near_duplicate_pairs(df, 0.6).collect()}
    want = brute(rows, 0.6)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_hot_bucket_is_tiled_without_loss(spark):
    rows = corpus(2, 2, 40)
    df = spark.createDataFrame(rows, ENTRY)
    got = {(r.doc_id_a, r.doc_id_b) for r in N.near_duplicate_pairs(df, 0.6, tile=5).collect()}
    assert got == set(brute(rows, 0.6))


def test_signature_serves_where_text_is_missing(spark):
    a, b = N.coefficients()
    text = " ".join(f"w{i}" for i in range(60))
    sig = N.signature_of(text, a, b).tolist()
    df = spark.createDataFrame([("p", text, None, ""), ("q", None, sig, ""), ("r", "other words that are not the same at all here", None, "")], ENTRY)
    assert [(r.doc_id_a, r.doc_id_b, r.similarity) for r in N.near_duplicate_pairs(df).collect()] == [("p", "q", 1.0)]


def test_groups(spark):
    rows = corpus(3, 5, 4)
    df = spark.createDataFrame(rows, ENTRY)
    pairs = brute(rows, 0.6)
    got = {r.doc_id: r for r in N.near_duplicate_groups(df, 0.6).collect()}
    assert len(got) == len(rows)
    for d, r in got.items():
        assert r.n_links == sum(d in p for p in pairs)
    root = {d: d for d in got}
    for _ in range(len(root)):
        for x, y in pairs:
            root[x] = root[y] = min(root[x], root[y])
    assert {d: r.group_id for d, r in got.items()} == root


def components(pairs):
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in pairs:
        a, b = sorted((find(x), find(y)))
        root[b] = a
    return {x: find(x) for x in root}


def graphs():
    rnd = random.Random(5)
    names = [f"{i:05}" for i in range(1000)]
    rnd.shuffle(names)
    yield list(zip(names, names[1:]))  # a path whose keys are in no order
    hub = names[7]
    yield [(hub, n) for n in names[:300] if n != hub]
    yield [(a, b) for i, a in enumerate(names[:25]) for b in names[:i]] + list(zip(names[500:520], names[501:521]))
    yield [(names[20 * i + j], names[20 * i + j + 1]) for i in range(20) for j in range(19)] + [(names[20 * i + j], names[20 * i + j + 20]) for i in range(19) for j in range(20)]


def test_components_of_any_shape(spark):
    for i, pairs in enumerate(graphs()):
        want = components(pairs)
        nodes = spark.createDataFrame([(n,) for n in [*want, "alone"]], "key string")
        links = spark.createDataFrame(pairs, "a string, b string")
        got = {r.key: r.root for r in N.connected(nodes, links, hot=50 if i else 100_000).collect()}
        assert got == want | {"alone": "alone"}


def test_copies_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "COPIES", 3)
    rows = corpus(4, 2, 3) + [(f"c{i}", corpus(4, 2, 3)[0][1], None, "x") for i in range(20)]
    got = {(r.doc_id_a, r.doc_id_b) for r in N.near_duplicate_pairs(spark.createDataFrame(rows, ENTRY), 0.6).collect()}
    assert got == set(brute(rows, 0.6))


def test_document_with_several_texts_joins_groups(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [("a", one, None, ""), ("b", one + " tail", None, ""), ("b", two, None, ""), ("c", two, None, ""), ("d", two + " end", None, ""), ("e", three, None, ""), ("b", "hi", None, ""), ("f", "hi", None, "")]
    got = {r.doc_id: (r.group_id, r.n_links) for r in N.near_duplicate_groups(spark.createDataFrame(rows, ENTRY), 0.6).collect()}
    assert got == {"a": ("a", 1), "b": ("a", 3), "c": ("a", 2), "d": ("a", 2), "e": ("e", 0), "f": ("f", 0)}


def test_bands_follow_the_threshold():
    assert N.banding(0.6) == (42, 3)
    for threshold in (0.2, 0.3, 0.4, 0.8, 0.95):
        bands, rows = N.banding(threshold)
        assert bands * rows <= 128 and 1 - (1 - threshold**rows) ** bands >= N.KEPT


def test_empty_table(spark):
    df = spark.createDataFrame([], ENTRY)
    assert N.near_duplicate_pairs(df).count() == 0 and N.near_duplicate_groups(df).count() == 0
