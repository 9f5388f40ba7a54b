import itertools
import random

import pytest

from veilframe.llm import mixing as X


def test_flow_against_brute_force():
    rnd = random.Random(8)
    for _ in range(60):
        members = {"A": ["s"], "B": ["t"], "C": ["s", "t"]}
        capacity = {p: rnd.randrange(1, 4) for p in members}
        repeats, quota = {"s": rnd.randrange(0, 3), "t": rnd.randrange(0, 3)}, {"s": rnd.randrange(0, 6), "t": rnd.randrange(0, 6)}
        flow = X.min_cost_flow(capacity, members, repeats, quota)
        caps = {p: capacity[p] * min(repeats[s] for s in members[p]) for p in members}
        cost = lambda used: sum(k // capacity[p] for p, n in used.items() for k in range(n))
        best = None
        for a, b, cs, ct in itertools.product(*(range(caps[p] + 1) for p in ("A", "B", "C", "C"))):
            if a + cs <= quota["s"] and b + ct <= quota["t"] and cs + ct <= caps["C"]:
                key = (-(a + b + cs + ct), cost({"A": a, "B": b, "C": cs + ct}))
                best = key if best is None or key < best else best
        used = {p: sum(v for (q, _), v in flow.items() if q == p) for p in members}
        assert (-sum(flow.values()), cost(used)) == best


def table(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice("alpha beta gamma delta".split()) for _ in range(rnd.randrange(5, 60))) + f" {i}", "big" if i < 200 else "small") for i in range(230)]
    rows += [(900, rows[0][1], "small"), (901, None, "big"), (902, "x", None), (903, "", "big"), (904, "y", "unknown")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_shares_and_caps(spark):
    docs = table(spark)
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("nothing", 0.0, 2)], "source string, target_share double, max_repeats int")
    selection, shares = X.mix(docs, targets, total_tokens=3000)
    rows, report = selection.collect(), {r.source: r for r in shares.collect()}
    assert all(r.repeats <= {"big": 1, "small": 3}[r.source] for r in rows)
    per_doc = {}
    for r in rows:
        per_doc[r.doc_id] = per_doc.get(r.doc_id, 0) + r.repeats
    assert max(per_doc.values()) <= 3 and not {901, 902, 903, 904, 900} & set(per_doc)
    for name, share in (("big", 0.6), ("small", 0.4)):
        assert abs(report[name].tokens - share * 3000) <= 80 and report[name].met
        assert report[name].tokens == sum(r.repeats * r.n_tokens for r in rows if r.source == name)
    assert report["nothing"].tokens == 0
    again = {(r.doc_id, r.source, r.repeats) for r in X.mix(docs.repartition(3), targets, total_tokens=3000)[0].collect()}
    assert again == {(r.doc_id, r.source, r.repeats) for r in rows}


def test_total_shrinks_until_shares_hold(spark):
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 1)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in X.mix(table(spark), targets, least_total=0.1)[1].collect()}
    assert all(r.met and abs(r.actual_share - r.target_share) < 0.02 for r in report.values())


def test_unreachable_target_and_empty(spark):
    targets = spark.createDataFrame([("big", 0.1, 1), ("small", 0.9, 2)], "source string, target_share double, max_repeats int")
    selection, shares = X.mix(table(spark), targets, total_tokens=6000, least_total=0.9)
    report = {r.source: r for r in shares.collect()}
    assert not report["small"].met and report["small"].repeats_used == 2 and not report["big"].met
    assert X.mix(table(spark).limit(0), targets)[0].count() == 0


def test_odd_names_and_sources_without_documents(spark):
    docs = spark.createDataFrame([(i, f"word {i} " * 9, 'a|b "c"' if i % 2 else "d,e") for i in range(200)], "doc_id int, text string, source string")
    targets = spark.createDataFrame([('a|b "c"', 0.5, 2), ("d,e", 0.4, 2), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in X.mix(docs, targets)[1].collect()}
    assert report["none"].tokens == 0 and not report["none"].met
    assert abs(report['a|b "c"'].actual_share - 5 / 9) < 0.02 and abs(report["d,e"].actual_share - 4 / 9) < 0.02


def test_too_many_sources_raise(spark):
    targets = spark.createDataFrame([(str(i), 0.1, 1) for i in range(5)], "source string, target_share double, max_repeats int")
    with pytest.raises(ValueError):
        X.mix(table(spark), targets, most_patterns=4)
