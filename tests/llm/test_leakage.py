import random

from veilframe.llm import leakage as L


def words(t):
    return [w.lower() for w in L.WORD.findall(t or "")]


def brute(docs, items):
    return {(d, i) for d, t in docs for i, u in items for k in range(len(words(u)) - 11) if f" {' '.join(words(u)[k : k + 12])} " in f" {' '.join(words(t))} "}


def test_exact_leaks_equal_brute_force(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{chr(97 + i % 26)}{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([8, 12, 20, 30])))) for i in range(20)]
    docs = []
    for d in range(60):
        t = [rnd.choice(vocabulary) for _ in range(30)]
        if d % 3 == 0:
            u = items[rnd.randrange(20)][1].split()
            a = rnd.randrange(max(len(u) - 11, 1))
            t[10:10] = u[a : a + rnd.choice([11, 12, 15])]
        docs.append((d, (", " if d % 2 else " - ").join(t).upper() if d % 5 == 0 else " ".join(t)))
    docs += [(100, None), (101, ""), (102, items[-1][1]), (102, items[-1][1])]
    df = spark.createDataFrame([(*r, "z") for r in docs], "doc_id int, text string, item_id string")
    it = spark.createDataFrame([*items, (99, None)], "item_id int, text string")
    for most in (500_000, 1):  # the broadcast way and the shuffled way
        found = L.find_leaks(df, it, most_windows=most).where("kind = 'exact'").collect()
        assert {(r.doc_id, r.item_id) for r in found} == brute([(d, t) for d, t in docs if t], items)
    assert L.find_leaks(df.limit(0), it).count() == 0 and L.find_leaks(df, it.limit(0)).count() == 0


def test_reparameterised(spark):
    item = "How many call notes may the clerk keep for 16 days after the fire drill ends"
    docs = [(1, item.replace("16", "77")), (2, item), (3, item.replace("keep", "burn"))]
    got = {r.doc_id: r.kind for r in L.find_leaks(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(1, item)], "item_id int, text string")).collect()}
    assert got == {1: "reparameterised", 2: "exact"}


def test_names_of_other_scripts_are_slots(spark):
    item = "сколько записей может хранить каждый сотрудник по имени Иван Петров после проверки в течение недели подряд и без перерыва"
    docs = [(1, item.replace("Иван Петров", "Анна Смирнова")), (2, item)]
    other = "потом после долгой и трудной проверки всех старых записей и списков стало ясно что делать дальше и тогда Анна Смирнова пришла сюда после того как закончилась проверка и все записи были убраны в архив навсегда без остатка"
    items = spark.createDataFrame([(1, item), (2, other)], "item_id int, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in L.find_leaks(spark.createDataFrame(docs, "doc_id int, text string"), items).collect()}
    assert got == {(1, 1): "reparameterised", (2, 1): "exact"}


def test_more_names_than_allowed_raise(spark):
    import pytest

    items = spark.createDataFrame([(1, "they met " + "and then they met Anna Smith so they went on and on again in the rain for days and days without rest " * 3)], "item_id int, text string")
    with pytest.raises(ValueError):
        L.find_leaks(items.selectExpr("item_id as doc_id", "text"), items, most_names=1)
