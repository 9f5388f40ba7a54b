import os

import pytest

from veilframe.llm import mojibake as M

CLEAN = [
    "Größere Mengen prüft die Außenstelle getrennt. Für Übergabelisten gilt eine kürzere Frist. Die Prüfgruppe möchte Anträge schwärzen.",
    "Según la comisión técnica, quedan nóminas antiguas. ¿Por qué el módulo bloqueó tres informes de auditoría? El archivo se revisó después.",
    "Le relevé a été supprimé deux fois après une seconde lecture. À partir de la version 2, l’équipe lit les reçus scannés.",
    "Лишь часть записей имели метку, потому что сумма не сошлась. Почему агент копирования проверил журналы проверки?",
    "ラベル付きの在庫表は少しだけだった。なぜ検査ノードは給与明細を再検査したのか？監査室によると、申請書が残っている。",
    "The file was moved twice. Only a few of the records carried a label.",
] * 6


@pytest.fixture(scope="module")
def reader():
    return M.Reader(M.train(CLEAN))


@pytest.mark.parametrize("chain", [[("utf-8", "latin-1")], [("utf-8", "web-1252")], [("utf-8", "web-1252")] * 2, [("cp1252", "mac_roman")], [("cp1252", "cp437")], [("cp1252", "cp850")], [("utf-8", "cp437")]])
def test_latin_round_trip(reader, chain):
    for text in (CLEAN[0], CLEAN[1], CLEAN[2]):
        garbled = text
        for true, wrong in chain:
            garbled = M.misread(garbled, true, wrong)
        assert reader.text(garbled) == (True, True, text)


@pytest.mark.parametrize("chain", [("utf-8", "latin-1"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r")])
def test_cyrillic_round_trip(reader, chain):
    assert reader.text(M.misread(CLEAN[3], *chain)) == (True, True, CLEAN[3])


@pytest.mark.parametrize("chain", [("utf-8", "web-1252"), ("shift_jis", "web-1252"), ("euc_jp", "latin-1")])
def test_japanese_round_trip(reader, chain):
    assert reader.text(M.misread(CLEAN[4], *chain)) == (True, True, CLEAN[4])


def test_clean_text_stays(reader):
    for text in [*CLEAN, *(t.upper() for t in CLEAN), "", "├── srv/archive/batch_3.log\n└── data", "The café — “a note” — costs €25.", "x²", "Тhe fіle wаs mоved"]:
        assert reader.text(text)[0] is False, text


def test_loss_is_told(reader):
    affected, lossless, _ = reader.text("Die Revision m�chte")
    assert affected and not lossless


def test_misread_three_times(reader):
    garbled = M.again(CLEAN[0], (("utf-8", "latin-1"),) * 3)
    assert reader.text(garbled) == (True, True, CLEAN[0])


@pytest.mark.parametrize("wrong", ["gbk", "shift_jis", "big5", "euc_kr"])
def test_decoders_of_several_bytes(reader, wrong):
    garbled = M.misread(CLEAN[3].replace("ё", "е"), "utf-8", wrong)
    affected, lossless, before = reader.text(garbled)
    assert affected and (not lossless or before == CLEAN[3].replace("ё", "е"))


def test_short_neighbours_follow_the_chain_of_their_text(reader):
    whole = CLEAN[0] + " Für."
    assert reader.text(M.misread(whole, "utf-8", "cp850")) == (True, True, whole)


def test_all_chains_on_held_out_sentences():
    """No restoration that is called lossless may differ from the original, and nearly all must be exact."""
    import duckdb

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("test data isn't there")
    texts = [r[0] for r in duckdb.sql(f"select distinct text from '{path}' where text is not null order by hash(text)").fetchall()]
    reader = M.Reader(M.train([line for t in texts[:800] for line in t.splitlines()]))
    trained = {m.group().strip() for t in texts[:800] for m in M.PIECE.finditer(t)}
    held = sorted({m.group().strip() for t in texts[800:] for m in M.PIECE.finditer(t)} - trained)
    held = [h for h in held if sum(c.isalpha() and not c.isascii() for c in h) >= 3][:200]
    total = exact = wrong = 0
    for chain in M.chains():
        for original in held:
            garbled = M.again(original, chain)
            lost = "\ufffd" in garbled or any(M.invert(M.again(original, chain[:i]), chain[:i]) != original for i in range(1, len(chain) + 1))
            if lost or garbled == original:
                continue
            affected, lossless, before = reader.text(garbled)
            total += 1
            exact += affected and lossless and before == original
            wrong += affected and lossless and before != original
    assert total > 2000 and wrong == 0 and exact >= 0.9 * total, (total, exact, wrong)


def test_inversion_is_strict():
    assert M.invert("Ã©", (("utf-8", "latin-1"),)) == "é"
    assert M.invert("é", (("utf-8", "latin-1"),)) is None
    assert M.invert("漢", (("utf-8", "latin-1"),)) is None


def test_operator_edges(spark):
    model = M.train(CLEAN)
    rows = [(1, M.misread(CLEAN[0], "utf-8", "latin-1"), "x")] * 2 + [(2, CLEAN[0], "x"), (3, None, "x"), (4, "", "x")]
    df = spark.createDataFrame(rows, "extraction_id bigint, text string, restored_text string")
    got = M.repair(df, model).collect()
    assert [(r.id, r.lossless, r.restored_text) for r in got] == [(1, True, CLEAN[0])]
    assert M.repair(df.limit(0), model).count() == 0


def test_copies_do_not_fill_the_training_sample(spark, monkeypatch):
    monkeypatch.setattr(M, "train", lambda texts: {"texts": texts})
    texts = [f"text number {n}" for n in range(6)]
    for hot in texts:
        df = spark.createDataFrame([(t,) for t in texts + [hot] * 20], "text string")
        assert len(set(M.fit(df, train_lines=4)["texts"])) == 4


def test_every_line_of_a_large_table_is_counted(spark):
    """A pair of letters that one line of 20,400 has is in the model, whichever line that is."""
    lines = ["中" + chr(0x4E00 + n) for n in range(20_400)]
    model = M.fit(spark.createDataFrame([(x,) for x in lines], "text string").repartition(3))
    want = {int(M.char_bigrams(x)[0]) for x in lines}
    assert want <= set(model["language"]["held"].tolist())


def test_chains_are_counted_over_all_sentences():
    texts = [*CLEAN, "漢字", "ß", "ﬁ—x ’s", "Ω мир " * 3, *(f"Größe {n}, café {n}: là-bas" for n in range(4_200))]
    kept = [m.group().strip() for text in texts for m in M.PIECE.finditer(text) if M.NON_ASCII.search(m.group())]
    counts, _, sizes = M.derived(M.tally(texts))
    assert sizes[0] == len(kept) > 4_200
    for k, chain in enumerate(M.chains(), 1):
        fit = [x for x in kept if x.encode(chain[0][0], "replace").count(b"?") - x.count("?") <= 0.5 * len(M.NON_ASCII.findall(x))]
        want = M.np.bincount(M.bigrams("\n" + "\n".join(M.again(x, chain) for x in fit) + "\n"), minlength=M.BUCKETS)
        assert (counts[k] == want).all(), chain


def test_parts_add_up_to_the_whole(spark):
    parts = M.summed([M.tally(CLEAN[:2]), M.tally(CLEAN[2:5]), M.tally(CLEAN[5:6])])
    assert all((x == y).all() for x, y in zip(parts, M.tally(CLEAN[:6])))
    whole, spread = M.train(CLEAN[:6]), M.fit(spark.createDataFrame([(x,) for x in CLEAN], "text string").repartition(4))
    assert (whole["used"] == spread["used"]).all() and M.np.allclose(whole["log"], spread["log"]) and M.np.allclose(whole["language"]["log"], spread["language"]["log"])


@pytest.mark.parametrize("texts", [[], [""], ["漢"], ["plain"]])
def test_little_to_train_on(spark, texts):
    model = M.fit(spark.createDataFrame([(x,) for x in texts], "text string"))
    assert M.np.allclose(model["log"], M.train(texts)["log"])
    assert M.Reader(model).text("café") == (False, True, "café")
