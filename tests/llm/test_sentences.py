import os
import time

import pytest

from veilframe.llm import sentences as S

SOURCE = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def model():
    """Trained on the small documents table: the operator learns from its own texts and holds no word lists."""
    import duckdb

    if not os.path.exists(SOURCE):
        pytest.skip("test data isn't there")
    return S.train(S.labelled([r[0] for r in duckdb.sql(f"select distinct text from '{SOURCE}' where text is not null order by text").fetchall()]))


def split(text, model):
    return [text[a:b] for a, b in S.spans_of(text, model)]


CASES = [
    ["Dr. Nestwick left.", "The door closed at 3.50 p.m. on Friday."],
    ["Only 65.2% of them passed.", "See www.scan4.example/help.html for more."],
    ['The banner said "Access denied." and the service closed.', "Nobody asked."],
    ["'Fine,' said the lead, 'but mask them first.'", "Between 08:12 and 02:37 it ran."],
    ["It ended.", "(The lab had copied the files.)", "Another began."],
    ["Laut Dr. Neststone wurden am 3. Mai ca. 336 Verträge geöffnet.", "Prof. Murrwick fragte: „Wer hat sie gesperrt?“", "Die Revision schwieg."],
    ["¿Por qué bloqueó la pasarela?", "¡No envíen nada!", "«¡Alto!», escribió la comisión."],
    ["«Стойте!» — написала бухгалтерия.", "Почему сервер удалил файл?"],
]


@pytest.mark.parametrize("want", CASES)
def test_sentences(model, want):
    assert split(" ".join(want), model) == want


def test_scripts_without_spaces(model):
    assert split("負责人写道：“已删除。请再查一次。”阈值太严格。", model) == ["負责人写道：“已删除。请再查一次。”", "阈值太严格。"]
    assert split("担当者は「消した。もう一度見る。」と書いた。しきい値は厳しすぎた。", model) == ["担当者は「消した。もう一度見る。」と書いた。", "しきい値は厳しすぎた。"]
    assert split("คำขอ A ยังเปิดอยู่และทีมกลางคืนกำลังดูแลค่ะ ดร. เทนสบี ตรวจ ใบส่งของ ครบ 3 รายการแล้วค่ะ", model) == ["คำขอ A ยังเปิดอยู่และทีมกลางคืนกำลังดูแลค่ะ", "ดร. เทนสบี ตรวจ ใบส่งของ ครบ 3 รายการแล้วค่ะ"]


def test_layout(model):
    text = "1. Background\r\n\r\nThe first line\nbreaks here. It goes on.  \n \n- owner: desk\n- Ask the team about it.\n\nStep\n2. of the list is empty."
    assert split(text, model) == ["1. Background", "The first line\nbreaks here.", "It goes on.", "- owner: desk", "- Ask the team about it.", "Step\n2. of the list is empty."]


@pytest.mark.parametrize("n", [30, 80, 2000])
def test_quotations_of_any_length(model, n):
    quote = "“" + " ".join(["The file was moved."] * n) + "”"
    assert split(f"The desk wrote: {quote} Nobody answered.", model) == [f"The desk wrote: {quote}", "Nobody answered."]


def test_unclosed_brackets_cost_in_proportion(model):
    def seconds(n):
        began = time.perf_counter()
        S.enclosed("(a “b " * n + ") x. " * 10)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(200_000) < 40 * max(seconds(20_000), 0.005)
    assert S.enclosed("(a (b) c) «d» (e") == [(0, 8), (10, 12)]


def test_blanks_in_thai_cost_in_proportion(model):
    began = time.perf_counter()
    S.spans_of("ข้อมูล " * 40_000, model)
    assert time.perf_counter() - began < 10


def test_edges(spark, model):
    df = spark.createDataFrame([(1, "One. Two.", "x"), (1, "One. Two.", "x"), (2, None, "x"), (3, "", "x"), (4, " \n ", "x"), (5, "no end", "x"), (6, "a b. " * 3000, "x")], "doc_id bigint, text string, span_start string")
    got = S.split_sentences(df, model).groupBy("doc_id").count().collect()
    counts = {r.doc_id: r["count"] for r in got}
    assert counts[5] == 1 and counts[1] in (2, 4) and not {2, 3, 4} & counts.keys()
    assert S.split_sentences(df.limit(0), model).count() == 0


def test_copies_do_not_fill_the_training_sample(spark, monkeypatch):
    monkeypatch.setattr(S, "labelled", lambda texts: texts)
    monkeypatch.setattr(S, "train", lambda texts: {t: 1.0 for t in texts})
    texts = [f"Text number {n}." for n in range(6)]
    for hot in texts:
        df = spark.createDataFrame([(t,) for t in texts + [hot] * 20], "text string")
        assert len(S.fit(df, train_rows=4)) == 4
