from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import chunking as C


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é漢.\n !", max_size=400), st.integers(16, 60), st.integers(0, 30))
def test_pieces_fit_and_restore_the_text(text, limit, overlap):
    overlap = min(overlap, limit // 2)
    cuts = C.pieces_of(text, limit, overlap)
    assert all(C.width_of(text[a:b]) <= limit for a, b, _ in cuts)
    assert "".join(text[a + shared : b] for a, b, shared in cuts) == text
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (_, before, _), (a, _, shared) in zip(cuts, cuts[1:]):
        assert a + shared == before and C.width_of(text[a:before]) <= overlap


def test_cuts_at_pauses():
    text = "First sentence here. Second one is here. Third sentence follows now."
    assert [text[a:b] for a, b, _ in C.pieces_of(text, 45, 0)] == ["First sentence here. Second one is here. ", "Third sentence follows now."]
    assert len(C.pieces_of("x" * 200, 50, 10)) == 5


def test_sections_are_kept_apart():
    first = "# Title\n\n" + "one two three. " * 40 + "\n\n"
    second = "# Second\n\n" + "four five six. " * 40 + "\n\n"
    third = "-----\n" + "seven eight. " * 40
    text = first + second + third
    cuts = C.pieces_of(text, 700, 0)
    assert [text[a:b] for a, b, _ in cuts] == [first, second + "-----\n", third[6:]]
    assert list(C.parts(text, 700)) == [first, second + "-----\n", third[6:]]


def test_limits_and_edges(spark):
    long = "word " * 600
    rows = [(1, long, "small", 9), (1, long, "small", 9), (2, long, None, 9), (3, None, "small", 9), (4, "", "small", 9), (5, long, "gone", 9), (6, long, "wide", 9), (7, "é" * 600, "tiny", 9)]
    df = spark.createDataFrame(rows, "extraction_id bigint, text string, stream_id string, buffer_size int")
    streams = spark.createDataFrame([("small", 1500, 100), ("wide", 16384, None), ("tiny", 10, 100000), (None, 1, 1)], "stream_id string, buffer_size bigint, overlap bigint")
    got = {}
    for r in C.split_oversized(df, streams).collect():
        got.setdefault(r.id, []).append(r)
    assert {k: len(v) for k, v in got.items()} == {1: 3, 2: 1, 4: 1, 5: 1, 6: 1, 7: 2}
    assert all(len(r.piece.encode()) <= r.limit_bytes for v in got.values() for r in v)
    assert got[7][0].limit_bytes == 1024 and max(r.overlap_chars for r in got[7]) > 0
    assert C.split_oversized(df.limit(0), streams).count() == 0


def test_overlap_reaches_over_short_pieces():
    text = "".join("word " * n + "\n\n" for n in (299, 299, 20, 289, 280))
    cuts = C.pieces_of(text, 3000, 1500)
    assert len(cuts) > 2 and all(C.width_of(text[a:b]) <= 3000 for a, b, _ in cuts)
    for (_, before, _), (a, _, _) in zip(cuts, cuts[1:]):
        assert 1490 <= C.width_of(text[a:before]) <= 1500
