"""Cutting oversized texts at natural boundaries: a recursive hierarchy of separators, packed greedily.

A text is split into sections (headings, rules, form feeds), those that are too large into paragraphs, lines, sentences,
words and at last characters; the parts are packed greedily into pieces that fit the limit in UTF-8
bytes.  Every piece but the first begins with the last bytes of the piece before it, cut at
a character and, where the overlap holds one, at the beginning of a word.

Defined results: a null text has no piece, an empty text one empty piece; a text within its
limit is one piece.  Limits under 1,024 bytes count as 1,024 and missing ones as 4,096;
missing or negative overlaps count as 0 and large ones as half of the limit.  Pieces are spans
of code points, so dropping each piece's first ``overlap_chars`` restores the text exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.session import by_key

LEAST_LIMIT, DEFAULT_LIMIT = 1024, 4096

#: Places after which a text may be cut, from the strongest to the weakest.
SEPARATORS = [
    # sections: before a heading (numbered, marked, or in capitals on a line of its own), behind a rule or form feed
    re.compile(r"\f+|(?:^[ \t]*(?:[-=*_][ \t]*){3,}\r?\n)+|(?=^#{1,6}[ \t]\S)|(?=^(?:Chapter|Section|Kapitel|Abschnitt|Chapitre|Capítulo|Глава|第)[ ]?[\dIVXLC一二三四五六七八九十]+)|(?=^\d{1,2}(?:\.\d{1,2})*\.?[ \t]+\S[^\n]{0,60}\r?\n[ \t]*\r?\n)", re.M),
    re.compile(r"(?:\r?\n[ \t]*){2,}"),
    re.compile(r"\r?\n"),
    re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？؟।]+[」』”）]*\s*"),
    re.compile(r"\s+"),
]


def width_of(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def parts(text: str, limit: int, level: int = 0) -> Iterator[str]:
    """Consecutive parts of at most ``limit`` bytes, as large as the separators of the level allow."""
    if width_of(text) <= limit:
        yield text
        return
    if level < len(SEPARATORS):
        at = 0
        for m in SEPARATORS[level].finditer(text):
            if at < m.end() < len(text):
                yield from parts(text[at : m.end()], limit, level + 1)
                at = m.end()
        if at < len(text):
            yield from parts(text[at:], limit, level + 1)
        return
    start, used = 0, 0
    for i, char in enumerate(text):
        size = width_of(char)
        if used + size > limit:
            yield text[start:i]
            start, used = i, 0
        used += size
    yield text[start:]


def tail_of(text: str, end: int, overlap: int, floor: int) -> int:
    """Start of the overlap before ``end``: at most that many bytes, at a word's beginning where there is one."""
    start, used = end, 0
    while start > floor and used + (size := width_of(text[start - 1])) <= overlap:
        used += size
        start -= 1
    if start > 0 and start < end and not text[start - 1].isspace():
        word = re.search(r"\s+(?=\S)", text[start:end])
        if word:
            start += word.end()
    return start


def pieces_of(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces as (start, end, overlapping characters), each within ``limit`` bytes."""
    if width_of(text) <= limit:
        return [(0, len(text), 0)]
    out: list[tuple[int, int, int]] = []
    fresh, end, start, used = 0, 0, 0, 0
    for part in parts(text, limit - overlap):
        size = width_of(part)
        if end > fresh and used + size > limit:
            out.append((start, end, fresh - start))
            start, fresh = tail_of(text, end, overlap, start), end
            used = width_of(text[start:end])
        end += len(part)
        used += size
    out.append((start, end, fresh - start))
    return out


def with_limits(records: DataFrame, streams: DataFrame, stream_id: str = "stream_id") -> DataFrame:
    """Adds ``limit_bytes`` and ``overlap_bytes``; of a stream that is listed twice the larger values count."""
    sizes = streams.where("stream_id is not null").groupBy(F.col("stream_id").alias("of_stream")).agg(F.max("buffer_size").alias("of_size"), F.max("overlap").alias("of_overlap"))
    limit = F.greatest(F.coalesce("of_size", F.lit(DEFAULT_LIMIT)), F.lit(LEAST_LIMIT))
    joined = records.join(sizes, records[stream_id] == sizes.of_stream, "left").withColumn("limit_bytes", limit)
    overlap = F.least(F.greatest(F.coalesce("of_overlap", F.lit(0)), F.lit(0)), F.floor(F.col("limit_bytes") / 2))
    return joined.withColumn("overlap_bytes", overlap).drop("of_stream", "of_size", "of_overlap")


def split_oversized(records: DataFrame, streams: DataFrame, record_id: str = "extraction_id", text: str = "text", stream_id: str = "stream_id") -> DataFrame:
    """(id, piece_no, pieces, span_start, span_end, overlap_chars, piece, limit_bytes), repeated rows counted once."""
    rows = with_limits(records.select(F.col(record_id).alias("id"), F.col(text).alias("text"), F.col(stream_id).alias("stream_id")), streams)
    rows = rows.where("id is not null and text is not null").select("id", "text", "limit_bytes", "overlap_bytes")
    rows = by_key(rows, "id").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["id", "piece_no", "pieces", "span_start", "span_end", "overlap_chars", "piece", "limit_bytes"]
        for frame in frames:
            made = []
            for id_, whole, limit, overlap in zip(frame["id"], frame["text"], frame["limit_bytes"], frame["overlap_bytes"]):
                cuts = pieces_of(whole, int(limit), int(overlap))
                made += [(id_, n, len(cuts), a, b, shared, whole[a:b], int(limit)) for n, (a, b, shared) in enumerate(cuts)]
            yield pd.DataFrame(made, columns=columns)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, piece_no int, pieces int, span_start bigint, span_end bigint, overlap_chars int, piece string, limit_bytes bigint")
