"""Sentence boundaries by a maximum-entropy classifier over candidate boundaries.

A text falls into blocks at blank lines and list items; inside a block every terminator (and, in
scripts without one, every blank after the script's letters) is a candidate.  Candidates inside a
quotation or bracket belong to the sentence around it; where the quotation closes right after
the terminator, the candidate is behind it.  A candidate is described by its neighbouring
tokens, their case, length, digits and script, and a logistic model decides.

The model is trained here, on boundaries that are reliable without it: ends of blocks are boundaries;
a full stop before a lower-case word that begins no block, or after a token that is often followed
by a full stop and never ends a block, is none; behind a quotation, what never begins a block goes on with the sentence.  No word list is used.
Training takes a bounded sample of the documents (``train_rows``).

Defined results: a null or blank text has no sentence; every row is split on its own, so a
repeated row gives its sentences again; texts are taken whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.session import sample_of, spread

BLANK_LINE = re.compile(r"\r?\n(?:[^\S\n]*\n)+")
MARK = re.compile(r"[^\S\n]*([-*•‣▪◦·–]|\(?\d{1,3}[.)]|\(?[a-zA-Z][)])[^\S\n]+\S")
TERMINATOR = re.compile(r"[.!?…‽]+|[。！？｡]+|[।॥]+|[؟۔]+|[;;]")
TOKEN = re.compile(r"\S+")
WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
PAIRS = {"«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "‘": "’", "‚": "‘", "‹": "›"}
SIGN = re.compile("[\"'«»“”„‘’‚‹›「」『』()（）\\[\\]]")
THAI_BLANK = re.compile(r"(?<=[\u0e00-\u0e7e])\s+")
THAI = re.compile("[\u0e00-\u0e7e]")
CLOSERS = set("»”“\"'’‘」』)）]›")


def script(char: str) -> str:
    code = ord(char)
    if 0x0E00 <= code < 0x0E80:
        return "thai"
    if 0x3040 <= code < 0x3100 or 0x3400 <= code < 0xA000 or 0xF900 <= code < 0xFB00 or 0xFF66 <= code < 0xFFA0:
        return "cjk"
    if 0x0370 <= code < 0x0400 or 0x1F00 <= code < 0x2000:
        return "greek"
    if 0x0400 <= code < 0x0530:
        return "cyrillic"
    if 0x0600 <= code < 0x0780:
        return "arabic"
    if 0x0900 <= code < 0x0980:
        return "indic"
    return "latin" if char.isalpha() else "other"


def blocks_of(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, may be split) of every block: paragraphs and headings, and single list items."""
    at = 0
    for start, end in [*((m.start(), m.end()) for m in BLANK_LINE.finditer(text)), (len(text), len(text))]:
        body = text[at:start]
        if body.strip():
            if MARK.match(body):
                kind = re.sub(r"\d+", "1", MARK.match(body).group(1))
                marks = [0]
                for m in re.finditer(r"\n", body):
                    mark = MARK.match(body, m.end())
                    if mark and re.sub(r"\d+", "1", mark.group(1)) == kind:
                        marks.append(m.end())
                for a, b in zip(marks, [*marks[1:], len(body)]):
                    yield at + a, at + b, False
            else:
                yield at, start, True
        at = end


OPENER = {close: {o for o, c in PAIRS.items() if c == close} for close in PAIRS.values()}


def enclosed(text: str) -> list[tuple[int, int]]:
    """Outermost closed quotations and brackets as (place of the opening, place of the closing), in one pass."""
    stack: list[tuple[str, int]] = []
    held: dict[str, list[int]] = {}  # places in the stack of every sign
    spans: list[tuple[int, int]] = []
    n = len(text)

    def put(c: str, i: int) -> None:
        held.setdefault(c, []).append(len(stack))
        stack.append((c, i))

    def take(at: int, i: int) -> None:
        spans.append((stack[at][1], i))
        while len(stack) > at:
            held[stack.pop()[0]].pop()

    for m in SIGN.finditer(text):
        i, c = m.start(), m.group()
        if c in "\"'":
            before, after = text[i - 1] if i else " ", text[i + 1] if i + 1 < n else " "
            own = held.get(c)
            if own and not before.isspace() and not (c == "'" and after.isalnum()):
                take(own[-1], i)
            elif not after.isspace() and not before.isalnum() and not own:
                put(c, i)
        elif c in "»”“」』)）]’‘›":
            at = max((held[o][-1] for o in OPENER.get(c, ()) if held.get(o)), default=-1)
            if at >= 0:
                take(at, i)
            elif c in PAIRS:
                put(c, i)
        elif c in PAIRS:
            put(c, i)
    outer: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


LAST = re.compile(r"[^\s(（\[\"“”«»„'‘「『/]+$")
NUMBER, FILE = re.compile(r"[\d.,:/%-]+"), re.compile(r"\w{2,}[.]\w{2,5}")


def token_type(before: str) -> str:
    """Normalised token in front of a terminator."""
    tail = before[-60:]
    m = LAST.search(tail)
    word = m.group() if m else ""
    if not word:
        return "<none>"
    if NUMBER.fullmatch(word):
        return "<num>"
    if len(word) == 1 and word.isupper():
        return "<initial>"
    if FILE.fullmatch(word):
        return "<file>"
    if any(c.isdigit() for c in word):
        return "<mixed>"
    return word.lower()


def following(after: str) -> tuple[str, str]:
    """(first word, kind of the first character) of what follows."""
    rest = after.lstrip()[:40]
    if not rest:
        return "<end>", "end"
    c = rest[0]
    m = WORD.search(rest)
    word = "<num>" if m and m.group()[0].isdigit() else m.group().lower() if m else "<none>"
    kind = "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "caseless" if c.isalpha() else "open" if c in "«“„\"'‘「『(（[¿¡" else c
    return word, kind


Described = tuple[str, ...]  # what a candidate looks like; equal descriptions have equal features


def described(mark: str, kind: str, before: str, after: str, quote: str, left: str | None = None) -> Described:
    word, case = following(after)
    if kind == "blank":
        return ("blank", before.rstrip()[-4:], word, case)
    left = token_type(before) if left is None else left
    return (mark, left, word, case, quote, script(before.rstrip()[-1]) if before.strip() else "none", after.lstrip()[:1] if case == "caseless" else "")


def features(seen: Described) -> list[str]:
    if seen[0] == "blank":
        _, left, word, case = seen
        return ["blank", "s3=" + left[-3:], "s4=" + left, "next=" + word, "b:" + case]
    mark, left, word, case, quote, letters, first = seen
    out = [
        "t=" + mark, "w=" + left, "len=" + str(min(len(left), 6)), "case=" + case, "t,case=" + mark + case, "w,case=" + left + case, "next=" + word, "w,next=" + left + "," + word,
        "q=" + quote, "q,case=" + quote + case, "script=" + letters,
    ]
    if first:
        out += ["nc=" + first, "q,nc=" + quote + first]
    if left[:1] != "<" and "." in left:
        out.append("inner stop")
    return out


def closing(rest: str) -> bool:
    """Whether nothing but blanks and closing signs is left of a quotation."""
    return all(c in CLOSERS for c in rest.strip())


def candidates(text: str, following_text: str = "") -> list[tuple[int, str, str, Described]]:
    """(place, token type, kind of what follows, description) of every candidate in a block."""
    spans = enclosed(text)
    out = []
    k = 0
    last = len(text.rstrip())
    found = [(m.start(), m.end(), m.group()) for m in TERMINATOR.finditer(text)]
    for start, end, mark in found:
        while k < len(spans) and spans[k][1] < start:
            k += 1
        if mark in ";;" and (start == 0 or script(text[start - 1]) != "greek"):
            continue
        place, quote = end, "none"
        if k < len(spans) and spans[k][0] < start < spans[k][1]:
            a, b = spans[k]
            if not (closing(text[end : min(b, end + 40)]) and (b <= end + 40 or closing(text[end:b]))):
                continue
            place = b + 1
            lead = text[max(0, a - 40) : a].rstrip() or text[:a].rstrip()
            if text[a] in "(（[":
                quote = "bracket first" if not lead or lead[-1] in ".!?。！？।؟" else "bracket inside"
            else:
                quote = "first" if not lead or lead[-1] in ".!?。！？।؟»”\"“'」" else "colon" if lead[-1] in ":：" else "comma" if lead[-1] in ",，" else "inside"
        else:
            while place < len(text) and text[place] in "”»」』’" and not any(a <= place <= b for a, b in spans[k : k + 2]):
                place += 1
        rest = text[place : place + 80]
        wide = mark[0] in "。！？｡" or (rest[:1] and script(rest[0]) == "cjk")
        if rest and not rest[0].isspace() and not wide:
            continue
        kind = mark[-1] if len(set(mark)) == 1 and len(mark) == 1 else "…" if set(mark) <= set(".…") else "!"
        kind = {"！": "!", "？": "?", "؟": "?", "।": "。", "॥": "。", "۔": "。", "｡": "。"}.get(kind, kind)
        after = rest if rest.strip() else following_text
        caseless = rest.strip() and following(rest)[1] in ("caseless",)
        if quote == "first" and caseless:
            quote = "first caseless"
        if rest and not rest.strip() and place < last:
            after = rest = text[place:].lstrip()[:80]
        before = text[max(0, start - 80) : start].rstrip()
        left = token_type(before)
        out.append((place, left, following(rest)[1], described(kind, "mark", before, after, quote, left)))
    if THAI.search(text):
        k = 0
        for m in THAI_BLANK.finditer(text):
            while k < len(spans) and spans[k][1] <= m.start():
                k += 1
            if k < len(spans) and spans[k][0] < m.start():
                continue
            before, rest = text[max(0, m.start() - 8) : m.start()], text[m.end() : m.end() + 80]
            out.append((m.start(), "s4=" + before[-4:], "thai" if m.end() < last else "end", described("", "blank", before, rest if m.end() < last else following_text, "")))
        if script(text[last - 1]) == "thai" and last == len(text):
            out.append((len(text), "s4=" + text[-4:], "end", described("", "blank", text[-8:], following_text, "")))
    return sorted(out, key=lambda x: x[0])


def kind_of(what: Described) -> tuple[str, str]:
    """How a quotation stands in its sentence, and the script before its end."""
    return what[4].removesuffix(" caseless"), what[5]


def labelled(texts: list[str]) -> list[tuple[list[str], int, float]]:
    """Training examples (features, label, weight) from boundaries that are reliable."""
    begins, small, firsts, ends, seen, follows, closes, held = Counter(), Counter(), Counter(), Counter(), Counter(), Counter(), Counter(), []
    quotes: Counter = Counter()
    bodies: set[str] = set()
    for text in texts:
        blocks = [(a, b) for a, b, split in blocks_of(text) if split]
        for i, (a, b) in enumerate(blocks):
            body = text[a:b].rstrip()
            nxt = text[blocks[i + 1][0] : blocks[i + 1][1]].lstrip()[:60] if i + 1 < len(blocks) else ""
            found = candidates(body, nxt)
            if not found or body in bodies:  # copies of a block prove nothing
                continue
            bodies.add(body)
            first_word, first_case = following(body)
            begins[first_word] += 1
            small[first_word] += first_case == "lower"
            firsts[body.lstrip()[0]] += 1
            for _, left, case, what in found:
                seen[left] += 1
                ends[left] += case == "end"
                follows[what[2]] += 1
                if what[0] != "blank" and what[4] != "none":
                    quotes[kind_of(what)] += 1
                    closes[kind_of(what)] += case == "end"
                held.append((left, case, what))
    out: list[tuple[list[str], int, float]] = []
    # a token that ends sentences ends a block with about the share of all tokens; enough misses make it an abbreviation
    share = min(0.5, max(0.05, sum(ends.values()) / max(sum(seen.values()), 1)))
    enough = max(12, math.ceil(math.log(0.002) / math.log(1 - share)))
    for left, case, what in held:
        nxt = what[2]
        if case == "end":
            label = (1, 1.0)
        elif what[0] == "blank":
            label = (0, 1.0) if seen[left] >= enough and not ends[left] else (1, 0.5) if ends[left] > 0.1 * seen[left] else None
        elif what[4] != "none":
            # behind a quotation or bracket: what never begins a block goes on with the sentence, and quotations of a kind that never ends a block are inside one
            first = what[6] or case
            inside = quotes[kind_of(what)] >= enough and not closes[kind_of(what)]
            goes_on = case == "lower" and not small[nxt] or case not in ("lower", "upper", "open", "digit") and not firsts[first] or inside and case != "open"
            label = (0, 1.0) if goes_on else (1, 0.5) if begins[nxt] and case != "lower" or what[6] and firsts[first] else None
        elif seen[left] >= enough and not ends[left]:
            label = (0, 1.0)
        elif case == "lower" and not small[nxt]:
            label = (0, 1.0)
        elif left in ("<num>", "<initial>", "<mixed>") and case == "upper" and follows[nxt] >= enough and not begins[nxt]:
            label = (0, 1.0)  # a word that often follows a full stop and never begins a block: the name of a month, a unit
        elif ends[left] and case in ("upper", "open", "caseless") and begins[nxt] or what[6] and what[0] in "。!?" and firsts[what[6]]:
            label = (1, 0.5)
        else:
            label = None
        if label:
            out.append((features(what), *label))
    return out


def train(examples: list[tuple[list[str], int, float]], rounds: int = 60, decay: float = 1e-4) -> dict[str, float]:
    """Logistic regression (maximum entropy) by AdaGrad on the whole set."""
    names: dict[str, int] = {}
    if not examples:
        return {"": 1.0}
    widest = max(len(fs) for fs, _, _ in examples)
    idx = np.zeros((len(examples), widest), np.int64)
    for i, (fs, _, _) in enumerate(examples):
        for j, f in enumerate(fs):
            idx[i, j] = names.setdefault(f, len(names) + 1)
    y, weight = np.array([x[1] for x in examples], float), np.array([x[2] for x in examples])
    w, g2, bias, b2 = np.zeros(len(names) + 1), np.full(len(names) + 1, 1e-8), 0.0, 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[idx].sum(axis=1) + bias, -30, 30)))
        error = (p - y) * weight
        g = np.bincount(idx.ravel(), np.repeat(error, widest), len(w)) + decay * len(examples) * w / 100
        g[0] = 0
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
        w[0] = 0
        gb = error.sum()
        b2 += gb * gb
        bias -= 0.5 * gb / b2**0.5
    model = {f: round(float(w[i]), 4) for f, i in names.items() if abs(w[i]) > 1e-3}
    model[""] = bias
    return model


class Judge:
    """Scores of candidates; equal descriptions are scored once."""

    def __init__(self, model: dict[str, float]) -> None:
        self.model, self.known = model, {}

    def __call__(self, what: Described) -> bool:
        held = self.known.get(what)
        if held is None:
            if len(self.known) > 500_000:
                self.known.clear()
            held = self.known[what] = self.model.get("", 0.0) + sum(self.model.get(f, 0.0) for f in features(what)) > 0
        return held


def spans_of(text: str, model: dict[str, float] | Judge) -> list[tuple[int, int]]:
    """Spans (start, end) of the sentences, headings and list items of a text, without outer blanks."""
    out = []
    boundary = model if isinstance(model, Judge) else Judge(model)

    def add(a: int, b: int) -> None:
        piece = text[a:b]
        lead = len(piece) - len(piece.lstrip())
        if lead < len(piece):
            out.append((a + lead, a + len(piece.rstrip())))

    for a, b, split in blocks_of(text):
        at = a
        if split:
            for place, _, case, what in candidates(text[a:b]):
                if case != "end" and a + place > at and boundary(what):
                    add(at, a + place)
                    at = a + place
        add(at, b)
    return out


def fit(documents: DataFrame, text: str = "text", train_rows: int = 6000) -> dict[str, float]:
    """The model, fitted on at most ``train_rows`` distinct documents of any length."""
    return train(labelled(sample_of(documents.select(F.col(text).alias("text")).where("text <> ''"), train_rows)))


def split_sentences(documents: DataFrame, model: dict[str, float] | None = None, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, sentence_no, span_start, span_end[, sentence]) of every sentence of every document."""
    model = fit(documents, text) if model is None else model
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    rows = spread(rows)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(model)
        for frame in frames:
            made = [(d, n, a, b, t[a:b] if with_text else None) for d, t in zip(frame["doc_id"], frame["text"]) for n, (a, b) in enumerate(spans_of(t, judge))]
            yield pd.DataFrame(made, columns=["doc_id", "sentence_no", "span_start", "span_end", "sentence"])

    out = rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, sentence_no int, span_start bigint, span_end bigint, sentence string")
    return out if with_text else out.drop("sentence")
