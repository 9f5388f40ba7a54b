"""Text that was decoded with the wrong encoding: found by a classifier on byte bigrams, restored by inversion.

A multinomial classifier over hashed byte bigrams is trained on all clean sentences and on the same
sentences after every known *chain* (true encoding, wrong decoder, possibly twice).  A single-byte
decoder reads every character by itself, so the bigrams after such a chain follow exactly from the pairs of
neighbouring characters, which are counted once; other chains are counted on the garbled text.  Every sentence of
every text is classified.  Where a chain beats clean text, all such chains are inverted, each alone, on the
whole sentence or else on those of its words that it explains; only a strict inversion counts (every
character encodable, every byte sequence decodable, the same garbled text when garbled again) that
reads better than the sentence itself.  Chains are undone until none is left, so text that was misread three times is
restored too.  A restoration is lossless only if no rival chain gives a reading that comes near and the restored
words consist of known letter pairs; otherwise the text is reported as affected without a restoration.

Defined results: a null text is not affected; replacement characters (U+FFFD) mean that
something was lost; ``restored_text`` is null unless every affected stretch was restored without
loss.  Repeated rows count once.  Long texts are taken whole.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain as chain_of

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.lookalike import LOOK_ALIKE
from veilframe.llm.sentences import script
from veilframe.session import by_key, sample_of

Chain = tuple[tuple[str, str], ...]
BUCKETS = 1 << 16
MULTI_BYTE = ("gbk", "shift_jis", "big5", "euc_kr")  # wrong decoders that read several bytes as one character


@cache
def decoder(name: str) -> str:
    """The 256 characters of a single-byte decoder; web-1252 passes undefined bytes on as controls."""
    if name == "web-1252":
        return "".join(bytes([b]).decode("cp1252", "replace").replace("�", chr(b)) for b in range(256))
    return "".join(bytes([b]).decode(name, "replace") for b in range(256))


@cache
def encoder(name: str) -> object:
    """The encoding map of a single-byte decoder; bytes without a character aren't in it."""
    return codecs.charmap_build(decoder(name).replace("\ufffd", "\ufffe"))


@cache
def reading(name: str) -> dict[int, str]:
    return {b: c for b, c in enumerate(decoder(name)) if ord(c) != b}


def to_bytes(text: str, name: str) -> bytes | None:
    """Bytes of a text in the encoding of a wrong decoder, or None where a character isn't in it."""
    if name in MULTI_BYTE:
        try:
            return text.encode(name)
        except UnicodeEncodeError:
            return None
    try:
        return codecs.charmap_encode(text, "strict", encoder(name))[0]
    except UnicodeEncodeError:
        return None


def misread(text: str, true: str, wrong: str) -> str:
    """``text`` written in ``true`` and read as ``wrong``; what ``true`` lacks becomes a question mark."""
    raw = text.encode(true, "replace")
    return raw.decode(wrong, "replace") if wrong in MULTI_BYTE else raw.decode("latin-1").translate(reading(wrong))


def chains() -> list[tuple[tuple[str, str], ...]]:
    """All chains, each a tuple of (true encoding, wrong decoder) in order of misreading."""
    once = [("utf-8", w) for w in ("latin-1", "web-1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp1250", "cp1253", "cp866")]
    once += [("cp1252", w) for w in ("mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8-r")]
    once += [(t, "web-1252") for t in ("mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "cp1253", "cp1256", "cp874", "gbk", "big5", "shift_jis", "euc_jp", "iso8859_5")]
    once += [(t, "latin-1") for t in ("cp1251", "koi8-r", "cp866", "gbk", "big5", "shift_jis", "euc_jp", "cp874", "cp1256", "cp1253")]
    once += [(t, w) for t, w in (("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8-r", "cp866"), ("cp1251", "mac_cyrillic"), ("cp1251", "mac_roman"), ("koi8-r", "mac_roman"), ("shift_jis", "mac_roman"), ("gbk", "mac_roman"), ("euc_jp", "mac_roman"), ("gbk", "cp437"), ("shift_jis", "cp437"))]
    once += [("utf-8", w) for w in MULTI_BYTE] + [("cp1252", "gbk"), ("cp1252", "shift_jis")]
    twice = [(("utf-8", w), ("utf-8", w)) for w in ("latin-1", "web-1252", "mac_roman", "cp437", "cp850", "cp1251")] + [(("utf-8", "latin-1"), ("utf-8", "web-1252")), (("utf-8", "web-1252"), ("utf-8", "latin-1"))]
    return [(c,) for c in once] + twice


def invert(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text before the chain, or None where the inversion isn't strict."""
    for true, wrong in reversed(chain):
        raw = to_bytes(text, wrong)
        if raw is None:
            return None
        try:
            text = raw.decode(true)
        except UnicodeDecodeError:
            return None
    return text


def again(text: str, chain: tuple[tuple[str, str], ...]) -> str:
    """The text after the chain."""
    for true, wrong in chain:
        text = misread(text, true, wrong)
    return text


def changed(text: str, before: str) -> tuple[str, str]:
    """The words of two readings that differ; the whole readings where words don't correspond."""
    a, b = text.split(" "), before.split(" ")
    if len(a) != len(b):
        return text, before
    differ = [(x, y) for x, y in zip(a, b) if x != y]
    return " ".join(x for x, _ in differ), " ".join(y for _, y in differ)


def bigrams(text: str) -> np.ndarray:
    """Hashed byte bigrams that touch a byte beyond ASCII; word edges and digits are merged."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if len(raw) < 2:
        return np.zeros(0, np.int64)
    a, b = raw[:-1].astype(np.int64), raw[1:].astype(np.int64)
    return (a * 256 + b)[(a >= 128) | (b >= 128)] % BUCKETS


ALIKE = {k: v for k, v in LOOK_ALIKE.items() if k.isascii()}
CHAR_BUCKETS = 1 << 18


def char_bigrams(text: str) -> np.ndarray:
    """Hashed character bigrams that touch a character beyond ASCII, for the check that a text reads better."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    if len(code) < 2:
        return np.zeros(0, np.int64)
    a, b = code[:-1], code[1:]
    return ((a * 1_000_003 + b * 8191) % CHAR_BUCKETS)[(a >= 128) | (b >= 128)]


PIECE = re.compile(r"[^\r\n]+?(?:[.!?][\"'”’»)]*(?=[ \t\r\n])|[。！？]|$|(?=[\r\n]))", re.M)
BEYOND = re.compile(r"[^\x00-\x7f]+")
NON_ASCII = re.compile(r"[^\x00-\x7f]")


def pieces(text: str) -> Iterator[tuple[int, int]]:
    for m in PIECE.finditer(text):
        if NON_ASCII.search(m.group()):
            yield m.start(), m.end()


LINE = re.compile(r"[^\r\n]+")
END = re.compile(r"[.!?][\"'”’»)]*(?=[ \t])|[。！？]")


def sentences_of(text: str) -> Iterator[str]:
    """The pieces of a text without outer blanks, those without a character beyond ASCII too; faster than ``PIECE`` on whole collections."""
    for line in LINE.findall(text):
        at = 0
        for m in END.finditer(line):
            if m.start() > at:
                yield line[at : m.end()].strip()
                at = m.end()
        yield line[at:].strip()


EXTRAS = [*(f"€{n}0" for n in range(1, 10)), *["—", "–", "£20", "café", "naïve", "№ 7", "5 °C", "…", "½", "±3", "§ 4", "™", "©", "résumé", "Zoë", "São", "x²", "10³", "7‰", "a·b"] * 9]
ALWAYS = "Selon l’équipe, la clé reste à l’été."
ENGLISH = ["café", "“x”", "it’s a", "a — b", "€25", "naïve", "résumé", "…"]
TREES = [a + b for a in ("├── ", "└── ", "│   ├── ", "│ ", "─────", "═════ ", "│   └── ", "┌──┐", "└──┘", "╔══╗", "║ ", "█▓▒░ ", "• ", "→ ", "■ ") for b in ("srv/archive/batch_3.log", "data", "notes", "")]

NEWLINE, BLANK = 10, 32
CODE = 21  # bits of a character
ASCII, ASCII_WORDY, LIGATURES, SIZES, DIRECT = -1, -2, -3, -4, -10  # kinds of counts beside the masks of sentences; DIRECT - k: bytes of chain k
PART = 1 << 21  # characters that are counted at once
HELD = 1 << 19  # counts that a task holds before it passes them on
LOSSY = sorted({chain[0][0] for chain in chains()} - {"utf-8"})
WORDY = 1 << len(LOSSY)  # bit of the mask of a sentence of more than three words; those below tell the encodings that hold it
Counts = tuple[np.ndarray, np.ndarray, np.ndarray]  # kind, key, number
Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]  # character, next character, number


def direct(chain: Chain) -> bool:
    """Whether a character's reading depends on its neighbours."""
    return any(wrong in MULTI_BYTE for _, wrong in chain)


@cache
def losses() -> np.ndarray:
    """By character, the encodings of ``LOSSY`` that lack it as bits; the topmost bit where that is known."""
    return np.zeros(1 << CODE, np.uint32)


def lost_in(codes: np.ndarray) -> np.ndarray:
    """The bits of ``losses`` of some characters."""
    table = losses()
    for code in np.unique(codes[table[codes] == 0]).tolist():
        bits = 1 << 31
        for e, name in enumerate(LOSSY):
            if chr(code).encode(name, "replace") == b"?":
                bits |= 1 << e
        table[code] = bits
    return table[codes]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)


def byte_pairs(raw: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the byte bigrams that touch a byte beyond ASCII."""
    found = np.bincount((raw[:-1].astype(np.uint16) << 8) | raw[1:], weights, BUCKETS).astype(np.float64)
    found.reshape(256, 256)[:128, :128] = 0
    return found


def summed(parts: list[Counts]) -> Counts:
    """Equal keys of a kind once, with their sum."""
    kind, key, number = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((key, kind))
    kind, key, number = kind[order], key[order], number[order]
    starts = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])]) if len(kind) else np.zeros(0, np.int64)
    return kind[starts], key[starts], np.add.reduceat(number, starts) if len(starts) else number


def tally(texts: list[str]) -> Counts:
    """How often one character follows another in the sentences of the texts, by the encodings that hold a sentence.

    Every sentence stands between line feeds, so the counts of any parts of a collection add up to those of the whole.
    """
    parts: list[Counts] = [(np.zeros(0, np.int64),) * 3]
    sentences, size = [], 0
    for text in texts:
        for sentence in sentences_of(text):
            if sentence:
                sentences.append(sentence)
                size += len(sentence)
                if size >= PART:
                    parts = [summed([*parts, *counted(sentences)])]
                    sentences, size = [], 0
    return summed([*parts, *counted(sentences)]) if sentences else parts[0]


def counted(sentences: list[str]) -> Iterator[Counts]:
    """The counts of some sentences, kind by kind."""

    def of(kind: int | np.ndarray, keys: np.ndarray, numbers: np.ndarray) -> Counts:
        return np.broadcast_to(np.asarray(kind, np.int64), keys.shape), keys.astype(np.int64), numbers.astype(np.int64)

    text = "\n" + "\n".join(sentences) + "\n"
    codes = codes_of(text)
    first, second = codes[:-1], codes[1:]
    beyond = (first >= 128) | (second >= 128)
    owner = np.cumsum(codes == NEWLINE) - 1  # the sentence of the pair that begins here
    wordy = np.bincount(owner[codes == BLANK], minlength=len(sentences)) >= 3
    plain = np.bincount((first * 128 + second + (wordy[owner[:-1]] << 14))[~beyond], minlength=1 << 15)
    for kind, numbers in zip((ASCII, ASCII_WORDY), plain.reshape(2, -1)):
        at = np.flatnonzero(numbers)
        yield of(kind, (at >> 7 << CODE) | (at & 127), numbers[at])

    tied = codes_of(text.replace("fi", "\ufb01").replace("fl", "\ufb02").replace("ff", "\ufb00"))
    near = np.flatnonzero((tied >= 0xFB00) & (tied <= 0xFB02))
    near = np.unique(np.r_[near - 1, near])
    pairs, numbers = np.unique((tied[near] << CODE) | tied[near + 1], return_counts=True)
    yield of(LIGATURES, pairs, numbers)

    wide = np.flatnonzero(codes >= 128)
    clean, starts, signs = np.unique(owner[wide], return_index=True, return_counts=True)
    yield of(SIZES, np.arange(2), np.array([len(clean), len(sentences)]))
    if not len(clean):
        return
    lost = lost_in(codes[wide])
    masks = np.where(wordy, WORDY, 0)
    for e in range(len(LOSSY)):
        gone = np.add.reduceat(((lost >> e) & 1).astype(np.int64), starts)
        masks[clean[gone <= 0.5 * signs]] |= 1 << e
    distinct, place = np.unique(masks, return_inverse=True)
    pairs, numbers = np.unique((place[owner[:-1][beyond]] << 2 * CODE) | (first[beyond] << CODE) | second[beyond], return_counts=True)
    yield of(distinct[pairs >> 2 * CODE], pairs & ((1 << 2 * CODE) - 1), numbers)

    for k, chain in enumerate(chains(), 1):
        if direct(chain):
            true = chain[0][0]
            held = clean if true == "utf-8" else clean[(masks[clean] >> LOSSY.index(true)) & 1 == 1]
            garbled = again("\n" + "\n".join(sentences[i] for i in held) + "\n", chain) if len(held) else ""
            found = byte_pairs(np.frombuffer(garbled.encode("utf-8", "replace"), np.uint8))
            at = np.flatnonzero(found)
            yield of(DIRECT - k, at, found[at])


def formed(pairs: Pairs, form: dict[str, list[tuple[str, float]]], weight: float) -> Pairs:
    """The expected pairs where every character becomes one of some strings, each with its probability."""
    a, b, n = pairs
    codes, place = np.unique(np.r_[a, b], return_inverse=True)
    a_at, b_at = place[: len(a)], place[len(a) :]
    choice = [form.get(chr(c)) or [(chr(c), 1.0)] for c in codes.tolist()]
    sides = []
    for end in (-1, 0):
        shares: list[dict[int, float]] = [{} for _ in choice]
        for share, strings in zip(shares, choice):
            for x, p in strings:
                share[ord(x[end])] = share.get(ord(x[end]), 0.0) + p
        width = np.array([len(x) for x in shares])
        sides.append((width, np.cumsum(width) - width, np.array([c for x in shares for c in x]), np.array([p for x in shares for p in x.values()])))
    (a_width, a_start, tail, a_share), (b_width, b_start, head, b_share) = sides
    many = a_width[a_at] * b_width[b_at]
    row = np.repeat(np.arange(len(a)), many)
    k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    width = b_width[b_at[row]]
    left, right = a_start[a_at[row]] + k // width, b_start[b_at[row]] + k % width
    inner = [(ord(x), ord(y), i, p) for i, strings in enumerate(choice) for s, p in strings for x, y in zip(s, s[1:])]
    times = np.bincount(a_at, n, len(codes))
    return (
        np.r_[tail[left], np.array([x for x, *_ in inner], np.int64)],
        np.r_[head[right], np.array([y for _, y, *_ in inner], np.int64)],
        weight * np.r_[n[row] * a_share[left] * b_share[right], np.array([times[i] * p for *_, i, p in inner], np.float64)],
    )


@cache
def clean_forms() -> list[tuple[dict[str, list[tuple[str, float]]], float]]:
    """Forms of every clean sentence as (what becomes of a character, number of such forms)."""
    printed = [chr(c) for c in range(0x21, 0x7F)]
    blanks = "\xa0\u2002\u2009\u202f\u2007\u205f\u3000"
    alike = {c: [(c, 0.6), *((x, 0.4 / len(xs)) for x in xs)] for c, xs in ALIKE.items()}
    wide = {c: [(c, 0.5), (chr(ord(c) + 0xFEE0), 0.5)] for c in printed}
    raised = {c: [(c, 0.9), (x, 0.1)] for c, x in zip("0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")}
    return [({}, 1.0), (alike, 0.3), (wide, 0.1), (raised, 0.1), *(({" ": [(x, 1.0)]}, 0.1 / len(blanks)) for x in blanks)]


UPPER, UNSEEN = 0.4, 0.1  # numbers of sentences in capitals and with invisible signs, to each as it is
AGAIN, CURLED = 1.67, 0.33  # wordy sentences with typographic signs, and with other apostrophes
EXTRA, QUOTED, OWNED, SPOKEN = 0.1, 0.005, 0.04, 0.33  # shares of their blanks with an extra word, of their words in quotation marks and with 's, of such sentences in quotation marks
TIED, DRAWN, SAID = 0.1, 0.06, 0.005  # ligatures; lines of trees and English phrases to each sentence
SMOOTH, SMOOTH_CHAIN = 50_000, 4_000  # sentences of clean text and of a chain from which on smoothing has a fixed share of the counts


def forms(pairs: Pairs, wordy: Pairs) -> Iterator[Pairs]:
    """The expected pairs of clean forms of clean sentences: as they are, in capitals, with look-alike letters, other blanks and typographic signs."""
    if not len(pairs[0]):
        return
    for form, weight in clean_forms():
        yield formed(pairs, form, weight)
    a, b, n = pairs
    codes = np.unique(np.r_[a, b]).tolist()
    yield formed(pairs, {chr(c): [(chr(c).upper(), 1.0)] for c in codes}, UPPER)
    yield formed(pairs, {chr(c): [(chr(c), 0.9), *((chr(c) + x, 0.1 / 6) for x in "\xad\u200b\u200c\u200d\u2060\ufeff")] for c in codes if c != NEWLINE}, UNSEEN)

    if not len(wordy[0]):
        return
    yield formed(wordy, {}, AGAIN)
    yield formed(wordy, {"'": [("’", 1.0)]}, CURLED)
    a, b, n = wordy
    made: list[Pairs] = []

    def put(x: np.ndarray | int, y: np.ndarray | int, number: np.ndarray) -> None:
        made.append((np.broadcast_to(np.asarray(x, np.int64), number.shape), np.broadcast_to(np.asarray(y, np.int64), number.shape), number))

    blank = n[a == BLANK].sum()
    for extra, many in Counter(EXTRAS).items():
        x = codes_of(" " + extra + " ")
        put(x[:-1], x[1:], np.full(len(x) - 1, blank * EXTRA * many / len(EXTRAS)))
    before, behind = (a == BLANK) | (a == NEWLINE), (b == BLANK) | (b == NEWLINE)
    for begins, ends, share in ((before & ~behind, behind & ~before, QUOTED), ((a == NEWLINE) & ~behind, (b == NEWLINE) & ~before, SPOKEN)):
        put(a[begins], ord("“"), share * n[begins])
        put(ord("“"), b[begins], share * n[begins])
        put(a[ends], ord("”"), share * n[ends])
        put(ord("”"), b[ends], share * n[ends])
    ends = (b == BLANK) & ~before
    put(a[ends], ord("’"), OWNED * n[ends])
    for x, y in ("’s", "s "):
        put(ord(x), ord(y), OWNED * n[ends])
    x, y, number = (np.concatenate(z) for z in zip(*made))
    yield x, y, number


def images(codes: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 of characters after a chain of single-byte decoders: all bytes, and where each character begins and ends."""
    texts = "\n".join("" if c == NEWLINE else chr(c) for c in codes.tolist())
    raw = np.frombuffer((again(texts, chain) + "\n").encode("utf-8", "replace"), np.uint8)
    ends = np.flatnonzero(raw == NEWLINE)
    starts = np.r_[0, ends[:-1] + 1]
    return raw, starts, np.where(starts == ends, ends + 1, ends)


def garbled_pairs(pairs: Pairs, chain: Chain) -> np.ndarray:
    """Numbers of the byte bigrams of a text after a chain, from its pairs of characters."""
    a, b, n = pairs
    if not len(a):
        return np.zeros(BUCKETS)
    codes, place = np.unique(np.r_[a, b], return_inverse=True)
    a_at, b_at = place[: len(a)], place[len(a) :]
    raw, starts, ends = images(codes, chain)
    times = np.zeros(len(raw) + 1)
    inside = np.bincount(a_at, n, len(codes))
    np.add.at(times, starts, inside)
    np.add.at(times, ends - 1, -inside)
    out = byte_pairs(raw, np.cumsum(times)[: len(raw) - 1])
    out += np.bincount(raw[ends[a_at] - 1].astype(np.int64) * 256 + raw[starts[b_at]], n, BUCKETS)
    out.reshape(256, 256)[:128, :128] = 0
    return out


def letter_pairs(pairs: Pairs) -> np.ndarray:
    """Numbers of the hashed character bigrams that touch a character beyond ASCII."""
    a, b, n = pairs
    beyond = (a >= 128) | (b >= 128)
    return np.bincount(((a * 1_000_003 + b * 8191) % CHAR_BUCKETS)[beyond], n[beyond], CHAR_BUCKETS)


def derived(counts: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of byte bigrams by class, of clean character bigrams, of sentences beyond ASCII and of all) that follow from the counts."""
    kind, key, number = counts
    every, sizes = chains(), np.zeros(2)
    out = np.zeros((len(every) + 1, BUCKETS))
    letters = np.zeros(CHAR_BUCKETS)

    def pairs(which: np.ndarray) -> Pairs:
        both, place = np.unique(key[which], return_inverse=True)
        return both >> CODE, both & ((1 << CODE) - 1), np.bincount(place, number[which], len(both))

    np.add.at(sizes, key[kind == SIZES], number[kind == SIZES])
    beyond, wordy = kind >= 0, (kind == ASCII_WORDY) | (kind >= 0) & (kind & WORDY > 0)
    a, b, n = pairs(kind == LIGATURES)
    for form in chain_of(forms(pairs(kind >= ASCII_WORDY), pairs(wordy)), [(a, b, n * TIED)]):
        out[0] += garbled_pairs(form, ())
        letters += letter_pairs(form)
    for k, chain in enumerate(every, 1):
        if direct(chain):
            out[k] += np.bincount(key[kind == DIRECT - k], number[kind == DIRECT - k], BUCKETS)
        else:
            true = chain[0][0]
            out[k] += garbled_pairs(pairs(beyond if true == "utf-8" else beyond & ((kind >> LOSSY.index(true)) & 1 == 1)), chain)
    return out, letters, sizes


def model_of(counts: np.ndarray, letters: np.ndarray, sizes: np.ndarray, prior: float = 0.02) -> dict:
    """The classifier: log probabilities of every bigram bucket by class; class 0 is clean text.

    Drawn lines and phrases that any text may have are added in proportion to the sentences, and so is ``prior``: were it
    fixed, what a class hasn't would count for ever less as the texts grow.
    """
    always, drawn, said = derived(tally([ALWAYS])), codes_of("\n" + "\n".join(TREES) + "\n"), derived(tally(ENGLISH))
    trees = drawn[:-1], drawn[1:], np.full(len(drawn) - 1, max(3000.0, DRAWN * sizes[1]) / len(TREES))
    counts, letters = counts + always[0], letters + always[1]
    counts[0] += garbled_pairs(trees, ())
    letters = letters + letter_pairs(trees)
    counts[1:] += said[0][1:] * max(20.0, SAID * sizes[0])
    used = np.flatnonzero(counts.sum(axis=0))
    grown = max(1.0, sizes[1] / SMOOTH)
    priors = prior * np.r_[grown, np.full(len(counts) - 1, max(1.0, sizes[0] / SMOOTH_CHAIN))][:, None]
    total = counts.sum(axis=1, keepdims=True)
    log = np.log((counts[:, used] + priors) / (total + priors * BUCKETS)).astype(np.float32)
    rest = np.log(priors / (total + priors * BUCKETS))[:, 0].astype(np.float32)
    active = np.flatnonzero(np.r_[True, total[1:, 0] > 0])
    held, least = np.flatnonzero(letters), 0.1 * grown
    every = letters.sum() + least * CHAR_BUCKETS
    language = {"held": held, "log": np.log((letters[held] + least) / every).astype(np.float32), "rest": float(np.log(least / every))}
    return {"language": language, "used": used, "log": log[active], "rest": rest[active], "chains": [(), *chains()], "active": active}


def train(texts: list[str]) -> dict:
    """The classifier of texts at hand: every sentence counts for clean text and for every chain."""
    return model_of(*derived(tally(texts)))


MARGIN = 7.0  # nats by which a chain must beat clean text, and restored text the stretch
RIVAL = 40.0  # nats within which another chain is a rival whose reading must be clearly worse
CONTROLS = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f\ue000-\uf8ff]")


def sensible(text: str, controls: bool = False) -> bool:
    """Whether a restored text has no controls (unless ``controls``), mixes no alphabets in a word and isn't a stray letter of one."""
    if not controls and CONTROLS.search(text):
        return False
    foreign = 0
    for word in re.findall(r"[^\W\d_]+", text):
        if word.isascii():
            continue
        other = sum(script(c) in ("greek", "cyrillic", "arabic", "indic", "thai") for c in word)
        if other and any("a" <= c.lower() <= "z" or "\xc0" <= c < "\u0250" for c in word):
            return False
        foreign += other + sum(script(c) == "cjk" for c in word)
    return foreign == 0 or foreign >= 3


SPLIT = re.compile(r"([ \t]+)")
EDGES = re.compile(r"^([^\w\x80-\u02ff\u0370-\u04ff]*)(.*?)([^\w\x80-\u02ff\u0370-\u04ff]*)$", re.S)
SURE = 0.8  # share of known bigrams in the restored words of a certain restoration
GAP = re.compile(r"\w\?\w|\?[^\W\d]")  # a question mark where a letter stood
CHUNK = 1 << 10  # strings whose scores are summed at once


WIDE = "\u0590-\u1fff\u2e80-\ua95f\uac00-\ud7ff\uf900-\ufaff\uff66-\uff9f"
TOKEN = re.compile(rf"(?:[{WIDE}]+|[^\s{WIDE}]*[^\s\x00-\x7f{WIDE}][^\s{WIDE}]*)(?:(?<=[^\s{WIDE}])[\xa0\x85\xad]+[^\s{WIDE}]+)*")


def best_run(leads: np.ndarray) -> tuple[int, int] | None:
    """(first, last) row of the run of rows with the largest sum in one column, if that reaches the margin."""
    best, run = MARGIN, None
    total, start = np.zeros(leads.shape[1]), np.zeros(leads.shape[1], int)
    for i, row in enumerate(leads):
        fresh = total <= 0
        start[fresh] = i
        total = np.where(fresh, row, total + row)
        k = int(total.argmax()) if len(total) else 0
        if len(total) and total[k] >= best:
            best, run = total[k], (int(start[k]), i)
    return run


class Reader:
    """Classifies the pieces of texts, inverts predicted chains and verifies what comes out."""

    def __init__(self, model: dict) -> None:
        self.where = np.full(BUCKETS, len(model["used"]), np.int64)
        self.where[model["used"]] = np.arange(len(model["used"]))
        self.log = np.ascontiguousarray(np.hstack([model["log"], model["rest"][:, None]]).T)
        self.peak = np.maximum((self.log[:, 1:] - self.log[:, :1]).max(axis=1, initial=0.0), 0.0).astype(np.float64)
        self.chains = [model["chains"][i] for i in model["active"]]
        self.language = np.full(CHAR_BUCKETS, model["language"]["rest"], np.float32)
        self.language[model["language"]["held"]] = model["language"]["log"]
        self.rare = model["language"]["rest"] + 1.0  # bigrams that were counted at most once or twice by chance lie below
        self.seen: dict[str, tuple[str, bool, Chain] | None] = {}
        self.tried: dict[str, tuple[str, bool, Chain] | None] = {}
        self.words: dict[tuple[str, Chain], str | None] = {}

    def scores(self, text: str) -> np.ndarray:
        return self.log[self.where[bigrams(text)]].sum(axis=0)

    def grams_of(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the table, owner) of the bigrams of many strings at once."""
        raw = np.frombuffer("\0".join(many).encode("utf-8", "replace"), np.uint8)
        if len(raw) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        x, y = raw[:-1].astype(np.int64), raw[1:].astype(np.int64)
        use = np.flatnonzero(((x >= 128) | (y >= 128)) & (x > 0) & (y > 0))
        return self.where[(x * 256 + y)[use] % BUCKETS], np.cumsum(raw[:-1] == 0)[use]

    def leads(self, many: list[str]) -> np.ndarray:
        """For each string, by how many nats each chain beats clean text; all strings are classified together."""
        out = np.zeros((len(many), self.log.shape[1] - 1), np.float32)
        rows, owner = self.grams_of(many)
        for at in range(0, len(many), CHUNK):
            low, high = np.searchsorted(owner, (at, at + CHUNK))
            if high > low:
                filled, starts = np.unique(owner[low:high], return_index=True)
                s = np.add.reduceat(self.log[rows[low:high]], starts, axis=0)
                out[filled] = s[:, 1:] - s[:, :1]
        return out

    def possible(self, many: list[str]) -> np.ndarray:
        """Strings in which some chain could lead by the margin somewhere: an upper bound, the sum of each bigram's best lead where it is positive."""
        rows, owner = self.grams_of(many)
        return np.bincount(owner, self.peak[rows], minlength=len(many)) >= MARGIN

    def suspects(self, many: list[str]) -> np.ndarray:
        """For each piece, whether some chain beats clean text."""
        return self.leads(many).max(axis=1, initial=0.0) >= MARGIN

    def stretches(self, many: list[str]) -> list[list[tuple[int, int]]]:
        """For each piece that reads as clean as a whole: the stretches of words (runs of one kind of script) in which a chain leads."""
        tokens = [[m.span() for m in TOKEN.finditer(x)] for x in many]
        place: dict[str, int] = {}
        rows = [[place.setdefault(x[a:b], len(place)) for a, b in t] for x, t in zip(many, tokens)]
        leads = self.leads(list(place))
        most = np.maximum(leads, 0).max(axis=1, initial=0.0)
        out: list[list[tuple[int, int]]] = []
        for t, r in zip(tokens, rows):
            found: list[tuple[int, int]] = []
            if most[r].sum() >= MARGIN and np.maximum(leads[r], 0).sum(axis=0).max() >= MARGIN:
                parts = [(0, len(r))]
                while parts:
                    low, high = parts.pop()
                    run = best_run(leads[r[low:high]])
                    if run:
                        found.append((t[low + run[0]][0], t[low + run[1]][1]))
                        parts += [(low, low + run[0]), (low + run[1] + 1, high)]
            out.append(sorted(found))
        return out

    def clean(self, text: str) -> float:
        """Log probability of the character bigrams as clean text; plain ASCII counts as certain."""
        return float(self.language[char_bigrams(" " + text + " ")].sum())

    def known(self, text: str) -> float:
        """Share of the character bigrams that clean text has."""
        grams = self.language[char_bigrams(" " + text + " ")]
        return float((grams > self.rare).mean()) if len(grams) else 1.0

    def familiar(self, text: str, before: str, chain: tuple[tuple[str, str], ...]) -> bool:
        """One letter for another in Latin text is weak evidence: most bigrams must be known, and many were not before."""
        if chain[0][0] == "utf-8" or any(script(c) not in ("latin", "other") for c in before):
            return True
        if len(before) == len(text) and any(a.isspace() and b.isalpha() for a, b in zip(text, before)):
            return False  # an odd blank is no letter
        now, then = changed(text, before)
        known = self.known(then)
        return known >= 0.6 and known >= self.known(now) + 0.25

    def acceptable(self, text: str, before: str | None, chain: tuple[tuple[str, str], ...]) -> bool:
        """Whether ``before`` is what ``text`` was: it becomes ``text`` again, is sensible and reads better."""
        return before is not None and before != text and self.clean(before) > self.clean(text) + MARGIN and sensible(before, chain[0][0] == "utf-8") and again(before, chain) == text and self.familiar(text, before, chain)

    def patched(self, text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
        """``text`` with those words inverted that one chain explains."""
        words, found = SPLIT.split(text), False
        for i, word in enumerate(words):
            if word.isascii():
                continue
            if (word, chain) not in self.words:
                self.words[word, chain] = self.explained(word, chain)
            before = self.words[word, chain]
            if before is not None:
                words[i], found = before, True
        return "".join(words) if found else None

    def explained(self, word: str, chain: Chain) -> str | None:
        """The word before the chain, with or without the signs around it, if that reads better."""
        for head, core, tail in (("", word, ""), EDGES.match(word).groups()):
            before = invert(core, chain)
            if before is not None and before != core and self.clean(before) > self.clean(core) and sensible(before, chain[0][0] == "utf-8"):
                return head + before + tail
        return None

    def step(self, text: str) -> tuple[str | None, bool, Chain] | None:
        """(text before one chain, whether that is certain, the chain); None where ``text`` reads as clean; no text where nothing inverts.

        All chains that beat clean text are tried on the whole piece, then word by word, each alone; the
        best reading counts. It is certain if no other reading comes near it.
        """
        s = self.scores(text)
        likely = [k for k in np.argsort(-s) if k and s[k] >= s[0] + MARGIN]
        if not likely:
            return None
        readings: dict[str, float] = {}
        by: dict[str, Chain] = {}
        for k in likely:
            before = invert(text, self.chains[k])
            if self.acceptable(text, before, self.chains[k]):
                readings[before], by[before] = self.clean(before), self.chains[k]
        if not readings:
            base = self.clean(text)
            for k in likely:
                before = self.patched(text, self.chains[k])
                if before is not None and before not in readings and self.clean(before) > base + MARGIN and self.familiar(text, before, self.chains[k]):
                    readings[before], by[before] = self.clean(before), self.chains[k]
        if not readings:
            grams = bigrams(text)
            # affected beyond doubt only if far from clean text
            return (None, False, ()) if len(grams) >= 12 and s[likely[0]] - s[0] > 2.5 * len(grams) else None
        best = max(readings, key=readings.get)
        rivals = {invert(text, self.chains[k]) for k in np.flatnonzero(s >= s[likely[0]] - RIVAL) if k} - {None, best, text}
        certain = all(readings[best] - self.clean(r) >= MARGIN for r in rivals | (readings.keys() - {best}))
        return best, certain, by[best]

    def piece(self, text: str) -> tuple[str, bool, Chain] | None:
        """(restored, lossless, chain) of one affected piece, None for a clean one; chains are undone until none is left."""
        now, certain, hit, undone = text, True, False, ()
        while (made := self.step(now)) is not None:
            hit = True
            certain &= made[1]
            if made[0] is None:
                certain = False
                break
            now, undone = made[0], made[2] + undone
        if not hit:
            return None
        return now, self.sure(text, now) and certain, undone

    def sure(self, text: str, now: str) -> bool:
        """Whether nothing was lost and the restored words are known."""
        return "\ufffd" not in now and sensible(now) and not GAP.search(now) and self.known(changed(text, now)[1]) >= SURE

    def texts(self, many: list[str]) -> list[tuple[bool, bool, str]]:
        """(affected, lossless, restored) of each text; every piece of every text is classified."""
        cuts = [[] if t.isascii() else list(pieces(t)) for t in many]
        fresh = list(dict.fromkeys(t[a:b] for t, c in zip(many, cuts) for a, b in c if t[a:b] not in self.seen))
        self.seen.update(dict.fromkeys(fresh))
        fresh = [x for x, maybe in zip(fresh, self.possible(fresh)) if maybe]
        for x, suspect in zip(fresh, self.suspects(fresh)):
            self.seen[x] = self.piece(x) if suspect else None
        left = [x for x in fresh if self.seen[x] is None]
        for x, found in zip(left, self.stretches(left)):
            if found:
                self.seen[x] = self.mended(x, found)
        out = []
        for t, c in zip(many, cuts):
            affected, lossless = "\ufffd" in t, "\ufffd" not in t
            made, at = [], 0
            hits = [self.seen[t[a:b]] for a, b in c]
            used = list(dict.fromkeys(h[2] for h in hits if h and h[2]))
            for (a, b), hit in zip(c, hits):
                hit = hit or self.likewise(t[a:b], used)
                if hit:
                    affected = True
                    lossless &= hit[1]
                    made += [t[at:a], hit[0]]
                    at = b
            out.append((affected, lossless, "".join([*made, t[at:]])))
        if len(self.seen) > 50_000:
            self.seen.clear()
            self.tried.clear()
        if len(self.words) > 500_000:
            self.words.clear()
        return out

    def mended(self, text: str, found: list[tuple[int, int]]) -> tuple[str, bool, Chain] | None:
        """A piece in which only stretches are garbled; certain if no chain that garbled them could have made the words that stay."""
        made, at, certain, chain, stays, used = [], 0, True, None, [], set()
        for a, b in found:
            stretch = text[a:b]
            if stretch not in self.tried:
                self.tried[stretch] = self.piece(stretch)
            hit = self.tried[stretch]
            if hit:
                made += [text[at:a], hit[0]]
                stays.append(text[at:a])
                at, chain = b, chain or hit[2]
                used.add(hit[2])
                certain &= hit[1]
        if chain is None and at == 0:
            return None
        words = {w for x in [*stays, text[at:]] for w in [*BEYOND.findall(x), *(m.group() for m in TOKEN.finditer(x))]}
        certain &= all(invert(w, c) in (None, w) for c in used for w in words)
        return "".join([*made, text[at:]]), certain, chain or ()

    def likewise(self, text: str, used: list[Chain]) -> tuple[str, bool, Chain] | None:
        """A piece too short to tell by itself, read by the chains that garbled other pieces of its text."""
        for chain in used:
            before = invert(text, chain)
            if before is not None and before != text and sensible(before) and again(before, chain) == text and self.clean(before) > self.clean(text):
                return before, self.sure(text, before), chain
        return None

    def text(self, text: str) -> tuple[bool, bool, str]:
        """(affected, lossless, restored) of one text."""
        return self.texts([text])[0]


def fit(clean_texts: DataFrame, text: str = "text", train_lines: int | None = None) -> dict:
    """The classifier, fitted on all distinct lines of clean texts of any length, or on at most ``train_lines`` of them.

    Executors count pairs of characters and work out every class from the summed pairs; the driver gets a row for each
    bucket of the model that isn't empty, however many texts there are.
    """
    lines = clean_texts.select(F.explode(F.split(F.col(text), "[\\r\\n]+")).alias("text")).where("trim(text) <> ''")
    if train_lines is not None:
        return train(sample_of(lines, train_lines))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[Counts] = []
        for frame in frames:
            held.append(tally(frame["text"].tolist()))
            if sum(len(x[0]) for x in held) >= HELD:
                held = [summed(held)]
                if len(held[0][0]) >= HELD // 2:
                    yield pd.DataFrame(dict(zip(("kind", "key", "number"), held.pop())))
        if held:
            yield pd.DataFrame(dict(zip(("kind", "key", "number"), summed(held))))

    def derive(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, size = None, [], 0
        for frame in chain_of(frames, [None]):
            if frame is not None:
                held.append(frame)
                size += len(frame)
            if held and (frame is None or size >= HELD // 4):
                made = derived(tuple(pd.concat(held)[name].to_numpy() for name in ("kind", "key", "number")))
                total = made if total is None else tuple(x + y for x, y in zip(total, made))
                held, size = [], 0
        if total is not None:
            for k, numbers in enumerate([*total[0], *total[1:]]):
                at = np.flatnonzero(numbers)
                yield pd.DataFrame({"class": k, "bucket": at, "number": numbers[at]})

    pairs = lines.distinct().mapInPandas(count, "kind bigint, key bigint, number bigint").groupBy("kind", "key").agg(F.sum("number").alias("number"))
    found = pairs.mapInPandas(derive, "class bigint, bucket bigint, number double").groupBy("class", "bucket").agg(F.sum("number").alias("number")).toPandas()
    classes = len(chains()) + 1
    counts, letters, sizes = np.zeros((classes, BUCKETS)), np.zeros(CHAR_BUCKETS), np.zeros(2)
    for k, target in enumerate([*counts, letters, sizes]):
        rows = found[found["class"] == k]
        target[rows["bucket"].to_numpy()] = rows["number"].to_numpy()
    return model_of(counts, letters, sizes)


def repair(records: DataFrame, model: dict, record_id: str = "extraction_id", text: str = "text") -> DataFrame:
    """(id, lossless, restored_text) of the affected records, each once."""
    rows = records.select(F.col(record_id).alias("id"), F.col(text).alias("text")).where(F.col("text").rlike("[^\\x00-\\x7f]"))
    rows = by_key(rows, "id").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model)
        for frame in frames:
            made = []
            for id_, (affected, lossless, before) in zip(frame["id"], reader.texts(frame["text"].tolist())):
                if affected:
                    made.append((id_, lossless, before if lossless else None))
            yield pd.DataFrame(made, columns=["id", "lossless", "restored_text"])

    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, lossless boolean, restored_text string")
