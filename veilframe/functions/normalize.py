"""Undoing obfuscation while keeping the way back: every rewritten character knows its original byte.

Text is carried as a string with a parallel list of original byte places.  Each stage is a regular
expression with a replacement; ``rewrite`` composes the places, so stages stay small and independent.
"""

from __future__ import annotations

import base64
import binascii
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from veilframe.functions.confusables import ascii_of
from veilframe.functions.text import LEET_FROM, LEET_TO, SPACES, ZERO_WIDTH

HOMOGLYPHS = ascii_of()
SPACE_SET, ZERO_SET = set(SPACES), set(ZERO_WIDTH)

Marked = tuple[str, list[int] | None]  # places are left out where only the text is wanted


def start(text: str) -> Marked:
    if text.isascii():
        return text, list(range(len(text)))
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    return text, (np.cumsum(width) - width).tolist()


def rewrite(marked: Marked, pattern: re.Pattern, replace: Callable[[re.Match], str | None]) -> Marked:
    """Replace matches; the new characters take the first place of what they replace. None keeps a match."""
    text, places = marked
    if places is None:
        return pattern.sub(lambda m: m.group() if (put := replace(m)) is None else put, text), None
    out, new, last = [], [], 0
    for m in pattern.finditer(text):
        put = replace(m)
        if put is None or put == m.group():
            continue
        out += [text[last : m.start()], put]
        new += places[last : m.start()] + [places[m.start()]] * len(put)
        last = m.end()
    if not last and not out:
        return marked
    return "".join([*out, text[last:]]), new + places[last:]


def printable(code: int) -> str | None:
    return chr(code) if 0x20 <= code < 0x7F else None


PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
ENTITY = re.compile(r"&#(?:[xX]([0-9A-Fa-f]{1,9})|([0-9]{1,9}));")
COMMENT = re.compile(r"/\*\*/|<!---->")
HEX_SPACED = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{2}(?: [0-9A-Fa-f]{2}){2,}(?![0-9A-Za-z])")
HEX_ESCAPE = re.compile(r"\\x([0-9A-Fa-f]{2})")
ENCODED = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_-]{12,}={0,6}(?![A-Za-z0-9+/_=.-])")
PADDING = re.compile(r"(?<=[^A-Za-z\s])\s+(?=[^A-Za-z\s])")
RUNS = re.compile(r"(?<=[0-9A-Za-z])([-./_\\])\1+(?=[0-9A-Za-z])")
BETWEEN = re.compile(r"(?<=[0-9A-Za-z])[-/\\_](?=[0-9A-Za-z])")
ADDRESS = re.compile(r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d.])")
DOTTED = re.compile(r"(?<![\d.])\d{1,6}(?:[./-]\d{1,6}){2,}(?![\d])")
MARKERS = re.compile(r"%[0-9A-Fa-f]{2}|&#|/\*\*/|<!---->|[^A-Za-z\s]\s+[^A-Za-z\s]|[-.]{2}|(?:[0-9A-Fa-f]{2} ){2}|\\x|[0-9A-Z][-/\\_.][0-9A-Za-z]|[0-9A-Za-z][-/\\_][0-9A-Z]|[A-Za-z0-9+/_-]{12}|[^\x00-\x7f]")


def readable(raw: bytes) -> str | None:
    """Decoded bytes if they are text: UTF-8, printable throughout, at least four characters, three different bytes."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    trimmed = text.strip()
    if len(trimmed) < 4 or len(set(raw)) < 3 or any(b < 9 or 13 < b < 32 or b == 127 for b in raw):
        return None
    return text if all(c.isprintable() or c.isspace() for c in text) else None


def padded(token: str, unit: int) -> str:
    body = token.rstrip("=")
    return body + "=" * (-len(body) % unit)


@lru_cache(maxsize=1 << 16)
def unbase(token: str) -> str | None:
    """First codec whose result reads as text: base32 for upper-case tokens, base64, base64url, base32, hex, base32hex."""
    body = token.rstrip("=")

    def attempt(f: Callable[[], bytes]) -> str | None:
        try:
            return readable(f())
        except (ValueError, binascii.Error):
            return None

    codecs = [
        lambda: base64.b64decode(padded(token, 4), validate=True),
        lambda: base64.b64decode(padded(token, 4), altchars=b"-_", validate=True),
        lambda: base64.b32decode(padded(body.upper(), 8)),
        lambda: bytes.fromhex(body.removeprefix("0x")) if len(body) >= 16 else b"",
        lambda: base64.b32hexdecode(padded(body.upper(), 8)),
    ]
    if re.fullmatch(r"[A-Z2-7]+", body) and re.search(r"[2-7]", body):
        codecs.insert(0, codecs[2])
    for codec in codecs:
        found = attempt(codec)
        if found:
            return found
    return None


@lru_cache(maxsize=1 << 16)
def plain_char(c: str) -> str:
    """What a character stands for: nothing, a blank, or its compatibility form with look-alikes replaced."""
    if c in ZERO_SET:
        return ""
    return " " if c in SPACE_SET else "".join(HOMOGLYPHS.get(x, x) for x in unicodedata.normalize("NFKC", c))


def normalize(text: str, places: bool = True) -> Marked:
    """(normalized text, original byte place of each of its characters)."""
    marked = start(text) if places else (text, None)
    if not MARKERS.search(text):
        return marked
    if "%" in text:
        for _ in range(2):
            marked = rewrite(marked, PERCENT, lambda m: printable(int(m.group(1), 16)))
    if "&#" in marked[0]:
        marked = rewrite(marked, ENTITY, lambda m: chr(n) if 0 < (n := int(m.group(1), 16) if m.group(1) else int(m.group(2))) < 0xD800 else None)
    if "/*" in marked[0] or "<!" in marked[0]:
        marked = rewrite(marked, COMMENT, lambda m: "")
    marked = rewrite(marked, HEX_SPACED, lambda m: s if (s := bytes.fromhex(m.group()).decode("latin-1")).isascii() and s.isprintable() and any(c.isalnum() for c in s) else None)
    if "\\x" in marked[0]:
        marked = rewrite(marked, HEX_ESCAPE, lambda m: printable(int(m.group(1), 16)))
    for _ in range(3):
        decoded = rewrite(marked, ENCODED, lambda m: unbase(m.group()))
        if decoded[0] == marked[0]:
            break
        marked = decoded
    marked = rewrite(marked, PADDING, lambda m: "")
    marked = rewrite(marked, RUNS, lambda m: m.group(1))
    kept = [m.span() for m in ADDRESS.finditer(marked[0])]
    marked = rewrite(marked, DOTTED, lambda m: None if any(a <= m.start() and m.end() <= b for a, b in kept) else m.group().replace(".", "")) if "." in marked[0] else marked
    before = marked[0]
    side = lambda c: c.isdigit() or c.isupper()
    marked = rewrite(marked, BETWEEN, lambda m: "" if side(before[m.start() - 1]) or side(before[m.end()]) else None)
    if not marked[0].isascii():
        text, places = marked  # the places from here on
        changed = {c: p for c in set(text) if not c.isascii() and (p := plain_char(c)) != c}
        if all(len(p) == 1 for p in changed.values()):
            marked = text.translate({ord(c): p for c, p in changed.items()}) if changed else text, places
        else:
            put = [changed.get(c, c) for c in text]
            marked = "".join(put), None if places is None else [p for x, p in zip(put, places) for _ in x]
    return marked


# ----------------------------------------------------------------------- alternative decodings
LEET = str.maketrans(LEET_FROM, LEET_TO)
ROT = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm")
#: International Morse code.
MORSE = dict(zip(".- -... -.-. -.. . ..-. --. .... .. .--- -.- .-.. -- -. --- .--. --.- .-. ... - ..- ...- .-- -..- -.-- --.. ----- .---- ..--- ...-- ....- ..... -.... --... ---.. ----.".split(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))


def unmorse(text: str) -> str | None:
    if not re.fullmatch(r"[.\-\s/|,:]+", text):
        return None
    words = re.split(r"\s*[/|:]\s*|\s{3,}", text.strip())
    out, symbols = [], 0
    for word in words:
        codes = [c for c in re.split(r"[\s,]+", word) if c]
        if any(c not in MORSE for c in codes):
            return None
        symbols += len(codes)
        out.append("".join(MORSE[c] for c in codes))
    return " ".join(out) if symbols >= 3 else None


def digit_morse(text: str) -> str | None:
    """Digits written as five marks each, without separators or between slashes and commas."""
    m = re.search(r"(?<![.\-])(?:[.\-]{5}[/, ]?){4,20}(?![.\-])", text)
    if not m:
        return None
    marks = re.sub(r"[^.\-]", "", m.group())
    digits = [MORSE.get(marks[i : i + 5]) for i in range(0, len(marks), 5)]
    return "".join(digits) if all(digits) else None


def alternatives(text: str, most: int = 16_384) -> list[str]:
    """Other readings of a short text, each different from it."""
    if not text or len(text.encode("utf-8", "surrogatepass")) > most:
        return []
    rot = text.translate(ROT)
    found = [rot, text.translate(LEET), unmorse(text), digit_morse(text), unbase(text.strip()), unbase(rot.strip())]
    found += [x.translate(ROT) for x in found[4:5] if x]
    return [x for x in dict.fromkeys(f for f in found if f) if x != text]
