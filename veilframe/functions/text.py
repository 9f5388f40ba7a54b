"""Text projections as Column expressions: masks, simple normalizers, entropy, n-grams, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.validators import char_entropy  # noqa: F401  (part of this module's surface)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters without a width, blanks beside the ASCII one, and look-alike digits and signs for letters.
ZERO_WIDTH = "".join(map(chr, [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), *range(0xFE00, 0xFE10), 0xFEFF]))
SPACES = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
LEET_FROM, LEET_TO = "@48(36#!1057+2", "aabceghilosttz"


def rot13(c: Column) -> Column:
    return F.translate(c, UPPER + LOWER, UPPER[13:] + UPPER[:13] + LOWER[13:] + LOWER[:13])


def unleet(c: Column) -> Column:
    return F.translate(c, LEET_FROM, LEET_TO)


def strip_zero_width(c: Column) -> Column:
    return F.translate(c, ZERO_WIDTH, "")


def plain_spaces(c: Column) -> Column:
    return F.translate(c, SPACES, " " * len(SPACES))


def strip_empty_comments(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("/**/"), F.lit("")), F.lit("<!---->"), F.lit(""))


def strip_tags(c: Column) -> Column:
    """Drops everything in angle brackets, joins blanks to one and trims."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"[ \t\r\n]+", " "))


def unfold_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r?\n[ \t]", "")


def redacted(c: Column) -> Column:
    """First and last three characters around stars; all stars for at most eight bytes."""
    n = F.length(c)
    return F.when(F.octet_length(c) <= 8, F.repeat(F.lit("*"), F.octet_length(c))).otherwise(F.concat(F.left(c, F.lit(3)), F.repeat(F.lit("*"), F.greatest(n - 6, F.lit(0))), F.right(c, F.lit(3))))


def masked(c: Column) -> Column:
    return F.repeat(F.lit("*"), F.length(c))


def truncated(c: Column, most: int = 200) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def html_escape(c: Column) -> Column:
    out = c
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def csv_field(c: Column) -> Column:
    """A field as the CSV sink writes it: quoted where it holds a separator or begins like a formula."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[,"\\n\\r]') | c.rlike("^[=+@-]"), quoted).otherwise(c)


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by a blank; an empty array for fewer tokens."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 of a string column, by the definition over two SHA-256 passes."""
    block = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


def initials(c: Column) -> Column:
    """First letters of the words, in capitals."""
    return F.upper(F.array_join(F.transform(F.filter(F.split(c, r"\s+"), lambda x: x.rlike("^[A-Za-z]")), lambda x: F.left(x, F.lit(1))), ""))


def pdf_time(c: Column) -> Column:
    """ISO time in UTC of a document date (``D:20240131120000+02'00'``), null where it isn't one; missing parts are the least."""
    part = lambda i: F.regexp_extract(c, r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:Z|([+-])(\d{2})'?(\d{2})?'?)?", i)
    number = lambda i, least: F.coalesce(F.nullif(part(i), F.lit("")).try_cast("int"), F.lit(least))
    local = F.try_make_timestamp(F.nullif(part(1), F.lit("")).try_cast("int"), number(2, 1), number(3, 1), number(4, 0), number(5, 0), number(6, 0).cast("double"))
    away = F.when(part(7) == "-", -1).when(part(7) == "+", 1).otherwise(0) * (number(8, 0) * 3600 + number(9, 0) * 60)
    return F.date_format(F.timestamp_micros(F.unix_micros(local) - away.cast("bigint") * 1_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def file_time(c: Column) -> Column:
    """ISO time in UTC of a count of 100 ns since 1601, null for none."""
    micros = F.floor(c / 10).cast("bigint") - F.lit(11_644_473_600_000_000)
    return F.when(c > 0, F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def safe_path(c: Column, root: str) -> Column:
    """Whether a path lies below ``root``, without parent steps, control characters or a drive."""
    below = c.startswith(root.rstrip("/") + "/")
    return F.coalesce(below & ~c.rlike(r"(^|[/\\\\])\.\.([/\\\\]|$)") & ~c.rlike(r"[\x00-\x1f]") & ~c.rlike(r"^[A-Za-z]:"), F.lit(False))
