"""Compound files (the container of older Office documents and Outlook messages), read from their published layout.

The container is a small file system: a header, an allocation table of sectors, a directory of streams, and a second table for
streams under 4,096 bytes. Property sets and message properties are streams of fixed binary layout.
"""

from __future__ import annotations

import re
import struct
from datetime import UTC, datetime, timedelta

MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
FREE = 0xFFFFFFFA  # chain ends and marks are at or above it
#: Property numbers of the summary, and message properties (tag of the stream) with their labels.
SUMMARY = {2: "title", 3: "subject", 4: "creator", 5: "keywords", 6: "comments", 8: "last_modified_by", 12: "created", 13: "modified", 18: "application"}
DOCUMENT_SUMMARY = {14: "manager", 15: "company"}
MESSAGE = {"0037": "Subject", "0C1A": "From", "0C1F": "From-Address", "0E04": "To", "0E03": "Cc", "007D": "Headers", "1000": "Body"}


def chain(start: int, table: list[int]) -> list[int]:
    """Sectors of a stream in order; a circle in a broken table ends it."""
    out, seen = [], set()
    while start < FREE and start < len(table) and start not in seen:
        seen.add(start)
        out.append(start)
        start = table[start]
    return out


def streams(raw: bytes) -> dict[str, bytes]:
    """Streams by their path of names."""
    if not raw.startswith(MAGIC) or len(raw) < 512:
        raise ValueError("not a compound file")
    sector_bits, mini_bits = struct.unpack_from("<HH", raw, 30)
    directory, cutoff, mini_start, difat_start = struct.unpack_from("<I4xII4xI", raw, 48)
    size, mini_size = 1 << sector_bits, 1 << mini_bits
    sector = lambda n: raw[512 + n * size if size == 512 else (n + 1) * size :][:size]
    tables = list(struct.unpack_from("<109I", raw, 76))
    visited: set[int] = set()
    while difat_start < FREE and difat_start not in visited:
        visited.add(difat_start)
        more = struct.unpack(f"<{size // 4}I", sector(difat_start).ljust(size, b"\xff"))
        tables += more[:-1]
        difat_start = more[-1]
    table: list[int] = []
    for n in tables:
        if n < FREE:
            table += struct.unpack(f"<{size // 4}I", sector(n).ljust(size, b"\xff"))
    whole = lambda start: b"".join(sector(n) for n in chain(start, table))
    mini_table_raw = whole(mini_start)
    mini_table = list(struct.unpack(f"<{len(mini_table_raw) // 4}I", mini_table_raw[: len(mini_table_raw) // 4 * 4]))
    entries = []
    listing = whole(directory)
    for at in range(0, len(listing) - 127, 128):
        length, kind, left, right, child = struct.unpack_from("<HBxIII", listing, at + 64)
        start, stream_size = struct.unpack_from("<II", listing, at + 116)
        entries.append((listing[at : at + max(0, min(length, 64) - 2)].decode("utf-16-le", "replace"), kind, left, right, child, start, stream_size))
    if not entries:
        return {}
    mini = whole(entries[0][5])
    out: dict[str, bytes] = {}
    todo, met = [(entries[0][4], "")], set()
    while todo:
        n, folder = todo.pop()
        if n >= len(entries) or n in met:
            continue
        met.add(n)
        name, kind, left, right, child, start, stream_size = entries[n]
        todo += [(left, folder), (right, folder)]
        if kind == 1:
            todo.append((child, f"{folder}{name}/"))
        elif kind == 2:
            small = stream_size < cutoff
            data = b"".join(mini[k * mini_size : (k + 1) * mini_size] for k in chain(start, mini_table)) if small else whole(start)
            out[folder + name] = data[:stream_size]
    return out


def file_time(ticks: int) -> str | None:
    """ISO time of a count of 100 ns since 1601, null for none."""
    if not 0 < ticks < 2_650_467_744_000_000_000:
        return None
    return (datetime(1601, 1, 1, tzinfo=UTC) + timedelta(microseconds=ticks // 10)).strftime("%Y-%m-%dT%H:%M:%SZ")


def properties(raw: bytes, names: dict[int, str]) -> dict[str, str]:
    """Strings, numbers and times of the first section of a property set."""
    out: dict[str, str] = {}
    if len(raw) < 48:
        return out
    base = struct.unpack_from("<I", raw, 44)[0]
    count = struct.unpack_from("<I", raw, base + 4)[0] if base + 8 <= len(raw) else 0
    where = dict(struct.unpack_from("<II", raw, base + 8 + 8 * i) for i in range(min(count, 1000)) if base + 16 + 8 * i <= len(raw))
    codec = "cp1252"
    if 1 in where and base + where[1] + 6 <= len(raw):
        page = struct.unpack_from("<H", raw, base + where[1] + 4)[0]
        codec = {65001: "utf-8", 1200: "utf-16-le"}.get(page, f"cp{page}")
    for number, name in names.items():
        at = base + where.get(number, len(raw))
        if at + 8 > len(raw):
            continue
        kind, value = struct.unpack_from("<II", raw, at)
        try:
            if kind == 30:
                text = raw[at + 8 : at + 8 + value].decode(codec, "replace").rstrip("\0")
            elif kind == 31:
                text = raw[at + 8 : at + 8 + 2 * value].decode("utf-16-le", "replace").rstrip("\0")
            elif kind == 64 and at + 12 <= len(raw):
                text = file_time(struct.unpack_from("<Q", raw, at + 4)[0])
            else:
                text = str(value) if kind in (2, 3) else None
        except LookupError:
            text = raw[at + 8 : at + 8 + value].decode("latin-1").rstrip("\0")
        if text:
            out[name] = text
    return out


def summary(parts: dict[str, bytes]) -> dict[str, str]:
    """Document properties of a compound file."""
    return properties(parts.get("\x05SummaryInformation", b""), SUMMARY) | properties(parts.get("\x05DocumentSummaryInformation", b""), DOCUMENT_SUMMARY)


def message(parts: dict[str, bytes]) -> str:
    """An Outlook message as labelled lines, with the names of its attachments."""
    lines = []
    for tag, label in MESSAGE.items():
        text = parts[f"__substg1.0_{tag}001F"].decode("utf-16-le", "replace") if f"__substg1.0_{tag}001F" in parts else parts.get(f"__substg1.0_{tag}001E", b"").decode("cp1252", "replace")
        text = text.rstrip("\0")
        if text:
            lines.append(text if label == "Body" else f"{label}: {text}")
    names = [v.decode("utf-16-le", "replace").rstrip("\0") for k, v in sorted(parts.items()) if re.fullmatch(r"__attach[^/]*/__substg1\.0_3707001F", k)]
    return "\n".join([*lines, *(f"Attachment: {n}" for n in names)])


def words_of(raw: bytes) -> str:
    """Runs of text in a binary stream, of one or two bytes a character."""
    wide = [m.group().decode("utf-16-le") for m in re.finditer(rb"(?:[\x20-\x7e\xa0-\xff\r\n\t]\x00|[\x10-\xff][\x03\x04]){6,}", raw)]
    narrow = [m.group().decode("cp1252", "replace") for m in re.finditer(rb"[\x20-\x7e\xa0-\xff\r\n\t]{8,}", raw)]
    return "\n".join(max((wide, narrow), key=lambda x: sum(map(len, x)))).replace("\r", "\n")
