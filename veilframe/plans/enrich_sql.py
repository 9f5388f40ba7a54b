"""Pieces of oracle SQL that several modules of queries use."""

from __future__ import annotations


def hmac_sql(message: str, key: bytes) -> str:
    """HMAC-SHA256 of a string expression from two plain hashes."""
    block = key.ljust(64, b"\0")
    inner, outer = (bytes(x ^ pad for x in block).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"
