"""Pieces of bytes for the operators that read words from whole texts."""

from __future__ import annotations

from collections.abc import Iterator


def slices(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` in parts of about ``size`` bytes that end at a space, so that a very long text is never one list of words."""
    lo = 0
    while lo < len(data):
        hi = data.find(b" ", lo + size)
        hi = len(data) if hi < 0 else hi
        yield data[lo:hi]
        lo = hi
