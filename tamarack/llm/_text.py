"""Plain functions over texts for Python workers; they import nothing of Spark."""

from __future__ import annotations

from collections.abc import Iterator


def pieces(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """data in parts of about ``size`` bytes that end where a word (or data) does."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end]
        at = end


def sliced(batches, rows: int = 512) -> Iterator:
    """The batches in slices of up to ``rows`` rows, so no more texts than that are Python objects at a time."""
    for b in batches:
        for at in range(0, max(1, b.num_rows), rows):
            yield b.slice(at, rows)


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def word_count(text: str | None) -> int:
    """Words between ASCII white space."""
    return sum(len(p.split()) for p in pieces(utf8(text)))
