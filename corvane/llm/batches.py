"""Slices of a batch with a bounded number of characters."""

from __future__ import annotations

from collections.abc import Iterator

CHARACTERS = 2_000_000


def slices(texts: list[str], rows: int = 1000, characters: int = CHARACTERS) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of at most `rows` texts and about `characters` characters; a longer text has a slice of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and (i - start >= rows or total + n > characters):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)
