"""Helpers for kernels that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


def spans(sizes: Sequence[int | None], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes add up to at most ``limit``, or of a single larger row."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + (n or 0) > limit:
            yield start, i
            start, total = i, 0
        total += n or 0
    if start < len(sizes):
        yield start, len(sizes)
