"""Batches of texts of bounded size, whatever the length of single texts."""

from __future__ import annotations

BATCH_ROWS, BATCH_BYTES = 4096, 4_000_000  # worked on at a time; a longer text is a batch of its own, whole


def slices(sizes: list[int]) -> list[tuple[int, int]]:
    """Runs (start, length) of rows of at most BATCH_ROWS rows and, but for a single row, BATCH_BYTES bytes."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > BATCH_BYTES or i - start >= BATCH_ROWS):
            out.append((start, i - start))
            start, total = i, 0
        total += n
    return [*out, (start, len(sizes) - start)] if sizes else out
