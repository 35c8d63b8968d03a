"""Texts as arrays of code points, for operators that hash n-grams in bulk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_CHARS = 1_000_000
SLICE_TEXTS = 1 << 16


def slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of about `SLICE_CHARS` characters together, whole,
    and `SLICE_TEXTS` of them at most.

    Gives the number of the first text and the texts; one longer text stands
    alone. Keeps the arrays made from a batch small.
    """
    at, size = 0, 0
    for i, text in enumerate(texts):
        if i > at and (size + len(text) > SLICE_CHARS or i - at == SLICE_TEXTS):
            yield at, texts[at:i]
            at, size = i, 0
        size += len(text) + 1
    if at < len(texts):
        yield at, texts[at:]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letter_table() -> np.ndarray:
    """For each code point: is it a letter?"""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
