"""Code points of whole texts as numpy arrays, a bounded number at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

LETTER, UPPER, DIGIT, BLANK, SYMBOL = 1, 2, 4, 8, 16
SYMBOLS = "#*$%&|<>"  # fixed values
SLICE = 1 << 18  # code points of a text that are looked at in one go


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Class bits and lower case of every code point."""
    classes, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        sign = chr(point)
        if sign.isalpha():
            low = sign.lower()
            classes[point] = LETTER | (UPPER if sign.isupper() else 0)
            if len(low) == 1:
                lower[point] = ord(low)
        elif sign.isnumeric():
            classes[point] = DIGIT
        elif sign.isspace():
            classes[point] = BLANK
    for sign in SYMBOLS:
        classes[ord(sign)] = SYMBOL
    return classes, lower


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def slices(texts: list[str], ahead: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of whole texts laid end to end, long texts in several runs.

    Yields (code points, start of each piece, its own length, its text's number); a piece
    is followed by up to ``ahead`` further code points of its text and then by one zero
    for each that is missing, so windows that start in a piece can be formed in full.
    """
    held: list[np.ndarray] = []
    rows: list[tuple[int, int, int]] = []
    at = 0
    tail = np.zeros(ahead, np.uint32)
    for number, text in enumerate(texts):
        for start in range(0, max(len(text), 1), SLICE):
            own = min(SLICE, len(text) - start)
            piece = points(text[start : start + own + ahead])
            held += [piece, tail[: own + ahead - len(piece)]]
            rows.append((at, own, number))
            at += own + ahead
            if at >= SLICE:
                yield np.concatenate(held), *np.array(rows, dtype=np.int64).T
                held, rows, at = [], [], 0
    if rows:
        yield np.concatenate(held), *np.array(rows, dtype=np.int64).T


def sums(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of ``values[start : start + length]`` for each piece; zero for an empty one."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[starts + lengths] - total[starts]
