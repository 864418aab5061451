"""Ids of many pieces of text, each distinct piece encoded once in a while."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions ``start .. start + count - 1`` of every range, after each other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


class PieceTable:
    """Ids by piece. Forgets all pieces when ``limit`` of them are known.

    ``encode`` gets distinct pieces and returns their ids after each other and
    the number of ids of each.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
                 limit: int = 200_000):
        self._encode, self._limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self._place: dict[str, int] = {}
        self._ids, self._starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces after each other, and the number of each piece's ids."""
        if len(self._place) > self._limit:
            self._clear()
        place = self._place
        new = [p for p in set(pieces) if p not in place]
        if new:
            ids, counts = self._encode(new)
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
            self._starts = np.concatenate([self._starts,
                                           self._starts[-1] + np.cumsum(counts)])
            self._ids = np.concatenate([self._ids, ids.astype(np.int32)])
        at = np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))
        starts = self._starts[at]
        counts = self._starts[at + 1] - starts
        return self._ids[ranges(starts, counts)], counts
