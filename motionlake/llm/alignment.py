"""Local alignment of word-hash sequences, one numpy pass for each word of the shorter side."""

from __future__ import annotations

import numpy as np

#: Scores of a matching word, a differing word, and a word on one side only.
MATCH, MISMATCH, GAP = 2, -1, -1
_SCORE, _HITS = 44, 24
_START = (1 << _HITS) - 1


def local_alignment(item: np.ndarray, text: np.ndarray, diagonal: int | None = None, band: int = 0) -> tuple[int, int, int, int]:
    """(score, matched words, start, end) of the best Smith-Waterman alignment; text[start:end] takes part.

    With ``diagonal`` only cells whose text position is within ``band`` of item position + diagonal
    count.  Score, matches and start of an alignment travel in one integer, so that a maximum picks
    the best score, then the most matches, then the latest start; of equal ends the first is taken.
    """
    if diagonal is not None:
        lo = max(0, diagonal - band)
        part = text[lo : max(lo, diagonal + len(item) + band)]
        score, hits, start, end = _rows(item, part, diagonal - lo, band)
        return score, hits, start + lo, end + lo
    return _rows(item, text, None, 0)


def _rows(item, text, diagonal, band):
    n = len(text)
    if not n or not len(item):
        return 0, 0, 0, 0
    fresh = np.arange(n + 1, dtype=np.int64)
    step = np.arange(n + 1, dtype=np.int64) * (-GAP << _SCORE)
    hit = (MATCH << _SCORE) + (1 << _HITS)
    prev, best = fresh.copy(), (0, 0)
    for k, word in enumerate(item):
        now = fresh.copy()
        np.maximum(now[1:], prev[:-1] + np.where(text == word, hit, MISMATCH << _SCORE), out=now[1:])
        np.maximum(now, prev + (GAP << _SCORE), out=now)
        if diagonal is not None:  # outside the band an alignment can only begin
            now[: max(0, k + diagonal - band)] = fresh[: max(0, k + diagonal - band)]
            now[k + diagonal + band + 2 :] = fresh[k + diagonal + band + 2 :]
        now = np.maximum(np.maximum.accumulate(now + step) - step, fresh)
        at = int(np.argmax(now >> _HITS))
        if now[at] >> _HITS > best[0] >> _HITS:
            best = int(now[at]), at
        prev = now
    value, end = best
    return value >> _SCORE, value >> _HITS & (1 << _SCORE - _HITS) - 1, value & _START, end


class GramIndex:
    """Inverted index from n-gram hashes to (item, position), looked up for whole arrays."""

    def __init__(self, grams: np.ndarray, items: np.ndarray, places: np.ndarray):
        order = np.argsort(grams, kind="stable")
        self.items, self.places = items[order], places[order]
        self.keys, self.first = np.unique(grams[order], return_index=True)
        self.last = np.append(self.first[1:], len(grams))
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[self.keys >> np.uint64(42)] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``grams`` of those that the index has, and which key each is."""
        at = np.flatnonzero(self.bits[grams >> np.uint64(42)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        key = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        same = self.keys[key] == grams[at]
        return at[same], key[same]

    def expand(self, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, place) for each entry under each key found."""
        count = self.last[key] - self.first[key]
        entry = np.repeat(self.first[key] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.repeat(at, count), self.items[entry], self.places[entry]


def code_points(data: np.ndarray, places: list[int]) -> list[int]:
    """Code points before each byte place of one UTF-8 text; places must rise."""
    out, done, total = [], 0, 0
    for p in places:
        total += int(np.count_nonzero(data[done:p] & 0xC0 != 0x80))
        done = p
        out.append(total)
    return out
