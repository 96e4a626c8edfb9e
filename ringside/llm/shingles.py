"""Word shingles of texts as 64-bit hashes, computed for a block of texts at once."""
from __future__ import annotations

import numpy as np

from ringside.llm.common import mixed, random_words

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
STEP = 0xD6E8FEB86659FD93 | 1
#: Bytes whose word hashes are computed at once.
CHUNK = 1 << 18
_BYTE = random_words(256, 11)
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n + 1:
        for i, base in enumerate((BASE, INVERSE)):
            row = np.full(n + 1, base, np.uint64)
            row[0] = 1
            _POWERS[i] = np.cumprod(row)
    return _POWERS


def _word_hashes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word; a hash depends on the word's bytes alone."""
    edges = np.diff(np.concatenate([[True], _IS_WHITE[symbols], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, side="right")))
        lo, hi = int(starts[at]), int(ends[stop - 1])
        up, down = _powers(hi - lo)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[symbols[lo:hi]] * down[:hi - lo])])
        s, e = starts[at:stop] - lo, ends[at:stop] - lo
        out[at:stop] = mixed((sums[e] - sums[s]) * up[s] + (e - s).astype(np.uint64))
        at = stop
    return out, starts


def shingle_sets(texts: list[bytes], words: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles, ascending, and how often each occurs.

    Words are lower-cased runs of characters that aren't white space. A text of fewer words than a
    shingle has one shingle of all its words; a text without words has none.
    """
    lowered = [t.lower() if t.isascii() else t.decode("utf-8", "replace").lower().encode("utf-8") for t in texts]
    first = np.cumsum([0] + [len(t) + 1 for t in lowered])
    hashes, starts = _word_hashes(np.frombuffer(b" ".join(lowered), np.uint8))
    own = np.searchsorted(starts, first[:-1])  # each text's first word
    bounds = np.append(own, len(starts))
    rolled = hashes.copy()
    step = np.uint64(STEP)
    for j in range(1, words):
        rolled[:len(hashes) - j] = rolled[:len(hashes) - j] * step + hashes[j:]
    rolled = mixed(rolled)
    out = []
    for lo, hi in zip(bounds, bounds[1:]):
        n = int(hi - lo)
        if n >= words:
            out.append(np.unique(rolled[lo:hi - words + 1], return_counts=True))
        elif n:
            whole = np.full(1, n, np.uint64)
            for h in hashes[lo:hi]:
                whole = whole * step + h
            out.append((mixed(whole), np.ones(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two ascending sets; two empty sets are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return shared / (len(a) + len(b) - shared)
