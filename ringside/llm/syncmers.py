"""Document fingerprints from closed syncmers.

A window of K characters is chosen if the least hash among its substrings of S characters stands at
its first or last place. The choice depends on the window alone, so an edit elsewhere never moves
an anchor. A fingerprint holds every anchor, by hash, with the first place of each; anchors of
two texts match if their hashes agree and their shift is about the usual shift of the pair.
"""
from __future__ import annotations

import numpy as np

from ringside.llm.common import mixed

K, S = 16, 8  # K = 2 S: a window's hash comes from those of its halves
#: Anchors of smallest hash that a fingerprint keeps: None, all of them, whatever the length.
SAMPLE = None
#: An anchor may be off the usual shift by this share of the longer text.
DRIFT = 0.125
_M = 0x9E3779B97F4A7C15 | 1


def _halves(x: np.ndarray, width: int) -> np.ndarray:
    """Hashes of 2 width characters from those of width characters."""
    return x[:-width] * np.uint64(pow(_M, width, 2**64)) + x[width:]


def anchors(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the hashes (32 bits, ascending) and first places of its anchors."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    points = mixed(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64))
    empty = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    out = [empty] * len(texts)
    for i in np.flatnonzero((lengths > 0) & (lengths < K)):  # one anchor: the text itself
        whole = np.uint64(lengths[i])
        with np.errstate(over="ignore"):
            for p in points[starts[i]:starts[i] + lengths[i]]:
                whole = whole * np.uint64(_M) + p
        out[i] = (mixed(np.array([whole])) >> np.uint64(32)).astype(np.uint32), np.zeros(1, np.int64)
    if len(points) < K:
        return out
    eight = _halves(_halves(_halves(points, 1), 2), 4)
    order = mixed(eight)
    two = np.minimum(order[:-1], order[1:])
    four = np.minimum(two[:-2], two[2:])
    least = np.minimum(four[:-4], four[4:])
    least = np.minimum(least[:-1], least[1:])  # over K - S + 1 = 9 substrings
    chosen = (order[:len(least)] == least) | (order[K - S:] == least)
    for i in range(1, K):  # windows that reach into the next text
        edge = starts + lengths - i
        edge = edge[(edge >= 0) & (edge < len(chosen))]
        chosen[edge] = False
    place = np.flatnonzero(chosen)
    windows = eight[place] * np.uint64(pow(_M, S, 2**64)) + eight[place + S]
    hashes = (mixed(windows) >> np.uint64(32)).astype(np.uint32)
    first = np.searchsorted(place, np.append(starts, len(points)))
    for i in np.flatnonzero(np.diff(first)):
        mine = slice(first[i], first[i + 1])
        # hash and place in one number, sorted: the first of a hash has its first place
        both = np.sort(hashes[mine].astype(np.uint64) << np.uint64(32) | (place[mine] - starts[i]).astype(np.uint64))
        h = (both >> np.uint64(32)).astype(np.uint32)
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        out[i] = h[new][:SAMPLE], (both[new] & np.uint64(2**32 - 1)).astype(np.int64)[:SAMPLE]
    return out


_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


def written(text_length: int, hashes: np.ndarray, places: np.ndarray) -> str:
    """A fingerprint as text: the length, then hash.place of each anchor in hexadecimal."""
    if not len(hashes):
        return f"{text_length:x}"
    wide = max(1, (int(places.max()).bit_length() + 3) // 4)
    digits = np.empty((len(hashes), 10 + wide), np.uint8)  # space, hash, point, place with its leading zeros
    digits[:, 0], digits[:, 9] = ord(" "), ord(".")
    for k in range(8):
        digits[:, 1 + k] = _DIGITS[(hashes >> np.uint32(28 - 4 * k)) & np.uint32(15)]
    kept = np.ones(digits.shape, bool)
    for k in range(wide):
        rest = places >> (4 * (wide - 1 - k))
        digits[:, 10 + k] = _DIGITS[rest & 15]
        if k + 1 < wide:
            kept[:, 10 + k] = rest > 0
    return f"{text_length:x}" + digits[kept].tobytes().decode("ascii")


def parsed(fingerprint: str) -> tuple[int, dict[int, int]]:
    length, *pairs = fingerprint.split(" ")
    return int(length, 16), {int(p[:8], 16): int(p[9:], 16) for p in pairs}


def likeness(a: tuple[int, dict[int, int]], b: tuple[int, dict[int, int]]) -> float:
    """`alike` for parsed fingerprints."""
    def arrays(anchors: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        pairs = sorted(anchors.items())
        return np.array([h for h, _ in pairs], np.uint32), np.array([p for _, p in pairs], np.int64)
    return alike(a[0], *arrays(a[1]), b[0], *arrays(b[1]))


def alike(n: int, own: np.ndarray, places: np.ndarray, m: int, other: np.ndarray, others: np.ndarray) -> float:
    """Share of the anchors of both texts together that both have at matching places, 0 to 1: the Jaccard similarity
    of the anchor sets but for anchors that moved against the others.

    Texts without anchors are alike only if both have none. n and m are the texts' lengths, hashes ascend.
    """
    if not len(own) or not len(other):
        return float(not len(own) and not len(other))
    at = np.minimum(np.searchsorted(other, own), len(other) - 1)
    met = other[at] == own
    shifts = places[met] - others[at[met]]
    if not len(shifts):
        return 0.0
    usual, free = np.partition(shifts, len(shifts) // 2)[len(shifts) // 2], max(n, m) * DRIFT
    return int((np.abs(shifts - usual) <= free).sum()) / (len(own) + len(other) - len(shifts))
