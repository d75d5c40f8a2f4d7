"""Words, word hashes and shingles of many texts at once.

Words are runs of anything but blanks (space, tab to carriage return), with
A-Z lower-cased.  A word's 64-bit hash is the sum over its bytes of a random
value for (position, byte), so two different words share one with a chance of
about 2**-64; a shingle's hash folds its words' hashes in order.
"""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POSITIONS = 64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads each input bit over the output."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(256 * _POSITIONS, dtype=np.uint64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, the index of each text's first word (and the end), and the words' bytes."""
    coded = [t.encode() for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(coded), np.uint8)]
    begins = np.cumsum([0, *(len(c) + 1 for c in coded)])
    solid = np.flatnonzero(~_BLANK[data])
    if not len(solid):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(solid, prepend=-2) != 1)  # into solid: where words begin
    sizes = np.diff(first, append=len(solid))
    place = np.arange(len(solid)) - np.repeat(first, sizes)
    key = (place << 8) | data[solid]
    values = _VALUES[key] if sizes.max() <= _POSITIONS else np.where(place < _POSITIONS, _VALUES[np.minimum(key, len(_VALUES) - 1)], mix(key.astype(np.uint64)))
    return np.add.reduceat(values, first), np.searchsorted(solid[first], begins), sizes


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on (the last k - 1 words begin none)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = mix(words[:n])
    for j in range(1, k):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + words[j : n + j])
    return out


def shingle_sets(texts: list[str], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingle hashes of each text, and the bytes of each shingle's words.

    With fewer than k words the whole sequence is one shingle.
    """
    words, at, sizes = word_hashes(texts)
    every = shingle_hashes(words, k)
    total = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            grams, first = np.unique(every[a : b - k + 1], return_index=True)
            out.append((grams, total[a + first + k] - total[a + first]))
        elif b > a:
            out.append((shingle_hashes(words[a:b], b - a) ^ np.uint64(0x5851F42D4C957F2D * (b - a) & 0xFFFFFFFFFFFFFFFF), total[b : b + 1] - total[a]))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out
