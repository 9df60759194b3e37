"""Word and shingle hashes of texts in numpy, for tasks that work on Arrow batches.

Words are runs without blank or the controls 9 to 13, as ``bytes.split`` takes them.
Hashes are 64-bit and depend on the bytes of the words alone.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype="u8") | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_POWERS = {"p": np.ones(1, dtype="u8")}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    if len(_POWERS["p"]) < n:
        with np.errstate(over="ignore"):
            full = np.full(max(n, 256), _BASE, dtype="u8")
            full[0] = 1
            _POWERS["p"] = np.multiply.accumulate(full)
    return _POWERS["p"]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes as an array, and where words start and end."""
    raw = np.frombuffer(data, dtype="u1")
    inside = np.concatenate(([False], ~_BLANK[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return raw, edges[0::2], edges[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each word of a text in order."""
    raw, starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, dtype="u8")
    lengths = ends - starts
    place = np.arange(len(raw)) - np.repeat(
        np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(raw)])))
    )
    with np.errstate(over="ignore"):
        value = _BYTE[raw] * _powers(int(place.max()) + 1)[place]
        value[_BLANK[raw]] = 0
        total = np.add.reduceat(value, starts)
        return mix(total + lengths.astype("u8") * _STEP)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` consecutive words; none where there are fewer."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype="u8")
    with np.errstate(over="ignore"):
        total = np.zeros(count, dtype="u8")
        for k in range(n):
            total = total * _BASE + words[k : k + count]
        return mix(total + np.uint64(n))


def shingle_set(text: str, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's ``n``-word shingles, A-Z lower-cased.

    A text of fewer words has one shingle, all of it; one without words has none.
    """
    words = word_hashes(text.encode("utf-8", "replace").lower())
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(n, len(words))))
