"""Word shingles of texts as 64-bit hashes, vectorised over many texts."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20_240_501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The bytes that part words.
SEPARATORS = b" \t\n\x0b\x0c\r"
_IS_SEP = np.isin(np.arange(256), np.frombuffer(SEPARATORS, np.uint8))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in a row, and how many words each text has."""
    flat = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    word = ~_IS_SEP[flat]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.append(0, edge)
    start, end = edge[::2], edge[1::2]
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths + 1)
    counts = np.diff(np.append(0, np.searchsorted(start, ends)))
    if not start.size:
        return np.zeros(0, np.uint64), counts
    size = end - start
    offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    power = np.full(int(size.max()), _BASE)
    power[0] = 1
    power = np.cumprod(power)
    h = np.add.reduceat(_BYTE[flat[word]] * power[offset], np.cumsum(size) - size)
    return mix(h + size.astype(np.uint64)), counts


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; a text of fewer words, but some, has them all as its one shingle."""
    words, counts = word_hashes(texts)
    out = []
    n = words.size - width + 1
    if n > 0:
        rolled = words[:n] * _PLACE[0]
        for k in range(1, width):
            rolled = rolled + words[k : n + k] * _PLACE[k]
        rolled = mix(rolled)
    at = 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(rolled[at : at + c - width + 1]))
        elif c:
            out.append(mix(np.array([(words[at : at + c] * _PLACE[:c]).sum(dtype=np.uint64) + np.uint64(c)])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out
