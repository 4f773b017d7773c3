"""The two word definitions of this subpackage, on UTF-8 bytes, and word hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
_SPACES = bytes(_LOWER.get(c, c) for c in range(256))
_ALNUM = bytes(
    _LOWER.get(c, c) if c >= 0x80 or 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)


def space_words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z; words are runs of anything but space and U+0009 to U+000D."""
    return text.encode("utf-8", "surrogatepass").translate(_SPACES).split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z; words are runs of 0-9, a-z and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split() if text else []


class WordHashes(dict):
    """word -> signed 64-bit hash, the same in every process; holds ``most`` words at the most."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        h = h - (1 << 64) if h >= 1 << 63 else h
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


_P = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_BREAKS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the hash's multiplier and of its inverse, so many at least."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, _INVERSE)):
            steps = np.full(2 * n, base)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def space_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each of the text's space_words, without making the words.

    Differences of a running polynomial over the bytes, brought back to a word's start.
    """
    if not text:
        return np.empty(0, np.uint64)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_SPACES), np.uint8)
    power, inverse = _powers_to(len(data) + 1)
    gaps = np.concatenate([[True], _BREAKS[data], [True]])
    edges = np.flatnonzero(gaps[1:] != gaps[:-1])
    starts, ends = edges[::2], edges[1::2]
    total = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * power[: len(data)])])
    return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(31)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _MIX
    return h ^ (h >> _SHIFT)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order; none if there are fewer words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out *= _ODD
        out += words[i : i + m]
        out ^= out >> _SHIFT
    return mixed(out)
