"""Vectorised 64-bit hashes of words, lines and n-grams over the bytes of many texts at once.

A substring's hash is a difference of prefix sums of ``table[byte] * base**position`` (modulo 2**64),
shifted back by a power of the base's inverse and mixed. Equal strings have equal hashes; different
ones collide with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20260101).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Keys that ``repeated`` counts at once.
BLOCK = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    known = _POWERS.get(name)
    if known is None or len(known) < n:
        size = 1 << max(16, (n - 1).bit_length())
        known = np.full(size, base, U64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if size <= 1 << 20:
            _POWERS[name] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Prefix:
    """Prefix sums over data; ``span(a, b)`` hashes data[a:b] for arrays a, b."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_TABLE[data] * _powers("base", BASE, len(data)), dtype=U64, out=self.sums[1:])
        self.back = _powers("inverse", INVERSE, len(data) + 1)

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(U64))


def separators(codes: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


#: Words are runs of anything but space and the controls 0x09-0x0D.
BLANK = separators(b"\x20\x09\x0a\x0b\x0c\x0d")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, at: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of its text; texts are data[at[i]:at[i + 1]]."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~blank[data]
    start = inside[:-1].copy()
    start[1:] &= ~inside[:-2]
    cut = at[:-1][np.diff(at) > 0]
    start[cut] = inside[cut]
    end = inside[:-1].copy()
    end[:-1] &= ~inside[1:-1]
    last = at[1:][np.diff(at) > 0] - 1
    end[last] = inside[last]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    return a, b, np.searchsorted(at, a, side="right") - 1


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of each n consecutive hashes; windows may cross texts, the caller masks those."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for k in range(n):
        out *= BASE
        out += hashes[k : k + m]
    return mix(out + U64(n))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more: a table of counts by low bits leaves few to sort."""
    n = len(keys)
    if n < 2:
        return np.zeros(n, bool)
    size = 1 << max(8, (4 * n - 1).bit_length())
    if n <= BLOCK:
        slot = (keys & U64(size - 1)).astype(np.int64)
        maybe = np.flatnonzero(np.bincount(slot)[slot] > 1)
    else:  # two bits' worth of a count, a block at a time
        once, twice = np.zeros(size, bool), np.zeros(size, bool)
        for a in range(0, n, BLOCK):
            slot = np.sort(keys[a : a + BLOCK] & U64(size - 1))
            twice[slot[1:][slot[1:] == slot[:-1]]] = True
            twice[slot[once[slot]]] = True
            once[slot] = True
        maybe = np.concatenate([a + np.flatnonzero(twice[keys[a : a + BLOCK] & U64(size - 1)]) for a in range(0, n, BLOCK)])
    out = np.zeros(n, bool)
    if len(maybe):
        own = keys[maybe]
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        out[maybe[order[1:][same]]] = True
        out[maybe[order[:-1][same]]] = True
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands before."""
    out = np.zeros(len(keys), bool)
    maybe = np.flatnonzero(repeated(keys))
    if len(maybe):
        order = np.argsort(keys[maybe], kind="stable")
        sorted_ = keys[maybe][order]
        out[maybe[order[1:][sorted_[1:] == sorted_[:-1]]]] = True
    return out


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of flags over data[at[i]:at[i + 1]]."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]
