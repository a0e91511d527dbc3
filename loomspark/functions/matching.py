"""The matching-blocks ratio of two strings, for whole batches at once.

The longest common block of two strings is found, the earliest in the first one among equals, then in the second; so are those of
what is before and after it, and twice the characters of all blocks over those of both strings is the ratio. All open parts of
all pairs of a batch take a step together: one row of the table of common runs a character, in numpy. In a second string of
POPULAR characters or more, those that make up over one in a hundred start no block, but extend one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

POPULAR, CELLS = 200, 1 << 20


def _codes(texts: list[str], fill: int) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts), default=0)), fill, np.int32)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _starters(texts: list[str], codes: np.ndarray) -> np.ndarray:
    """Which characters of the second strings may start a block."""
    out = np.ones(codes.shape, bool)
    for k, t in enumerate(texts):
        if len(t) >= POPULAR:
            own = codes[k, : len(t)]
            _, code, times = np.unique(own, return_inverse=True, return_counts=True)
            out[k, : len(t)] = times[code] <= len(t) // 100 + 1
    return out


def _longest(a: np.ndarray, b: np.ndarray, starts: np.ndarray, part: np.ndarray) -> np.ndarray:
    """first place in a, in b, and size of the longest block of each part (pair, a's begin and end, b's begin and end)."""
    pair, alo, ahi, blo, bhi = part
    width = int((bhi - blo).max())
    at = blo[:, None] + np.arange(width)
    inside = at < bhi[:, None]
    at = np.minimum(at, b.shape[1] - 1)
    own, able = b[pair[:, None], at], inside & starts[pair[:, None], at]
    best = np.stack([alo, blo, np.zeros_like(alo)])
    run = np.zeros((len(pair), width + 1), np.int32)
    for k in range(int((ahi - alo).max())):
        i = alo + k
        same = (own == a[pair, np.minimum(i, a.shape[1] - 1)][:, None]) & able & (i < ahi)[:, None]
        run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        j = run[:, 1:].argmax(axis=1)
        size = run[np.arange(len(pair)), j + 1]
        more = size > best[2]
        best[:, more] = np.stack([i - size + 1, blo + j - size + 1, size])[:, more]
    return best


def _extended(a: str, b: str, part: tuple, best: tuple) -> tuple:
    """A block with the equal characters around it that may not start one."""
    (alo, ahi, blo, bhi), (i, j, n) = part, best
    while i > alo and j > blo and a[i - 1] == b[j - 1]:
        i, j, n = i - 1, j - 1, n + 1
    while i + n < ahi and j + n < bhi and a[i + n] == b[j + n]:
        n += 1
    return i, j, n


def _matched(a: list[str], b: list[str]) -> np.ndarray:
    """Characters in blocks of each pair."""
    ca, cb = _codes(a, -1), _codes(b, -2)
    starts, total = _starters(b, cb), np.zeros(len(a), np.int64)
    la, lb = np.array(list(map(len, a))), np.array(list(map(len, b)))
    zero = np.zeros(len(a), np.int64)
    queue = [np.stack([np.arange(len(a)), zero, la, zero, lb])[:, (la > 0) & (lb > 0)]]
    while queue:
        part = queue.pop()
        if not part.shape[1]:
            continue
        most = max(1, CELLS // int((part[4] - part[3]).max()))
        if part.shape[1] > most:
            queue += [part[:, k : k + most] for k in range(0, part.shape[1], most)]
            continue
        best = _longest(ca, cb, starts, part)
        for k in np.flatnonzero(lb[part[0]] >= POPULAR):
            p = part[0, k]
            best[:, k] = _extended(a[p], b[p], tuple(part[1:, k].tolist()), tuple(best[:, k].tolist()))
        np.add.at(total, part[0], best[2])
        found = best[2] > 0
        (pair, alo, ahi, blo, bhi), (i, j, n) = part[:, found], best[:, found]
        for more in (np.stack([pair, alo, i, blo, j]), np.stack([pair, i + n, ahi, j + n, bhi])):
            queue.append(more[:, (more[1] < more[2]) & (more[3] < more[4])])
    return total


def ratios(a: list[str], b: list[str]) -> list[float]:
    """The ratio of each pair; pairs of like length share a table."""
    order = np.argsort([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], kind="stable")
    out = np.ones(len(a))
    at = 0
    while at < len(order):
        size = max(1, len(a[order[at]]), len(b[order[at]]))
        to = at + 1
        while to < len(order) and (to - at) * max(len(a[order[to]]), len(b[order[to]])) <= CELLS and max(len(a[order[to]]), len(b[order[to]])) <= 2 * size + 16:
            to += 1
        some = order[at:to]
        own, other = [a[k] for k in some], [b[k] for k in some]
        length = np.array([len(x) + len(y) for x, y in zip(own, other, strict=True)])
        out[some] = np.where(length > 0, 2.0 * _matched(own, other) / np.maximum(length, 1), 1.0)
        at = to
    return out.tolist()


@F.pandas_udf(DoubleType())
def similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The matching-blocks ratio of two strings, once a distinct pair and batch; null if one is null."""
    for a, b in batches:
        rows = list(zip(a, b, strict=True))
        pairs = list({p for p in rows if p[0] is not None and p[1] is not None})
        known = dict(zip(pairs, ratios([x for x, _ in pairs], [y for _, y in pairs]), strict=True)) if pairs else {}
        yield pd.Series([known.get(p) for p in rows], dtype="float64")


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
