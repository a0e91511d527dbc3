"""chrF++: 24 additive counts a pair of texts, and the score as a function of summed counts.

For each of 8 orders (characters 1-6 without white space, words 1-2) the counts are: n-grams of the hypothesis (0 if the
reference has none of that order), of the reference, and common ones. Sums of counts over rows score a corpus, so
resampling never has to look at text again.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

CHARS, WORDS, BETA = 6, 2, 2
ORDERS = CHARS + WORDS
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words(text: str) -> list[str]:
    """Words; one mark at the end, else one at the start, is a word of its own."""
    out: list[str] = []
    for w in text.split():
        if len(w) > 1 and w[-1] in MARKS:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in MARKS:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def grams(text: str) -> tuple[Counter, list[int]]:
    """All n-grams of a text, counted (a word has a blank before, two have one between), and how many there are of each order."""
    chars, ws = "".join(text.split()), words(text)
    n = len(chars)
    keys = [chars[i : i + k] for k in range(1, CHARS + 1) for i in range(n - k + 1)]
    keys += [" " + w for w in ws]
    keys += [a + " " + b for a, b in pairwise(ws)]
    return Counter(keys), [max(0, n - k) for k in range(CHARS)] + [max(0, len(ws) - k) for k in range(WORDS)]


def common(h: Counter, r: Counter) -> list[int]:
    """n-grams in common, by order."""
    out = [0] * ORDERS
    for g in h.keys() & r.keys():
        order = len(g) - 1 if " " not in g else CHARS if g[0] == " " else CHARS + 1
        out[order] += min(h[g], r[g])
    return out


def counts(hypothesis: str, reference: str, known=grams) -> list[int]:
    """Hypothesis, reference and common counts of each order, one order after the other."""
    (h, hs), (r, rs) = known(hypothesis), known(reference)
    return [x for n, m, c in zip(hs, rs, common(h, r), strict=True) for x in (n if m else 0, m, c)]


def _value(hs: list[int], rs: list[int], c: list[int]) -> float:
    used = [(n, m, x) for n, m, x in zip(hs, rs, c, strict=True) if n and m]
    p, r = sum(x / n for n, _, x in used), sum(x / m for _, m, x in used)
    if not used or p + r <= 0:
        return 0.0
    p, r = p / len(used), r / len(used)
    return 100 * (1 + BETA**2) * p * r / (BETA**2 * p + r)


#: n-grams that a task remembers at once.
HELD = 1 << 20


def _remembered():
    """n-grams of a task's texts; of those met lately, HELD n-grams at most, each text is counted once."""
    known: dict[str, tuple[Counter, list[int]]] = {}
    held = 0

    def of(text: str):
        nonlocal held
        if text not in known:
            own = grams(text)
            held += len(own[0]) + 1
            if held > HELD:
                known.clear()
                held = len(own[0]) + 1
            known[text] = own
        return known[text]

    return of


@F.pandas_udf(ArrayType(IntegerType()))
def stats(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The 24 counts of (hypothesis, reference); null counts as empty."""
    known = _remembered()
    for h, r in batches:
        yield pd.Series([counts(x or "", y or "", known) for x, y in zip(h, r, strict=True)])


@F.pandas_udf(ArrayType(DoubleType()))
def pool_means(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Of an array of texts: the mean chrF++ of each against each of the others; 100 for one alone."""
    known = _remembered()
    for pools in batches:
        out = []
        for pool in pools:
            n = len(pool)
            own, total = [known(x) for x in pool], [0.0] * n
            for i in range(n):
                for j in range(i):
                    c = common(own[i][0], own[j][0])
                    total[i] += _value(own[i][1], own[j][1], c)
                    total[j] += _value(own[j][1], own[i][1], c)
            out.append([x / (n - 1) for x in total] if n > 1 else [100.0] * n)
        yield pd.Series(out)


def summed(column: str = "stats") -> list[Column]:
    """Aggregates s0..s23 of an array column of counts."""
    return [F.sum(F.get(F.col(column), F.lit(k))).alias(f"s{k}") for k in range(3 * ORDERS)]


def score(at) -> Column:
    """The score, 0 to 100, of counts that at(k) gives as columns."""
    precision, recall, used = F.lit(0.0), F.lit(0.0), F.lit(0)
    for order in range(ORDERS):
        h, r, m = (at(3 * order + k) for k in range(3))
        on = (h > 0) & (r > 0)
        precision += F.when(on, m / h).otherwise(0.0)
        recall += F.when(on, m / r).otherwise(0.0)
        used += F.when(on, 1).otherwise(0)
    p, r = precision / used, recall / used
    f = 100 * (1 + BETA**2) * p * r / (BETA**2 * p + r)
    return F.when((used > 0) & (precision + recall > 0), f).otherwise(0.0)


def of_array(column: str = "stats") -> Column:
    return score(lambda k: F.get(F.col(column), F.lit(k)))


def of_sums() -> Column:
    return score(lambda k: F.col(f"s{k}"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
