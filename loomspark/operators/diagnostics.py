"""Contamination and failure diagnostics of a prediction against a reference, and their summaries.

Flags are 0/1 integers. A null prediction or reference counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text
from loomspark.functions.charsets import LATIN, Charset

PRIMARY = ("contamination", "truncation", "over_expansion", "suffix_drop", "number_mismatch")


def _any(x: Column, needles, absent_from: Column | None = None) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | (x.contains(n) & (~absent_from.contains(n) if absent_from is not None else F.lit(True)))
    return out


def flags(prediction: Column | str, reference: Column | str, cs: Charset = LATIN) -> dict[str, Column]:
    """Each flag as a boolean Column."""
    p, r = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in (prediction, reference))
    n, m = F.length(p), F.length(r)
    exact = p == r
    suffix_of = lambda x: (F.length(x) > 0) & (F.instr(F.lit(cs.suffixes), F.right(x, F.lit(1))) > 0)
    wanted = F.array_distinct(F.filter(F.split(r, ""), lambda c: (c != "") & (F.instr(F.lit(cs.suffixes), c) > 0)))
    numbers, numbers_r = text.signature(p, cs.numerals), text.signature(r, cs.numerals)
    sentence = _any(p, cs.punctuation)
    return {
        "exact": exact,
        "contamination": p.rlike(cs.contamination),
        "truncation": (m > 0) & (n <= F.greatest(F.lit(1), (m / 2).cast("int"))),
        "over_expansion": (m > 0) & (n >= m + 4) & (2 * n >= 3 * m),
        "suffix_drop": F.size(F.array_except(wanted, F.split(p, ""))) > 0,
        "number_mismatch": (numbers != "") & (numbers_r != "") & (numbers != numbers_r),
        "over_modernization": ~exact & (_any(p, cs.markers) | ((n >= m + 5) & ~suffix_of(p))),
        "narrativization": ~exact & (m > 0) & (n >= m + 4) & ~suffix_of(p) & (sentence | _any(p, cs.subjects, r) | _any(p, cs.narrative, r)),
        "false_specificity": _any(p, cs.terms, r),
        "substitution": ~exact & (F.length(text.common_prefix(p, r)) >= 2) & suffix_of(p) & suffix_of(r) & (F.right(p, F.lit(1)) != F.right(r, F.lit(1))),
    }


def diagnosed(df: DataFrame, prediction: str, reference: str, cs: Charset = LATIN) -> DataFrame:
    """df with a 0/1 column for each flag."""
    return df.select("*", *(v.cast("int").alias(k) for k, v in flags(prediction, reference, cs).items()))


def primary_error() -> Column:
    """The first that applies: exact, contamination, truncation, over_expansion, suffix_drop, number_mismatch, content_drift."""
    out = F.lit("content_drift")
    for name in reversed(("exact", *PRIMARY)):
        out = F.when(F.col(name) == 1, name).otherwise(out)
    return out


def all_errors() -> Column:
    """Every label that applies, in that order."""
    return F.array_compact(F.array(*(F.when(F.col(n) == 1, n) for n in PRIMARY)))


def components(prediction: Column | str, cs: Charset = LATIN) -> Column:
    """The four ways to be contaminated, as a struct of 0/1."""
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    tests = {"ascii": p.rlike("[A-Za-z]"), "angle": p.rlike("[<>]"), "unk": p.contains("[UNK]"), "artifact": p.rlike(cs.artifacts or "$^")}
    return F.struct(*(v.cast("int").alias(k) for k, v in tests.items()))


def audit(df: DataFrame, *by: str) -> DataFrame:
    """audit_flags (sum of five), flagged_rows (any of five) and n of each group of a diagnosed frame."""
    five = ["contamination", "suffix_drop", "number_mismatch", "over_expansion", "truncation"]
    total = sum((F.col(x) for x in five), F.lit(0))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(total).alias("audit_flags"), F.sum((total > 0).cast("int")).alias("flagged_rows"), *(F.sum(x).alias(x) for x in five))


def taxonomy(df: DataFrame, *by: str) -> DataFrame:
    """Counts of primary errors by group, with the sum of two of them that tables show together."""
    labels = ("exact", *PRIMARY, "content_drift")
    counts = [F.count_if(F.col("primary_error") == x).alias(x) for x in labels]
    return df.withColumn("primary_error", primary_error()).groupBy(*by).agg(*counts).withColumn("suffix_or_number", F.col("suffix_drop") + F.col("number_mismatch"))
