"""Intervals, resampling of few rows, and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpora import number


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Low and high end, in 0..1; 0 and 0 for no rows."""
    p, z2 = k / n, z * z
    middle, spread = p + z2 / (2 * n), z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)
    end = lambda s: F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (middle + s * spread) / (1 + z2 / n))))
    return end(-1), end(1)


def bootstrap(rows: DataFrame, columns: Sequence[str], resamples: int, n: int, seed: str = "42", by: str | None = None) -> DataFrame:
    """sample (and by), sums of columns over resamples of the n rows with idx 0..n-1; the draws are shared by the groups.

    Rows hold additive statistics, so a sample is a sum: a row's weight in a sample is the count of draws that hit it.
    """
    spark = rows.sparkSession
    draws = spark.range(resamples * n).select((F.col("id") / n).cast("long").alias("sample"), (F.col("id") % n).alias("draw"))
    weights = draws.select("sample", (number(seed, "sample", "draw") % n).alias("idx")).groupBy("sample", "idx").agg(F.count("*").alias("w"))
    keys = ["sample", by] if by else ["sample"]
    return weights.join(rows, "idx").groupBy(*keys).agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in columns))


def unit(x: Column | str) -> Column:
    """A vector over its L2 norm + 1e-8."""
    x = F.col(x) if isinstance(x, str) else x
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return F.transform(x, lambda v: v.cast("double") / (norm + 1e-8))


def mean_pooled(tokens: Column | str, mask: Column | str) -> Column:
    """The mean of the token vectors whose mask is not 0, over their number + 1e-8; zeros where none is."""
    tokens, mask = (F.col(x) if isinstance(x, str) else x for x in (tokens, mask))
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda z: z["m"] != 0), lambda z: z["t"])
    zero = F.transform(F.get(tokens, F.lit(0)), lambda v: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda a, v: F.zip_with(a, v, lambda p, q: p + q.cast("double")))
    return F.transform(total, lambda v: v / (F.size(kept) + 1e-8))
