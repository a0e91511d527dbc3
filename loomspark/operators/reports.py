"""Tables of reports: split summaries, perplexities, suffix preservation, ratios to an anchor system, training mixes in random order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .corpora import finite, ranked, upsampled


def split_report(rows: DataFrame, split: str, text: str, order: str, examples: int = 5) -> DataFrame:
    """split, n, lengths (array of length and count, by length) and the first examples of each split, by order. Histograms are summed before they meet."""
    lengths = rows.groupBy(split, F.length(text).alias("length")).agg(F.count("*").alias("n"))
    lengths = lengths.groupBy(split).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("length", F.col("n").alias("times")))).alias("lengths"))
    # A few rows of each split and hash block first, so that no task gathers a split.
    pair = F.struct(F.col(order).alias("at"), F.col(text).alias("text"))
    within = rows.select(split, F.pmod(F.xxhash64(order), F.lit(1024)).alias("block"), pair.alias("x"))
    best = within.withColumn("place", F.row_number().over(Window.partitionBy(split, "block").orderBy("x"))).where(F.col("place") <= examples)
    firsts = best.groupBy(split).agg(F.slice(F.array_sort(F.collect_list("x")), 1, examples).alias("examples"))
    return lengths.join(firsts, split)


def perplexities(loss: Column | str) -> Column:
    """exp(loss); not finite where that overflows, null for null."""
    return F.exp(F.col(loss) if isinstance(loss, str) else loss)


def finite_summary(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """n, mean, low, high over finite values (null if there are none), and how many are not finite; null counts as such."""
    ok = finite(F.col(column))
    value = F.when(ok, F.col(column))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.count_if(~ok).alias("non_finite"))


def suffix_kept(prediction: Column | str, reference: Column | str, suffixes: str) -> Column:
    """Whether all suffix characters of a reference are in the prediction; null if it has none."""
    p, r = (F.col(x) if isinstance(x, str) else x for x in (prediction, reference))
    wanted = F.filter(F.array(*map(F.lit, suffixes)), lambda c: r.contains(c))
    return F.when(F.size(wanted) > 0, F.forall(wanted, lambda c: F.coalesce(p.contains(c), F.lit(False))))


def anchored(rows: DataFrame, system: str, anchor: str, higher: Sequence[str], lower: Sequence[str] = ()) -> DataFrame:
    """rows (one a system) with anchor_<m> and relative_<m>: a measure over the anchor system's, inverted for those of which less is better.

    Null where there is no quotient; without a row of the anchor system all of these are null. The anchor is a row and is broadcast.
    """
    names = [*higher, *lower]
    own = rows.where(F.col(system) == anchor).agg(*(F.first(m).alias(f"anchor_{m}") for m in names))
    both = rows.join(F.broadcast(own), F.lit(True), "left")
    ratio = lambda m: F.try_divide(F.col(m), F.col(f"anchor_{m}")) if m in higher else F.try_divide(F.col(f"anchor_{m}"), F.col(m))
    return both.select("*", *(ratio(m).alias(f"relative_{m}") for m in names))


def mixed(df: DataFrame, times: int, other: DataFrame, key: Sequence[str], seed: str = "42") -> DataFrame:
    """df times over with other, and place, the row's position from 0 in a random order of all rows. key: columns that tell rows of one copy apart."""
    rows = upsampled(df, times, other).withColumn("__key", F.concat_ws("|", "copy", *key))
    return ranked(rows, "__key", seed, "place").drop("__key")
