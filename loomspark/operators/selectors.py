"""Candidate pools, their scores and the selectors. A pool is an array in its row, so no selector shuffles anything.

A pool's members are structs (pos, name, pred) in declared order; empty predictions are no members. Scores are exact:
hundredths in integers until the last division.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import add

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from loomspark.functions import chrf, text
from loomspark.functions.charsets import LATIN, Charset

FRONTIER = "frontier"
#: Hundredths: shared start, shared end, title suffix, distance from the median length, contamination, short, long, prior.
WEIGHTS = {"prefix": 140, "suffix": 120, "title": 250, "length": -100, "contaminated": -600, "short": -400, "long": -200, "prior": 75}


def pool(df: DataFrame, names: Sequence[str], column: str = "pool") -> DataFrame:
    """df with the pool of the columns of names."""
    members = [F.struct(F.lit(k).alias("pos"), F.lit(n).alias("name"), text.strip(n).alias("pred")) for k, n in enumerate(names)]
    return df.withColumn(column, F.filter(F.array(*members), lambda m: F.coalesce(m["pred"] != "", F.lit(False))))


def upper_median(lengths: Column) -> Column:
    """Of an even number of values, the upper middle one."""
    return F.get(F.array_sort(lengths), (F.size(lengths) / 2).cast("int"))


def _common_start(a: str, b: str) -> int:
    """Length of the longest common start, by halves."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def ends_of(pool: Sequence[str]) -> list[int]:
    """Two numbers a text: characters that it shares with the starts, and with the ends, of those that differ from it. Shares of one character
    don't count, nor does an end that reads as the start."""
    out, back = [0] * (2 * len(pool)), [x[::-1] for x in pool]
    for i, a in enumerate(pool):
        for j in range(i):
            if a == pool[j]:
                continue
            p, s = _common_start(a, pool[j]), _common_start(back[i], back[j])
            start, end = (p if p >= 2 else 0), (s if s >= 2 and a[len(a) - s :] != a[:p] else 0)
            for k in (i, j):
                out[2 * k] += start
                out[2 * k + 1] += end
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def shared_ends(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """ends_of of an array of texts."""
    for pools in batches:
        yield pd.Series([ends_of(list(pool)) for pool in pools])


#: The order of a member's features.
FEATURES = tuple(WEIGHTS)


def featured(df: DataFrame, charset: Charset = LATIN, source: str = "source") -> DataFrame:
    """df with featured: members with length, consensus, flags and their features as an array in the order of FEATURES; pool's median length beside."""
    median = upper_median(F.transform("pool", lambda m: F.length(m["pred"])))
    df = df.withColumns({"median_length": median, "__ends": shared_ends(F.transform("pool", lambda m: m["pred"]))})

    def one(m: Column, i: Column) -> Column:
        n = F.length(m["pred"])
        pre, suf = (F.get("__ends", 2 * i + k) for k in (0, 1))
        title = F.instr(F.lit(charset.suffixes), F.right(m["pred"], F.lit(1))) > 0
        dirty = m["pred"].rlike(charset.contamination)
        short = n <= F.greatest(F.lit(1), (F.length(source) / 4).cast("int"))
        long = (n >= F.col("median_length") + 5) & (n >= F.length(source) + 5)
        parts = {"prefix": pre, "suffix": suf, "title": title, "length": F.abs(n - F.col("median_length")), "contaminated": dirty, "short": short, "long": long, "prior": m["name"] == FRONTIER}
        features = F.array(*(parts[k].cast("long") for k in FEATURES))
        return F.struct(m["pos"].alias("pos"), m["name"].alias("name"), m["pred"].alias("pred"), n.alias("length"), (pre + suf).alias("consensus"), title.alias("title"), dirty.alias("dirty"), short.alias("short"), long.alias("long"), features.alias("features"))

    return df.withColumn("featured", F.transform("pool", one)).drop("__ends")


def values(weights: Mapping[str, int]) -> Column:
    """Weights as an array in the order of FEATURES."""
    return F.array(*(F.lit(weights[k]).cast("long") for k in FEATURES))


def weighted(df: DataFrame, weights: Column) -> DataFrame:
    """df with scored: the featured members with score, the product of their features and the weights (array<bigint> in the order of FEATURES)."""
    kept = ("pos", "name", "pred", "length", "consensus", "title", "dirty", "short", "long")
    product = lambda m: reduce(add, (F.get(m["features"], F.lit(k)) * F.get(weights, F.lit(k)) for k in range(len(FEATURES))))
    return df.withColumn("scored", F.transform("featured", lambda m: F.struct(*(m[k].alias(k) for k in kept), product(m).alias("score"))))


def scored(df: DataFrame, charset: Charset = LATIN, weights: Mapping[str, int] = WEIGHTS, source: str = "source") -> DataFrame:
    """df with scored: members with length, consensus, flags and score (hundredths); pool's median length beside."""
    return weighted(featured(df, charset, source), values(weights)).drop("featured")


def studied(df: DataFrame, pools: Mapping[str, Sequence[str]], settings: Sequence[Mapping]) -> DataFrame:
    """df's rows once for each of the pools (name: columns) and settings (dicts of name, mode, margin, consensus and weights that differ): pool, setting, chosen, switched.

    A member's features are made once a pool; settings are a table, and each is one product. Nothing is shuffled.
    """
    names = list(dict.fromkeys(n for members in pools.values() for n in members))
    every = pool(df, names, "__every")
    of = lambda members: F.filter("__every", lambda m: m["name"].isin(*members))
    choices = F.array(*(F.struct(F.lit(name).alias("name"), of(members).alias("members")) for name, members in pools.items()))
    rows = featured(every.withColumn("__p", F.explode(choices)).select("*", F.col("__p.name").alias("pool_name"), F.col("__p.members").alias("pool")).drop("__every", "__p"))
    table = F.array(*(
        F.struct(F.lit(x["name"]).alias("name"), F.lit(x.get("mode", "guarded")).alias("mode"), F.lit(x.get("margin", 300)).alias("margin"), F.lit(x.get("consensus", 2)).alias("consensus"),
            F.array(*(F.lit(x.get(k, WEIGHTS[k])).cast("long") for k in FEATURES)).alias("weights"))
        for x in settings))
    rows = weighted(rows.withColumn("__s", F.explode(table)), F.col("__s.weights"))
    by_rule = guarded(rows, F.col("__s.margin"), F.col("__s.consensus")).withColumnRenamed("chosen", "__guarded").drop("action")
    chosen = F.when(F.col("__s.mode") == "score_max", _best()).otherwise(F.col("__guarded"))
    out = by_rule.withColumn("chosen", chosen).withColumn("setting", F.col("__s.name")).withColumn("switched", F.coalesce(F.col("chosen.name") != FRONTIER, F.lit(False)))
    return out.drop("pool", "featured", "scored", "median_length", "__s", "__guarded").withColumnRenamed("pool_name", "pool")


def _first(candidates: Column, *keys) -> Column:
    """The member with the greatest keys, first in pool order among equals."""
    ranked = F.transform(candidates, lambda m: F.struct(*(k(m).alias(f"k{i}") for i, k in enumerate(keys)), (-m["pos"]).alias("pos"), m.alias("m")))
    return F.array_max(ranked)["m"]


def _frontier() -> Column:
    return F.get(F.filter("scored", lambda m: m["name"] == FRONTIER), F.lit(0))


def _best() -> Column:
    return _first(F.col("scored"), lambda m: m["score"], lambda m: (m["name"] == FRONTIER).cast("int"))


def score_max(df: DataFrame) -> DataFrame:
    """The highest score; among equals the frontier's, then the first."""
    return df.withColumn("chosen", _best())


def guarded(df: DataFrame, margin: Column | int = 300, consensus: Column | int = 2) -> DataFrame:
    """The frontier's, unless a local one is safer by one of four rules; action names the rule."""
    f, best = F.col("__f"), F.col("__l")
    df = df.withColumn("__f", _frontier()).withColumn("__l", _first(F.filter("scored", lambda m: m["name"] != FRONTIER), lambda m: m["score"]))
    clean = best.isNotNull() & ~best["dirty"]
    rules = [
        ("no_frontier", f.isNull()),
        ("contamination", f["dirty"] & clean),
        ("fragment", (f["length"] <= 1) & (best["length"] >= 3)),
        ("margin", (best["score"] - f["score"] >= margin) & (best["consensus"] >= f["consensus"] + consensus) & ~best["short"] & clean & (best["title"] | ~f["title"])),
        ("length", f["long"] & ~best["long"] & (best["consensus"] >= consensus) & (best["length"] + 2 <= f["length"])),
    ]
    action = F.lit("keep_frontier")
    for name, rule in reversed(rules):
        action = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(action)
    df = df.withColumn("action", action)
    return df.withColumn("chosen", F.when(F.col("action") == "keep_frontier", f).otherwise(best)).drop("__f", "__l")


def vote(df: DataFrame) -> DataFrame:
    """The most frequent prediction; a tie falls to the frontier if it takes part, else to the first in pool order."""
    count = lambda m: F.size(F.filter("scored", lambda o: o["pred"] == m["pred"]))
    return df.withColumn("chosen", _first(F.col("scored"), count, lambda m: (m["name"] == FRONTIER).cast("int")))


def closest(pool: Column | str, means: Column | str) -> Column:
    """struct(pos, name, pred, mean): the member of a pool with the highest mean (rounded to 1e-9); ties to the frontier, then the first. Null for an empty pool."""
    pool, means = (F.col(x) if isinstance(x, str) else x for x in (pool, means))
    ranked = F.transform(pool, lambda m, i: F.struct(F.round(F.get(means, i), 9).alias("mean"), (m["name"] == FRONTIER).cast("int").alias("f"), (-m["pos"]).alias("p"), m.alias("m")))
    best = F.array_max(ranked)
    return F.when(best.isNotNull(), F.struct(best["m"]["pos"].alias("pos"), best["m"]["name"].alias("name"), best["m"]["pred"].alias("pred"), best["mean"].alias("mean")))


def pool_means(pool: Column | str) -> Column:
    """The mean chrF++ of each member of a pool against the others."""
    return chrf.pool_means(F.transform(pool, lambda m: m["pred"]))


def mbr(df: DataFrame, key: str = "row_idx") -> DataFrame:
    """key, chosen: the member closest to the others by mean chrF++ (rounded to 1e-9); ties to the frontier, then the first. Nothing is shuffled."""
    scored_ = df.where(F.size("pool") > 0).select(key, "pool", pool_means("pool").alias("means"))
    return scored_.select(key, closest("pool", "means").alias("chosen"))


def _own() -> Column:
    return F.get(F.filter("pool", lambda m: m["name"] == FRONTIER), F.lit(0))["pred"]


def _substitutes(charset: Charset) -> Column:
    """The clean members of a pool whose frontier isn't clean; of others none."""
    clean = F.filter("pool", lambda m: ~m["pred"].rlike(charset.contamination))
    return F.when(F.coalesce(_own().rlike(charset.contamination), F.lit(True)), clean).otherwise(F.slice("pool", 1, 0))


def side_by_side(df: DataFrame, repair: Column, charset: Charset = LATIN) -> DataFrame:
    """df (with pool) with a row for each of five selectors: selector, pred. mbr, contamination (the frontier's if clean, else the closest clean one), title (no prior),
    sparse (guarded), audit (the closest one where repair holds, else the guarded one). Features once, two passes of chrF++ over the pool, no shuffle."""
    rows = df.withColumn("__clean", _substitutes(charset))
    rows = featured(rows.withColumns({"__means": pool_means("pool"), "__clean_means": pool_means("__clean")}), charset)
    rows = score_max(weighted(rows, values(WEIGHTS | {"prior": 0}))).withColumnRenamed("chosen", "__title")
    rows = guarded(weighted(rows, values(WEIGHTS))).withColumnRenamed("chosen", "__sparse").withColumn("__f", _frontier())
    mbr_, clean = closest("pool", "__means")["pred"], closest("__clean", "__clean_means")["pred"]
    picks = {
        "mbr": mbr_,
        "contamination": F.when(~F.col("__f.dirty"), F.col("__f.pred")).otherwise(F.coalesce(clean, F.col("__f.pred"))),
        "title": F.col("__title.pred"),
        "sparse": F.col("__sparse.pred"),
        "audit": F.when(repair, mbr_).otherwise(F.col("__sparse.pred")),
    }
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("selector"), p.alias("pred")) for n, p in picks.items())))
    return rows.select(*df.columns, each.alias("__s")).select(*df.columns, "__s.*")


def contamination_guard(df: DataFrame, charset: Charset = LATIN) -> DataFrame:
    """df (with pool) with pick: the frontier's if clean; else that of the clean member closest to the other clean ones; else the frontier's. Only pools whose
    frontier isn't clean are compared, and nothing is shuffled."""
    df = df.withColumns({"__f": _own(), "__clean": _substitutes(charset)})
    df = df.withColumn("__means", pool_means("__clean"))
    return df.withColumn("pick", F.coalesce(closest("__clean", "__means")["pred"], "__f")).drop("__f", "__clean", "__means")


def two_way(default: Column | str, other: Column | str, bad: str = LATIN.contamination) -> Column:
    """struct(pred, reason): the other one if only the default is dirty, or if it repairs a default of up to 3 characters by a super-sequence."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (default, other))
    dirty, other_dirty = a.rlike(bad), b.rlike(bad)
    repair = (F.length(a) <= 3) & (F.length(b) > F.length(a)) & ~other_dirty & text.is_subsequence(a, b)
    reason = F.when(dirty & ~other_dirty, "default_dirty").when(repair, "repair").otherwise("default")
    return F.struct(F.when(reason == "default", a).otherwise(b).alias("pred"), reason.alias("reason"))


def basis(df: DataFrame) -> DataFrame:
    """The owner of the chosen prediction: the frontier if it made it too, else the first."""
    owners = F.filter("pool", lambda m: m["pred"] == F.col("chosen.pred"))
    return df.withColumn("basis", F.when(F.exists(owners, lambda m: m["name"] == FRONTIER), FRONTIER).otherwise(F.get(owners, F.lit(0))["name"]))


def labelled(df: DataFrame) -> DataFrame:
    """Distinct predictions as 'A: ...' lines, in the order of their first owner."""
    distinct = F.array_distinct(F.transform("pool", lambda m: m["pred"]))
    lines = F.transform(distinct, lambda p, i: F.concat(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), i + 1, F.lit(1)), F.lit(": "), p))
    return df.withColumn("labels", F.array_join(lines, "\n"))


def hints(df: DataFrame) -> DataFrame:
    """Shared starts and ends, of two characters or more, of the distinct predictions of a pool; sorted, one a line."""
    distinct = F.array_distinct(F.transform("pool", lambda m: m["pred"]))
    pairs = F.flatten(F.transform(distinct, lambda a: F.transform(F.filter(distinct, lambda b: b > a), lambda b: F.array(text.common_prefix(a, b), text.common_suffix(a, b)))))
    return df.withColumn("hints", F.array_join(F.array_sort(F.array_distinct(F.filter(F.flatten(pairs), lambda x: F.length(x) >= 2))), "\n"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
