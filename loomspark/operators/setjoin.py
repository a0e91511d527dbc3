"""Best matches of sets: the highest Jaccard similarity of each set with any set of a pool, exactly and without a table of all pairs.

Elements are ordered by rarity in the pool, and a set is looked up by a prefix of it, its rarest elements. The prefix that is
needed for a similarity s shrinks as s grows, so levels of similarity come in turn, high ones first: a set whose best match so
far reaches the level is done, and the others look further only for what beats their best, which shortens prefixes and windows
of sizes. The HOT most frequent elements are never looked up. What a set has in common with others by them alone follows from a
table of their 2^HOT combinations with the smallest set that has each, whatever the number of sets that hold them.

Where the sets that ask are few, as a benchmark's are, all tasks hold them, by element, and each set of the pool is compared where it
is read: in numpy, without a shuffle and without a file, and a task gives one best match for each set that asks.

Several comparisons of the same kind can be made in one go: sets then have a group, and only those of the same group are compared.
Equal sets are one. An element of more than BLOCK pool sets is dealt in blocks, so that no task meets all of its sets.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.sources.io import materialised

#: Elements that are not looked up; sets of the pool that an element brings into one task; levels of similarity; elements that are broadcast.
HOT, BLOCK, LEVELS, HEAVY = 10, 256, (0.5, 0.15, 0.0), 2000
#: Rows from looking up whole sets, as a multiple of the pool's elements, up to which that is done at once.
FEW = 4
#: Sets that ask, and their elements, up to which tasks hold them; cells that a comparison takes at a time.
ASKING, HELD, CELLS = 4096, 1 << 20, 1 << 21
_SLACK = 1e-9


def _distinct(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, group, k of every row with elements, and k, group, grams of the distinct sets; null elements are none. An element bears its group's name."""
    own = sets.select("id", "group", F.array_sort(F.array_distinct(F.array_compact("grams"))).alias("grams")).where(F.size("grams") > 0)
    own = own.withColumn("k", F.md5(F.to_json(F.struct("group", "grams"))))
    named = F.transform("grams", lambda g: F.concat("group", F.lit("\t"), g))
    # Grams are a key here, not an aggregate: copies go by hash where they are read, without a sort of all rows.
    return own.select("id", "group", "k"), own.select("k", "group", "grams").distinct().select("k", "group", named.alias("grams"))


def _ordered(sets: DataFrame, often: DataFrame, rest: DataFrame) -> DataFrame:
    """k, group, n, mask of hot elements, grams: array<struct<df, gram>> in the order of rarity; elements that the pool lacks come first."""
    rows = sets.select("k", "group", F.explode("grams").alias("gram")).join(F.broadcast(often), "gram", "left")
    # What is found already goes on under a key of its own, so frequent elements stand in no task's way.
    key = F.when(F.col("df").isNull(), F.concat(F.lit("="), "gram")).otherwise(F.concat(F.lit("!"), "k"))
    rows = rows.withColumn("key", key).join(rest, "key", "left").select("k", "group", "gram", "bit", F.coalesce("df", "rest_df", F.lit(0)).alias("df"))
    order = F.array_sort(F.collect_list(F.struct("df", "gram")))
    return rows.groupBy("k", "group").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.expr("shiftleft(1L, bit)")), F.lit(0)).alias("mask"), order.alias("grams"))


def _by_hot(left: DataFrame, right: DataFrame) -> DataFrame:
    """k, best: what hot elements alone give each set of left, from the smallest set of right for each combination of them."""
    every = F.explode(F.sequence(F.lit(1), F.lit((1 << HOT) - 1))).alias("part")
    inside = (F.col("part").bitwiseAND(F.col("mask"))) == F.col("part")
    least = right.where("mask > 0").groupBy("group", "mask").agg(F.min("n").alias("m")).select("group", "mask", "m", every).where(inside).groupBy("group", "part").agg(F.min("m").alias("m"))
    masks = left.where("mask > 0").select("group", "mask").distinct().select("group", "mask", every).where(inside)  # 3^HOT rows a group at most
    choices = masks.join(F.broadcast(least), ["group", "part"]).groupBy("group", "mask").agg(F.collect_set(F.struct(F.expr("bit_count(part)").alias("s"), "m")).alias("choices"))
    one = F.array_max(F.transform("choices", lambda c: c["s"] / (F.col("n") + c["m"] - c["s"])))
    return left.join(F.broadcast(choices), ["group", "mask"], "left").select("k", F.coalesce(one, F.lit(0.0)).alias("best"))


def _need(threshold: Column | float, n: Column | str) -> Column:
    """How many elements a set of n must share for the threshold."""
    n = F.col(n) if isinstance(n, str) else n
    return F.greatest(F.lit(1), F.ceil(n * threshold - _SLACK))


def _prefix(sets: DataFrame, threshold: Column | float, *more: str) -> DataFrame:
    """k, n, pos, gram, df of the elements by which a set is looked up."""
    part = F.slice("grams", F.lit(1), (F.col("n") - _need(threshold, "n") + 1).cast("int"))
    return sets.select("k", "n", *more, F.posexplode(part).alias("pos", "g")).select("k", "n", *more, "pos", "g.gram", "g.df")


def candidates(left: DataFrame, right: DataFrame, level: float, hot: list[str]) -> DataFrame:
    """Distinct pairs k, other of left (k, n, grams, best) and right that may reach the level and beat left's best."""
    wanted = F.greatest(F.lit(level), F.col("best"))
    look = _prefix(left.withColumn("wanted", wanted), F.col("wanted"), "wanted").where((F.col("df") > 0) & ~F.col("gram").isin(hot))
    found = _prefix(right, level).where(~F.col("gram").isin(hot)).select(F.col("k").alias("other"), F.col("n").alias("m"), F.col("pos").alias("at"), "gram", "df")
    blocks = F.ceil(F.col("df") / BLOCK).cast("int")
    look = look.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("df")
    found = found.withColumn("block", F.pmod(F.xxhash64("other"), blocks).cast("int")).drop("df")
    fits = (F.col("m") >= F.col("n") * F.col("wanted") - _SLACK) & (F.col("m") * F.col("wanted") <= F.col("n") + _SLACK)
    ahead = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at"))
    enough = ahead * (1 + F.col("wanted")) >= F.col("wanted") * (F.col("n") + F.col("m")) - _SLACK
    return look.join(found, ["gram", "block"]).where(fits & enough).select("k", "other").distinct()


def _held(sets: DataFrame) -> dict[str, tuple]:
    """Of each group: k and sizes of its sets, its elements, and the sets that hold each: those of element e stand from starts[e] to starts[e + 1]."""
    rows = sets.select("k", "group", F.expr("transform(grams, g -> substring(g, length(group) + 2))").alias("grams")).toArrow().combine_chunks()
    out = {}
    for group in rows["group"].unique().to_pylist():
        own = rows.filter(pc.equal(rows["group"], group)).combine_chunks()
        size = pc.list_value_length(own["grams"]).to_numpy().astype(np.int64)
        grams = pc.list_flatten(own["grams"]).combine_chunks().dictionary_encode()
        at = grams.indices.to_numpy()
        starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(grams.dictionary)))])
        out[group] = own["k"].to_pylist(), size, grams.dictionary, starts, np.repeat(np.arange(len(size)), size)[np.argsort(at, kind="stable")]
    return out


def _closest(grams: pa.Array, size: np.ndarray, elements: pa.Array, starts: np.ndarray, holders: np.ndarray) -> np.ndarray:
    """The highest similarity of each held set with any of grams, by counting what each two share."""
    m = pc.list_value_length(grams).to_numpy(zero_copy_only=False).astype(np.int64)
    at = pc.index_in(grams.flatten(), value_set=elements).cast(pa.int64()).fill_null(-1).to_numpy()
    row = np.repeat(np.arange(len(m)), m)[at >= 0]
    at = at[at >= 0]
    times = starts[at + 1] - starts[at]
    ends = np.cumsum(np.bincount(row, times, len(m)) + len(size))
    best = np.zeros(len(size))
    low = 0
    while low < len(m):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CELLS, side="right")))
        own = slice(*np.searchsorted(row, [low, high]))
        n = times[own]
        place = np.repeat(starts[at[own]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = np.repeat((row[own] - low) * len(size), n) + holders[place]
        shared = np.bincount(cell, minlength=(high - low) * len(size)).reshape(-1, len(size))
        best = np.maximum(best, (shared / (size + m[low:high, None] - shared)).max(axis=0))
        low = high
    return best


def _compared(mine: DataFrame, right: DataFrame) -> DataFrame:
    """k, best of every set of mine that shares an element with a row of right: right's rows are read once and stay where they are."""
    held = _held(mine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {group: np.zeros(len(own[1])) for group, own in held.items()}
        for batch in batches:
            for group in set(batch.column("group").unique().to_pylist()) & set(held):
                grams = batch.filter(pc.equal(batch.column("group"), group)).column("grams")
                best[group] = np.maximum(best[group], _closest(grams, *held[group][1:]))
        for group, found in best.items():
            k = pa.array(held[group][0], pa.string())
            yield pa.RecordBatch.from_arrays([k, pa.array(found)], ["k", "best"]).filter(pa.array(found > 0))

    sets = right.where("grams is not null").select("group", F.array_distinct(F.array_compact("grams")).cast("array<string>").alias("grams"))
    return sets.mapInArrow(run, "k string, best double").groupBy("k").agg(F.max("best").alias("best"))


def best_jaccard(left: DataFrame, right: DataFrame, grouped: bool = False) -> DataFrame:
    """id (and group), best of every row of left (id, grams): the highest Jaccard similarity with a row of right (id, grams), 0 if none shares an element.

    grouped: both sides have a column group, of few values. Null elements, null and empty sets share nothing; repeated ids have a row each.
    """
    left, right = (df if grouped else df.withColumn("group", F.lit("")) for df in (left, right))
    ids, mine = _distinct(left)
    mine = materialised(mine, "sets")
    asking, elements = mine.agg(F.count("*"), F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()
    if asking <= ASKING and elements <= HELD:
        out = ids.join(_compared(mine, right), "k", "left").select("id", "group", F.coalesce("best", F.lit(0.0)).alias("best"))
        return _with_empty(out, left, grouped)
    pool = materialised(_distinct(right)[1], "sets")
    rows = lambda sets, k, n: sets.select(F.col("k").alias(k), F.size("grams").alias(n), "group", F.explode("grams").alias("gram"))
    counts = rows(pool, "other", "m").groupBy("group", "gram").agg(F.count("*").alias("df"))
    asked = rows(mine, "k", "n").groupBy("gram").agg(F.count("*").alias("times"))
    seen = counts.join(asked, "gram", "left").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum(F.col("df") * F.col("times")), F.lit(0))).first()
    total, hits = seen[0], seen[1]
    if hits <= FEW * total:  # looking everything up makes no more rows than a few times the elements there are
        met = rows(mine, "k", "n").join(rows(pool, "other", "m").drop("group"), "gram").groupBy("k", "other", "n", "m").agg(F.count("*").alias("s"))
        found = met.groupBy("k").agg(F.max(F.col("s") / (F.col("n") + F.col("m") - F.col("s"))).alias("best"))
        out = ids.join(found, "k", "left").select("id", "group", F.coalesce("best", F.lit(0.0)).alias("best"))
        return _with_empty(out, left, grouped)
    counts = materialised(counts, "element-counts")
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("df"), F.desc("gram")))
    top = counts.where("df > 1").withColumn("place", place).where(F.col("place") <= HOT).collect()  # HOT rows a group
    hot = [r["gram"] for r in top]
    bits = F.create_map(*(F.lit(x) for r in top for x in (r["gram"], r["place"] - 1))) if top else F.lit(None).cast("map<string,int>")
    heavy = (F.col("df") * HEAVY >= F.lit(total)) | F.col("gram").isin(hot)  # HEAVY rows, and the hot ones
    often = counts.where(heavy).select("gram", "df", bits[F.col("gram")].alias("bit"))
    rest = counts.where(~heavy).select(F.concat(F.lit("="), "gram").alias("key"), F.col("df").alias("rest_df"))
    mine, pool = materialised(_ordered(mine, often, rest), "ordered-sets"), materialised(_ordered(pool, often, rest), "ordered-sets")
    best = materialised(_by_hot(mine, pool), "best-matches")
    own = lambda grams: F.transform(grams, lambda g: g["gram"])
    for k, level in enumerate(LEVELS):
        open_ = best.where(F.col("best") < (LEVELS[k - 1] if k else 1.0))
        pairs = candidates(mine.join(open_, "k"), pool, level, hot)
        met = pairs.join(mine.select("k", "n", own("grams").alias("a")), "k").join(pool.select(F.col("k").alias("other"), F.col("n").alias("m"), own("grams").alias("b")), "other")
        met = met.select("k", "n", "m", F.size(F.array_intersect("a", "b")).alias("s")).groupBy("k").agg(F.max(F.col("s") / (F.col("n") + F.col("m") - F.col("s"))).alias("found"))
        best = materialised(best.join(met, "k", "left").select("k", F.greatest("best", F.coalesce("found", F.lit(0.0))).alias("best")), "best-matches")
    return _with_empty(ids.join(best, "k").select("id", "group", "best"), left, grouped)


def _with_empty(known: DataFrame, left: DataFrame, grouped: bool) -> DataFrame:
    none = left.where(F.coalesce(F.size(F.array_compact("grams")), F.lit(0)) <= 0).select("id", "group", F.lit(0.0).alias("best"))
    out = known.unionByName(none)
    return out if grouped else out.drop("group")


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
