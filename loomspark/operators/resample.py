"""Bootstrap resampling of additive statistics: blocks of rows times a matrix of draw counts, without a row a draw.

A resample of n rows is n draws. Which block of BLOCK rows a draw falls into is counted first, for ranges of draws; then each
block places its draws among its rows, and a resample's sums over the block are one row of the product of the matrix of counts
and the matrix of statistics, so work is n a resample in all and a task holds one block. Sums over blocks are an aggregation.
Draws are a hash of seed, stream, resample and number; systems with the same stream share their draws, which makes the
differences between them paired.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, RANGE, CHUNK = 4096, 1 << 18, 64
MASK, FIRST, SECOND, PLACE = (1 << 32) - 1, 0x7FEB352D, 0x045D9F3B, 0x9E3779B9


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers, in 64-bit arithmetic without overflow."""
    x = ((x ^ (x >> 16)) * FIRST) & MASK
    x = ((x ^ (x >> 15)) * SECOND) & MASK
    return x ^ (x >> 16)


def _counts(spark: SparkSession, n: int, streams: int, resamples: int, seed: int) -> DataFrame:
    """key (stream * resamples + resample), block, draws."""
    ranges = -(-n // RANGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                key, r = divmod(i, ranges)
                draws = np.arange(r * RANGE, min(n, (r + 1) * RANGE), dtype=np.int64)
                row = (mixed((mixed(np.int64((seed + key) & MASK)) + draws) & MASK) * n) >> 32
                found = np.bincount(row // BLOCK)
                block = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(block), key)), pa.array(block), pa.array(found[block])], ["key", "block", "draws"])

    slots = spark.range(streams * resamples * ranges)
    return slots.mapInArrow(run, "key long, block long, draws long").groupBy("key", "block").agg(F.sum("draws").alias("draws"))


def bootstrap(rows: DataFrame, columns: Sequence[str], n: int, resamples: int, seed: int = 42, streams: int = 1) -> DataFrame:
    """sample, system and the sums of columns over each resample, of rows (system, stream, idx, columns): every system has the rows idx 0..n-1.

    streams: how many different values, from 0, stream has. n below 2^31. A row that a system lacks counts as zeros.
    """
    spark, k = rows.sparkSession, len(columns)
    blocks = rows.select("system", F.col("stream").cast("long").alias("stream"), (F.col("idx") / BLOCK).cast("long").alias("block"), (F.col("idx") % BLOCK).cast("int").alias("at"), *(F.col(c).cast("double").alias(c) for c in columns))
    drawn = _counts(spark, n, streams, resamples, seed).withColumn("stream", (F.col("key") / resamples).cast("long"))

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out: dict[str, list] = {"sample": [], "system": [], **{c: [] for c in columns}}
        if mine.num_rows and theirs.num_rows:
            systems, code = np.unique(np.array(mine.column("system").to_pylist()), return_inverse=True)
            block = mine.column("block")[0].as_py()
            size = min(BLOCK, n - block * BLOCK)
            values = np.zeros((size, len(systems), k))
            values[mine.column("at").to_numpy(), code] = np.stack([mine.column(c).to_numpy() for c in columns], axis=1)
            values = values.reshape(size, -1)
            keys, draws = theirs.column("key").to_numpy(), theirs.column("draws").to_numpy()
            for a in range(0, len(keys), CHUNK):
                key, some = keys[a : a + CHUNK], draws[a : a + CHUNK]
                own = np.repeat(np.arange(len(key)), some)
                number = np.arange(len(own)) - np.repeat(np.cumsum(some) - some, some)
                start = mixed((mixed((seed + key) & MASK) + block + PLACE) & MASK)
                at = (mixed((start[own] + number) & MASK) * size) >> 32
                weights = np.bincount(own * size + at, minlength=len(key) * size).reshape(len(key), size)
                sums = (weights.astype(np.float64) @ values).reshape(-1, k)
                out["sample"].append(np.repeat(key % resamples, len(systems)))
                out["system"] += systems.tolist() * len(key)
                for j, c in enumerate(columns):
                    out[c].append(sums[:, j])
        arrays = [pa.array(np.concatenate(v) if v else np.zeros(0)) if name != "system" else pa.array(v, pa.string()) for name, v in out.items()]
        return pa.Table.from_arrays(arrays, list(out)).cast(pa.schema([("sample", pa.int64()), ("system", pa.string()), *((c, pa.float64()) for c in columns)]))

    schema = "sample long, system string, " + ", ".join(f"{c} double" for c in columns)
    sums = blocks.groupBy("stream", "block").cogroup(drawn.groupBy("stream", "block")).applyInArrow(run, schema)
    return sums.groupBy("sample", "system").agg(*(F.sum(c).alias(c) for c in columns))


def intervals(samples: DataFrame, by: Sequence[str], measures: dict[str, Column], level: float = 0.95) -> DataFrame:
    """by, and low and high of each measure of the resamples, by linear interpolation between neighbours."""
    tail = (1 - level) / 2
    scored = samples.select(*by, *(m.alias(name) for name, m in measures.items()))
    ends = [F.percentile(name, q).alias(f"{name}_{end}") for name in measures for end, q in (("low", tail), ("high", 1 - tail))]
    return scored.groupBy(*by).agg(*ends)


def paired(samples: DataFrame, pairs: Sequence[tuple[str, str]], measures: dict[str, Column]) -> DataFrame:
    """sample, a, b and b's measures less a's for each pair of systems, over the resamples that they share."""
    scored = samples.select("sample", "system", *(m.alias(name) for name, m in measures.items()))
    wanted = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))).alias("p")
    systems = sorted({x for p in pairs for x in p})
    wide = scored.groupBy("sample").agg(*(F.first(F.when(F.col("system") == s, F.struct(*measures)), ignorenulls=True).alias(f"of_{s}") for s in systems))
    rows = wide.select("*", wanted).select("*", "p.*")
    of = lambda side: F.coalesce(*(F.when(F.col(side) == s, F.col(f"of_{s}")) for s in systems))
    return rows.select("sample", "a", "b", *((of("b")[name] - of("a")[name]).alias(name) for name in measures))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
