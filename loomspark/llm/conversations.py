"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Logs hold a conversation again and again as it grows. A turn-prefix hash is the sum of its turns' hashes, each of which
covers the turn's number, so sums can roll: a conversation is a snapshot of a longer one if its own sum is that one's
sum at the same number of turns. Snapshots go by an anti-join, copies by keeping the smallest conv_id; what is left is
rendered. Hashes are two independent ones of 64 bits, summed in 32-bit halves, which can't overflow.

A conversation of any length rolls in blocks of BLOCK turn numbers, so no task sorts it whole; equal sums are counted
before they are joined, so a first turn or a conversation that a third of the log shares is one row there. Only the
rendered text of a kept conversation is gathered, because it is one value.

Defined results: turns are ordered by (turn, role, text); null turn is -1, null role and text are empty; repeated rows
count once; rows without a conv_id belong to no conversation and are left out. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
SUMS = ["s0", "s1", "s2", "s3"]


def turns(log: DataFrame) -> DataFrame:
    return log.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def _halves() -> list[Column]:
    a, b = F.xxhash64("turn", "role", "text"), F.xxhash64(F.lit("second"), "text", "turn", "role")
    return [x.alias(n) for x, n in zip((f(h) for h in (a, b) for f in (lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)), lambda h: F.shiftrightunsigned(h, 32))), SUMS, strict=True)]


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, turn, n (turns up to it), s0..s3 (their rolling hash)."""
    block = F.floor(F.col("turn") / BLOCK).alias("block")
    steps = rows.select("conv_id", "turn", *_halves()).distinct().groupBy("conv_id", "turn").agg(F.count("*").alias("n"), *(F.sum(s).alias(s) for s in SUMS))
    steps = steps.select("*", block)
    values = ["n", *SUMS]
    up_to = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    inner = steps.select("conv_id", "turn", "block", *(F.sum(v).over(up_to).alias(v) for v in values)).alias("i")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = steps.groupBy("conv_id", "block").agg(*(F.sum(v).alias(v) for v in values))
    blocks = blocks.select("conv_id", "block", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(v) for v in values)).alias("b")
    same = (F.col("i.conv_id") == F.col("b.conv_id")) & (F.col("i.block") == F.col("b.block"))
    return inner.join(blocks, same).select("i.conv_id", "i.turn", *((F.col(f"i.{v}") + F.col(f"b.{v}")).alias(v) for v in values))


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that are no snapshot of another one."""
    rolled = prefixes(rows)
    key = ["n", *SUMS]
    last = rolled.groupBy("conv_id").agg(F.max(F.struct("turn", *key)).alias("m")).select("conv_id", "m.*")
    distinct = last.groupBy(*key).agg(F.min(F.struct("conv_id")).alias("m"), F.count("*").alias("n_copies")).select("m.conv_id", *key, "n_copies")
    p, t = rolled.alias("p"), last.select("conv_id", F.col("n").alias("total")).alias("t")
    proper = p.join(t, (F.col("p.conv_id") == F.col("t.conv_id")) & (F.col("p.n") < F.col("t.total"))).select(*(f"p.{k}" for k in key)).distinct()
    return distinct.join(proper, key, "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def rendered(log: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, chat of each maximal conversation of log(conv_id, turn, role, text).

    A turn is <|role|>, a line break, its text, <|end|> and a line break; '<|' inside a text becomes '<\\|'.
    """
    rows = turns(log)
    kept = maximal(rows).alias("k")
    r = rows.alias("r")
    own = r.join(kept, F.col("r.conv_id") == F.col("k.conv_id"))
    joined = own.groupBy("r.conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_set(F.struct("r.turn", "r.role", "r.text"))).alias("ts"))
    piece = lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), F.replace(t["text"], F.lit("<|"), F.lit("<\\|")), F.lit("<|end|>\n"))
    return joined.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("ts", piece), "").alias("chat"))
