"""Corpus construction: deterministic splits, synthesis, flattening, deduplication and preference pairs.

Randomness is a number from md5 of a seed and a key, the same in SQL. Orders over all rows are taken within hash blocks
(BLOCKS of them) and put together from counts, so no task sorts everything.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1 << 32
#: Fixed value: one character of the unified ideographs' first block.
IDEOGRAPH = r"^[\x{4E00}-\x{9FFF}]$"


def number(seed: str, *keys: Column | str) -> Column:
    """A number in 0..2**32-1 of a seed and a row's key."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))), 1, 8), 16, 10).cast("long")


def ranked(df: DataFrame, key: str, seed: str, name: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """df with rank, from 0, in the order of (number, key), within groups of by if given."""
    df = df.withColumn("__n", number(seed, key)).withColumn("__b", (F.col("__n") / (SPAN // 256)).cast("int"))
    groups = [*by, "__b"]
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*groups).agg(F.count("*").alias("__c")).select(*groups, F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__base"))  # 256 rows a group
    inner = df.withColumn("__r", F.row_number().over(Window.partitionBy(*groups).orderBy("__n", key)))
    if by:
        same = [F.col(f"i.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups]
        met = inner.alias("i").join(base.alias("b"), reduce(lambda a, b: a & b, same)).select("i.*", "b.__base")
        return met.withColumn(name, F.col("__base") + F.col("__r") - 1).drop("__n", "__b", "__r", "__base")
    return inner.join(F.broadcast(base), groups).withColumn(name, F.col("__base") + F.col("__r") - 1).drop("__n", "__b", "__r", "__base")


def split(df: DataFrame, key: str, sizes: dict[str, int], rest: str = "train", seed: str = "42") -> DataFrame:
    """df with split: the first sizes in random order, then the rest."""
    out, at, name = F.lit(rest), 0, []
    for k, n in sizes.items():
        name.append((k, at, at + n))
        at += n
    for k, a, b in reversed(name):
        out = F.when(F.col("rank").between(a, b - 1), k).otherwise(out)
    return ranked(df, key, seed).withColumn("split", out).drop("rank")


def stratified(df: DataFrame, key: str, stratum: str, quotas: dict[str, int], seed: str = "42") -> DataFrame:
    """df with split: each quota in turn takes rows round-robin over strata, ascending, of what is left; the rest is null.

    A stratum is taken from its start on, so a row's split follows from its rank in the stratum and from how many rows of it each
    quota takes. Those follow from the strata's sizes alone: no row is moved for them, and at most quota turns are looked at.
    """
    order = ranked(df, key, seed, "__i", [stratum])
    took = df.groupBy(stratum).agg(F.count("*").alias("__size")).withColumn("__0", F.lit(0).cast("long"))
    for k, (_, quota) in enumerate(quotas.items()):
        left = took.withColumn("__left", F.col("__size") - F.col(f"__{k}"))
        some = left.where((F.col("__left") > 0) & (F.lit(quota) > 0))
        turns = some.select(stratum, F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("__left", F.lit(quota))))).alias("__turn"))
        sizes = turns.groupBy("__turn").agg(F.count("*").alias("__n"))
        before = Window.orderBy("__turn").rowsBetween(Window.unboundedPreceding, -1)  # at most quota rows
        base = sizes.select("__turn", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
        place = F.col("__base") + F.row_number().over(Window.partitionBy("__turn").orderBy(stratum))
        taken = turns.join(base, "__turn").where(F.col("__base") < quota).withColumn("__place", place).where(F.col("__place") <= quota).groupBy(stratum).agg(F.count("*").alias("__t"))
        both = took.join(taken.withColumnRenamed(stratum, "__s"), F.col(stratum).eqNullSafe(F.col("__s")), "left")
        took = both.withColumn(f"__{k + 1}", F.col(f"__{k}") + F.coalesce("__t", F.lit(0))).drop("__s", "__t")
    ends = took.drop("__size").withColumnRenamed(stratum, "__s")
    split = F.lit(None).cast("string")
    for k, name in reversed(list(enumerate(quotas))):
        split = F.when(F.col("__i") < F.col(f"__{k + 1}"), name).otherwise(split)
    return order.join(ends, F.col(stratum).eqNullSafe(F.col("__s"))).select(*df.columns, split.alias("split"))


def first_valid(df: DataFrame, valid: Column, n: int, *order: str) -> DataFrame:
    """The first n rows, in order, that are valid: each task keeps n."""
    return df.where(F.coalesce(valid, F.lit(False))).orderBy(*order).limit(n)


def upsampled(df: DataFrame, times: int, other: DataFrame) -> DataFrame:
    """df times over, with other."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).unionByName(other.withColumn("copy", F.lit(0)))


def replaced(texts: DataFrame, table: DataFrame, unknown: str | None = "[UNK]", pick: Column | float | None = None, seed: str = "42", unknown_if: str = IDEOGRAPH) -> DataFrame:
    """id, synthetic, n_replaced: words (id, words) by one of the candidates of table (word, candidates), chosen by number.

    unknown: what a word outside the table that matches unknown_if becomes, which counts as replaced (None: it stays, as all others do).
    pick: only max(1, int(k * pick)) of the k replaceable ones, lowest number first; rows with fewer than two go. pick may be a column
    of texts. Words are exploded and put together again by id; a text without words stays, empty.
    """
    own_pick = F.lit(1.0) if pick is None else pick if isinstance(pick, Column) else F.lit(pick)
    rows = texts.select("id", own_pick.alias("pick"), F.posexplode_outer("words").alias("pos", "word")).join(table, "word", "left")
    n = number(seed, "id", "pos")
    choice = F.element_at("candidates", (n % F.size("candidates") + 1).cast("int"))
    rows = rows.withColumn("n", n).withColumn("hit", F.col("candidates").isNotNull())
    if pick is not None:
        own = Window.partitionBy("id")
        rows = rows.withColumn("k", F.count_if("hit").over(own)).where("k >= 2")
        rank = F.row_number().over(own.orderBy(F.col("hit").desc(), "n", "pos"))
        rows = rows.withColumn("hit", F.col("hit") & (rank <= F.greatest(F.lit(1), (F.col("k") * F.col("pick")).cast("int"))))
    lost = F.lit(False) if unknown is None else F.coalesce(~F.col("hit") & F.col("word").rlike(unknown_if), F.lit(False))
    new = F.when(F.col("hit"), choice).when(lost, unknown).otherwise(F.coalesce("word", F.lit("")))
    rows = rows.select("id", "pos", new.alias("new"), (F.col("hit") | lost).alias("hit"))
    out = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("new").alias("w")))).alias("ws"), F.count_if("hit").alias("n_replaced"))
    return out.select("id", F.array_join(F.transform("ws", lambda w: w["w"]), " ").alias("synthetic"), "n_replaced")


def first_of(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows with equal keys the first; a partial aggregate, no window."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("__f"), F.count("*").alias("n_rows")).select(*keys, *(F.col(f"__f.{c}").alias(c) for c in others), "n_rows")


def preference_pairs(candidates: DataFrame, least_gap: float = 0.05) -> DataFrame:
    """prompt, chosen, rejected, gap of candidates (prompt, idx, text, reward): first best against last worst, of two filled ones at least."""
    own = candidates.where("text is not null and text <> '' and reward is not null and not isnan(reward)")
    best = F.max_by(F.struct("text", "reward"), F.struct("reward", -F.col("idx")))
    worst = F.min_by(F.struct("text", "reward"), F.struct("reward", -F.col("idx")))
    out = own.groupBy("prompt").agg(best.alias("b"), worst.alias("w"), F.count("*").alias("n")).where("n >= 2")
    gap = F.col("b.reward") - F.col("w.reward")
    return out.select("prompt", F.col("b.text").alias("chosen"), F.col("w.text").alias("rejected"), gap.alias("gap")).where(F.col("gap") >= least_gap)


def preference_reward(lexical: Column | str, perplexity: Column | str, weight: float = 0.01) -> Column:
    """Lexical coverage less weight times the logarithm of the perplexity; null without either."""
    lex, ppl = (F.col(x) if isinstance(x, str) else x for x in (lexical, perplexity))
    return lex - F.lit(weight) * F.log(ppl + 1e-8)


def preference_filtered(pairs: DataFrame, least_gap: float, order: str) -> DataFrame:
    """pairs with reason: as preference_reason says; of kept pairs equal in prompt, chosen and rejected all but the first are duplicates."""
    df = pairs.withColumn("reason", preference_reason(least_gap))
    first = df.where("reason = 'kept'").groupBy("prompt", "chosen", "rejected").agg(F.min(order).alias("__first"))
    same = reduce(lambda a, b: a & b, [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("prompt", "chosen", "rejected")])
    met = df.alias("p").join(first.alias("f"), same, "left")
    reason = F.when((F.col("p.reason") == "kept") & (F.col(f"p.{order}") != F.col("f.__first")), "duplicate").otherwise(F.col("p.reason"))
    return met.select(*(F.col(f"p.{c}") for c in pairs.columns), reason.alias("reason"))


def preference_reason(least_gap: float) -> Column:
    """Why a pair goes, in this order: non_finite, same_text, small_gap; else kept. Columns chosen(_reward), rejected(_reward)."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    gap = F.col("chosen_reward") - F.col("rejected_reward")
    return F.when(~finite(F.col("chosen_reward")) | ~finite(F.col("rejected_reward")), "non_finite").when(F.col("chosen") == F.col("rejected"), "same_text").when(gap < least_gap, "small_gap").otherwise("kept")


def targets(x: Column | str) -> tuple[Column, Column]:
    """Literal and final target of a training output: what stands in and after <literal>; without one, the whole for both; trimmed."""
    x = F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))
    pattern, trim = r"(?s)<literal>(.*?)</literal>\s*(.*)$", lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    part = lambda k: trim(F.when(x.rlike(pattern), F.regexp_extract(x, pattern, k)).otherwise(x))
    return part(1), part(2)


def looked_up(rows: DataFrame, files: Sequence[DataFrame], column: str, first: bool = True) -> DataFrame:
    """rows (prompt) with column, the output of the training record of its prompt; null without one. files: (order, prompt, output) of each file in turn.

    Of records of one prompt the first one counts, over all files, or the last one.
    """
    every = reduce(DataFrame.unionByName, (f.select("prompt", "output", F.struct(F.lit(k).alias("file"), F.col("order").alias("order")).alias("at")) for k, f in enumerate(files)))
    pick = F.min_by if first else F.max_by
    known = every.groupBy("prompt").agg(pick("output", "at").alias(column))
    return rows.join(known.hint("merge"), "prompt", "left")  # by its files the optimizer would take either side for small, and broadcast it


#: Name of a design, and its reward from lexical coverage, likeness to the literal and to the final target.
DESIGNS = {
    "current_lex_ppl": None,
    "lex_only": lambda lex, literal, final: lex,
    "literal_chrf": lambda lex, literal, final: literal,
    "lex_plus_literal": lambda lex, literal, final: 0.5 * lex + 0.5 * literal,
    "oracle_final_chrf": lambda lex, literal, final: final,
}


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def designed(pairs: DataFrame) -> DataFrame:
    """One row a design, in one pass over pairs: of both sides (chosen, rejected) reward, lex, literal, final and match, the likeness to the gold target."""
    both = lambda name: (F.col(f"chosen_{name}"), F.col(f"rejected_{name}"))
    of = lambda design: (tuple(design(F.col(f"{s}_lex"), F.col(f"{s}_literal"), F.col(f"{s}_final")) for s in ("chosen", "rejected")) if design else both("reward"))
    rewards = F.array(*(F.struct(F.lit(name).alias("design"), of(d)[0].alias("x"), of(d)[1].alias("y")) for name, d in DESIGNS.items()))
    (good, bad), (x, y) = both("match"), both("reward")
    rows = pairs.select((x - y).alias("current"), (good - bad).alias("better"), F.explode(rewards).alias("r")).select("current", "better", "r.design", (F.col("r.x") - F.col("r.y")).alias("gap"))
    ok, kept = finite(F.col("gap")), lambda least: (F.col("gap") >= least) & ~F.isnan("gap")
    rate = lambda condition, of=None: F.count_if(condition) / F.nullif(F.count("*") if of is None else F.count_if(of), F.lit(0))
    return rows.groupBy("design").agg(
        F.count("*").alias("pairs"), rate(F.col("better") > 0).alias("chosen_better"), rate(F.col("better") < 0).alias("rejected_better"), rate(F.col("better") == 0).alias("equal"),
        F.avg(F.when(ok, F.col("gap"))).alias("mean_gap"), F.count_if(kept(0.2)).alias("kept_02"), F.count_if(kept(0.4)).alias("kept_04"),
        rate(kept(0.2) & (F.col("better") > 0), kept(0.2)).alias("good_02"), rate(kept(0.4) & (F.col("better") > 0), kept(0.4)).alias("good_04"),
        F.count_if(ok & finite(F.col("current")) & ((F.col("gap") >= 0) != (F.col("current") >= 0))).alias("flips"),
    )


#: Upper ends of the bins of reward gaps.
GAP_BINS = (0.05, 0.1, 0.2, 0.4)


def gap_bin(gap: Column) -> Column:
    """0 to len(GAP_BINS): how many ends a gap is above."""
    return sum(((gap > end).cast("int") for end in GAP_BINS), F.lit(0))


def gold_audited(pairs: DataFrame) -> DataFrame:
    """One row a bin of finite gaps, and one for all (bin null): pairs (chosen, rejected, both rewards, chosen_match and rejected_match, null without a gold target)."""
    ok = finite(F.col("chosen_reward")) & finite(F.col("rejected_reward"))
    gap = F.when(ok, F.col("chosen_reward") - F.col("rejected_reward"))
    better = F.when(ok, F.col("chosen_match") - F.col("rejected_match"))
    rows = pairs.select((F.col("chosen") == F.col("rejected")).alias("same"), ok.alias("ok"), gap.alias("gap"), better.alias("better"), F.when(ok, gap_bin(gap)).alias("bin"))
    return rows.select("*", F.explode(F.array_distinct(F.array(F.lit(-1), F.coalesce("bin", F.lit(-1))))).alias("of")).groupBy("of").agg(
        F.count("*").alias("pairs"), F.count_if("same").alias("same"), F.count_if(~F.col("ok")).alias("non_finite"), F.avg("gap").alias("mean_gap"), F.min("gap").alias("low"), F.max("gap").alias("high"),
        F.count("better").alias("gold"), F.count_if(F.col("better") > 0).alias("chosen_better"), F.count_if(F.col("better") < 0).alias("rejected_better"), F.count_if(F.col("better") == 0).alias("equal"),
        F.count_if((F.col("gap") <= 0.1) & F.col("better").isNotNull()).alias("low_gap"), F.count_if((F.col("gap") <= 0.1) & (F.col("better") > 0)).alias("low_gap_better"),
        *(F.count_if(F.col("gap") >= least).alias(f"ge_{int(100 * least):02d}") for least in (0.05, 0.1, 0.2, 0.3, 0.4)),
    ).withColumn("bin", F.nullif("of", F.lit(-1))).drop("of")
