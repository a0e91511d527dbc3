"""Queries of pools, selectors, diagnostics and chrF++, over the pools derived from part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import chrf
from loomspark.functions.charsets import CLASSICAL
from loomspark.operators import diagnostics as D
from loomspark.operators import selectors as S

from .common import NAMES, POOL_SQL, PRIMARY_SQL, SCORED_SQL, SCORED_TITLES_SQL, TITLES_SQL, Query, chrf_sql, flags_sql, guarded_sql, pools, prefix_sql, score_sql, titles


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scored(S.pool(pools(spark, sf_dir), NAMES))


def _chosen(df: DataFrame, *more: str) -> DataFrame:
    return df.select("row_idx", F.col("chosen.name").alias("name"), F.col("chosen.pred").alias("pred"), *more)


def pool_scored(spark, d):
    # explode() would have the optimizer score every pool once more, below the exchange, to see whether it is empty.
    rows = scored(spark, d).select("row_idx", "median_length", F.explode_outer("scored").alias("m")).where("m is not null")
    return rows.select("row_idx", "median_length", "m.*")


def pool_guarded(spark, d):
    return _chosen(S.guarded(scored(spark, d)), "action")


def pool_score_max(spark, d):
    return _chosen(S.score_max(scored(spark, d)))


def pool_title_guard(spark, d):
    df = S.pool(pools(spark, d), NAMES)
    return _chosen(S.score_max(S.scored(df, weights=S.WEIGHTS | {"prior": 0})))


def pool_vote(spark, d):
    return _chosen(S.vote(scored(spark, d)))


def pool_mbr(spark, d):
    return _chosen(S.mbr(S.pool(pools(spark, d), NAMES)))


def pool_contamination_guard(spark, d):
    return S.contamination_guard(S.pool(pools(spark, d), NAMES)).select("row_idx", F.col("pick").alias("pred"))


def pool_audit_preserving(spark, d):
    """Analysis only: looks at the reference."""
    f = D.flags("frontier", "reference")
    repair = f["contamination"] | f["truncation"]
    df = S.pool(pools(spark, d), NAMES).where(F.size("pool") > 0)
    df = df.withColumn("repaired", F.when(repair, F.col("pool")).otherwise(F.slice("pool", 1, 0))).withColumn("means", S.pool_means("repaired"))
    df = S.guarded(S.scored(df))
    mbr = S.closest("repaired", "means")["pred"]
    return df.select("row_idx", F.when(repair, "repair").otherwise(F.col("action")).alias("action"), F.when(repair, mbr).otherwise(F.col("chosen.pred")).alias("pred"))


def pool_two_way(spark, d):
    return pools(spark, d).select("row_idx", S.two_way("frontier", "dpo").alias("t")).select("row_idx", "t.*")


def pool_basis(spark, d):
    return S.basis(S.vote(scored(spark, d))).select("row_idx", "basis")


def pool_labels(spark, d):
    return S.labelled(S.pool(pools(spark, d), NAMES)).select("row_idx", "labels")


def pool_hints(spark, d):
    return S.hints(S.pool(pools(spark, d), NAMES)).select("row_idx", "hints")


def selector_summary(spark, d):
    """The guarded selector with its measures: one row. Flagship."""
    # Out of an array: else the optimizer writes the selector out for each place where its pick is used, and chrF++'s input takes all that in.
    pick = F.explode(F.array(F.struct("action", F.col("chosen.pred").alias("pred")))).alias("p")
    df = S.guarded(scored(spark, d)).select("reference", pick).select("reference", "p.*")
    df = D.diagnosed(df, "pred", "reference").withColumn("stats", chrf.stats("pred", "reference"))
    measures = [
        F.count("*").alias("n"), F.sum("exact").alias("exact"), F.sum("contamination").alias("contaminated"), F.count_if(F.col("action") != "keep_frontier").alias("switches"),
        F.round(F.sum(F.length("pred")) / F.greatest(F.lit(1), F.sum(F.length("reference"))), 6).alias("length_ratio"), F.sum("suffix_drop").alias("suffix_errors"), F.sum("over_expansion").alias("over_expansion"),
    ]
    out = df.agg(*measures, *chrf.summed())
    return out.withColumn("chrf", F.round(chrf.of_sums(), 6)).drop(*(f"s{k}" for k in range(24)))


def selector_actions(spark, d):
    return S.guarded(scored(spark, d)).groupBy("action", F.col("chosen.name").alias("name")).agg(F.count("*").alias("n"))


def _grid(df: DataFrame, of: list[str]) -> DataFrame:
    """exact and switches of the rows of each k (columns k, reference, action, chosen), a row a k, named by the SQL values in of."""
    exact, switched = F.col("chosen.pred") == F.col("reference"), F.col("action") != "keep_frontier"
    sums = df.agg(*(F.count_if((F.col("k") == k) & x).alias(f"{c}_{k}") for k in range(len(of)) for c, x in (("exact", exact), ("switches", switched))))
    rows = F.array(*(F.struct(F.expr(name).alias("v"), F.col(f"exact_{k}").alias("exact"), F.col(f"switches_{k}").alias("switches")) for k, name in enumerate(of)))
    return sums.select(F.explode(rows).alias("r")).select("r.v.*", "r.exact", "r.switches")


def selector_sensitivity(spark, d):
    """Margins by consensus and title weights, all nine in one pass: features once, scores once per weight set, rules per margin."""
    titles_, margins = (0, 250, 500), (0, 300, 600)
    of = [f"struct({title} AS title, {margin} AS margin)" for title in titles_ for margin in margins]
    df = S.featured(S.pool(pools(spark, d), NAMES)).withColumn("t", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), S.values(S.WEIGHTS | {"title": title}).alias("w")) for i, title in enumerate(titles_)))))
    df = S.weighted(df, F.col("t.w")).withColumn("m", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(m).alias("margin")) for i, m in enumerate(margins)))))
    return _grid(S.guarded(df, F.col("m.margin")).withColumn("k", F.col("t.i") * len(margins) + F.col("m.i")), of)


def pool_ablation(spark, d):
    """The guarded selector over sub-pools, in one pass: a row a sub-pool."""
    of = (["frontier", "unk"], ["frontier", "dpo"], ["unk", "dpo"], NAMES)
    df = S.pool(pools(spark, d), NAMES, "every")
    part = lambda names: F.filter("every", lambda m: m["name"].isin(*names))
    each = F.array(*(F.struct(F.lit(k).alias("k"), part(names).alias("pool")) for k, names in enumerate(of)))
    df = df.withColumn("p", F.explode(each)).select("source", "reference", "p.*")
    return _grid(S.guarded(S.scored(df)), [f"struct('{'+'.join(names)}' AS pool)" for names in of])


def diag_flags_classical(spark, d):
    """The diagnostics of invented classical titles."""
    df = D.diagnosed(titles(spark, d), "frontier", "reference", CLASSICAL)
    return df.select("row_idx", *D.flags("frontier", "reference", CLASSICAL), D.primary_error().alias("primary_error"))


def pool_guarded_classical(spark, d):
    return _chosen(S.guarded(S.scored(S.pool(titles(spark, d), NAMES), CLASSICAL)), "action")


def selector_value_ablation(spark, d):
    """Five selectors side by side, in one pass: rows, exact, contaminated."""
    f = D.flags("frontier", "reference")
    rows = S.side_by_side(S.pool(pools(spark, d), NAMES), f["contamination"] | f["truncation"]).select("selector", "reference", "pred")
    return D.audit(D.diagnosed(rows, "pred", "reference"), "selector").drop("suffix_drop", "number_mismatch")


def diag_flags(spark, d):
    df = D.diagnosed(pools(spark, d), "frontier", "reference")
    return df.select("row_idx", *D.flags("frontier", "reference"), D.primary_error().alias("primary_error"), F.array_join(D.all_errors(), "|").alias("errors"))


def contamination_components(spark, d):
    return pools(spark, d).select("row_idx", D.components("unk").alias("c")).select("row_idx", "c.*")


def _systems(spark, d) -> DataFrame:
    rows = pools(spark, d).select("row_idx", "reference", F.explode(F.array(*(F.struct(F.lit(n).alias("system"), F.col(n).alias("pred")) for n in NAMES))).alias("s"))
    return rows.select("row_idx", "reference", "s.*")


def failure_taxonomy(spark, d):
    return D.taxonomy(D.diagnosed(_systems(spark, d), "pred", "reference"), "system")


def audit_summary(spark, d):
    return D.audit(D.diagnosed(_systems(spark, d), "pred", "reference"), "system")


def chrf_stats(spark, d):
    df = pools(spark, d).select("row_idx", chrf.stats("frontier", "reference").alias("stats"))
    return df.select("row_idx", *(F.get("stats", F.lit(k)).alias(f"s{k}") for k in range(24)), F.round(chrf.of_array(), 6).alias("score"))


def chrf_corpus(spark, d):
    df = _systems(spark, d).withColumn("stats", chrf.stats("pred", "reference")).withColumn("one", chrf.of_array())
    sums = df.groupBy("system").agg(F.count("*").alias("n"), F.round(F.avg("one"), 6).alias("mean_sentence"), *chrf.summed())
    return sums.select("system", "n", "mean_sentence", F.round(chrf.of_sums(), 6).alias("corpus"))


def _stats_of(spark, d, *names: str) -> DataFrame:
    df = pools(spark, d)
    for n in names:
        df = df.withColumn(f"c_{n}", chrf.stats(n, "reference"))
    return df


def oracle_best_of_two(spark, d):
    df = _stats_of(spark, d, "frontier", "dpo")
    a, b = chrf.of_array("c_frontier"), chrf.of_array("c_dpo")
    df = df.withColumn("stats", F.when(F.round(b, 9) > F.round(a, 9), F.col("c_dpo")).otherwise(F.col("c_frontier"))).withColumn("other", (F.round(b, 9) > F.round(a, 9)).cast("int"))
    return df.agg(F.count("*").alias("n"), F.sum("other").alias("from_dpo"), *chrf.summed()).select("n", "from_dpo", F.round(chrf.of_sums(), 6).alias("chrf"))


def pairwise_wins(spark, d):
    df = _systems(spark, d).withColumn("stats", chrf.stats("pred", "reference")).select("row_idx", "system", F.round(chrf.of_array(), 9).alias("f"))
    wide = df.groupBy("row_idx").agg(*(F.max(F.when(F.col("system") == n, F.col("f"))).alias(n) for n in NAMES))
    pairs = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]]
    rows = wide.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs))).alias("p")).select("p.*")
    return rows.groupBy("a", "b").agg(F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") == F.col("y")).alias("ties"), F.count_if(F.col("x") < F.col("y")).alias("losses"))


def exact_overlap(spark, d):
    a, b = F.col("frontier") == F.col("reference"), F.col("dpo") == F.col("reference")
    return pools(spark, d).agg(F.count_if(a | b).alias("either"), F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"), F.count_if(a & b).alias("both"))


def agreement_regions(spark, d):
    same = (F.col("unk") == F.col("dpo")).alias("same_prediction")
    return pools(spark, d).groupBy(same).agg(F.count("*").alias("n"), F.count_if(F.col("unk") == F.col("reference")).alias("exact"))


def subset_report(spark, d):
    """Overlapping groups: all, by suffix, by length bin."""
    n = F.length("reference")
    groups = F.array_compact(F.array(F.lit("all"), F.when(F.instr(F.lit("ensdt"), F.right("reference", F.lit(1))) > 0, "suffix").otherwise("no_suffix"), F.when(n <= 15, "short").when(n <= 19, "medium").otherwise("long")))
    df = D.diagnosed(pools(spark, d), "frontier", "reference").withColumn("subset", F.explode(groups))
    return df.groupBy("subset").agg(F.count("*").alias("n"), F.sum("exact").alias("exact"), F.sum("contamination").alias("contamination"), F.round(F.avg(F.length("frontier")), 6).alias("mean_length"))


def qualitative_cases(spark, d):
    """The first row of each kind of case."""
    df = D.diagnosed(pools(spark, d), "frontier", "reference").withColumn("primary_error", D.primary_error())
    return df.groupBy("primary_error").agg(F.min_by(F.struct("row_idx", "frontier", "reference"), "row_idx").alias("c")).select("primary_error", "c.*")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        selector_summary, pool_scored, pool_guarded, pool_score_max, pool_title_guard, pool_vote, pool_mbr, pool_contamination_guard, pool_audit_preserving, pool_two_way, pool_basis, pool_labels, pool_hints,
        selector_actions, selector_sensitivity, pool_ablation, diag_flags_classical, pool_guarded_classical, selector_value_ablation, diag_flags, contamination_components, failure_taxonomy, audit_summary, chrf_stats, chrf_corpus,
        oracle_best_of_two, pairwise_wins, exact_overlap, agreement_regions, subset_report, qualitative_cases,
    )
}

_SYSTEMS = "sys AS (SELECT row_idx, reference, system, CASE system WHEN 'frontier' THEN frontier WHEN 'unk' THEN unk ELSE dpo END AS pred FROM pool0, (VALUES ('frontier'), ('unk'), ('dpo')) AS v(system))"
_PICK = "SELECT row_idx, name, pred FROM scored QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY {order}) = 1"


def _mbr(members: str = "members") -> str:
    """mbr(row_idx, name, pred) over members."""
    return f"""pairs AS (SELECT a.row_idx * 100 + a.pos * 10 + b.pos AS id, a.row_idx, a.pos AS i, a.pred AS h, b.pred AS r FROM {members} a JOIN {members} b ON a.row_idx = b.row_idx AND a.pos <> b.pos),
{chrf_sql("pairs")},
means AS (SELECT row_idx, i, round(avg({score_sql()}), 9) AS mean FROM pairs JOIN stats USING (id) GROUP BY 1, 2),
mbr AS (SELECT m.row_idx, name, pred FROM {members} m LEFT JOIN means ON m.row_idx = means.row_idx AND i = pos
  QUALIFY row_number() OVER (PARTITION BY m.row_idx ORDER BY coalesce(mean, 100) DESC, (name = 'frontier')::INT DESC, pos) = 1)"""


_CLEAN = "clean AS (SELECT * FROM members WHERE NOT regexp_matches(pred, '[<>]|\\[UNK\\]'))"
_GUARD = "guard AS (SELECT f.row_idx, CASE WHEN NOT f.dirty THEN f.pred ELSE coalesce(mbr.pred, f.pred) END AS pred FROM (SELECT * FROM scored WHERE name = 'frontier') f LEFT JOIN mbr USING (row_idx))"
_TITLE = "title AS (SELECT row_idx, pred FROM scored QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY score - 75 * (name = 'frontier')::INT DESC, (name = 'frontier')::INT DESC, pos) = 1)"
_FLAGS = {n: f"flag_{n} AS (SELECT *, {flags_sql('pred', 'reference')} FROM {n})" for n in ("sys",)}


def _summed(names: str = "stats") -> str:
    return ", ".join(f"sum(s{k}) AS s{k}" for k in range(24))


def _ablation() -> str:
    parts = []
    for names in (["frontier", "unk"], ["frontier", "dpo"], ["unk", "dpo"], NAMES):
        inside = SCORED_SQL.replace("AS v(pos, name)),", f"AS v(pos, name) WHERE name IN ({', '.join(repr(n) for n in names)})),", 1)
        if "frontier" in names:
            tail = f"{guarded_sql()} SELECT '{'+'.join(names)}' AS pool, count(*) FILTER (pred = reference) AS exact, count(*) FILTER (action <> 'keep_frontier') AS switches FROM choice JOIN pool0 USING (row_idx)"
        else:
            tail = f"l AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY score DESC, pos) = 1) SELECT '{'+'.join(names)}' AS pool, count(*) FILTER (pred = reference) AS exact, count(*) AS switches FROM l JOIN pool0 USING (row_idx)"
        parts.append(f"(WITH {inside}, {tail})")
    return " UNION ALL ".join(parts)


def _sensitivity() -> str:
    parts = []
    for title in (0, 250, 500):
        for margin in (0, 300, 600):
            parts.append(f"(WITH {SCORED_SQL.replace('250 * title', f'{title} * title')}, {guarded_sql(margin)} SELECT {title} AS title, {margin} AS margin, count(*) FILTER (action <> 'keep_frontier') AS switches, count(*) FILTER (pred = reference) AS exact FROM choice JOIN pool0 USING (row_idx))")
    return " UNION ALL ".join(parts)


_ALL = f"{POOL_SQL}, {_SYSTEMS}, every AS (SELECT row_idx * 10 + CASE system WHEN 'frontier' THEN 0 WHEN 'unk' THEN 1 ELSE 2 END AS id, system, row_idx, pred AS h, reference AS r FROM sys), {chrf_sql('every')}, f AS (SELECT id, row_idx, system, round({score_sql()}, 9) AS f, stats.* EXCLUDE (id) FROM every JOIN stats USING (id))"
_FIVE = "contamination + suffix_drop + number_mismatch + over_expansion + truncation"
_AUDIT = f"count(*) AS n, sum({_FIVE})::BIGINT AS audit_flags, sum((({_FIVE}) > 0)::INT)::BIGINT AS flagged_rows"
_FLAG_NAMES = "exact, contamination, truncation, over_expansion, suffix_drop, number_mismatch, over_modernization, narrativization, false_specificity, substitution"

ORACLES: dict[str, str] = {
    "pool_scored": f"WITH {SCORED_SQL} SELECT row_idx, med::INT AS median_length, pos, name, pred, length::INT AS length, consensus::INT AS consensus, title, dirty, short, long, score FROM scored",
    "pool_guarded": f"WITH {SCORED_SQL}, {guarded_sql()} SELECT row_idx, name, pred, action FROM choice",
    "pool_score_max": f"WITH {SCORED_SQL} {_PICK.format(order="score DESC, (name = 'frontier')::INT DESC, pos")}",
    "pool_title_guard": f"WITH {SCORED_SQL} {_PICK.format(order="score - 75 * (name = 'frontier')::INT DESC, (name = 'frontier')::INT DESC, pos")}",
    "pool_vote": f"WITH {SCORED_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY row_idx, pred) AS votes FROM scored) SELECT row_idx, name, pred FROM c QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY votes DESC, (name = 'frontier')::INT DESC, pos) = 1",
    "diag_flags_classical": f"WITH {TITLES_SQL}, f AS (SELECT row_idx, {flags_sql('frontier', 'reference', CLASSICAL)} FROM pool0) SELECT row_idx, {_FLAG_NAMES}, {PRIMARY_SQL} AS primary_error FROM f",
    "pool_guarded_classical": f"WITH {SCORED_TITLES_SQL}, {guarded_sql()} SELECT row_idx, name, pred, action FROM choice",
    "pool_mbr": f"WITH {SCORED_SQL}, {_mbr()} SELECT row_idx, name, pred FROM mbr",
    "pool_contamination_guard": f"WITH {SCORED_SQL}, {_CLEAN}, {_mbr('clean')}, {_GUARD} SELECT row_idx, pred FROM guard",
    "pool_audit_preserving": f"WITH {SCORED_SQL}, {guarded_sql()}, {_mbr()}, fl AS (SELECT row_idx, {flags_sql('frontier', 'reference')} FROM pool0) SELECT row_idx, CASE WHEN contamination + truncation > 0 THEN 'repair' ELSE action END AS action, CASE WHEN contamination + truncation > 0 THEN mbr.pred ELSE choice.pred END AS pred FROM choice JOIN mbr USING (row_idx) JOIN fl USING (row_idx)",
    "pool_two_way": f"""WITH {POOL_SQL}, t AS (SELECT row_idx, frontier AS a, dpo AS b, regexp_matches(frontier, '[<>]|\\[UNK\\]') AS ad, regexp_matches(dpo, '[<>]|\\[UNK\\]') AS bd,
      regexp_matches(dpo, '^(?s).*' || array_to_string(list_transform(string_split(frontier, ''), lambda c: regexp_escape(c)), '.*')) AS sub FROM pool0),
      z AS (SELECT *, CASE WHEN ad AND NOT bd THEN 'default_dirty' WHEN length(a) <= 3 AND length(b) > length(a) AND NOT bd AND sub THEN 'repair' ELSE 'default' END AS reason FROM t)
      SELECT row_idx, CASE WHEN reason = 'default' THEN a ELSE b END AS pred, reason FROM z""",
    "pool_basis": f"WITH {SCORED_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY row_idx, pred) AS votes FROM scored), w AS (SELECT row_idx, pred FROM c QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY votes DESC, (name = 'frontier')::INT DESC, pos) = 1) SELECT row_idx, m.name AS basis FROM w JOIN members m USING (row_idx, pred) QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY (m.name = 'frontier')::INT DESC, m.pos) = 1",
    "pool_labels": f"WITH {SCORED_SQL}, u AS (SELECT row_idx, pred, min(pos) AS pos FROM members GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY pos) AS k FROM u) SELECT row_idx, string_agg(substr('ABC', k, 1) || ': ' || pred, chr(10) ORDER BY k) AS labels FROM n GROUP BY 1",
    "pool_hints": f"WITH {SCORED_SQL}, u AS (SELECT DISTINCT row_idx, pred FROM members), p AS (SELECT a.row_idx, a.pred AS x, b.pred AS y FROM u a JOIN u b ON a.row_idx = b.row_idx AND a.pred < b.pred), h AS (SELECT row_idx, left(x, {prefix_sql('x', 'y')}) AS h FROM p UNION SELECT row_idx, right(x, {prefix_sql('reverse(x)', 'reverse(y)')}) FROM p) SELECT pool0.row_idx, coalesce(string_agg(h, chr(10) ORDER BY h) FILTER (length(h) >= 2), '') AS hints FROM pool0 LEFT JOIN h USING (row_idx) GROUP BY 1",
    "selector_summary": f"""WITH {SCORED_SQL}, {guarded_sql()}, c AS (SELECT row_idx AS id, action, pred AS h, reference AS r, pred, reference FROM choice JOIN pool0 USING (row_idx)), {chrf_sql("c")}, fl AS (SELECT *, {flags_sql('pred', 'reference')} FROM c), t AS (SELECT {_summed()} FROM stats)
      SELECT count(*) AS n, sum(exact)::BIGINT AS exact, sum(contamination)::BIGINT AS contaminated, count(*) FILTER (action <> 'keep_frontier') AS switches, round(sum(length(pred)) / greatest(1, sum(length(reference))), 6) AS length_ratio,
      sum(suffix_drop)::BIGINT AS suffix_errors, sum(over_expansion)::BIGINT AS over_expansion, (SELECT round({score_sql()}, 6) FROM t) AS chrf FROM fl""",
    "selector_actions": f"WITH {SCORED_SQL}, {guarded_sql()} SELECT action, name, count(*) AS n FROM choice GROUP BY 1, 2",
    "selector_sensitivity": _sensitivity(),
    "pool_ablation": _ablation(),
    "selector_value_ablation": f"""WITH {SCORED_SQL}, {guarded_sql()}, {_mbr()}, {_TITLE}, fl AS (SELECT row_idx, {flags_sql('frontier', 'reference')} FROM pool0),
      {_CLEAN}, guard AS (SELECT g.* FROM (WITH x AS (SELECT 1) SELECT row_idx, pred FROM contam) g),
      every AS (SELECT row_idx, pred, 'mbr' AS selector FROM mbr UNION ALL SELECT row_idx, pred, 'contamination' FROM guard UNION ALL SELECT row_idx, pred, 'title' FROM title UNION ALL SELECT row_idx, pred, 'sparse' FROM choice
        UNION ALL SELECT row_idx, CASE WHEN contamination + truncation > 0 THEN mbr.pred ELSE choice.pred END, 'audit' FROM choice JOIN mbr USING (row_idx) JOIN fl USING (row_idx)),
      flagged2 AS (SELECT selector, {flags_sql('pred', 'reference')} FROM every JOIN pool0 USING (row_idx))
      SELECT selector, {_AUDIT}, sum(contamination)::BIGINT AS contamination, sum(over_expansion)::BIGINT AS over_expansion, sum(truncation)::BIGINT AS truncation FROM flagged2 GROUP BY 1""".replace("SELECT row_idx, pred FROM contam) g", f"SELECT row_idx, pred FROM (WITH {SCORED_SQL}, {_CLEAN}, {_mbr('clean')}, {_GUARD} SELECT * FROM guard)) g"),
    "diag_flags": f"WITH {POOL_SQL}, fl AS (SELECT row_idx, {flags_sql('frontier', 'reference')} FROM pool0) SELECT row_idx, {_FLAG_NAMES}, {PRIMARY_SQL} AS primary_error, concat_ws('|', CASE WHEN contamination = 1 THEN 'contamination' END, CASE WHEN truncation = 1 THEN 'truncation' END, CASE WHEN over_expansion = 1 THEN 'over_expansion' END, CASE WHEN suffix_drop = 1 THEN 'suffix_drop' END, CASE WHEN number_mismatch = 1 THEN 'number_mismatch' END) AS errors FROM fl",
    "contamination_components": f"WITH {POOL_SQL} SELECT row_idx, regexp_matches(unk, '[A-Za-z]')::INT AS ascii, regexp_matches(unk, '[<>]')::INT AS angle, contains(unk, '[UNK]')::INT AS unk, regexp_matches(unk, '(?:translation|analysis)')::INT AS artifact FROM pool0",
    "failure_taxonomy": f"WITH {POOL_SQL}, {_SYSTEMS}, {_FLAGS['sys']}, p AS (SELECT system, {PRIMARY_SQL} AS e FROM flag_sys) SELECT system, " + ", ".join(f"count(*) FILTER (e = '{x}') AS {x}" for x in ("exact", *D.PRIMARY, "content_drift")) + ", count(*) FILTER (e IN ('suffix_drop', 'number_mismatch')) AS suffix_or_number FROM p GROUP BY 1",
    "audit_summary": f"WITH {POOL_SQL}, {_SYSTEMS}, {_FLAGS['sys']} SELECT system, {_AUDIT}, sum(contamination)::BIGINT AS contamination, sum(suffix_drop)::BIGINT AS suffix_drop, sum(number_mismatch)::BIGINT AS number_mismatch, sum(over_expansion)::BIGINT AS over_expansion, sum(truncation)::BIGINT AS truncation FROM flag_sys GROUP BY 1",
    "chrf_stats": f"WITH {POOL_SQL}, one AS (SELECT row_idx AS id, frontier AS h, reference AS r FROM pool0), {chrf_sql('one')} SELECT id AS row_idx, stats.* EXCLUDE (id), round({score_sql()}, 6) AS score FROM stats",
    "chrf_corpus": f"WITH {_ALL}, t AS (SELECT system, count(*) AS n, round(avg(f), 6) AS mean_sentence, {_summed()} FROM f GROUP BY 1) SELECT system, n, mean_sentence, round({score_sql()}, 6) AS corpus FROM t",
    "oracle_best_of_two": f"WITH {_ALL}, a AS (SELECT * FROM f WHERE system = 'frontier'), b AS (SELECT * FROM f WHERE system = 'dpo'), w AS (SELECT row_idx, b.f > a.f AS other FROM a JOIN b USING (row_idx)), t AS (SELECT count(*) AS n, sum(other::INT)::BIGINT AS from_dpo, {_summed()} FROM w JOIN f ON f.row_idx = w.row_idx AND f.system = CASE WHEN other THEN 'dpo' ELSE 'frontier' END) SELECT n, from_dpo, round({score_sql()}, 6) AS chrf FROM t",
    "pairwise_wins": f"WITH {_ALL} SELECT x.system AS a, y.system AS b, count(*) FILTER (x.f > y.f) AS wins, count(*) FILTER (x.f = y.f) AS ties, count(*) FILTER (x.f < y.f) AS losses FROM f x JOIN f y ON x.row_idx = y.row_idx AND x.id < y.id GROUP BY 1, 2",
    "exact_overlap": f"WITH {POOL_SQL}, z AS (SELECT frontier = reference AS a, dpo = reference AS b FROM pool0) SELECT count(*) FILTER (a OR b) AS either, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, count(*) FILTER (a AND b) AS both FROM z",
    "agreement_regions": f"WITH {POOL_SQL} SELECT unk = dpo AS same_prediction, count(*) AS n, count(*) FILTER (unk = reference) AS exact FROM pool0 GROUP BY 1",
    "subset_report": f"WITH {POOL_SQL}, fl AS (SELECT *, {flags_sql('frontier', 'reference')} FROM pool0), g AS (SELECT *, unnest(['all', CASE WHEN instr('ensdt', right(reference, 1)) > 0 THEN 'suffix' ELSE 'no_suffix' END, CASE WHEN length(reference) <= 15 THEN 'short' WHEN length(reference) <= 19 THEN 'medium' ELSE 'long' END]) AS subset FROM fl) SELECT subset, count(*) AS n, sum(exact)::BIGINT AS exact, sum(contamination)::BIGINT AS contamination, round(avg(length(frontier)), 6) AS mean_length FROM g GROUP BY 1",
    "qualitative_cases": f"WITH {POOL_SQL}, fl AS (SELECT *, {flags_sql('frontier', 'reference')} FROM pool0), p AS (SELECT *, {PRIMARY_SQL} AS primary_error FROM fl) SELECT primary_error, row_idx, frontier, reference FROM p QUALIFY row_number() OVER (PARTITION BY primary_error ORDER BY row_idx) = 1",
}
