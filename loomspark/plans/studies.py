"""Queries of studies: pools of candidates by selector settings, reward designs and the audit of preferences against gold targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import chrf, matching
from loomspark.functions.charsets import LATIN
from loomspark.operators import corpora as C
from loomspark.operators import dictionary as D
from loomspark.operators import selectors as S

from .common import POOL, REF, SCORED_SQL, Query, chrf_sql, matched_sql, parts, score_sql, table

#: A fourth system beside those of the pools.
MTSFT = f"CASE p_partkey % 5 WHEN 0 THEN {REF} WHEN 1 THEN '' WHEN 2 THEN p_name || ' ' || p_brand WHEN 3 THEN p_type ELSE {REF} || ' and more of it' END"
STUDY = {k: v for k, v in POOL.items() if k != "dpo"} | {"mtsft": MTSFT, "dpo": POOL["dpo"]}
POOLS = {
    "frontier": ["frontier"],
    "frontier+unk": ["frontier", "unk"],
    "frontier+mtsft": ["frontier", "mtsft"],
    "frontier+dpo": ["frontier", "dpo"],
    "frontier+unk+dpo": ["frontier", "unk", "dpo"],
}
SETTINGS = [
    {"name": "default_guarded"},
    {"name": "score_max", "mode": "score_max"},
    *({"name": f"frontier_prior_{x / 100}", "prior": x} for x in (0, 25, 150)),
    *({"name": f"switch_margin_{x / 100}", "margin": x} for x in (200, 400)),
    *({"name": f"title_bonus_{x / 100}", "title": x} for x in (150, 350)),
]


def selector_grid(spark, d):
    """Five pools by nine settings in one pass: exact, contaminated and switched rows, length ratio, kept suffixes."""
    df = parts(spark, d).selectExpr(*(f"{e} AS {n}" for n, e in STUDY.items()))
    rows = S.studied(df, POOLS, SETTINGS).withColumn("pred", F.coalesce("chosen.pred", F.lit("")))
    suffixes = F.filter(F.split(F.lit(",".join(LATIN.suffixes)), ","), lambda c: F.col("reference").contains(c))
    kept = F.forall(suffixes, lambda c: F.col("pred").contains(c))
    return rows.groupBy("pool", "setting").agg(
        F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("reference")).alias("exact"), F.count_if(F.col("pred").rlike(LATIN.contamination)).alias("contaminated"),
        F.count_if("switched").alias("switched"), F.round(F.sum(F.length("pred")) / F.greatest(F.lit(1), F.sum(F.length("reference"))), 6).alias("length_ratio"),
        F.count_if(F.size(suffixes) > 0).alias("with_suffix"), F.count_if((F.size(suffixes) > 0) & kept).alias("suffix_kept"),
    )


PROMPT = "'Translate.' || chr(10) || p_name || ' ' || p_size"
OUTPUT = "CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || p_brand ELSE '<literal> ' || p_type || ' ' || p_name || '</literal> ' || p_name || ' ' || p_brand || '  ' END"
#: Rewards in hundredths from a hash, so that gaps meet the ends of bins; some are not finite.
REWARD = "CASE WHEN p_partkey % 41 = 0 THEN double('nan') WHEN p_partkey % 43 = 0 THEN double('inf') ELSE (p_partkey * {a} % 101) / 100.0D END"


def _preferences(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey AS id", f"{PROMPT} AS prompt", "p_name AS input", f"{POOL['frontier']} AS chosen", f"CASE WHEN p_partkey % 5 = 0 THEN {POOL['frontier']} ELSE {POOL['dpo']} END AS rejected",
        f"{REWARD.format(a=37)} AS chosen_reward", f"{REWARD.format(a=53)} AS rejected_reward")


def _records(spark, d, rule: str):
    return table(spark, d, "part").where(rule).selectExpr("p_partkey AS `order`", f"{PROMPT} AS prompt", f"{OUTPUT} AS output")


def reward_designs(spark, d):
    """Five designs of the reward over the pairs whose prompt is among the training records."""
    known = C.looked_up(_preferences(spark, d), [_records(spark, d, "p_partkey % 7 = 1"), _records(spark, d, "p_partkey % 2 = 0")], "output").where("output is not null")
    literal, final = C.targets("output")
    pairs = known.withColumn("literal", literal).withColumn("gold", final)
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("text")) for s in ("chosen", "rejected")))).alias("s")
    texts = pairs.select("id", "input", sides).select(F.struct("id", "s.side").alias("id"), F.split("input", " ").alias("words"), F.split("s.text", " ").alias("tokens"))
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("key")).distinct().where("ascii(key) % 4 > 0").select("key", F.array(F.col("key"), F.concat("key", F.lit("s"))).alias("meanings"))
    lex = D.coverage(texts, words).select("id.id", "id.side", "coverage").groupBy("id").agg(*(F.max(F.when(F.col("side") == s, F.col("coverage"))).alias(f"{s}_lex") for s in ("chosen", "rejected")))
    four = [(f"{s}_{name}", s, target) for s in ("chosen", "rejected") for name, target in (("literal", "literal"), ("final", "gold"))]
    long = pairs.select("id", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(s).alias("text"), F.col(t).alias("target")) for n, s, t in four))).alias("x"))
    scores = long.select("id", "x.name", chrf.stats("x.text", "x.target").alias("stats")).select("id", "name", (chrf.of_array() / 100).alias("score"))
    scores = scores.groupBy("id").agg(*(F.max(F.when(F.col("name") == n, F.col("score"))).alias(n) for n, _, _ in four))
    pairs = pairs.withColumns({f"{s}_match": F.round(matching.similarity(s, "gold"), 9) for s in ("chosen", "rejected")}).join(scores.hint("merge"), "id")
    out = C.designed(pairs.join(lex.hint("merge"), "id"))
    return out.select("design", *(F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes[1:]))


def gold_audit(spark, d):
    """Pairs by bins of their reward gap, held against the gold target: the last training record of the prompt."""
    known = C.looked_up(_preferences(spark, d), [_records(spark, d, "p_partkey % 7 = 1"), _records(spark, d, "p_partkey % 2 = 0")], "gold", first=False)
    out = C.gold_audited(known.withColumns({f"{s}_match": F.round(matching.similarity(s, "gold"), 9) for s in ("chosen", "rejected")}))
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes))


QUERIES: dict[str, Query] = {f.__name__: f for f in (selector_grid, reward_designs, gold_audit)}


def _grid() -> str:
    """The scores of all pools at once, then a product a setting."""
    members = "FROM pool0, (VALUES (0, 'frontier'), (1, 'unk'), (2, 'dpo')) AS v(pos, name))"
    own = "FROM pool0, (VALUES (0, 'frontier'), (1, 'unk'), (2, 'mtsft'), (3, 'dpo')) AS v(pos, name) WHERE list_contains(names, name) AND (name <> 'mtsft' OR mtsft <> ''))"
    start = f"raw AS (SELECT {', '.join(f'{e} AS {n}' for n, e in STUDY.items())} FROM part), pools_(pool, k, names) AS (VALUES {', '.join(f'({name!r}, {k}, {list(m)!r})' for k, (name, m) in enumerate(POOLS.items()))}),\npool0 AS (SELECT raw.* EXCLUDE (row_idx), row_idx * 10 + k AS row_idx, pool, names FROM raw, pools_)"
    scored = SCORED_SQL[SCORED_SQL.index("members AS") :]
    assert members in scored
    scored = scored.replace(members, own).replace("WHEN 1 THEN unk ELSE dpo END", "WHEN 1 THEN unk WHEN 2 THEN mtsft ELSE dpo END")
    default = {"title": 250, "prior": 75, "margin": 300, "mode": "guarded"}
    rows = ", ".join("({name!r}, {mode!r}, {title}, {prior}, {margin})".format(**(default | x)) for x in SETTINGS)
    return f"""WITH {start}, {scored}, settings(setting, mode, w_title, w_prior, margin) AS (VALUES {rows}),
s AS (SELECT scored.* EXCLUDE (score), setting, mode, margin, score + (w_title - 250) * title::INT + (w_prior - 75) * (name = 'frontier')::INT AS score FROM scored, settings),
f AS (SELECT * FROM s WHERE name = 'frontier'),
l AS (SELECT * FROM s WHERE name <> 'frontier' QUALIFY row_number() OVER (PARTITION BY row_idx, setting ORDER BY score DESC, pos) = 1),
top AS (SELECT row_idx, setting, name, pred FROM s QUALIFY row_number() OVER (PARTITION BY row_idx, setting ORDER BY score DESC, (name = 'frontier')::INT DESC, pos) = 1),
g AS (SELECT f.row_idx, f.setting, f.mode, coalesce((f.dirty AND NOT l.dirty) OR (f.length <= 1 AND l.length >= 3) OR (l.score - f.score >= f.margin AND l.consensus >= f.consensus + 2 AND NOT l.short AND NOT l.dirty AND (l.title OR NOT f.title))
  OR (f.long AND NOT l.long AND l.consensus >= 2 AND l.length + 2 <= f.length), false) AS local, f.pred AS fp, l.pred AS lp, l.name AS ln FROM f LEFT JOIN l USING (row_idx, setting)),
c AS (SELECT g.row_idx, g.setting, CASE WHEN mode = 'score_max' THEN top.name WHEN local THEN ln ELSE 'frontier' END AS name, CASE WHEN mode = 'score_max' THEN top.pred WHEN local THEN lp ELSE fp END AS pred FROM g JOIN top USING (row_idx, setting)),
e AS (SELECT c.*, pool, reference, list_filter(string_split('{','.join(LATIN.suffixes)}', ','), lambda x: contains(reference, x)) AS need FROM c JOIN pool0 USING (row_idx))
SELECT pool, setting, count(*) AS n, count(*) FILTER (pred = reference) AS exact, count(*) FILTER (regexp_matches(pred, '{LATIN.contamination}')) AS contaminated, count(*) FILTER (name <> 'frontier') AS switched,
  round(sum(length(pred)) / greatest(1, sum(length(reference))), 6) AS length_ratio, count(*) FILTER (len(need) > 0) AS with_suffix, count(*) FILTER (len(need) > 0 AND len(list_filter(need, lambda x: NOT contains(pred, x))) = 0) AS suffix_kept
FROM e GROUP BY 1, 2"""


_REWARD_SQL = REWARD.replace("double('nan')", "'nan'::DOUBLE").replace("double('inf')", "'inf'::DOUBLE").replace("100.0D", "100.0::DOUBLE")
_OK = "(isfinite(chosen_reward) AND isfinite(rejected_reward))"


def _pairs_sql(order: str) -> str:
    """p(id, ..., output): preferences with the first or last record of their prompt."""
    return f"""rec AS (SELECT k, p_partkey AS o, {PROMPT} AS prompt, {OUTPUT} AS output FROM part, (VALUES (0), (1)) AS v(k) WHERE CASE k WHEN 0 THEN p_partkey % 7 = 1 ELSE p_partkey % 2 = 0 END),
known AS (SELECT prompt, output FROM rec QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY k {order}, o {order}) = 1),
p AS (SELECT * FROM (SELECT p_partkey AS id, {PROMPT} AS prompt, p_name AS input, {POOL['frontier']} AS chosen, CASE WHEN p_partkey % 5 = 0 THEN {POOL['frontier']} ELSE {POOL['dpo']} END AS rejected,
  {_REWARD_SQL.format(a=37)} AS chosen_reward, {_REWARD_SQL.format(a=53)} AS rejected_reward FROM part) LEFT JOIN known USING (prompt))"""


def _designs() -> str:
    has = "regexp_matches(output, '(?s)<literal>.*?</literal>')"
    part = lambda k: f"trim(CASE WHEN {has} THEN regexp_extract(output, '(?s)<literal>(.*?)</literal>\\s*(.*)$', {k}) ELSE output END)"
    rewards = {"current_lex_ppl": "chosen_reward, rejected_reward", "lex_only": "cl, rl", "literal_chrf": "c0, r0", "lex_plus_literal": "0.5::DOUBLE * cl + 0.5::DOUBLE * c0, 0.5::DOUBLE * rl + 0.5::DOUBLE * r0", "oracle_final_chrf": "c1, r1"}
    union = " UNION ALL ".join(f"SELECT '{n}' AS design, cur, better, x - y AS gap FROM (SELECT chosen_reward - rejected_reward AS cur, cm - rm AS better, {v.replace(', ', ' AS x, ', 1)} AS y FROM m)" for n, v in rewards.items())
    kept = lambda t: f"(gap >= {t} AND NOT isnan(gap))"
    one = "max(CASE WHEN id % 4 = {k} THEN f END) AS {n}"
    return f"""WITH RECURSIVE {_pairs_sql('ASC')}, q AS (SELECT *, {part(1)} AS literal, {part(2)} AS gold FROM p WHERE output IS NOT NULL),
every AS (SELECT id * 4 + 2 * side + t AS id, CASE side WHEN 0 THEN chosen ELSE rejected END AS h, CASE t WHEN 0 THEN literal ELSE gold END AS r FROM q, (VALUES (0), (1)) AS a(side), (VALUES (0), (1)) AS b(t)),
{chrf_sql('every')}, scores AS (SELECT id, {score_sql()} / 100 AS f FROM stats),
wide AS (SELECT id // 4 AS id, {one.format(k=0, n='c0')}, {one.format(k=1, n='c1')}, {one.format(k=2, n='r0')}, {one.format(k=3, n='r1')} FROM scores GROUP BY 1),
src AS (SELECT chosen AS a, gold AS b FROM q UNION SELECT rejected, gold FROM q), {matched_sql('src')},
dict AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE ascii(w) % 4 > 0),
lx AS (SELECT id, avg((list_contains(string_split(chosen, ' '), w) OR list_contains(string_split(chosen, ' '), w || 's'))::INT) AS cl, avg((list_contains(string_split(rejected, ' '), w) OR list_contains(string_split(rejected, ' '), w || 's'))::INT) AS rl
  FROM (SELECT id, chosen, rejected, unnest(string_split(input, ' ')) AS w FROM q) JOIN dict USING (w) GROUP BY 1),
m AS (SELECT q.*, wide.* EXCLUDE (id), coalesce(cl, 0) AS cl, coalesce(rl, 0) AS rl, round(u.ratio, 9) AS cm, round(v.ratio, 9) AS rm FROM q JOIN wide USING (id) LEFT JOIN lx USING (id) JOIN ratios u ON u.a = chosen AND u.b = gold JOIN ratios v ON v.a = rejected AND v.b = gold),
g AS ({union})
SELECT design, count(*) AS pairs, round(count(*) FILTER (better > 0) / count(*), 6) AS chosen_better, round(count(*) FILTER (better < 0) / count(*), 6) AS rejected_better, round(count(*) FILTER (better = 0) / count(*), 6) AS equal,
  round(avg(gap) FILTER (isfinite(gap)), 6) AS mean_gap, count(*) FILTER ({kept(0.2)}) AS kept_02, count(*) FILTER ({kept(0.4)}) AS kept_04,
  round(count(*) FILTER ({kept(0.2)} AND better > 0) / nullif(count(*) FILTER ({kept(0.2)}), 0), 6) AS good_02, round(count(*) FILTER ({kept(0.4)} AND better > 0) / nullif(count(*) FILTER ({kept(0.4)}), 0), 6) AS good_04,
  count(*) FILTER (isfinite(gap) AND isfinite(cur) AND (gap >= 0) <> (cur >= 0)) AS flips FROM g GROUP BY 1"""


def _audit() -> str:
    return f"""WITH RECURSIVE {_pairs_sql('DESC')}, src AS (SELECT chosen AS a, output AS b FROM p WHERE output IS NOT NULL UNION SELECT rejected, output FROM p WHERE output IS NOT NULL), {matched_sql('src')},
m AS (SELECT chosen = rejected AS same, {_OK} AS ok, CASE WHEN {_OK} THEN chosen_reward - rejected_reward END AS gap, CASE WHEN {_OK} THEN round(u.ratio, 9) - round(v.ratio, 9) END AS better
  FROM p LEFT JOIN ratios u ON u.a = chosen AND u.b = output LEFT JOIN ratios v ON v.a = rejected AND v.b = output),
n AS (SELECT *, CASE WHEN ok THEN (gap > 0.05::DOUBLE)::INT + (gap > 0.1::DOUBLE)::INT + (gap > 0.2::DOUBLE)::INT + (gap > 0.4::DOUBLE)::INT END AS bin FROM m),
e AS (SELECT * FROM n WHERE bin IS NOT NULL UNION ALL SELECT * REPLACE (NULL AS bin) FROM n)
SELECT bin, count(*) AS pairs, count(*) FILTER (same) AS same, count(*) FILTER (NOT ok) AS non_finite, round(avg(gap), 6) AS mean_gap, round(min(gap), 6) AS low, round(max(gap), 6) AS high, count(better) AS gold,
  count(*) FILTER (better > 0) AS chosen_better, count(*) FILTER (better < 0) AS rejected_better, count(*) FILTER (better = 0) AS equal, count(*) FILTER (gap <= 0.1::DOUBLE AND better IS NOT NULL) AS low_gap, count(*) FILTER (gap <= 0.1::DOUBLE AND better > 0) AS low_gap_better,
  {', '.join(f'count(*) FILTER (gap >= {x}::DOUBLE) AS ge_{int(100 * x):02d}' for x in (0.05, 0.1, 0.2, 0.3, 0.4))} FROM e GROUP BY 1"""


ORACLES: dict[str, str] = {"selector_grid": _grid(), "reward_designs": _designs(), "gold_audit": _audit()}
