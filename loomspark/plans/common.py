"""Tables, derived inputs and SQL fragments that queries and their SQL share.

The derived pool is one list of expressions that Spark and DuckDB both read, so both sides see the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.functions.charsets import CLASSICAL, LATIN, Charset

Query = Callable[[SparkSession, str], DataFrame]
REF = "p_name || ' ' || p_type"
POOL = {
    "row_idx": "p_partkey",
    "source": REF,
    "reference": REF,
    "frontier": f"CASE p_partkey % 6 WHEN 0 THEN {REF} WHEN 1 THEN substr(p_name, 1, 2) WHEN 2 THEN {REF} || ' then it is' WHEN 3 THEN '<x>' || {REF} WHEN 4 THEN p_type || ' ' || p_name ELSE p_name END",
    "unk": f"CASE p_partkey % 4 WHEN 0 THEN {REF} WHEN 1 THEN p_name || ' [UNK]' WHEN 2 THEN p_name || ' ' || p_brand ELSE {REF} || 's' END",
    "dpo": f"CASE p_partkey % 3 WHEN 0 THEN {REF} || ' extended text.' WHEN 1 THEN p_name || 'ed' ELSE {REF} END",
}
NAMES = ["frontier", "unk", "dpo"]
#: The same for invented classical titles.
TITLE = "concat(CASE p_partkey % 4 WHEN 0 THEN '山水' WHEN 1 THEN '清風' WHEN 2 THEN '三千世' ELSE '光明界' END, CASE p_partkey % 5 WHEN 0 THEN '經' WHEN 1 THEN '論' WHEN 2 THEN '義疏' WHEN 3 THEN '品第一' ELSE '' END)"
TITLES = {
    "row_idx": "p_partkey",
    "source": TITLE,
    "reference": TITLE,
    "frontier": f"CASE p_partkey % 7 WHEN 0 THEN {TITLE} WHEN 1 THEN substr({TITLE}, 1, 1) WHEN 2 THEN concat({TITLE}, '，两人在路上') WHEN 3 THEN concat('x', {TITLE}) WHEN 4 THEN concat(substr({TITLE}, 1, 2), '記') WHEN 5 THEN concat('佛說', {TITLE}, '二') ELSE concat({TITLE}, '即名為大') END",
    "unk": f"CASE p_partkey % 3 WHEN 0 THEN {TITLE} WHEN 1 THEN concat(substr({TITLE}, 1, 2), '[UNK]') ELSE concat(substr({TITLE}, 1, 2), '傳') END",
    "dpo": f"CASE p_partkey % 2 WHEN 0 THEN concat({TITLE}, '序') ELSE {TITLE} END",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df's rows over all cores: a table of a few MB is read by a task or two, however much work its rows make."""
    return df.repartition(max(32, 4 * df.sparkSession.sparkContext.defaultParallelism), *keys)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "part"), "p_partkey")


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).selectExpr(*(f"{e} AS {n}" for n, e in POOL.items()))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).selectExpr(*(f"{e} AS {n}" for n, e in TITLES.items()))


POOL_SQL = "pool0 AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in POOL.items()) + " FROM part)"


def prefix_sql(a: str, b: str) -> str:
    n = f"least(length({a}), length({b}))"
    return f"coalesce(list_min(list_filter(range(1, {n} + 1), lambda i: substr({a}, i, 1) <> substr({b}, i, 1))) - 1, {n})"


#: members(row_idx, pos, name, pred, source) and, with score in hundredths, scored.
SCORED_SQL = f"""{POOL_SQL},
members AS (SELECT row_idx, source, pos, name, trim(CASE pos WHEN 0 THEN frontier WHEN 1 THEN unk ELSE dpo END) AS pred
  FROM pool0, (VALUES (0, 'frontier'), (1, 'unk'), (2, 'dpo')) AS v(pos, name)),
med AS (SELECT row_idx, list_sort(list(length(pred)))[count(*) // 2 + 1] AS med FROM members GROUP BY 1),
pre AS (SELECT a.row_idx, a.pos, b.pred AS o, {prefix_sql("a.pred", "b.pred")} AS p, {prefix_sql("reverse(a.pred)", "reverse(b.pred)")} AS s, a.pred AS own
  FROM members a JOIN members b ON a.row_idx = b.row_idx AND a.pred <> b.pred),
con AS (SELECT row_idx, pos, sum(CASE WHEN p >= 2 THEN p ELSE 0 END) AS pre, sum(CASE WHEN s >= 2 AND right(own, s) <> left(own, p) THEN s ELSE 0 END) AS suf FROM pre GROUP BY 1, 2),
flagged AS (SELECT m.*, length(pred) AS length, med, coalesce(pre, 0) AS pre, coalesce(suf, 0) AS suf, instr('ensdt', right(pred, 1)) > 0 AS title,
  regexp_matches(pred, '[<>]|\\[UNK\\]') AS dirty, length(pred) <= greatest(1, length(source) // 4) AS short, length(pred) >= med + 5 AND length(pred) >= length(source) + 5 AS long
  FROM members m JOIN med USING (row_idx) LEFT JOIN con USING (row_idx, pos)),
scored AS (SELECT *, (pre + suf)::BIGINT AS consensus, (140 * pre + 120 * suf + 250 * title::INT - 100 * abs(length - med) - 600 * dirty::INT - 400 * short::INT - 200 * long::INT
  + 75 * (name = 'frontier')::INT)::BIGINT AS score FROM flagged)"""

TITLES_SQL = "pool0 AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in TITLES.items()) + " FROM part)"
SCORED_TITLES_SQL = SCORED_SQL.replace(POOL_SQL, TITLES_SQL).replace(f"instr('{LATIN.suffixes}'", f"instr('{CLASSICAL.suffixes}'").replace(f"'{LATIN.contamination}'", f"'{CLASSICAL.contamination}'")


def guarded_sql(margin: int = 300) -> str:
    """choice(row_idx, action, name, pred) over scored."""
    return f"""f AS (SELECT * FROM scored WHERE name = 'frontier'),
l AS (SELECT * FROM scored WHERE name <> 'frontier' QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY score DESC, pos) = 1),
acted AS (SELECT l.row_idx, CASE WHEN f.dirty AND NOT l.dirty THEN 'contamination' WHEN f.length <= 1 AND l.length >= 3 THEN 'fragment'
  WHEN l.score - f.score >= {margin} AND l.consensus >= f.consensus + 2 AND NOT l.short AND NOT l.dirty AND (l.title OR NOT f.title) THEN 'margin'
  WHEN f.long AND NOT l.long AND l.consensus >= 2 AND l.length + 2 <= f.length THEN 'length' ELSE 'keep_frontier' END AS action, f.name AS fn, f.pred AS fp, l.name AS ln, l.pred AS lp
  FROM l JOIN f USING (row_idx)),
choice AS (SELECT row_idx, action, CASE WHEN action = 'keep_frontier' THEN fn ELSE ln END AS name, CASE WHEN action = 'keep_frontier' THEN fp ELSE lp END AS pred FROM acted)"""


def flags_sql(p: str, r: str, cs: Charset = LATIN) -> str:
    """The diagnostics' flags of columns p and r, as 0/1."""
    suffixed = lambda x: f"(length({x}) > 0 AND instr('{cs.suffixes}', right({x}, 1)) > 0)"
    has = lambda needles: "(" + " OR ".join(f"contains({p}, '{n}')" for n in needles) + ")"
    news = lambda needles: "(" + " OR ".join(f"(contains({p}, '{n}') AND NOT contains({r}, '{n}'))" for n in needles) + ")"
    digits = lambda x: f"regexp_replace({x}, '[^{cs.numerals}]', '', 'g')"
    rules = {
        "exact": f"{p} = {r}",
        "contamination": f"regexp_matches({p}, '{cs.contamination}')",
        "truncation": f"length({r}) > 0 AND length({p}) <= greatest(1, length({r}) // 2)",
        "over_expansion": f"length({r}) > 0 AND length({p}) >= length({r}) + 4 AND 2 * length({p}) >= 3 * length({r})",
        "suffix_drop": f"len(list_filter(string_split('{','.join(cs.suffixes)}', ','), lambda c: contains({r}, c) AND NOT contains({p}, c))) > 0",
        "number_mismatch": f"{digits(p)} <> '' AND {digits(r)} <> '' AND {digits(p)} <> {digits(r)}",
        "over_modernization": f"{p} <> {r} AND ({has(cs.markers)} OR (length({p}) >= length({r}) + 5 AND NOT {suffixed(p)}))",
        "narrativization": f"{p} <> {r} AND length({r}) > 0 AND length({p}) >= length({r}) + 4 AND NOT {suffixed(p)} AND ({has(cs.punctuation)} OR {news(cs.subjects)} OR {news(cs.narrative)})",
        "false_specificity": news(cs.terms),
        "substitution": f"{p} <> {r} AND {prefix_sql(p, r)} >= 2 AND {suffixed(p)} AND {suffixed(r)} AND right({p}, 1) <> right({r}, 1)",
    }
    return ", ".join(f"({v})::INT AS {k}" for k, v in rules.items())


PRIMARY_SQL = "CASE WHEN exact = 1 THEN 'exact' WHEN contamination = 1 THEN 'contamination' WHEN truncation = 1 THEN 'truncation' WHEN over_expansion = 1 THEN 'over_expansion' WHEN suffix_drop = 1 THEN 'suffix_drop' WHEN number_mismatch = 1 THEN 'number_mismatch' ELSE 'content_drift' END"


def chrf_sql(source: str) -> str:
    """stats(id, s0..s23) of source(id, h, r): the 24 counts of chrF++."""
    marks = r"[!-/:-@\[-`{-~]"
    words = lambda x: f"""flatten(list_transform(list_filter(string_split(regexp_replace({x}, '\\s+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: CASE WHEN length(w) > 1 AND regexp_matches(right(w, 1), '{marks}') THEN [left(w, length(w) - 1), right(w, 1)] WHEN length(w) > 1 AND regexp_matches(left(w, 1), '{marks}') THEN [left(w, 1), substr(w, 2)] ELSE [w] END))"""
    grams = " UNION ALL ".join(
        [f"SELECT id, side, {n - 1} AS o, unnest(list_transform(range(1, length(c) - {n} + 2), lambda i: substr(c, i, {n}))) AS g FROM texts" for n in range(1, 7)]
        + [f"SELECT id, side, {5 + n} AS o, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' '))) AS g FROM texts" for n in (1, 2)]
    )
    columns = ", ".join(f"coalesce(sum({v}) FILTER (o = {o}), 0)::INT AS s{3 * o + k}" for o in range(8) for k, v in enumerate(("CASE WHEN rt > 0 THEN ht ELSE 0 END", "rt", "m")))
    return f"""texts AS (SELECT id, side, regexp_replace(x, '\\s', '', 'g') AS c, {words("x")} AS w FROM (SELECT id, 'h' AS side, h AS x FROM {source} UNION ALL SELECT id, 'r', r FROM {source})),
grams AS (SELECT id, o, g, count(*) FILTER (side = 'h') AS hc, count(*) FILTER (side = 'r') AS rc FROM ({grams}) GROUP BY 1, 2, 3),
orders AS (SELECT id, o, sum(hc) AS ht, sum(rc) AS rt, sum(least(hc, rc)) AS m FROM grams GROUP BY 1, 2),
stats AS (SELECT id, {columns} FROM {source} LEFT JOIN orders USING (id) GROUP BY id)"""


def score_sql(prefix: str = "s") -> str:
    on = [f"({prefix}{3 * o} > 0 AND {prefix}{3 * o + 1} > 0)" for o in range(8)]
    p = " + ".join(f"CASE WHEN {c} THEN {prefix}{3 * o + 2} / {prefix}{3 * o} ELSE 0.0::DOUBLE END" for o, c in enumerate(on))
    r = " + ".join(f"CASE WHEN {c} THEN {prefix}{3 * o + 2} / {prefix}{3 * o + 1} ELSE 0.0::DOUBLE END" for o, c in enumerate(on))
    n = " + ".join(f"{c}::INT" for c in on)
    return f"(CASE WHEN ({n}) > 0 AND ({p}) + ({r}) > 0 THEN 100 * 5 * (({p}) / ({n})) * (({r}) / ({n})) / (4 * (({p}) / ({n})) + (({r}) / ({n}))) ELSE 0.0 END)"


def matched_sql(source: str) -> str:
    """ratios(a, b, ratio) of source(a, b), distinct pairs of short strings: the longest common block of each part by a comparison at every two places; for WITH RECURSIVE."""
    x, y = "substr(a, i + 1, ahi - i)", "substr(b, j + 1, bhi - j)"
    n = f"least(length({x}), length({y}))"
    size = f"coalesce(list_min(list_filter(range(1, {n} + 1), lambda q: substr(a, i + q, 1) <> substr(b, j + q, 1))) - 1, {n})"
    best = f"list_max(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j: {{'k': {size}, 'i': -i, 'j': -j}}))))"
    return f"""blocks AS (SELECT *, {best} AS m FROM (SELECT a, b, 0::BIGINT AS alo, length(a)::BIGINT AS ahi, 0::BIGINT AS blo, length(b)::BIGINT AS bhi FROM {source})
  UNION ALL SELECT *, {best} AS m FROM (SELECT a, b, CASE WHEN side = 0 THEN alo ELSE m.k - m.i END AS alo, CASE WHEN side = 0 THEN -m.i ELSE ahi END AS ahi, CASE WHEN side = 0 THEN blo ELSE m.k - m.j END AS blo, CASE WHEN side = 0 THEN -m.j ELSE bhi END AS bhi
    FROM blocks, (VALUES (0), (1)) AS v(side) WHERE m.k > 0) WHERE alo < ahi AND blo < bhi),
ratios AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1 ELSE 2 * coalesce(sum(m.k), 0) / (length(a) + length(b)) END AS ratio FROM blocks GROUP BY a, b)"""
