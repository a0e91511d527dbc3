"""Queries of overlap audits and resampling: best matches of character n-grams in three pools, intervals and paired differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import chrf
from loomspark.functions import text as T
from loomspark.operators import corpora as C
from loomspark.operators import resample as R
from loomspark.operators import setjoin, statistics

from .common import NAMES, POOL_SQL, Query, chrf_sql, dealt, pools, score_sql, table

RESAMPLES, SEED = 5000, 42
PAIRS = [("frontier", "unk"), ("frontier", "dpo"), ("unk", "dpo")]
SUMS = [f"s{k}" for k in range(24)]


def leakage_chars(spark, d):
    """Of each benchmark text the highest Jaccard similarity of its character n-grams, n of 2 to 4, with any text of three pools: whole texts."""
    own = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    p = table(spark, d, "part")
    others = {
        "train": table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "text"),
        "dev": table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text")),
        "synth": p.select(F.col("p_partkey").alias("id"), T.after(F.concat(F.lit("<literal>"), "p_type", F.lit("</literal> "), "p_name")).alias("text")),
    }
    grams = lambda names: F.explode(F.array(*(F.struct(F.lit(f"{name}_{n}").alias("group"), T.char_ngrams("text", n).alias("grams")) for name in names for n in (2, 3, 4)))).alias("g")
    mine = own.select("id", grams(others)).select("id", "g.*")
    texts = {name: df.groupBy("text").agg(F.min("id").alias("id")) for name, df in others.items()}  # equal texts are cut up once
    pool = reduce(DataFrame.unionAll, (dealt(df).select("id", grams([name])).select("id", "g.*") for name, df in texts.items()))
    best = setjoin.best_jaccard(mine, pool, grouped=True)
    columns = [F.round(F.max(F.when(F.col("group") == f"{name}_{n}", F.col("best"))), 6).alias(f"{name}_{n}") for n in (2, 3, 4) for name in others]
    return best.groupBy(F.col("id").alias("item_id")).agg(*columns)


def _rows(spark, d, own_streams: bool = False) -> DataFrame:
    """system, stream, idx, chrF++ counts, exact and a mock judge's overall score of every row of the pools."""
    df = C.ranked(pools(spark, d), "row_idx", "rows", "idx")
    judged = lambda n: C.number("overall", F.lit(n), "row_idx") % 5 + 1
    members = F.array(*(F.struct(F.lit(n).alias("system"), F.lit(k if own_streams else 0).alias("stream"), F.col(n).alias("pred"), judged(n).alias("judge")) for k, n in enumerate(NAMES)))
    rows = df.select("idx", "reference", F.explode(members).alias("m")).select("idx", "m.*", (F.col("m.pred") == F.col("reference")).cast("int").alias("exact"), chrf.stats("m.pred", "reference").alias("stats"))
    return rows.select("system", "stream", "idx", "exact", "judge", F.lit(1).alias("n"), *(F.get("stats", F.lit(k)).alias(f"s{k}") for k in range(24)))


COLUMNS = ["exact", "judge", "n", *SUMS]


def _measures() -> dict:
    return {"chrf": chrf.of_sums(), "exact": F.col("exact") / F.col("n"), "judge": F.col("judge") / F.col("n")}


def _points(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("system").agg(*(F.sum(c).alias(c) for c in COLUMNS))
    return sums.select("system", F.col("n").alias("rows"), *(m.alias(name) for name, m in _measures().items()), F.col("exact").alias("hits"))


def _samples(rows: DataFrame, streams: int = 1) -> DataFrame:
    n = rows.where(F.col("system") == NAMES[0]).count()
    return R.bootstrap(rows, COLUMNS, n, RESAMPLES, SEED, streams)


def bootstrap_methods(spark, d):
    """Each system's measures with intervals of 5,000 resamples of all rows, whose draws the systems share."""
    rows = _rows(spark, d)
    ends = R.intervals(_samples(rows), ["system"], _measures())
    both = _points(rows).drop("hits").join(ends, "system")
    return both.select("system", "rows", *(F.round(c, 8).alias(c) for m in _measures() for c in (m, f"{m}_low", f"{m}_high")))


def bootstrap_pairs(spark, d):
    """Differences of pairs of systems, with intervals over the resamples that they share."""
    rows = _rows(spark, d)
    names = list(_measures())
    ends = R.intervals(R.paired(_samples(rows), PAIRS, _measures()), ["a", "b"], {m: F.col(m) for m in names})
    points = _points(rows).select("system", *names)
    a, b = (points.select(F.col("system").alias(side), F.struct(*names).alias(f"of_{side}")) for side in ("a", "b"))
    both = ends.join(a, "a").join(b, "b")  # a row a pair
    delta = lambda m: F.col(f"of_b.{m}") - F.col(f"of_a.{m}")
    return both.select("a", "b", *(F.round(c, 8).alias(name) for m in names for name, c in ((m, delta(m)), (f"{m}_low", F.col(f"{m}_low")), (f"{m}_high", F.col(f"{m}_high")))))


def bootstrap_streams(spark, d):
    """chrF++ intervals of resamples that each system draws for itself, and Wilson's of its exact matches."""
    rows = _rows(spark, d, own_streams=True)
    ends = R.intervals(_samples(rows, len(NAMES)), ["system"], {"chrf": chrf.of_sums()})
    low, high = statistics.wilson(F.col("hits"), F.col("rows"))
    points = _points(rows).select("system", "rows", "hits", "chrf", low.alias("exact_low"), high.alias("exact_high")).join(ends, "system")
    return points.select("system", "rows", "hits", *(F.round(c, 8).alias(c) for c in ("chrf", "chrf_low", "chrf_high", "exact_low", "exact_high")))


def bootstrap_delta(spark, d):
    """The paired difference of two systems' corpus chrF++ over shared resamples of all rows."""
    samples = R.paired(_samples(_rows(spark, d)), [("frontier", "dpo")], {"chrf": chrf.of_sums()})
    ends = R.intervals(samples, ["a", "b"], {"chrf": F.col("chrf")})
    mean = samples.groupBy("a", "b").agg(F.avg("chrf").alias("mean"))
    return ends.join(mean, ["a", "b"]).select(F.round("chrf_low", 8).alias("low"), F.round("chrf_high", 8).alias("high"), F.round("mean", 8).alias("mean"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (leakage_chars, bootstrap_methods, bootstrap_pairs, bootstrap_streams, bootstrap_delta)}


def _mixed(source: str, expression: str, name: str) -> str:
    """source with name, the operator's bijection of 32-bit numbers of an expression."""
    return f"""(SELECT * EXCLUDE (e, x0, x1), xor(x1, x1 >> 16) AS {name} FROM (SELECT *, (xor(x0, x0 >> 15) * {R.SECOND}) % 4294967296 AS x1 FROM
  (SELECT *, (xor(e, e >> 16) * {R.FIRST}) % 4294967296 AS x0 FROM (SELECT *, ({expression}) % 4294967296 AS e FROM {source}))))"""


def _num(seed: str, *keys: str) -> str:
    return "('0x' || substr(md5(" + " || '|' || ".join([f"'{seed}'", *(f"({k})::VARCHAR" for k in keys)]) + "), 1, 8))::BIGINT"


def _resampled(streams: int = 1) -> str:
    """rows(system, stream, idx, ...) and samples(sample, system, sums), with all draws as rows."""
    stream = "CASE system WHEN 'frontier' THEN 0 WHEN 'unk' THEN 1 ELSE 2 END"
    keys = _mixed(f"(SELECT st, s, st * {RESAMPLES} + s AS key, (SELECT count(*) FROM pool0) AS total FROM range({streams}) AS a(st), range({RESAMPLES}) AS b(s))", f"{SEED} + key", "start")
    draws = _mixed(f"(SELECT * FROM {keys}, range((SELECT count(*) FROM pool0)) AS c(j))", "start + j", "u")
    placed = f"(SELECT *, ((u * total) >> 32) // {R.BLOCK} AS block FROM {draws})"
    numbered = f"(SELECT st, s, total, start, block, row_number() OVER (PARTITION BY key, block ORDER BY j) - 1 AS number FROM {placed})"
    inner = _mixed(_mixed(numbered, f"start + block + {R.PLACE}", "own"), "own + number", "v")
    sums = ", ".join(f"sum(w * {c})::DOUBLE AS {c}" for c in COLUMNS)
    return f"""{POOL_SQL}, ranks AS (SELECT *, row_number() OVER (ORDER BY {_num('rows', 'row_idx')}, row_idx) - 1 AS idx FROM pool0),
every AS (SELECT idx * 3 + {stream} AS id, system, {stream if streams > 1 else 0} AS stream, idx, row_idx, CASE system WHEN 'frontier' THEN frontier WHEN 'unk' THEN unk ELSE dpo END AS h, reference AS r
  FROM ranks, (VALUES ('frontier'), ('unk'), ('dpo')) AS v(system)),
{chrf_sql('every')},
rows_ AS (SELECT every.*, (h = r)::INT AS exact, {_num('overall', 'system', 'row_idx')} % 5 + 1 AS judge, 1 AS n, stats.* EXCLUDE (id) FROM every JOIN stats USING (id)),
draws AS (SELECT st, s, block * {R.BLOCK} + ((v * least({R.BLOCK}, total - block * {R.BLOCK})) >> 32) AS idx FROM {inner}),
w AS (SELECT st, s, idx, count(*) AS w FROM draws GROUP BY ALL),
sums AS (SELECT s AS sample, system, {sums} FROM w JOIN rows_ ON rows_.idx = w.idx AND rows_.stream = st GROUP BY 1, 2),
samples AS (SELECT sample, system, {score_sql()} AS chrf, exact / n AS exact, judge / n AS judge FROM sums),
points AS (SELECT system, rows, hits, {score_sql()} AS chrf, hits / rows AS exact, judge / rows AS judge FROM (SELECT system, count(*) AS rows, sum(exact)::BIGINT AS hits, sum(judge) AS judge, {", ".join(f"sum({c}) AS {c}" for c in SUMS)} FROM rows_ GROUP BY 1))"""


def _ends(*names: str) -> str:
    return ", ".join(f"round(quantile_cont({m}, 0.025), 8) AS {m}_low, round(quantile_cont({m}, 0.975), 8) AS {m}_high" for m in names)


_DELTAS = "deltas AS (SELECT x.system AS a, y.system AS b, y.chrf - x.chrf AS chrf, y.exact - x.exact AS exact, y.judge - x.judge AS judge FROM samples x JOIN samples y USING (sample) WHERE (x.system, y.system) IN (('frontier', 'unk'), ('frontier', 'dpo'), ('unk', 'dpo')))"


def _wilson(sign: int) -> str:
    z = 1.96
    p = "(hits / rows)"
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({p} + {z * z}::DOUBLE / (2 * rows) + {sign} * {z}::DOUBLE * sqrt(({p} * (1 - {p}) + {z * z}::DOUBLE / (4 * rows)) / rows)) / (1 + {z * z}::DOUBLE / rows)))"


def _leaks() -> str:
    """One column a pool and n, from the number of n-grams that each two texts share."""
    sides = {"train": "SELECT row_number() OVER () AS id, text FROM conversations", "dev": "SELECT o_orderkey AS id, o_orderpriority || ' ' || o_orderstatus AS text FROM orders", "synth": "SELECT p_partkey AS id, p_name AS text FROM part"}
    grams = lambda source, n: f"SELECT DISTINCT id, substr(text, i, {n}) AS g FROM ({source}), unnest(range(1, length(text) - {n} + 2)) AS t(i)"
    ctes, columns, joins = [], [], []
    for n in (2, 3, 4):
        ctes.append(f"own{n} AS ({grams('SELECT item_id AS id, text FROM benchmark', n)}), size{n} AS (SELECT id, count(*) AS n FROM own{n} GROUP BY 1)")
        for name, source in sides.items():
            k = f"{name}{n}"
            ctes.append(f"{k} AS ({grams(source, n)}), size_{k} AS (SELECT id, count(*) AS m FROM {k} GROUP BY 1)")
            ctes.append(f"met_{k} AS (SELECT o.id, p.id AS other, count(*) AS s FROM own{n} o JOIN {k} p USING (g) GROUP BY 1, 2)")
            ctes.append(f"best_{k} AS (SELECT x.id, max(s / (n + m - s)) AS best FROM met_{k} x JOIN size{n} y ON y.id = x.id JOIN size_{k} z ON z.id = x.other GROUP BY 1)")
            columns.append(f"round(coalesce(best_{k}.best, 0), 6) AS {name}_{n}")
            joins.append(f"LEFT JOIN best_{k} ON best_{k}.id = item_id")
    return f"WITH {', '.join(ctes)} SELECT item_id, {', '.join(columns)} FROM benchmark {' '.join(joins)}"


ORACLES: dict[str, str] = {
    "leakage_chars": _leaks(),
    "bootstrap_methods": f"WITH {_resampled()}, ends AS (SELECT system, {_ends('chrf', 'exact', 'judge')} FROM samples GROUP BY 1) SELECT system, rows, round(chrf, 8) AS chrf, round(exact, 8) AS exact, round(judge, 8) AS judge, ends.* EXCLUDE (system) FROM points JOIN ends USING (system)",
    "bootstrap_pairs": f"WITH {_resampled()}, {_DELTAS}, ends AS (SELECT a, b, {_ends('chrf', 'exact', 'judge')} FROM deltas GROUP BY 1, 2) SELECT ends.*, round(y.chrf - x.chrf, 8) AS chrf, round(y.exact - x.exact, 8) AS exact, round(y.judge - x.judge, 8) AS judge FROM ends JOIN points x ON x.system = a JOIN points y ON y.system = b",
    "bootstrap_streams": f"WITH {_resampled(3)}, ends AS (SELECT system, {_ends('chrf')} FROM samples GROUP BY 1) SELECT system, rows, hits, round(chrf, 8) AS chrf, chrf_low, chrf_high, round({_wilson(-1)}, 8) AS exact_low, round({_wilson(1)}, 8) AS exact_high FROM points JOIN ends USING (system)",
    "bootstrap_delta": f"WITH {_resampled()}, {_DELTAS} SELECT round(quantile_cont(chrf, 0.025), 8) AS low, round(quantile_cont(chrf, 0.975), 8) AS high, round(avg(chrf), 8) AS mean FROM deltas WHERE a = 'frontier' AND b = 'dpo'",
}
