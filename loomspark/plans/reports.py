"""Queries of report tables and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.functions.charsets import LATIN
from loomspark.operators import corpora as C
from loomspark.operators import dictionary as D
from loomspark.operators import reports as R

from .common import NAMES, POOL_SQL, Query, pools, table

SYSTEM = "Translate."


def gloss_prompts(spark, d):
    """Prompts and training texts with a gloss line for each match of a title; entries without meaning, English or reading, and words without entry."""
    p = table(spark, d, "part")
    entries = p.groupBy(F.split("p_name", " ")[0].alias("key")).agg(F.max_by(F.struct("p_type", "p_brand", "p_partkey"), "p_partkey").alias("e"))
    k = F.col("e.p_partkey")
    entries = entries.select("key", F.when(k % 3 > 0, F.col("e.p_type")).otherwise("").alias("cn"), F.when(k % 2 > 0, F.col("e.p_brand")).alias("en"), F.when(k % 5 > 1, F.concat(F.lit("r"), k.cast("string"))).alias("gx"))
    texts = p.select(F.col("p_partkey").alias("id"), F.split(F.concat_ws(" ", "p_name", F.lit("blue")), " ").alias("words"))
    segments = D.forward_matches(texts, entries).select("id", F.posexplode("segments").alias("pos", "s"))
    lines = segments.select("id", "pos", F.col("s.segment").alias("key"), F.col("s.known").alias("known")).join(entries, "key", "left")
    blocks = lines.groupBy("id").agg(D.in_order("pos", T.gloss_line("key", F.col("known"), "cn", "en", "gx"), "\n").alias("block"))
    return blocks.select("id", T.chat_prompt(F.lit(SYSTEM), "block").alias("prompt"), F.md5(T.chat_turns(F.lit(SYSTEM), "block", F.lit("ok"))).alias("sample_md5"))


def split_histograms(spark, d):
    """Splits of the parts with their sizes, lengths of names and first five examples."""
    rows = C.split(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", {"test": 50, "dev": 41})
    out = R.split_report(rows, "split", "p_name", "p_partkey")
    pairs = lambda xs, f: F.array_join(F.transform(xs, f), " ")
    return out.select("split", "n", pairs("lengths", lambda x: F.concat_ws(":", x["length"].cast("string"), x["times"].cast("string"))).alias("lengths"), F.array_join(F.transform("examples", lambda x: x["text"]), "|").alias("examples"))


def perplexity_stats(spark, d):
    """Perplexities of losses, some of which are not finite or overflow, by segment; one segment has no finite one."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    loss = F.when((F.col("c_mktsegment") == "MACHINERY") | (k % 11 == 0), F.lit(1000.0)).when(k % 13 == 0, F.lit(float("nan"))).when(k % 17 > 0, (k % 50) / F.lit(10.0))
    out = R.finite_summary(c.select("c_mktsegment", R.perplexities(loss).alias("ppl")), "ppl", "c_mktsegment")
    return out.select("c_mktsegment", "n", *(F.round(x, 6).alias(x) for x in ("mean", "low", "high")), "non_finite")


def suffix_preservation(spark, d):
    """Of references with suffix characters, how many predictions have all of them, by system."""
    rows = pools(spark, d).select("reference", F.explode(F.array(*(F.struct(F.lit(n).alias("system"), F.col(n).alias("pred")) for n in NAMES))).alias("s")).select("reference", "s.*")
    kept = rows.withColumn("kept", R.suffix_kept("pred", "reference", LATIN.suffixes[:3]))
    return kept.groupBy("system").agg(F.count("kept").alias("total"), F.count_if("kept").alias("kept"), F.round(F.avg(F.col("kept").cast("int")), 6).alias("rate"))


def dual_anchor(spark, d):
    """Measures of sources against those of one of them: more characters are better, fewer rows are."""
    m = table(spark, d, "documents").groupBy("source").agg(F.avg("n_chars").alias("chars"), F.count("*").cast("double").alias("ppl"))
    out = R.anchored(m, "source", "src0", ["chars"], ["ppl"])
    return out.select("source", *(F.round(c, 6).alias(c) for c in ("chars", "ppl", "anchor_chars", "anchor_ppl", "relative_chars", "relative_ppl")))


def upsample_mixed(spark, d):
    """Nations ten times over with the suppliers, in a random order of all rows."""
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    return R.mixed(n, 10, table(spark, d, "supplier").select(F.col("s_name").alias("name")), ["name"])


QUERIES: dict[str, Query] = {f.__name__: f for f in (gloss_prompts, split_histograms, perplexity_stats, suffix_preservation, dual_anchor, upsample_mixed)}


def _num(seed: str, key: str) -> str:
    return f"('0x' || substr(md5('{seed}|' || ({key})::VARCHAR), 1, 8))::BIGINT"


_BLOCK = f"'<|im_start|>system' || chr(10) || '{SYSTEM}<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || block || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"
_LOSS = "CASE WHEN c_mktsegment = 'MACHINERY' OR c_custkey % 11 = 0 THEN 'inf'::DOUBLE WHEN c_custkey % 13 = 0 THEN 'nan'::DOUBLE WHEN c_custkey % 17 > 0 THEN exp((c_custkey % 50) / 10.0::DOUBLE) END"

ORACLES: dict[str, str] = {
    "gloss_prompts": f"""WITH e AS (SELECT string_split(p_name, ' ')[1] AS key, p_partkey AS k, p_type, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY key ORDER BY p_partkey DESC) = 1),
      w AS (SELECT id, unnest(range(len(ws))) AS pos, unnest(ws) AS key FROM (SELECT p_partkey AS id, string_split(p_name || ' blue', ' ') AS ws FROM part)),
      l AS (SELECT id, pos, '  ' || w.key || ' = ' || CASE WHEN k IS NULL THEN '[未收录]' ELSE CASE WHEN k % 3 > 0 THEN p_type ELSE '[未知]' END || CASE WHEN k % 2 > 0 THEN ' (' || p_brand || ')' ELSE '' END || CASE WHEN k % 5 > 1 THEN ' [拟音: r' || k || ']' ELSE '' END END AS line FROM w LEFT JOIN e USING (key)),
      b AS (SELECT id, string_agg(line, chr(10) ORDER BY pos) AS block FROM l GROUP BY 1) SELECT id, {_BLOCK} AS prompt, md5({_BLOCK} || 'ok<|im_end|>') AS sample_md5 FROM b""",
    "split_histograms": f"""WITH r AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY {_num('42', 'p_partkey')}, p_partkey) AS r FROM part), s AS (SELECT *, CASE WHEN r <= 50 THEN 'test' WHEN r <= 91 THEN 'dev' ELSE 'train' END AS split FROM r),
      h AS (SELECT split, length(p_name) AS l, count(*) AS n FROM s GROUP BY 1, 2), g AS (SELECT split, sum(n)::BIGINT AS n, string_agg(l || ':' || n, ' ' ORDER BY l) AS lengths FROM h GROUP BY 1),
      x AS (SELECT split, p_partkey, p_name FROM s QUALIFY row_number() OVER (PARTITION BY split ORDER BY p_partkey) <= 5) SELECT split, n, lengths, string_agg(p_name, '|' ORDER BY p_partkey) AS examples FROM g JOIN x USING (split) GROUP BY 1, 2, 3""",
    "perplexity_stats": f"WITH p AS (SELECT c_mktsegment, {_LOSS} AS ppl FROM customer), q AS (SELECT *, coalesce(isfinite(ppl), false) AS ok FROM p) SELECT c_mktsegment, count(*) AS n, round(avg(ppl) FILTER (ok), 6) AS mean, round(min(ppl) FILTER (ok), 6) AS low, round(max(ppl) FILTER (ok), 6) AS high, count(*) FILTER (NOT ok) AS non_finite FROM q GROUP BY 1",
    "suffix_preservation": f"WITH {POOL_SQL}, s AS (SELECT system, reference, CASE system WHEN 'frontier' THEN frontier WHEN 'unk' THEN unk ELSE dpo END AS pred FROM pool0, (VALUES ('frontier'), ('unk'), ('dpo')) AS v(system)), n AS (SELECT system, pred, list_filter(string_split('{','.join(LATIN.suffixes[:3])}', ','), lambda c: contains(reference, c)) AS need FROM s), k AS (SELECT system, len(list_filter(need, lambda c: NOT contains(pred, c))) = 0 AS kept FROM n WHERE len(need) > 0) SELECT system, count(*) AS total, count(*) FILTER (kept) AS kept, round(avg(kept::INT), 6) AS rate FROM k GROUP BY 1",
    "dual_anchor": "WITH m AS (SELECT source, avg(n_chars) AS chars, count(*)::DOUBLE AS ppl FROM documents GROUP BY 1), a AS (SELECT chars AS ac, ppl AS ap FROM m WHERE source = 'src0') SELECT source, round(chars, 6) AS chars, round(ppl, 6) AS ppl, round(ac, 6) AS anchor_chars, round(ap, 6) AS anchor_ppl, round(chars / ac, 6) AS relative_chars, round(ap / ppl, 6) AS relative_ppl FROM m LEFT JOIN a ON true",
    "upsample_mixed": f"WITH u AS (SELECT copy::INT AS copy, n_name AS name FROM nation, range(1, 11) AS r(copy) UNION ALL SELECT 0, s_name FROM supplier) SELECT copy, name, row_number() OVER (ORDER BY {_num('42', 'copy || chr(124) || name')}, copy || chr(124) || name) - 1 AS place FROM u",
}
