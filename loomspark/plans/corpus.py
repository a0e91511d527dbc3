"""Queries of corpus construction, preferences, joins, aggregates, resampling and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import chrf
from loomspark.functions import text as T
from loomspark.operators import corpora as C
from loomspark.operators import search, setjoin
from loomspark.operators import statistics as S
from loomspark.sources import io

from .common import NAMES, POOL_SQL, Query, chrf_sql, dealt, pools, score_sql, table


def split_assign(spark, d):
    return C.split(table(spark, d, "documents").select("doc_id"), "doc_id", {"test": 50, "dev": 41})


def stratified_split(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("stratum"))
    return C.stratified(df, "c_custkey", "stratum", {"train": 60, "dev": 20, "test": 20})


def split_summary(spark, d):
    df = stratified_split(spark, d).where("split is not null")
    return df.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("stratum").alias("strata"), F.min("c_custkey").alias("first"))


def upsample_union(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    return C.upsampled(n, 10, table(spark, d, "supplier").select(F.col("s_name").alias("name"))).groupBy("copy").agg(F.count("*").alias("n"))


def _words(spark, d):
    """Words of names and types, with an ideograph and a mark that no table holds, and one of which some have a meaning."""
    middle = F.when(F.col("p_partkey") % 4 == 0, "甲 乙").otherwise("甲 !")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split(F.concat_ws(" ", "p_name", middle, "p_type"), " ").alias("words"))


def _table(spark, d):
    p = table(spark, d, "part")
    return p.groupBy(F.split("p_name", " ")[0].alias("word")).agg(F.array_sort(F.collect_set("p_brand")).alias("candidates"))


def synth_unk(spark, d):
    return C.replaced(_words(spark, d), _table(spark, d)).where("n_replaced >= 1")


def synth_first_valid(spark, d):
    """The first 40 rows with enough replaced: the feature is the limit."""
    return C.first_valid(synth_unk(spark, d), F.col("n_replaced") >= 2, 40, "id")


def synth_mixed(spark, d):
    both = _table(spark, d).unionAll(table(spark, d, "part").groupBy(F.col("p_type").alias("word")).agg(F.array_sort(F.collect_set("p_brand")).alias("candidates")))
    share = F.lit(0.3) + F.lit(0.4) * (C.number("share", "p_partkey") / F.lit(4294967296.0))  # of each row its own
    rows = _words(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), share.alias("share")), "id")
    return C.replaced(rows, both, unknown=None, pick=F.col("share"))


def synth_semantic(spark, d):
    """Words outside the table take the label that their nearest vectors vote for; a word without a vector is [UNK]."""
    votes = knn_vote(spark, d).select(F.concat(F.lit("v"), F.col("query").cast("string")).alias("word"), F.array(F.concat(F.lit("L"), F.col("label").cast("string"))).alias("candidates"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.lit("near"), F.concat(F.lit("v"), (F.col("s_suppkey") % 7 * 100).cast("string"))).alias("words"))
    return C.replaced(s, votes, unknown_if="^v")


def fewshot_block(spark, d):
    """The same block of fixed example rows before each input."""
    p = table(spark, d, "part").where(F.col("p_partkey").isin(1, 6, 15, 16)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_type", "p_name"))), lambda x: F.concat(x["p_type"], F.lit(" = "), x["p_name"])), "\n").alias("block"))
    n = table(spark, d, "nation")
    return n.crossJoin(F.broadcast(p)).select("n_nationkey", F.concat_ws("\n", "block", "n_name").alias("prompt"))  # one row


def synth_multitask(spark, d):
    """What a text is made of, its literal and the title, as one target."""
    df = C.replaced(_words(spark, d), _table(spark, d)).join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_type", "p_name"), "id")
    return df.select("id", F.concat(F.lit("<dict_match>"), "synthetic", F.lit("</dict_match> <literal>"), "p_type", F.lit("</literal> "), "p_name").alias("target"))


def dedupe_first(spark, d):
    p = table(spark, d, "part").select("p_name", "p_type", "p_partkey", "p_size")
    return C.first_of(p, ["p_name", "p_type"], "p_partkey")


def dedupe_nbest(spark, d):
    df = pools(spark, d)
    return df.select("row_idx", F.array_join(F.array_distinct(F.filter(F.array("frontier", "dpo", "unk", "reference"), lambda x: x != "")), "|").alias("candidates"))


def flatten_groups(spark, d):
    """Orders' items in order of their number; an order with an item without a part goes, with the first reason."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    rows = li.select("l_orderkey", F.explode("items").alias("i")).select("l_orderkey", "i.*")
    known = table(spark, d, "part").where("p_size > 2").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("ok"))
    joined = rows.join(known, "l_partkey", "left")
    bad = F.min_by(F.col("l_partkey"), F.when(F.col("ok").isNull(), F.struct("l_linenumber", "l_partkey")))
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), " ")
    return joined.groupBy("l_orderkey").agg(seq.alias("parts"), bad.cast("string").alias("first_missing"))


def best_variant(spark, d):
    """Of the systems and one that has no score (-1), the one with the best corpus chrF++; the first among equals."""
    df = pools(spark, d)
    members = F.array(*(F.struct(F.lit(k).alias("pos"), F.lit(n).alias("name"), F.col(n).alias("pred")) for k, n in enumerate(NAMES)))
    rows = df.select("reference", F.explode(members).alias("m")).select("m.*", chrf.stats("m.pred", "reference").alias("stats"))
    scores = rows.groupBy("pos", "name").agg(*chrf.summed()).select("pos", "name", F.round(chrf.of_sums(), 6).alias("score"))
    every = scores.unionAll(spark.range(1).select(F.lit(-1).alias("pos"), F.lit("absent").alias("name"), F.lit(-1.0).alias("score")))
    return every.agg(F.max_by(F.struct("name", "score"), F.struct("score", -F.col("pos"))).alias("b")).select(F.col("b.name").alias("best"), F.col("b.score").alias("score"))


def _candidates(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("prompt"), F.col("event_id").alias("idx"), F.concat_ws(" ", "event_type", "props").alias("text"), F.round(C.preference_reward((F.col("event_id") % 11) / F.lit(10.0), F.abs("value") + 1), 9).alias("reward"))


def pref_pairs(spark, d):
    return C.preference_pairs(_candidates(spark, d)).select("prompt", "chosen", "rejected", F.round("gap", 6).alias("gap"))


def _pairs(spark, d):
    """Each event against the next one's neighbour by id, some rewards not finite."""
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    f = e.select((F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("rejected"), F.col("value").alias("rejected_reward"))
    odd = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).when(F.col("event_id") % 89 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return e.join(f, "event_id").select("event_id", F.col("event_type").alias("chosen"), "rejected", odd.alias("chosen_reward"), "rejected_reward")


def pref_filter(spark, d):
    """Reasons, counted in their order, with the share of all pairs."""
    df = _pairs(spark, d).withColumn("prompt", F.col("event_id") % 50)
    n = C.preference_filtered(df, 20.0, "event_id").groupBy("reason").agg(F.count("*").alias("n"))
    return n.select("reason", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("rate"))  # a row a reason


def pref_audit(spark, d):
    df = _pairs(spark, d).withColumn("reason", C.preference_reason(0.0)).withColumn("gap", F.when(~F.col("reason").isin("non_finite"), F.col("chosen_reward") - F.col("rejected_reward")))
    g = F.col("gap")
    bins = [F.count_if((g > a) & (g <= b)).alias(f"bin{k}") for k, (a, b) in enumerate([(-1e9, 0.0), (0.0, 10.0), (10.0, 40.0), (40.0, 1e9)])]
    return df.agg(F.count("*").alias("pairs"), F.count_if(F.col("reason") == "non_finite").alias("non_finite"), F.count_if(F.col("chosen") == F.col("rejected")).alias("same"), F.round(F.avg(g), 6).alias("mean_gap"), F.round(F.min(g), 6).alias("low"), F.round(F.max(g), 6).alias("high"), *bins, F.count_if(g >= 40.0).alias("ge_40"))


def reward_grid(spark, d):
    """Sign flips of the preference under several weights, against the plain reward: scored once, weighted per variant."""
    base = _pairs(spark, d).where(C.preference_reason(-1e9) != "non_finite")
    lex = F.length("chosen") - F.length("rejected")
    gap = F.col("chosen_reward") - F.col("rejected_reward")
    out = [base.agg(F.count_if(gap * (gap + w * lex) < 0).alias("flips"), F.count_if(gap + w * lex >= 20).alias("kept")).select(F.lit(w).alias("weight"), "*") for w in (0, 2, 8)]
    return reduce(DataFrame.unionAll, out)


def lookup_last(spark, d):
    o = table(spark, d, "orders")
    last = o.groupBy("o_custkey").agg(F.max_by("o_orderpriority", "o_orderkey").alias("last"), F.min_by("o_orderpriority", "o_orderkey").alias("first"))
    return table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "last", "first")


def resume_anti(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("input"), "c_name")
    return io.unfinished(c, table(spark, d, "orders").select(F.col("o_custkey").alias("input")))


def membership_counts(spark, d):
    """Customers by nation, with orders, in the suppliers' nations."""
    c, o, s = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "supplier")
    own = c.join(o.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(1)), "c_custkey", "left")
    own = own.join(s.select(F.col("s_nationkey").alias("c_nationkey")).distinct().withColumn("near", F.lit(1)), "c_nationkey", "left")
    return own.agg(F.count("*").alias("n"), F.count("has").alias("with_orders"), F.count("near").alias("near"), F.count_if(F.col("has").isNotNull() & F.col("near").isNotNull()).alias("both"))


def shared_keys(spark, d):
    e = table(spark, d, "events")
    users = [e.where(F.col("event_type") == t).select("user_id") for t in ("error", "click", "view")]
    return reduce(DataFrame.intersect, users)


def score_once(spark, d):
    """Distinct texts are measured once and joined back."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return p.join(p.select("p_name").distinct().withColumn("n", F.length(F.regexp_replace("p_name", "[aeiou]", ""))), "p_name").select("p_partkey", "n")


def leakage_exact(spark, d):
    """Benchmark lines that stand as lines in documents."""
    line = lambda n: F.explode(F.split("text", "\n")).alias(n)
    b = table(spark, d, "benchmark").select("item_id", line("line")).where("line <> ''").distinct()
    t = table(spark, d, "documents").select("doc_id", line("line"))
    met = t.join(b, "line")
    return met.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("line").alias("n_lines"))


def _line_grams(df, key, n):
    """Distinct runs of n words; a shorter text is one run."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    rows = df.select(F.col(key).alias("id"), F.array_distinct(T.runs(words, n, " ")).alias("grams"), words.alias("w"))
    return rows.select("id", F.when(F.size("w") >= n, F.col("grams")).otherwise(F.array(F.array_join("w", " "))).alias("grams"))


def _leakage(n):
    def query(spark, d):
        """The highest Jaccard similarity of each item with any turn of any conversation: whole texts."""
        b = table(spark, d, "benchmark")
        c = dealt(table(spark, d, "conversations").select((F.col("conv_id") * 10000 + F.col("turn")).alias("item_id"), "text"), "item_id")
        df = setjoin.best_jaccard(_line_grams(b, "item_id", n), _line_grams(c, "item_id", n))
        return df.select(F.col("id").alias("item_id"), F.round("best", 6).alias("best"))

    query.__name__ = f"leakage_jaccard_{n}"
    return query


def wilson_by_group(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    g = x.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("k"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return g.select("lang", "n", "k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def quantiles(spark, d):
    q = [F.percentile("n_chars", x).alias(f"q{int(1000 * x)}") for x in (0.025, 0.5, 0.9, 0.975)]
    return table(spark, d, "documents").groupBy("lang").agg(*q)


def bootstrap_ci(spark, d):
    """Intervals of the mean balance by segment, of 200 resamples of the nations' sums."""
    rows = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("idx"), "c_mktsegment").agg(F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))
    b = S.bootstrap(rows, ["cents", "n"], 200, 25, by="c_mktsegment")
    m = b.select("c_mktsegment", (F.col("cents") / F.col("n")).alias("mean"))
    return m.groupBy("c_mktsegment").agg(F.round(F.percentile("mean", 0.025), 6).alias("low"), F.round(F.percentile("mean", 0.975), 6).alias("high"))


def anchor_ratio(spark, d):
    m = table(spark, d, "documents").groupBy("source").agg(F.avg("n_chars").alias("mean"), F.count("*").alias("n"))
    anchor = m.where("source = 'src0'").select(F.col("mean").alias("anchor"))
    return m.crossJoin(F.broadcast(anchor)).select("source", "n", F.round(F.try_divide("mean", "anchor"), 6).alias("ratio"))  # one row


def log_ratio_scale(spark, d):
    m = anchor_ratio(spark, d).withColumn("l", F.log10("ratio"))
    p90 = m.agg(F.percentile(F.abs("l"), 0.9).alias("p90"))
    return m.crossJoin(F.broadcast(p90)).select("source", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide("l", "p90"))), 6).alias("scaled"))  # one row


def finite_stats(spark, d):
    df = _pairs(spark, d)
    ok = ~F.isnan("chosen_reward") & (F.abs("chosen_reward") < float("inf"))
    v = F.when(ok, F.col("chosen_reward"))
    return df.agg(F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.count_if(~ok).alias("non_finite"))


def judge_means(spark, d):
    """Mock judge: four scores of 1 to 5 from the row's hash, and their means by segment."""
    c = table(spark, d, "customer")
    s = [((C.number(k, "c_custkey") % 5) + 1).alias(k) for k in ("agreement", "faithfulness", "style", "overall")]
    return c.select("c_mktsegment", *s).groupBy("c_mktsegment").agg(*(F.round(F.avg(k), 6).alias(k) for k in ("agreement", "faithfulness", "style", "overall")))


def mode_first(spark, d):
    """The most frequent value, the first seen among equals."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.col("first"))).alias("mode"))


def histogram(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def ordered_slice(spark, d):
    """Rows start..start+n of an ordered input: the feature is the limit."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20)
    return o


def rounded_means(spark, d):
    """Means of values rounded a row first, to tenths, half up."""
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.avg(F.floor(F.col("c_acctbal") * 10 / 7 + 0.5)) / 10, 6).alias("mean"))


def json_entries(spark, d):
    e = io.entries_of(table(spark, d, "events"), "props", "event_id")
    return e.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("value").try_cast("long")).alias("total"))


def html_rows(spark, d):
    p = table(spark, d, "pages").select("page_id", io.rows_of_html("html").alias("rows"))
    return p.select("page_id", F.size("rows").alias("n"), F.md5(F.array_join("rows", "\n")).alias("rows_md5"))


def aligned_mismatches(spark, d):
    df = pools(spark, d)
    return io.mismatches(df.select("row_idx", F.col("frontier").alias("input")), df.select("row_idx", F.col("reference").alias("input")))


def wide_metrics(spark, d):
    """Nested metrics of systems as a wide table."""
    m = table(spark, d, "documents").groupBy("lang").agg(F.struct(F.avg("n_chars").alias("mean"), F.max("n_chars").alias("max")).alias("chars"), F.struct(F.count("*").alias("n")).alias("rows"))
    return m.select("lang", F.round("chars.mean", 6).alias("chars_mean"), F.col("chars.max").alias("chars_max"), F.col("rows.n").alias("n"))


def knn_topk(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = v.where("id % 100 = 0")  # the stated query set of searches
    return search.nearest(v, q).select("query", "rank", "id", F.round("distance", 5).alias("distance"))


def knn_vote(spark, d):
    v = table(spark, d, "embeddings")
    near = search.nearest(v.select(F.col("vec_id").alias("id"), "embedding"), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), "embedding"))
    votes = near.join(v.select(F.col("vec_id").alias("id"), "label"), "id").groupBy("query", "label").agg(F.count("*").alias("n"), F.min("rank").alias("r"))
    return votes.groupBy("query").agg(F.max_by("label", F.struct("n", -F.col("r"))).alias("label"))


def unit_vectors(spark, d):
    """Vectors after L2 normalisation, as text of their first and last numbers."""
    u = S.unit("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.get(u, F.lit(0)), 6).alias("first"), F.round(F.element_at(u, -1), 6).alias("last"))


def pooled_vectors(spark, d):
    """The masked mean of three tokens, which are rotations of a vector; the mask goes by id."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding", F.size("embedding").alias("n"))
    turn = lambda k: F.concat(F.slice("embedding", k + 1, F.col("n")), F.slice("embedding", 1, k))
    mask = F.array(*(F.when(F.col("vec_id") % (k + 2) == 0, 0).otherwise(1) for k in range(3)))
    pooled = S.mean_pooled(F.array(F.col("embedding"), turn(1), turn(2)), mask)
    return v.select("vec_id", F.round(F.get(pooled, F.lit(0)), 5).alias("first"), F.round(F.element_at(pooled, -1), 5).alias("last"))


def html_records(spark, d):
    """Rows of pages with their cells by class: two required, one optional."""
    html = F.expr("""concat('<table><tr><th>x</th></tr><TR id="a"><td><p class="big src">', p_name, '</p></td><td>', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('<p class="dst">', chr(10), '<b>', p_type, '</b> </p>') END, '</td></tr>',
      '<tr><td><p class="src">', p_brand, '</p><p class="dst">', p_size + 100, '</p><p class="note" lang="x">n', p_size, '</p></td></tr><tr><p class="src"> </p><p class="dst">y</p></tr></table>')""")
    rows = io.records_of_html("html", {"input": ("src", True), "output": ("dst", True), "note": ("note", False)})
    p = table(spark, d, "part").select("p_partkey", html.alias("html"))
    return p.select("p_partkey", F.posexplode(rows).alias("pos", "r")).select("p_partkey", "pos", "r.*")


def file_scans(spark, d):
    """Records written to files of each kind and read back by its scan."""
    root = io.shared_folder(spark, "file-scans")
    p = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_partkey").alias("input"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_type")).alias("reference"), F.col("p_brand").alias("prediction"))
    n = table(spark, d, "nation").select(F.col("n_name").alias("prompt"), F.lit("a").alias("chosen"), F.lit("b").alias("rejected"), (F.col("n_nationkey") / 2).alias("chosen_reward"))
    io.write_jsonl(p, f"{root}/jsonl")
    io.write_csv(p, f"{root}/csv")
    io.document(n).write.text(f"{root}/array")
    table(spark, d, "region").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", F.col("r_regionkey").cast("string")))))).write.text(f"{root}/map")
    io.write_vectors(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("k"), "vec_id").alias("key"), "embedding"), f"{root}/vectors")
    frames = {
        "jsonl": io.jsonl(spark, f"{root}/jsonl", "prediction").select("input", "reference"),
        "strict": io.jsonl(spark, f"{root}/jsonl", "prediction", strict=True).select("input", "reference"),
        "spec": io.registered(spark, [f"a={root}/jsonl", f"b={root}/jsonl"], "prediction").select(F.concat("system", "input"), "reference"),
        "csv": spark.read.csv(f"{root}/csv", header=True, schema="input string, reference string, prediction string").select("input", "reference"),
        "array": io.json_array(spark, f"{root}/array", "preference").select("prompt", F.col("chosen_reward").cast("string")),
        "map": io.json_map(spark, f"{root}/map").select("key", "value"),
        "vectors": spark.read.parquet(f"{root}/vectors").select("key", F.size("embedding").cast("string")),
    }
    one = lambda name, df: df.toDF("a", "b").agg(F.lit(name).alias("source"), F.count("*").alias("n"), F.sum(F.length("a")).alias("chars"), F.count("b").alias("filled"))
    return reduce(DataFrame.unionAll, (one(k, df) for k, df in frames.items()))


def nested_scan(spark, d):
    """Nested inscriptions as rows, one a character."""
    body = F.expr("""concat('{"RubbingName": "r', n_nationkey, '", "RecordUtilSentenceGroupVoList": [{"GroupCategory": "a", "RecordUtilOracleCharVoList": [{"OrderNumber": 1, "Label": "', n_name, '"}, {"OrderNumber": 2, "Label": null}]}, {"GroupCategory": "b", "RecordUtilOracleCharVoList": [{"OrderNumber": ', n_regionkey, ', "Label": "x"}]}]}')""")
    return io.inscriptions(table(spark, d, "nation").select("n_nationkey", body.alias("body")), "n_nationkey", "body")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        split_assign, stratified_split, split_summary, upsample_union, synth_unk, synth_first_valid, synth_mixed, synth_multitask, synth_semantic, fewshot_block, dedupe_first, dedupe_nbest, flatten_groups, best_variant, pref_pairs, pref_filter, pref_audit,
        reward_grid, lookup_last, resume_anti, membership_counts, shared_keys, score_once, leakage_exact, _leakage(2), _leakage(3), _leakage(4), wilson_by_group, quantiles, bootstrap_ci, anchor_ratio,
        log_ratio_scale, finite_stats, judge_means, mode_first, histogram, ordered_slice, rounded_means, json_entries, html_rows, aligned_mismatches, wide_metrics, knn_topk, knn_vote, unit_vectors, pooled_vectors, html_records, nested_scan, file_scans,
    )
}


def num(seed: str, *keys: str) -> str:
    return "('0x' || substr(md5(" + " || '|' || ".join([f"'{seed}'", *(f"({k})::VARCHAR" for k in keys)]) + "), 1, 8))::BIGINT"


_SPLIT = f"(SELECT c_custkey, c_nationkey AS stratum, row_number() OVER (PARTITION BY c_nationkey ORDER BY {num('42', 'c_custkey')}, c_custkey) AS i FROM customer)"


def _stratified() -> str:
    """Each quota takes turns over what the ones before have left."""
    ctes, left = [f"l0 AS {_SPLIT}"], "l0"
    for k, (name, quota) in enumerate((("train", 60), ("dev", 20), ("test", 20))):
        ctes.append(f"t{k} AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY i) AS turn FROM {left})")
        ctes.append(f"p{k} AS (SELECT *, row_number() OVER (ORDER BY turn, stratum) AS place FROM t{k})")
        ctes.append(f"l{k + 1} AS (SELECT c_custkey, stratum, i FROM p{k} WHERE place > {quota})")
        ctes.append(f"g{k} AS (SELECT c_custkey, stratum, '{name}' AS split FROM p{k} WHERE place <= {quota})")
        left = f"l{k + 1}"
    return ", ".join(ctes) + ", strat AS (SELECT * FROM g0 UNION ALL SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT c_custkey, stratum, NULL FROM l3)"


_TEXT = "string_split(p_name || ' 甲 ' || CASE WHEN p_partkey % 4 = 0 THEN '乙 ' ELSE '! ' END || p_type, ' ')"
_SYNTH = f"""w AS (SELECT p_partkey AS id, pos, {_TEXT}[pos] AS word FROM part, unnest(range(1, 20)) AS t(pos) WHERE pos <= len({_TEXT})),
tab AS (SELECT string_split(p_name, ' ')[1] AS word, list_sort(list(DISTINCT p_brand)) AS candidates FROM part GROUP BY 1),
typ AS (SELECT * FROM tab UNION ALL SELECT p_type, list_sort(list(DISTINCT p_brand)) FROM part GROUP BY 1),
r AS (SELECT id, pos, w.word, candidates, {num('42', 'id', 'pos - 1')} AS n FROM w LEFT JOIN tab USING (word)), rt AS (SELECT id, pos, w.word, candidates, {num('42', 'id', 'pos - 1')} AS n FROM w LEFT JOIN typ USING (word)),
unk AS (SELECT id, string_agg(CASE WHEN candidates IS NOT NULL THEN candidates[n % len(candidates) + 1] WHEN word IN ('甲', '乙') THEN '[UNK]' ELSE word END, ' ' ORDER BY pos) AS synthetic, count(*) FILTER (candidates IS NOT NULL OR word IN ('甲', '乙')) AS n_replaced FROM r GROUP BY 1)"""
_PAIRS = "pairs AS (SELECT e.event_id, e.event_type AS chosen, f.event_type AS rejected, CASE WHEN e.event_id % 97 = 0 THEN 'nan'::DOUBLE WHEN e.event_id % 89 = 0 THEN 'inf'::DOUBLE ELSE e.value END AS chosen_reward, f.value AS rejected_reward FROM events e JOIN events f ON f.event_id = e.event_id + 1)"
_FINITE = "isfinite(chosen_reward) AND isfinite(rejected_reward)"
_ANCHOR = "m AS (SELECT source, avg(n_chars) AS mean, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT source, n, round(mean / (SELECT mean FROM m WHERE source = 'src0'), 6) AS ratio FROM m)"
_KNN = """q AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
dist AS (SELECT query, vec_id AS id, list_sum(list_transform(list_zip(q, embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM q JOIN embeddings ON vec_id <> query),
near AS (SELECT query, id, d, row_number() OVER (PARTITION BY query ORDER BY d, id) AS rank FROM dist QUALIFY rank <= 3)"""


def _leak(n: int) -> str:
    grams = lambda t, k, w: f"SELECT {k} AS id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - {n - 1}, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' ')))) AS g FROM (SELECT {k}, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM {t} {w})"
    return f"""WITH a AS ({grams('benchmark', 'item_id', '')}), b AS ({grams('(SELECT conv_id * 10000 + turn AS conv_turn, text FROM conversations)', 'conv_turn', '')}), na AS (SELECT id, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT id, count(*) AS n FROM b GROUP BY 1),
      s AS (SELECT a.id, b.id AS o, count(*) AS s FROM a JOIN b USING (g) GROUP BY 1, 2), j AS (SELECT s.id, max(s / (na.n + nb.n - s)) AS best FROM s JOIN na ON na.id = s.id JOIN nb ON nb.id = s.o GROUP BY 1)
      SELECT item_id, round(coalesce(best, 0), 6) AS best FROM benchmark LEFT JOIN j ON j.id = item_id"""


ORACLES: dict[str, str] = {
    "split_assign": f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {num('42', 'doc_id')}, doc_id) AS r FROM documents) SELECT doc_id, CASE WHEN r <= 50 THEN 'test' WHEN r <= 91 THEN 'dev' ELSE 'train' END AS split FROM r",
    "stratified_split": f"WITH {_stratified()} SELECT * FROM strat",
    "split_summary": f"WITH {_stratified()} SELECT split, count(*) AS n, count(DISTINCT stratum) AS strata, min(c_custkey) AS first FROM strat WHERE split IS NOT NULL GROUP BY 1",
    "upsample_union": "SELECT copy::INT AS copy, count(*) AS n FROM (SELECT unnest(range(1, 11)) AS copy FROM nation UNION ALL SELECT 0 FROM supplier) GROUP BY 1",
    "synth_unk": f"WITH {_SYNTH} SELECT * FROM unk WHERE n_replaced >= 1",
    "synth_mixed": f"WITH {_SYNTH}, k AS (SELECT *, count(candidates) OVER (PARTITION BY id) AS k, row_number() OVER (PARTITION BY id ORDER BY (candidates IS NULL)::INT, n, pos) AS rk FROM rt), h AS (SELECT *, candidates IS NOT NULL AND rk <= greatest(1, floor(k * (0.3::DOUBLE + 0.4::DOUBLE * ({num('share', 'id')} / 4294967296.0::DOUBLE)))) AS hit FROM k WHERE k >= 2) SELECT id, string_agg(CASE WHEN hit THEN candidates[n % len(candidates) + 1] ELSE word END, ' ' ORDER BY pos) AS synthetic, count(*) FILTER (hit) AS n_replaced FROM h GROUP BY 1",
    "synth_multitask": f"WITH {_SYNTH} SELECT id, '<dict_match>' || synthetic || '</dict_match> <literal>' || p_type || '</literal> ' || p_name AS target FROM unk JOIN part ON p_partkey = id",
    "synth_semantic": f"WITH {_KNN}, v AS (SELECT query, label, count(*) AS n, min(rank) AS r FROM near JOIN embeddings ON vec_id = id GROUP BY 1, 2), t AS (SELECT query, label FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, r) = 1) SELECT s_suppkey AS id, 'near ' || coalesce('L' || label, '[UNK]') AS synthetic, 1::BIGINT AS n_replaced FROM supplier LEFT JOIN t ON query = s_suppkey % 7 * 100",
    "fewshot_block": "WITH b AS (SELECT string_agg(p_type || ' = ' || p_name, chr(10) ORDER BY p_partkey) AS block FROM part WHERE p_partkey IN (1, 6, 15, 16)) SELECT n_nationkey, block || chr(10) || n_name AS prompt FROM nation, b",
    "dedupe_first": "SELECT p_name, p_type, p_partkey, p_size, count(*) OVER (PARTITION BY p_name, p_type) AS n_rows FROM part QUALIFY row_number() OVER (PARTITION BY p_name, p_type ORDER BY p_partkey) = 1",
    "dedupe_nbest": f"WITH {POOL_SQL}, c AS (SELECT row_idx, unnest([frontier, dpo, unk, reference]) AS x, unnest([1, 2, 3, 4]) AS k FROM pool0), f AS (SELECT row_idx, x, min(k) AS k FROM c WHERE x <> '' GROUP BY 1, 2) SELECT row_idx, string_agg(x, '|' ORDER BY k) AS candidates FROM f GROUP BY 1",
    "flatten_groups": "WITH j AS (SELECT l_orderkey, l_linenumber, l_partkey, p_partkey IS NULL AS bad FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 2) ON p_partkey = l_partkey) SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_linenumber, l_partkey) AS parts, (array_agg(l_partkey ORDER BY l_linenumber, l_partkey) FILTER (bad))[1]::VARCHAR AS first_missing FROM j GROUP BY 1",
    "best_variant": f"""WITH {POOL_SQL}, src AS (SELECT row_idx * 3 + k AS id, [frontier, unk, dpo][k + 1] AS h, reference AS r FROM pool0, unnest(range(3)) AS t(k)), {chrf_sql('src')},
      t AS (SELECT id % 3 AS k, {", ".join(f"sum(s{k}) AS s{k}" for k in range(24))} FROM stats GROUP BY 1), e AS (SELECT k, ['frontier', 'unk', 'dpo'][k + 1] AS best, round({score_sql()}, 6) AS score FROM t UNION ALL SELECT -1, 'absent', -1.0) SELECT best, score FROM e ORDER BY score DESC, k LIMIT 1""",
    "synth_first_valid": f"WITH {_SYNTH} SELECT * FROM unk WHERE n_replaced >= 2 ORDER BY id LIMIT 40",
    "html_records": """WITH r AS (SELECT p_partkey, 0 AS k, p_name AS input, p_type AS output, '' AS note FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 1, p_brand, (p_size + 100)::VARCHAR, 'n' || p_size FROM part)
      SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY k) - 1)::INT AS pos, input, output, note FROM r""",
    "file_scans": """WITH p AS (SELECT length(p_name || ' ' || p_partkey) AS c, p_partkey % 5 > 0 AS f FROM part) SELECT s AS source, count(*) * k AS n, (sum(c + k - 1) * k)::BIGINT AS chars, count(*) FILTER (f) * k AS filled FROM p, (VALUES ('jsonl', 1), ('strict', 1), ('spec', 2), ('csv', 1)) AS v(s, k) GROUP BY s, k
      UNION ALL SELECT 'array', count(*), sum(length(n_name))::BIGINT, count(*) FROM nation UNION ALL SELECT 'map', count(*), sum(length(r_name))::BIGINT, count(*) FROM region UNION ALL SELECT 'vectors', count(*), sum(length('k' || vec_id))::BIGINT, count(*) FROM embeddings""",
    "nested_scan": "SELECT n_nationkey, unnest(['a', 'a', 'b']) AS category, unnest([1, 2, n_regionkey])::BIGINT AS pos, unnest([n_name, NULL, 'x']) AS label FROM nation",
    "pooled_vectors": """WITH m AS (SELECT vec_id, embedding AS e, len(embedding) AS n, (vec_id % 2 <> 0)::INT AS a, (vec_id % 3 <> 0)::INT AS b, (vec_id % 4 <> 0)::INT AS c FROM embeddings)
      SELECT vec_id, round((a * e[1]::DOUBLE + b * e[2]::DOUBLE + c * e[3]::DOUBLE) / (a + b + c + 1e-8::DOUBLE), 5) + 0.0 AS first, round((a * e[n]::DOUBLE + b * e[1]::DOUBLE + c * e[2]::DOUBLE) / (a + b + c + 1e-8::DOUBLE), 5) + 0.0 AS last FROM m""",
    "pref_pairs": "WITH c AS (SELECT user_id AS prompt, event_id AS idx, concat_ws(' ', event_type, props) AS text, round((event_id % 11) / 10.0::DOUBLE - 0.01::DOUBLE * ln(abs(value) + 1 + 1e-8::DOUBLE), 9) AS reward FROM events WHERE value IS NOT NULL AND concat_ws(' ', event_type, props) <> ''), b AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY reward DESC, idx) AS best, row_number() OVER (PARTITION BY prompt ORDER BY reward, idx DESC) AS worst, count(*) OVER (PARTITION BY prompt) AS n FROM c) SELECT b.prompt, b.text AS chosen, w.text AS rejected, round(b.reward - w.reward, 6) AS gap FROM b JOIN b w ON w.prompt = b.prompt WHERE b.best = 1 AND w.worst = 1 AND b.n >= 2 AND b.reward - w.reward >= 0.05",
    "pref_filter": f"WITH {_PAIRS}, r AS (SELECT *, event_id % 50 AS prompt, CASE WHEN NOT coalesce({_FINITE}, false) THEN 'non_finite' WHEN chosen = rejected THEN 'same_text' WHEN chosen_reward - rejected_reward < 20 THEN 'small_gap' ELSE 'kept' END AS reason FROM pairs), q AS (SELECT CASE WHEN reason = 'kept' AND row_number() OVER (PARTITION BY reason, prompt, chosen, rejected ORDER BY event_id) > 1 THEN 'duplicate' ELSE reason END AS reason FROM r) SELECT reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS rate FROM q GROUP BY 1",
    "pref_audit": f"WITH {_PAIRS}, g AS (SELECT *, CASE WHEN {_FINITE} THEN chosen_reward - rejected_reward END AS gap FROM pairs) SELECT count(*) AS pairs, count(*) FILTER (NOT ({_FINITE})) AS non_finite, count(*) FILTER (chosen = rejected) AS same, round(avg(gap), 6) AS mean_gap, round(min(gap), 6) AS low, round(max(gap), 6) AS high, count(*) FILTER (gap <= 0) AS bin0, count(*) FILTER (gap > 0 AND gap <= 10) AS bin1, count(*) FILTER (gap > 10 AND gap <= 40) AS bin2, count(*) FILTER (gap > 40) AS bin3, count(*) FILTER (gap >= 40) AS ge_40 FROM g",
    "reward_grid": f"WITH {_PAIRS}, g AS (SELECT chosen_reward - rejected_reward AS gap, length(chosen) - length(rejected) AS lex FROM pairs WHERE {_FINITE}) SELECT w::INT AS weight, count(*) FILTER (gap * (gap + w * lex) < 0) AS flips, count(*) FILTER (gap + w * lex >= 20) AS kept FROM g, (VALUES (0), (2), (8)) AS v(w) GROUP BY 1",
    "lookup_last": "SELECT c_custkey, arg_max(o_orderpriority, o_orderkey) AS last, arg_min(o_orderpriority, o_orderkey) AS first FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "resume_anti": "SELECT c_custkey AS input, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "membership_counts": "WITH x AS (SELECT c_custkey IN (SELECT o_custkey FROM orders) AS has, c_nationkey IN (SELECT s_nationkey FROM supplier) AS near FROM customer) SELECT count(*) AS n, count(*) FILTER (has) AS with_orders, count(*) FILTER (near) AS near, count(*) FILTER (has AND near) AS both FROM x",
    "shared_keys": "SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'view'",
    "score_once": "SELECT p_partkey, length(regexp_replace(p_name, '[aeiou]', '', 'g'))::INT AS n FROM part",
    "leakage_exact": "WITH b AS (SELECT DISTINCT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark), t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT item_id, count(DISTINCT doc_id) AS n_docs, count(DISTINCT line) AS n_lines FROM t JOIN b USING (line) WHERE line <> '' GROUP BY 1",
    "leakage_jaccard_2": _leak(2),
    "leakage_jaccard_3": _leak(3),
    "leakage_jaccard_4": _leak(4),
    "wilson_by_group": "WITH g AS (SELECT lang, count(*) AS n, sum(quality)::BIGINT AS k FROM labels JOIN documents USING (doc_id) GROUP BY 1), p AS (SELECT *, k / n AS p, 1.96::DOUBLE * 1.96::DOUBLE AS z2 FROM g) SELECT lang, n, k, round(greatest(0.0, least(1.0, (p + z2 / (2 * n) - 1.96::DOUBLE * sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n))), 9) AS low, round(greatest(0.0, least(1.0, (p + z2 / (2 * n) + 1.96::DOUBLE * sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n))), 9) AS high FROM p",
    "quantiles": "SELECT lang, quantile_cont(n_chars, 0.025) AS q25, quantile_cont(n_chars, 0.5) AS q500, quantile_cont(n_chars, 0.9) AS q900, quantile_cont(n_chars, 0.975) AS q975 FROM documents GROUP BY 1",
    "bootstrap_ci": f"WITH r AS (SELECT c_nationkey AS idx, c_mktsegment, sum(round(c_acctbal * 100)::BIGINT) AS cents, count(*) AS n FROM customer GROUP BY 1, 2), dr AS (SELECT s AS sample, {num('42', 's', 'k')} % 25 AS idx FROM range(200) AS a(s), range(25) AS b(k)), b AS (SELECT sample, c_mktsegment, sum(cents)::DOUBLE / sum(n) AS mean FROM dr JOIN r USING (idx) GROUP BY 1, 2) SELECT c_mktsegment, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM b GROUP BY 1",
    "anchor_ratio": f"WITH {_ANCHOR} SELECT * FROM r",
    "log_ratio_scale": f"WITH {_ANCHOR}, l AS (SELECT source, log10(ratio) AS l FROM r), p AS (SELECT quantile_cont(abs(l), 0.9) AS p90 FROM l) SELECT source, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, l / p90)), 6) AS scaled FROM l, p",
    "finite_stats": f"WITH {_PAIRS} SELECT round(avg(chosen_reward) FILTER (isfinite(chosen_reward)), 6) AS mean, min(chosen_reward) FILTER (isfinite(chosen_reward)) AS low, max(chosen_reward) FILTER (isfinite(chosen_reward)) AS high, count(*) FILTER (NOT isfinite(chosen_reward)) AS non_finite FROM pairs",
    "judge_means": "SELECT c_mktsegment, " + ", ".join(f"round(avg({num(k, 'c_custkey')} % 5 + 1), 6) AS {k}" for k in ("agreement", "faithfulness", "style", "overall")) + " FROM customer GROUP BY 1",
    "mode_first": "WITH e AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2) SELECT user_id, event_type AS mode FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1",
    "histogram": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
    "ordered_slice": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    "rounded_means": "SELECT c_mktsegment, round(avg(floor(c_acctbal * 10 / 7 + 0.5)) / 10, 6) AS mean FROM customer GROUP BY 1",
    "json_entries": "WITH k AS (SELECT unnest(json_keys(props)) AS key, props FROM events) SELECT key, count(*) AS n, sum(try_cast(json_extract_string(props, '$.' || key) AS BIGINT))::BIGINT AS total FROM k GROUP BY 1",
    "html_rows": r"WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1), lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'), ' ')), lambda x: x <> '') AS r FROM pages) SELECT page_id, len(r)::INT AS n, md5(array_to_string(r, chr(10))) AS rows_md5 FROM p",
    "aligned_mismatches": f"WITH {POOL_SQL} SELECT row_idx, frontier AS l, reference AS r FROM pool0 WHERE frontier <> reference",
    "wide_metrics": "SELECT lang, round(avg(n_chars), 6) AS chars_mean, max(n_chars) AS chars_max, count(*) AS n FROM documents GROUP BY 1",
    "knn_topk": f"WITH {_KNN} SELECT query, rank::INT AS rank, id, round(d, 5) AS distance FROM near",
    "knn_vote": f"WITH {_KNN}, v AS (SELECT query, label, count(*) AS n, min(rank) AS r FROM near JOIN embeddings ON vec_id = id GROUP BY 1, 2) SELECT query, label FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, r) = 1",
    "unit_vectors": "WITH n AS (SELECT vec_id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) SELECT vec_id, round(e[1] / (n + 1e-8), 6) + 0.0 AS first, round(e[len(e)] / (n + 1e-8), 6) + 0.0 AS last FROM n",
}
