"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations only.

An item's window (10 words, or the whole of a shorter item) is a set of 5-word shingles; a text contains the window only
if it contains all of them, so one necessary shingle, the rarest in the corpus, is its prefix. One pass over the texts
counts the benchmark's shingles, a second one looks up the prefix shingle at every word, bounds the window by position
and length and compares its words exactly. Both passes stay in generated code and shuffle counts and hits only; whole
arrays of words never enter a shuffle.

The benchmark's side of a join is broadcast in blocks of at most BLOCK_WINDOWS windows, so its size is bounded whatever
the benchmark's. A text's hits are merged as intervals, sorted by the window operator, which spills.

Defined results: null texts have no words; items without words or without an id match nothing; rows of one item_id are
one item; rows that repeat doc_id and text have the same result each; other columns are not read.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import written

WINDOW, SHINGLE = 10, 5
#: Windows in a broadcast at once: about 300 bytes each.
BLOCK_WINDOWS = 100_000
#: What separates words, after A-Z are lower-cased.
PATTERN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, PATTERN), "")


def _key(of: Column, at: Column, n: int) -> Column:
    """Hash of the n words of an array from the 0-based index at."""
    return F.xxhash64(*(F.get(of, at + k) for k in range(n)))


def occurrences(benchmark: DataFrame) -> DataFrame:
    """item (string), window (its words), wid (the window's hash), size, n (words in a shingle) of each window of each item; written."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    size = F.least(F.lit(WINDOW), F.size("w"))
    start = F.explode(F.sequence(F.lit(1), F.size("w") - size + 1))
    rows = items.where(F.size("w") > 0).select("item", "w", size.alias("size"), start.alias("i"))
    rows = rows.select("item", F.slice("w", F.col("i"), F.col("size")).alias("window"), "size", F.least(F.lit(SHINGLE), "size").alias("n"))
    return written(rows.withColumn("wid", F.xxhash64("window")).distinct(), "benchmark-windows")


def _shingles(wins: DataFrame, n: int) -> DataFrame:
    """Every shingle of the windows whose shingles have n words: wid, window, size, offset, key."""
    rows = wins.where(F.col("n") == n).withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("size") - n)))
    return rows.withColumn("key", _key(F.col("window"), F.col("offset"), n))


def _positions(documents: DataFrame, n: int) -> DataFrame:
    """A row for each place of documents where n words follow: doc_id, text_hash, w, pos, key."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    rows = texts.select("*", F.posexplode("w").alias("pos", "word")).where(F.col("pos") <= F.size("w") - n)
    return rows.withColumn("key", _key(F.col("w"), F.col("pos"), n))


def hits(documents: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, size, wid of each occurrence in a text of a distinct window of known, as occurrences has them."""
    found = []
    wins = written(known.groupBy("wid", "size", "n").agg(F.first("window").alias("window")), "distinct-windows")
    counts = wins.groupBy("n").count().collect()  # a row for each length of a shingle: five at most
    for n, total in sorted((r["n"], r["count"]) for r in counts):
        blocks = -(-total // BLOCK_WINDOWS)
        for block in range(blocks):
            own = wins.where(F.pmod("wid", F.lit(blocks)) == block) if blocks > 1 else wins
            shingles = _shingles(own, n)
            seen = _positions(documents, n).join(F.broadcast(shingles.select("key").distinct()), "key").groupBy("key").agg(F.count("*").alias("n_seen"))
            rarity = written(seen, "shingle-counts")
            order = Window.partitionBy("wid").orderBy(F.coalesce("n_seen", F.lit(0)), "offset")
            prefix = shingles.join(rarity, "key", "left").withColumn("rank", F.row_number().over(order)).where("rank = 1 and n_seen is not null")
            prefix = prefix.select("key", "wid", "window", "size", "offset")
            text = _positions(documents, n).alias("t")
            fits = (F.col("t.pos") >= F.col("p.offset")) & (F.col("t.pos") - F.col("p.offset") + F.col("p.size") <= F.size("t.w"))
            same = F.slice("t.w", F.greatest(F.col("t.pos") - F.col("p.offset") + 1, F.lit(1)), F.col("p.size")) == F.col("p.window")
            joined = text.join(F.broadcast(prefix.alias("p")), (F.col("t.key") == F.col("p.key")) & fits & same)
            found.append(joined.select("doc_id", "text_hash", (F.col("t.pos") - F.col("p.offset")).alias("start"), "size", "wid"))
    if not found:
        empty = "doc_id long, text_hash long, start int, size int, wid long"
        return documents.sparkSession.createDataFrame([], empty)
    return reduce(DataFrame.unionAll, found)


def summary(found: DataFrame, known: DataFrame) -> DataFrame:
    """n_hit and items (sorted strings) of each text with hits: positions by window, items after."""
    row = ["doc_id", "text_hash"]
    ends = F.max(F.col("start") + F.col("size"))
    before = Window.partitionBy(*row).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.groupBy(*row, "start").agg(ends.alias("end"))
    fresh = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    spans = spans.withColumn("fresh", F.greatest(fresh, F.lit(0)))
    sizes = spans.groupBy(*row).agg(F.sum("fresh").alias("n_hit")).alias("s")
    met = found.select(*row, "wid").distinct().join(known.select("wid", "item"), "wid").groupBy(*row).agg(F.array_sort(F.collect_set("item")).alias("items")).alias("m")
    same = F.col("s.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("s.text_hash") == F.col("m.text_hash"))
    return sizes.join(met, same).select("s.doc_id", "s.text_hash", "n_hit", "items")


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of documents."""
    known = occurrences(benchmark)
    found = written(summary(written(hits(documents, known), "window-hits"), known), "contaminated-texts").alias("f")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words")).alias("d")
    joined = rows.join(found, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_hash") == F.col("f.text_hash")), "left")
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return joined.select(
        F.col("d.doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents without a hit, with their own columns."""
    found = written(hits(documents, occurrences(benchmark)).select("doc_id", "text_hash").distinct(), "contaminated-texts").alias("f")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64("d.text") == F.col("f.text_hash"))
    return documents.alias("d").join(found, same, "left_anti")
