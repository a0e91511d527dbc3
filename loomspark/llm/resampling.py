"""Importance resampling towards a target distribution, in DataFrame operations only.

A table of positions has a row for each word of each text (posexplode); for runs of two and more words lead() over a text's
positions puts the following words beside it. Each run is hashed to one of a fixed number of buckets; counts of the buckets
in the corpus and in the target give a bucket's gain, the logarithm of the smoothed ratio. A text's weight is the sum of
its gains; a Gumbel draw from a hash of the seed and the id is added, and the highest scores are drawn, without replacement.

Scale: texts never enter a shuffle. Counts of buckets are summed up before they move, and so are a text's gains: with runs of
one word a scan, a broadcast join with the gains (as many rows as buckets, a parameter) and a partial sum for each text make
one stage. Runs of more words shuffle positions once by text, whose rows the window reads in order and may spill. The order
of all scores is a range partitioning on score and id, written once, and a rank inside each range; only the ranges' sizes,
one row a partition, meet in one place.

Defined results: a null or empty text has no runs and weight 0; a null id draws as an empty one; each row of the documents
counts for itself, also if it repeats; an empty target or corpus has no counts and is smoothed as such; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import written
from .decontamination import words

BUCKETS, SEED = 10_000, 2024


def positions(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos and word: a row for each word of text; a text without words keeps one row, without a word."""
    return texts.select(*keys, F.posexplode_outer(words(F.col("text"))).alias("pos", "word"))


def runs(texts: DataFrame, keys: list[str], longest: int, buckets: int) -> DataFrame:
    """keys and bucket: a row for each run of 1 to longest words; a text without words keeps one row, without a bucket."""
    rows, run = positions(texts, keys), [F.col("word")]
    if longest > 1:
        following = Window.partitionBy(*keys).orderBy("pos")
        rows = rows.select("*", *(F.lead("word", k).over(following).alias(f"next{k}") for k in range(1, longest)))
        for k in range(2, longest + 1):
            joined = F.concat_ws(" ", "word", *(f"next{i}" for i in range(1, k)))
            run.append(F.when(F.col(f"next{k - 1}").isNotNull(), joined))
        some = F.filter(F.array(*run), lambda x: x.isNotNull())
        rows = rows.select(*keys, F.explode_outer(some).alias("run"))
    else:
        rows = rows.select(*keys, F.col("word").alias("run"))
    return rows.select(*keys, (F.crc32(F.col("run").cast("binary")) % buckets).cast("int").alias("bucket"))


def gains(documents: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of every bucket: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))); as many rows as buckets."""
    spark = documents.sparkSession

    def counted(texts: DataFrame, name: str) -> DataFrame:
        own = texts.select(F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
        return runs(own, ["row"], longest, buckets).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))

    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counted(documents, "s"), "bucket", "left").join(counted(target, "t"), "bucket", "left")
    both = written(both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "bucket-counts")
    whole = Window.partitionBy(F.lit(0))  # as many rows as buckets
    both = both.select("*", F.sum("s").over(whole).alias("all_s"), F.sum("t").over(whole).alias("all_t"))
    d = lambda c, more: F.col(c).cast("double") + F.lit(float(more))
    ratio = (d("t", 1) * d("all_s", buckets)) / (d("s", 1) * d("all_t", buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def draw(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) with u in (0, 1) from the first 32 bits of sha256 of seed:key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighted(documents: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row of documents."""
    table = F.broadcast(gains(documents, target, longest, buckets))  # as many rows as buckets
    own = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = ["row", "doc_id"]
    rows = runs(own, keys, longest, buckets).join(table, "bucket", "left")
    sums = rows.groupBy(*keys).agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    # n words have n + (n - 1) + ... runs, as far as n reaches.
    n = F.col("n_features")
    if longest > 1:
        short = longest * (longest + 1) // 2
        exact = F.when(n < short, F.floor((F.sqrt(8 * n + 1) - 1) / 2)).otherwise((n + longest * (longest - 1) // 2) / longest)
    else:
        exact = n
    return sums.select("doc_id", exact.cast("long").alias("n_words"), "n_features", "weight", (F.col("weight") + draw(F.col("doc_id"), seed)).alias("score"))


def resampled(
    documents: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, least_words: int = 20, percent: int = 10
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (1, 2, ... for the rows drawn, else null) of each row of documents.

    Of the n rows with least_words words, floor(percent * n / 100) are drawn: highest score first, smaller doc_id of equal ones.
    """
    known = weighted(documents, target, longest, buckets, seed).withColumn("able", F.col("n_words") >= least_words)
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    known = known.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    known = written(known, "weighted-texts")  # ranges are read from here on, never worked out again
    sizes = known.where("able").groupBy("range").agg(F.count("*").alias("size"))  # a row for each partition
    before = Window.partitionBy(F.lit(0)).orderBy("range")
    limit = F.expr(f"(sum(size) over (partition by 0) * {percent}) div 100")
    sizes = sizes.select("range", (F.sum("size").over(before) - F.col("size")).alias("offset"), limit.alias("drawn")).where("offset < drawn")
    rows = known.join(F.broadcast(sizes), "range", "left")
    place = F.col("offset") + F.row_number().over(Window.partitionBy("range", "able").orderBy(*order[1:]))
    first = rows.where("able and offset is not null").withColumn("rank", place)
    first = first.withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")))
    rest = rows.where("not able or offset is null").withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long"))


def sampled_documents(documents: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of documents whose id is drawn, with their own columns."""
    ids = resampled(documents, target, **settings).where("rank is not null").select(F.col("doc_id").alias("drawn_id")).distinct()
    return documents.join(ids, F.col("doc_id").cast("long") == F.col("drawn_id"), "left_semi")
