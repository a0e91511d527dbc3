"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

A word's embedding is the sum of hashed vectors of the word and of its first bytes (so inflected forms share most of
it). Filters of widths 1 to 3 slide over the words of a text, a rectified maximum over its whole length is what a filter
says of it, and a logistic unit weighs the filters. Only gradients of the winning positions flow back.

The model is fitted on the driver on a bounded sample: at most SAMPLE labelled rows of each class, lowest hash of doc_id
first, held-out rows (crc32 of the id mod 5 = 0) excluded. Vectors of features that fewer than MIN_TEXTS texts of the
sample hold stay zero, so single texts can't be learned by heart. Its size is fixed (2**16 vectors of 8), so it travels
with the task. Scoring is one pass over whole texts without a shuffle; a lost task is rerun.

Each language's threshold makes the fewest errors on all its labelled rows that are not held out, in the mix of classes
that they have: their scores are counted by language, class and one of BINS steps of the logit, sums that tasks merge. A
cut lies in the middle between the scores of two filled steps; scores within one step are not told apart. A language with
fewer than MIN_LANGUAGE rows of either class takes 0.5. The score itself sees nothing but the text.

Defined results: null and empty texts have the score of no words; without labels of both classes the score is a
constant below 0.5; rows that repeat an id in labels count once, toxic if one of them says so; null labels count not.
Other columns are ignored by ``scores`` and kept by ``clean_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _hashing as H
from ._runtime import pieces, release, ship, utf8, written

BITS, DIM, WIDTHS, FILTERS = 16, 8, (1, 2, 3), 8
#: Bytes of a word's start that are features beside the word.
STARTS = (3, 4, 5, 6)
SAMPLE, MIN_TEXTS, MIN_LANGUAGE = 2000, 3, 5
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.02, 1e-4
#: Steps of the logit from -SPAN to SPAN that thresholds tell apart; what lies beyond falls into the outermost.
BINS, SPAN = 1 << 16, 16
#: Words are runs of letters and digits: neither ASCII punctuation nor white space.
BREAK = H.separators(bytes(c for c in range(128) if not chr(c).isalnum()))


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, features) hashed numbers, 0 where a word is too short; and the text of each word."""
    data = H.lower_ascii(data)
    a, b, text = H.words(data, at, BREAK)
    prefix = H.Prefix(data)
    out = np.zeros((len(a), 1 + len(STARTS)), np.int32)
    shift = np.uint64(64 - BITS)
    out[:, 0] = (prefix.span(a, b) >> shift).astype(np.int32) | 1
    for k, n in enumerate(STARTS, 1):
        long = b - a > n
        out[long, k] = (H.mix(prefix.span(a[long], a[long] + n) + np.uint64(n)) >> shift).astype(np.int32) | 1
    return out, text


class Model:
    """Weights; feature 0 is the zero vector."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        taps = sum(WIDTHS) * FILTERS
        self.vectors = rng.normal(0, 0.3, (1 << BITS, DIM)).astype(np.float32)
        self.vectors[0] = 0
        self.filters = rng.normal(0, 0.5, (DIM, taps)).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.weights = rng.normal(0.5, 0.1, len(self.bias)).astype(np.float32)
        self.constant = np.full(1, -2.0, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.bias, self.weights, self.constant]

    def pooled(self, feats: np.ndarray, text: np.ndarray, n_texts: int, argmax: bool = False):
        """(texts, filters) maxima, at least 0; and on request the winning word of each, or -1."""
        x = self.vectors[feats[:, 0]].copy()
        for k in range(1, feats.shape[1]):
            x += self.vectors[feats[:, k]]
        y = x @ self.filters
        out = np.zeros((n_texts, len(self.bias)), np.float32)
        where = np.full(out.shape, -1, np.int64) if argmax else None
        first = np.searchsorted(text, np.arange(n_texts + 1))
        filled = np.flatnonzero(np.diff(first))
        tap = 0
        for w_at, w in enumerate(WIDTHS):
            n = max(0, len(x) - w + 1)
            z = np.zeros((len(x), FILTERS), np.float32)
            for k in range(w):
                z[:n] += y[k : k + n, tap : tap + FILTERS]
                tap += FILTERS
            columns = slice(w_at * FILTERS, (w_at + 1) * FILTERS)
            z += self.bias[columns]
            over = np.ones(len(x), bool)
            over[:n] = text[:n] != text[w - 1 :] if n else over[:n]
            z[over] = 0
            if len(filled):
                top = np.maximum.reduceat(z, first[filled], axis=0)
                out[filled, columns] = np.maximum(top, 0)
                if argmax:
                    for i, row in enumerate(filled.tolist()):
                        a = first[row]
                        won = z[a : first[row + 1]].argmax(axis=0) + a
                        where[row, columns] = np.where(top[i] > 0, won, -1)
        return (out, where, x) if argmax else out

    def score(self, feats: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
        logit = self.pooled(feats, text, n_texts) @ self.weights + self.constant
        return 1 / (1 + np.exp(-logit.astype(np.float64)))

    def gradients(self, feats: np.ndarray, text: np.ndarray, n_texts: int, labels: np.ndarray, cost: np.ndarray) -> list[np.ndarray]:
        pooled, where, x = self.pooled(feats, text, n_texts, argmax=True)
        p = 1 / (1 + np.exp(-(pooled @ self.weights + self.constant)))
        d = ((p - labels) * cost / cost.sum()).astype(np.float32)
        g_filters, g_vectors = np.zeros_like(self.filters), np.zeros_like(self.vectors)
        back = d[:, None] * self.weights * (where >= 0)
        tap = 0
        for w_at, w in enumerate(WIDTHS):
            for k in range(w):
                for f in range(FILTERS):
                    column, won = w_at * FILTERS + f, where[:, w_at * FILTERS + f]
                    rows = np.flatnonzero(won >= 0)
                    words = won[rows] + k
                    g = back[rows, column]
                    g_filters[:, tap + f] = g @ x[words]
                    step = g[:, None] * self.filters[:, tap + f]
                    for c in range(feats.shape[1]):
                        np.add.at(g_vectors, feats[words, c], step)
                tap += FILTERS
        g_vectors[0] = 0
        return [g_vectors, g_filters, back.sum(axis=0), pooled.T @ d, d.sum(keepdims=True)]


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Adam on the cross entropy, both classes with the same weight in all."""
    model, rng = Model(seed), np.random.default_rng(seed)
    if len(set(labels.tolist())) < 2:
        model.weights[:] = 0
        return model
    found, owners = [], []
    for at in range(0, len(texts), 64):
        raw = [t.encode() for t in texts[at : at + 64]]
        own, owner = features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        found.append(own)
        owners.append((owner + at).astype(np.int32))
    feats, word_text = np.concatenate(found), np.concatenate(owners)
    first = np.searchsorted(word_text, np.arange(len(texts) + 1))
    holding = np.zeros(1 << BITS, np.int32)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        holding[np.unique(feats[a:b])] += 1
    common = holding >= MIN_TEXTS
    common[0] = False
    model.vectors[~common] = 0
    feats *= common[feats]
    cost = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    step = 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(texts)), -(-len(texts) // BATCH)):
            size = first[rows + 1] - first[rows]
            words = np.repeat(first[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
            grads = model.gradients(feats[words], np.repeat(np.arange(len(rows)), size), len(rows), labels[rows], cost[rows])
            step += 1
            for k, (p, g, (m, v)) in enumerate(zip(model.parameters(), grads, state, strict=True)):
                g = g + DECAY * p if k < 2 else g
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
            model.vectors[~common] = 0
    return model


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def known(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of labelled ids that are not held out."""
    rows = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return rows.where(~held_out())


def trained(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit on the sample; what reaches the driver is bounded by 2 * SAMPLE texts: of rows that repeat an id, the least text."""
    own, rank = known(labels), F.xxhash64("doc_id")
    picked = own.where("toxic = 1").orderBy(rank).limit(SAMPLE).unionAll(own.where("toxic = 0").orderBy(rank).limit(SAMPLE))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    one = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = one.toArrow().sort_by([("doc_id", "ascending")])
    sample, toxic = (rows.column(c).to_pylist() for c in ("text", "toxic"))
    del rows
    release(documents.sparkSession)
    return fit(sample, np.array(toxic, np.int64))


def _scored(model: Model, text: pa.Array) -> np.ndarray:
    data, at = utf8(text)
    feats, word_text = features(data, at)
    return model.score(feats, word_text, len(text))


def _scores(documents: DataFrame, model) -> DataFrame:
    """doc_id, held_out, lang, score, bin of each row, written once."""
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            score = _scored(model.value, piece.column(1))
            with np.errstate(divide="ignore"):
                logit = np.log(score) - np.log1p(-score)
            step = np.floor((np.clip(logit, -SPAN, SPAN) + SPAN) * (BINS / (2 * SPAN))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), piece.column(3), pa.array(score), pa.array(step)], ["doc_id", "held_out", "lang", "score", "bin"])

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"), lang.alias("lang"))
    return written(own.mapInArrow(run, "doc_id long, held_out boolean, lang string, score double, bin int"), "toxicity-scores")


def thresholds(scored: DataFrame, labels: DataFrame) -> dict[str | None, float]:
    """Of each language: the middle of the widest gap among the cuts with the fewest errors on all labelled rows."""
    counts = scored.join(known(labels), "doc_id").groupBy("lang", "bin").agg(F.sum("toxic").alias("bad"), F.count_if(F.col("toxic") != 1).alias("good"), F.min("score").alias("low"), F.max("score").alias("high"))
    every = Window.partitionBy("lang")  # at most BINS + 1 rows
    order = every.orderBy("bin")
    to_here = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = counts.select("*", F.sum("bad").over(every).alias("all_bad"), F.sum("good").over(every).alias("all_good"), F.sum("bad").over(to_here).alias("missed"), F.sum("good").over(to_here).alias("passed"), F.lead("low").over(order).alias("next"))
    cuts = sums.withColumn("errors", F.col("missed") + F.col("all_good") - F.col("passed")).withColumn("fewest", F.min("errors").over(every))
    cuts = cuts.where((F.least("all_bad", "all_good") >= MIN_LANGUAGE) & (F.col("errors") == F.col("fewest")) & F.col("next").isNotNull())
    best = F.max_by((F.col("high") + F.col("next")) / 2, F.struct(F.col("next") - F.col("high"), -F.col("bin")))
    return {r["lang"]: r["limit"] for r in cuts.groupBy("lang").agg(best.alias("limit")).collect()}  # a row a language


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold and toxic (score at its language's threshold or above) of each row."""
    spark = documents.sparkSession
    ship(spark)
    scored = _scores(documents, spark.sparkContext.broadcast(trained(documents, labels)))
    limits = spark.createDataFrame(list(thresholds(scored, labels).items()), "own string, threshold double")
    rows = scored.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("own")), "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("toxic"))


def clean_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents(doc_id, text, lang, ...) below their language's threshold, with their own columns."""
    context = documents.sparkSession.sparkContext
    ship(documents.sparkSession)
    model = context.broadcast(trained(documents, labels))
    limits = context.broadcast(thresholds(_scores(documents, model), labels))
    names = documents.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            score = _scored(model.value, piece.column(names.index("text")))
            languages = piece.column(names.index("lang")).to_pylist() if "lang" in names else [None] * len(score)
            yield piece.filter(pa.array(score < np.array([limits.value.get(x, 0.5) for x in languages])))

    return documents.mapInArrow(run, documents.schema)
