"""Quality by perplexity: interpolated modified Kneser-Ney models of characters, one for each language with trusted text.

A model's symbols are the code points of the lower-cased text, digits as one, so every script is spelled out; its n-grams are
strings of up to ORDER of them. Counts come from all trusted text that isn't held out, whatever their number: tasks send sums
of their distinct n-grams, and continuation counts, context totals, discounts, back-off weights and the interpolated
probability of every n-gram seen are aggregations and joins of these counts in Spark.

Documents meet the counts in a sharded join. They are dealt into blocks of about BLOCK characters; a block asks once for each of
its distinct n-grams and contexts, by 64-bit keys. Requests and models are dealt by ranges of the key (shards), and each shard
answers with the probabilities that it knows, in the order asked. Answers meet their block's documents, whose exchange serves both
times, and every position of a text takes the longest n-gram known, backed off by the weights of its contexts. No table reaches the
driver or is broadcast.

One in HELD_OUT trusted documents (by crc32 of the id) trains nothing. A language's threshold is the QUANTILE of their perplexities, or of all its trusted ones where none is held out. Documents of other languages share the model of all trusted text, '',
whose threshold is the same quantile of all held-out documents scored by it; it is made only if there are such documents.

Defined results: a document without text has no perplexity and is not kept; rows of labels with a null id or quality count
not, repeated ones count as trusted if one is; without trusted text to train on, every text is kept with no perplexity; repeated rows
are scored one by one; texts are scored in slices, so their length is bounded by what a row may hold. Two of N keys collide with
a probability of N**2 / 2**65. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _hashing as H
from ._runtime import parts, release, ship, tidy, written

ORDER, QUANTILE, HELD_OUT = 4, 0.99, 5
#: Characters of a block of documents, about; positions that numpy works on at once; n-grams that a task sums up before it sends them.
BLOCK, SLICE, SUMS = 16_000_000, 1 << 19, 1 << 18
#: Bytes of requests that one shard answers, about.
SHARD = 1 << 25
#: Label rows that are broadcast to pick trusted texts; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
POOLED, PAD = "", "\n"
WEIGHTS = [np.uint64(pow(int(H.BASE), k, 1 << 64)) for k in range(ORDER)]


# Keys


def _salt(model: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(model.encode(), digest_size=8).digest(), "little"))


def _symbols(codes: np.ndarray) -> np.ndarray:
    return H.mix(codes.astype(np.uint64) + np.uint64(1))


def _key(sums: np.ndarray, salt, kind: int) -> np.ndarray:
    """kind: k > 0 an n-gram of k symbols, -k the context of one, 0 the model itself."""
    return H.mix(sums + H.mix(salt + np.uint64(kind & 0xFF)))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, in the keys' order, and which of them each key is: one sort of numbers that hold a key's head and its place."""
    n = len(keys)
    low = np.uint64(max(1, (n - 1).bit_length()))
    both = (keys >> low << low) | np.arange(n, dtype=np.uint64)
    both.sort()
    place, head = (both & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64), both >> low
    new = np.ones(n, bool)
    new[1:] = head[1:] != head[:-1]
    which = np.empty(n, np.int32)
    which[place] = np.cumsum(new, dtype=np.int32) - 1
    first = place[new]
    if (keys[first][which] != keys).any():  # two keys with one head
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    return first, which.astype(np.int32, copy=False)


class Grams:
    """Distinct n-grams of ORDER symbols of some texts, by key: symbols, last one first, and the salt of the model."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray, salt: np.ndarray):
        first, self.which = distinct(keys)
        self.first, self.keys, self.codes, self.salt = first, keys[first], codes[first], salt[first]

    def kinds(self) -> dict[int, np.ndarray]:
        """The keys of all that the n-grams need, by kind."""
        symbols, none = _symbols(self.codes), np.zeros(len(self.keys), np.uint64)
        out = {ORDER: self.keys, 0: _key(none, self.salt, 0), -1: _key(none, self.salt, -1)}
        gram, context = none, none
        for k in range(1, ORDER):
            gram = gram + symbols[:, k - 1] * WEIGHTS[k - 1]
            context = context + symbols[:, k] * WEIGHTS[k - 1]
            out[k], out[-k - 1] = _key(gram, self.salt, k), _key(context, self.salt, -k - 1)
        return out


class Slice(Grams):
    """Positions of texts that numpy works on at once: which of the distinct n-grams ends at each, and where texts begin."""

    def __init__(self, codes: np.ndarray, at: np.ndarray, own: np.ndarray, salts: np.ndarray):
        first = at[0] - ORDER + 1
        codes, at = codes[first : at[-1] + 1], at - first
        symbols, salt = _symbols(codes), salts[own]
        sums = symbols[at]
        for k in range(1, ORDER):
            sums = sums + symbols[at - k] * WEIGHTS[k]
        keys = _key(sums, salt, ORDER)
        some, self.which = distinct(keys)
        spot = at[some]
        self.keys, self.salt, self.codes = keys[some], salt[some], np.stack([codes[spot - k] for k in range(ORDER)], axis=1)
        self.owner, self.count = own[some], np.bincount(self.which, minlength=len(some))
        self.starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        self.texts, self.sizes = own[self.starts], np.diff(self.starts, append=len(own))


def merged(parts_: Iterable[Slice]) -> Grams:
    """The distinct n-grams of slices."""
    found = [(p.keys, p.codes, p.salt) for p in parts_]
    if not found:
        return Grams(np.zeros(0, np.uint64), np.zeros((0, ORDER), np.uint32), np.zeros(0, np.uint64))
    return Grams(*(np.concatenate(x) for x in zip(*found, strict=True)))


def slices(texts: list[str], salts: np.ndarray) -> Iterator[Slice]:
    """All positions of texts; a text begins after ORDER - 1 breaks."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE):
            size += len(texts[to])
            to += 1
        low = [t.lower() for t in texts[at:to]]
        codes = np.frombuffer("".join([PAD * (ORDER - 1) + t for t in low]).encode("utf-32-le"), np.uint32).copy()
        codes[(codes >= 48) & (codes <= 57)] = 48
        length = np.array([len(t) for t in low])
        ends = np.cumsum(length)
        for a in range(0, int(ends[-1]), SLICE):
            place = np.arange(a, min(a + SLICE, int(ends[-1])))
            own = np.searchsorted(ends, place, side="right")
            yield Slice(codes, place + (own + 1) * (ORDER - 1), own + at, salts)
        at = to


def _models(names: list[str]) -> np.ndarray:
    known = {m: _salt(m) for m in set(names)}
    return np.array([known[m] for m in names], np.uint64)


# Counts


def _texts(documents: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(POOLED)) if "lang" in documents.columns else F.lit(POOLED)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.alias("lang"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id, held_out of the trusted documents; written."""
    ids = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("q")).where("q = 1")
    return written(ids.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0).alias("held_out")), "trusted-ids")


def _of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi")


def counts(texts: DataFrame, pooled: bool) -> DataFrame:
    """model, g, c: how often each n-gram of ORDER symbols occurs in texts(text, lang), for each language and, if pooled, for all; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, bytes], int] = {}
        for batch in batches:
            tidy()
            text, lang = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in slices(text, _models(lang)):
                raw, size = np.ascontiguousarray(part.codes[:, ::-1]).tobytes(), 4 * ORDER
                for k, (own, c) in enumerate(zip(part.owner.tolist(), part.count.tolist(), strict=True)):
                    key = lang[own], raw[k * size : (k + 1) * size]
                    found[key] = found.get(key, 0) + c
                if len(found) > SUMS:
                    yield sent(found)
                    found = {}
        if found:
            yield sent(found)

    def sent(found: dict) -> pa.RecordBatch:
        columns = [pa.array([m for m, _ in found]), pa.array([g.decode("utf-32-le") for _, g in found]), pa.array(list(found.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["model", "g", "c"])

    rows = texts.select("text", "lang").mapInArrow(run, "model string, g string, c long")
    own = rows.groupBy("model", "g").agg(F.sum("c").alias("c"))
    if pooled:  # from the languages' sums; texts of no language count here only
        own = written(own, "ngrams-by-language")
        own = own.where(F.col("model") != POOLED).unionAll(own.groupBy("g").agg(F.sum("c").alias("c")).select(F.lit(POOLED).alias("model"), "g", "c"))
    return written(own.where(F.lit(pooled) | (F.col("model") != POOLED)), "ngram-counts")


def levels(top: DataFrame) -> list[DataFrame]:
    """Counts (model, g, c) of order 1 to ORDER: below the highest, of the distinct symbols before."""
    out = [top]
    for _ in range(ORDER - 1):
        out.append(written(out[-1].groupBy("model", F.expr("substring(g, 2)").alias("g")).agg(F.count("*").alias("c")), "continuations"))
    return out[::-1]


def weighted(level: DataFrame, order: int, few: bool) -> tuple[DataFrame, DataFrame]:
    """Of counts (model, g, c): discounted shares (model, g, share), and back-off weights (model, context, weight). few: whether a row a model can be broadcast."""
    n = [F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))
    d = [k - (k + 1) * y * F.try_divide(f"n{k + 1}", f"n{k}") for k in (1, 2, 3)]
    bounded = [F.greatest(F.lit(0.0), F.least(F.coalesce(x, F.lit(0.75)), F.lit(float(k)))).alias(f"d{k}") for k, x in enumerate(d, 1)]
    discounts = level.groupBy("model").agg(*n).select("model", *bounded)  # a row a model
    discounts = F.broadcast(discounts) if few else discounts
    own = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = level.join(discounts, "model").withColumn("d", F.least(own, F.col("c"))).withColumn("context", F.expr(f"substring(g, 1, {order - 1})"))
    contexts = rows.groupBy("model", "context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("weight"))
    shares = rows.join(contexts, ["model", "context"]).select("model", "context", "g", ((F.col("c") - F.col("d")) / F.col("total")).alias("share"), "weight")
    return shares, contexts.select("model", "context", "weight")


def probabilities(top: DataFrame) -> DataFrame:
    """model, kind, g, value: of every n-gram of k symbols seen its probability (kind k), of every context its weight (-k), of a model the
    probability of a symbol of which nothing is known (0)."""
    below, out = None, []
    few = top.select("model").distinct().count() <= BROADCAST_ROWS
    for order, level in enumerate(levels(top), 1):
        shares, contexts = weighted(level, order, few)
        if below is None:  # all seen symbols, and one for what is not
            below = level.groupBy("model").agg((1 / (F.count("*") + 1)).alias("p"))
            out.append(below.select("model", F.lit(0).alias("kind"), F.lit("").alias("g"), F.col("p").alias("value")))
            own = shares.join(F.broadcast(below) if few else below, "model")
        else:
            own = shares.withColumn("suffix", F.expr("substring(g, 2)")).join(below.withColumnRenamed("g", "suffix"), ["model", "suffix"])
        below = written(own.select("model", "g", (F.col("share") + F.col("weight") * F.col("p")).alias("p")), "probabilities")
        out.append(below.select("model", F.lit(order).alias("kind"), "g", F.col("p").alias("value")))
        out.append(contexts.select("model", F.lit(-order).alias("kind"), F.col("context").alias("g"), F.col("weight").alias("value")))
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionAll(x)
    return rows


def _keyed(table: DataFrame, bits: int) -> DataFrame:
    """shard, key, value of probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            salt, kind, text = _models(batch.column(0).to_pylist()), batch.column(1).to_numpy(), np.array(batch.column(2).to_pylist() + [None], object)[:-1]
            keys = np.zeros(batch.num_rows, np.uint64)
            for k in np.unique(kind).tolist():
                own, size = np.flatnonzero(kind == k), k if k >= 0 else -k - 1
                sums = np.zeros(len(own), np.uint64)
                if size:
                    symbols = _symbols(np.frombuffer("".join(text[own]).encode("utf-32-le"), np.uint32).reshape(-1, size))
                    for j in range(size):
                        sums += symbols[:, size - 1 - j] * WEIGHTS[j]
                keys[own] = _key(sums, salt[own], k)
            columns = [pa.array((keys >> np.uint64(64 - bits)).astype(np.int64)), pa.array(keys.view(np.int64)), batch.column(3).cast(pa.float32())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "key", "value"])

    return table.mapInArrow(run, "shard long, key long, value float")


# The join of documents with the counts


def _asked(kinds: dict[int, np.ndarray]) -> np.ndarray:
    """All keys, each once, sorted."""
    keys = np.sort(np.concatenate(list(kinds.values())))
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def perplexities(texts: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, again, model, n_chars, perplexity of each row of texts(doc_id, again, text, model); written."""
    spark = texts.sparkSession
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    bits = max(4, (max(parts(spark), total // SHARD) - 1).bit_length())  # requests are about a byte a character
    dealt = texts.select("doc_id", "again", "text", "model", F.pmod(F.xxhash64("doc_id", "again", "text"), F.lit(blocks)).alias("block"))

    def ask(rows: pa.Table) -> pa.Table:
        tidy()
        keys = _asked(merged(slices(rows.column("text").to_pylist(), _models(rows.column("model").to_pylist()))).kinds())
        shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(keys) else np.zeros(0, np.int64)
        blobs = [keys[a:b].tobytes() for a, b in zip(start.tolist(), [*start[1:].tolist(), len(keys)], strict=False)]
        return pa.table({"block": pa.array(np.full(len(start), rows.column("block")[0].as_py())), "shard": pa.array(shard[start]), "keys": pa.array(blobs, pa.binary())})

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        tidy()
        own, value = known.column("key").to_numpy().view(np.uint64), known.column("value").to_numpy()
        order = np.argsort(own)
        own, value = own[order], value[order]
        out = []
        for blob in asked.column("keys"):
            keys = np.frombuffer(blob.as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(own, keys), max(0, len(own) - 1))
            out.append(np.where(own[at] == keys, value[at], np.float32(np.nan)).astype(np.float32).tobytes() if len(own) else np.full(len(keys), np.nan, np.float32).tobytes())
        return pa.table({"block": asked.column("block"), "shard": asked.column("shard"), "answers": pa.array(out, pa.binary())})

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        tidy()
        text, model = rows.column("text").to_pylist(), rows.column("model").to_pylist()
        salts = _models(model)
        parts_ = list(slices(text, salts)) if sum(map(len, text)) <= 2 * BLOCK else None  # else once more: a very long text
        grams = merged(parts_ or slices(text, salts))
        kinds = grams.kinds()
        keys = _asked(kinds)
        shards = np.argsort(answers.column("shard").to_numpy())
        value = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(answers.column("answers")[k].as_buffer(), np.float32) for k in shards.tolist())]).astype(np.float64)
        if len(value) != len(keys):
            raise ValueError(f"a block asked for {len(keys)} keys and got {len(value)} answers")
        known = {kind: value[np.searchsorted(keys, own)] for kind, own in kinds.items()}
        p = known[0]
        for k in range(1, ORDER + 1):
            p = np.where(np.isnan(known[k]), np.where(np.isnan(known[-k]), 1.0, known[-k]) * p, known[k])
        log, bits_, n = np.log2(p), np.zeros(len(text)), np.zeros(len(text), np.int64)
        for part in parts_ or slices(text, salts):
            own = log[np.searchsorted(grams.keys, part.keys)][part.which]
            np.add.at(bits_, part.texts, np.add.reduceat(own, part.starts))
            np.add.at(n, part.texts, part.sizes)
        result = np.exp2(-bits_ / np.maximum(n, 1))
        return pa.table({"doc_id": rows.column("doc_id"), "again": rows.column("again"), "model": rows.column("model"), "n_chars": pa.array(n), "perplexity": pa.array(result, mask=(n == 0) | np.isnan(result))})

    asked = dealt.groupBy("block").applyInArrow(ask, "block long, shard long, keys binary")
    answers = asked.groupBy("shard").cogroup(_keyed(table, bits).groupBy("shard")).applyInArrow(answer, "block long, shard long, answers binary")
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, again boolean, model string, n_chars long, perplexity double")
    out = written(out, "perplexities")
    release(spark)
    return out


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, model (its language, or '' for the shared one), n_chars, perplexity, threshold, kept of each row."""
    ship(documents.sparkSession)
    texts, ids = _texts(documents), trusted_ids(labels)
    trains = _of(texts, ids.where("not held_out").select("doc_id"))
    own = trains.where((F.col("lang") != POOLED) & (F.col("text") != "")).select("lang").distinct()
    languages = written(own, "languages").withColumn("model", F.col("lang"))
    pooled = not texts.select("lang").join(languages, "lang", "left_anti").isEmpty()
    table = written(probabilities(counts(trains, pooled)), "model")
    release(documents.sparkSession)  # shuffles of the counts
    known = texts.join(languages, "lang", "left").select("doc_id", F.lit(False).alias("again"), "text", F.coalesce("model", F.lit(POOLED)).alias("model"))
    if pooled:  # the shared model's threshold: held-out texts of the others once more
        held = _of(texts, ids.where("held_out").select("doc_id")).join(languages, "lang", "left_semi")
        known = known.unionAll(held.select("doc_id", F.lit(True), "text", F.lit(POOLED)))
    rows = perplexities(known, table)
    quantile = lambda of: F.percentile_approx(F.when(of, F.col("perplexity")), QUANTILE, 10_000)
    limits = rows.join(ids, "doc_id").groupBy("model").agg(F.coalesce(quantile(F.col("held_out")), quantile(~F.col("again"))).alias("threshold"))  # a row a model
    out = rows.where("not again").drop("again").join(limits, "model", "left").select("doc_id", "model", "n_chars", "perplexity", "threshold")
    return out.withColumn("kept", (F.col("n_chars") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
