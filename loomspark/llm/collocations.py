"""Collocations of a corpus: merged count-min sketches find the phrases that can be frequent, a second pass counts those exactly.

Pass 1: every task counts the hashes of all words, pairs and triples of its texts in a sketch of DEPTH rows whose counters stop
at the threshold, and sends it in blocks of BLOCK counters, as counters or as a list of those above 0, whichever is shorter.
Blocks are summed up as they arrive, so no task holds more than its share of the sketch. A counter is never below the count of
a phrase that falls on it, so a phrase is dropped only if it is rare. Pass 2 looks each phrase up in the bitmaps of full
counters, adds up what survives in each piece of text, and Spark adds up the rest by the phrase itself. Counts, cuts and
scores are then joins and aggregations, exact in decimals.

Scale: a row of the sketch has about one counter for every CELLS occurrences, up to MOST counters: the bitmaps that go
through the driver to all tasks end at DEPTH * MOST / 8 bytes. Beyond that more rare phrases pass and are counted, and the
result stays the same. A phrase whose parts fail is not looked up. Parts that make up 1 / HEAVY of all words or more, at
most 2 * HEAVY rows, are broadcast; any other part has few phrases, so the joins have no hot keys. The first of each language
are found in three rounds of ranks over salted groups.

Defined results: a null text is empty; a null language is 'und'; repeated rows count each time; empty tables give no rows.
A longer text is worked on in slices of SLICE bytes that share two words; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._hashing import U64, Prefix, lower_ascii, mix, ngrams, separators, words
from ._runtime import parts, pieces, ship, tidy, utf8, written

LEAST, TOP = 10, 2000
LONGEST = 3
#: Rows of the sketch, counters in a block of one, occurrences for each counter, least and most counters in a row.
DEPTH, BLOCK, CELLS = 2, 1 << 16, 8
FEWEST, MOST = 1 << 18, 1 << 27
#: Bytes of text that are hashed at once.
SLICE = 4 << 20
HEAVY = 2000
#: Groups in which the first TOP of a language are looked for, round by round.
SALTS = (1024, 32, 1)
#: What ends a piece, and what words are apart by.
STOP, BLANK = separators(b".,;:!?\x0a\x0b\x0c\x0d"), separators(b"\x20\x09")
APART = STOP | BLANK


class Slice:
    """Words, pairs and triples in a run of texts. By length: index of the text, first byte, end, hash, whether it counts here, whether its words are one space apart."""

    def __init__(self, data: np.ndarray, at: np.ndarray, langs: np.ndarray, fresh: np.ndarray):
        """langs: a hash for each text; fresh: the byte of data after which a phrase of each text must end to count."""
        data = lower_ascii(data)
        self.data = np.where(data == 9, np.uint8(32), data)
        a, b, text = words(self.data, at, APART)
        stops = np.zeros(len(data) + 1, np.int64)
        np.cumsum(STOP[self.data], out=stops[1:])
        piece, own = stops[a], Prefix(self.data).span(a, b)
        wide = np.zeros(len(a) + 1, np.int64)  # how many words before have more than a space after them
        np.cumsum(a[1:] - b[:-1] > 1, out=wide[1 : len(a)]) if len(a) else None
        self.text, self.start, self.end, self.hash, self.counts, self.plain = [], [], [], [], [], []
        for n in range(1, LONGEST + 1):
            m = max(0, len(a) - n + 1)
            k = np.flatnonzero((text[:m] == text[n - 1 :]) & (piece[:m] == piece[n - 1 :]))
            self.text.append(text[k])
            self.start.append(a[k])
            self.end.append(b[k + n - 1])
            self.hash.append(mix(ngrams(own, n)[k] ^ langs[text[k]]))
            self.counts.append(b[k + n - 1] > fresh[text[k]])
            self.plain.append(wide[k + n - 1] == wide[k])

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes and how often each occurs."""
        return np.unique(np.concatenate([h[c] for h, c in zip(self.hash, self.counts, strict=True)]), return_counts=True)


def _lang_hash(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode() + b"\0", np.uint8)
    return Prefix(data).span(np.zeros(1, np.int64), np.full(1, len(data)))[0]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Slice, list[str]]]:
    """Slices of about SLICE bytes of lang, text batches, with the language of each text."""
    known: dict[str, np.uint64] = {}
    for batch in pieces(batches, limit=SLICE):
        langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        for lang in set(langs).difference(known):
            known[lang] = _lang_hash(lang)
        hashes = np.array([known[x] for x in langs], U64)
        data, at = utf8(batch.column(batch.schema.get_field_index("text")))
        if len(data) <= 2 * SLICE:
            yield Slice(data, at, hashes, at[:-1]), langs
            continue
        for i in range(len(langs)):  # one long text
            yield from ((x, langs[i : i + 1]) for x in _long(data[at[i] : at[i + 1]], hashes[i : i + 1]))
    tidy()


def _long(data: np.ndarray, lang: np.ndarray) -> Iterator[Slice]:
    """Slices of one text that end between words and begin LONGEST - 1 words before the last one's end."""
    begin = fresh = 0
    while fresh < len(data):
        end = fresh + SLICE
        while end < len(data):  # up to the next place between words
            gap = np.flatnonzero(APART[data[end : end + SLICE]])
            if len(gap):
                end += int(gap[0])
                break
            end += SLICE
        end = min(end, len(data))
        part = data[begin:end]
        yield Slice(part, np.array([0, len(part)]), lang, np.array([fresh - begin]))
        a, _, _ = words(part, np.array([0, len(part)]), APART)
        begin += int(a[max(0, len(a) - LONGEST + 1)]) if len(a) else len(part)
        fresh = end


def cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """The counter of each hash in a row of a sketch of width counters, a power of two up to 2^32."""
    return ((hashes >> U64(32 * row)) & U64(width - 1)).astype(np.int64)


def _packed(counters: np.ndarray) -> bytes:
    """A block: counters of a byte each, or places and counters of those above 0."""
    some = np.flatnonzero(counters)
    if len(some) * 3 < len(counters):
        return b"S" + some.astype("<u2").tobytes() + counters[some].tobytes()
    return b"D" + counters.tobytes()


def _add(into: np.ndarray, block: bytes, least: int) -> None:
    if block[:1] == b"D":
        into[:] = np.minimum(into.astype(np.uint16) + np.frombuffer(block, np.uint8, offset=1), least)
    else:
        n = (len(block) - 1) // 3
        at = np.frombuffer(block, "<u2", n, 1)
        into[at] = np.minimum(into[at].astype(np.uint16) + np.frombuffer(block, np.uint8, n, 1 + 2 * n), least)


def width_of(total: int) -> int:
    """Counters in a row for so many occurrences."""
    return int(min(MOST, max(FEWEST, 1 << max(0, -(-total // CELLS) - 1).bit_length())))


def sketched(texts: DataFrame, width: int, least: int = LEAST) -> DataFrame:
    """depth, block, bits: of each block of the merged sketch the bitmap of its full counters; written. texts: lang, text."""
    spark = texts.sparkSession
    ship(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((DEPTH, width), np.uint8)
        for part, _ in slices(batches):
            found, times = part.counted()
            for row in range(DEPTH):
                at = cells(found, row, width)
                order = np.argsort(at, kind="stable")
                at = at[order]
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))[: len(at)]
                if len(first):
                    sums = np.add.reduceat(times[order], first)
                    sketch[row, at[first]] = np.minimum(sketch[row, at[first]] + sums, least)
        for row in range(DEPTH):
            for block in range(0, width, BLOCK):
                counters = sketch[row, block : block + BLOCK]
                if counters.any():
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([block // BLOCK]), pa.array([_packed(counters)], pa.binary())], ["depth", "block", "counters"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, block, counters in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                into = sums.setdefault((row, block), np.zeros(min(BLOCK, width), np.uint8))
                _add(into, counters, least)
        full = [(row, block, np.packbits(x >= least).tobytes()) for (row, block), x in sums.items()]
        if full:
            row, block, bits = zip(*full, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(block), pa.array(bits, pa.binary())], ["depth", "block", "bits"])

    blocks = texts.mapInArrow(count, "depth long, block long, counters binary")
    merged = blocks.repartition(parts(spark), "depth", "block").mapInArrow(merge, "depth long, block long, bits binary")
    return written(merged, "phrase-sketch")


def _full(spark, blocks: DataFrame, width: int):
    """The bitmaps of full counters, DEPTH * width bits, for every task; bounded by MOST."""
    size = min(BLOCK, width) // 8
    full = np.zeros((DEPTH, width // 8), np.uint8)
    for r in blocks.collect():
        full[r["depth"], r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(full)


def survivors(texts: DataFrame, width: int, least: int = LEAST) -> DataFrame:
    """lang, n_words, phrase, f: exact counts of all phrases of 1 to LONGEST words with at least so many occurrences; written.

    A row of n_words 0 and an empty phrase holds the number of all words of a language.
    """
    spark = texts.sparkSession
    full = _full(spark, sketched(texts, width, least), width)

    def look(hashes: np.ndarray) -> np.ndarray:
        k = np.arange(len(hashes))
        for row in range(DEPTH):
            at = cells(hashes[k], row, width)
            k = k[(full.value[row, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0]
        return k

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, langs in slices(batches):
            names, codes = np.unique(np.array(langs), return_inverse=True)
            totals = np.bincount(codes[part.text[0][part.counts[0]]], minlength=len(names))
            yield _batch(names.tolist(), 0, pa.array([""] * len(names)), totals)
            common = None
            for n in range(1, LONGEST + 1):
                a, b = part.start[n - 1], part.end[n - 1]
                k = np.arange(len(a)) if common is None else np.flatnonzero(_within(a, b, common))
                k = k[look(part.hash[n - 1][k])]
                common = a[k], b[k]  # what longer phrases may begin and end with
                k = k[part.counts[n - 1][k]]
                _, first, times = np.unique(part.hash[n - 1][k], return_index=True, return_counts=True)
                k = k[first]
                for at in range(0, len(k), 1 << 16):
                    some = k[at : at + (1 << 16)]
                    own = names[codes[part.text[n - 1][some]]].tolist()
                    yield _batch(own, n, _phrases(part, n, some), times[at : at + (1 << 16)])

    rows = texts.mapInArrow(count, "lang string, n_words int, phrase string, f long")
    sums = rows.groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f"))
    return written(sums.where((F.col("f") >= least) | (F.col("n_words") == 0)), "phrase-counts")


def _batch(langs: list[str], n: int, phrases_: pa.Array, times: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(langs, pa.string()), pa.array(np.full(len(langs), n, np.int32)), phrases_, pa.array(times.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "n_words", "phrase", "f"])


def _phrases(part: Slice, n: int, k: np.ndarray) -> pa.Array:
    """The phrases k of n words, a space between words."""
    a, b = part.start[n - 1][k], part.end[n - 1][k]
    ends = np.zeros(len(k) + 1, np.int32)
    np.cumsum(b - a, out=ends[1:])
    data = part.data[np.arange(ends[-1]) + np.repeat(a - ends[:-1], b - a)]
    out = pa.StringArray.from_buffers(len(k), pa.py_buffer(ends), pa.py_buffer(data))
    wide = np.flatnonzero(~part.plain[n - 1][k])
    if len(wide):
        texts = out.to_pylist()
        for i in wide.tolist():
            texts[i] = " ".join(filter(None, texts[i].split(" ")))
        out = pa.array(texts, pa.string())
    return out


def _within(a: np.ndarray, b: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether each phrase begins where a common one does and ends where another one does."""
    starts, ends = common
    out = np.zeros(len(a), bool)
    if len(starts):
        at = np.searchsorted(starts, a)
        out = (at < len(starts)) & (starts[np.minimum(at, len(starts) - 1)] == a)
        at = np.searchsorted(ends, b)
        out &= (at < len(ends)) & (ends[np.minimum(at, len(ends) - 1)] == b)
    return out


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, n_words, a, l, r, score of each phrase of two words or more; the lowest-scoring cut counts, the first of equal ones."""
    cut = "explode(transform(sequence(1, n_words - 1), k -> struct(k, substring_index(phrase, ' ', k) as left, substring_index(phrase, ' ', k - n_words) as right))) as cut"
    cuts = counts.where("n_words > 1").selectExpr("lang", "phrase", "n_words", "f as a", cut).select("lang", "phrase", "n_words", "a", "cut.*")
    shorter = counts.where(F.col("n_words").between(1, LONGEST - 1)).select("lang", "phrase", "f")
    # The words of a pair that occurs ten times do so too, so pairs have no more occurrences than the words here: 2 * HEAVY rows at most are often.
    total = counts.where("n_words = 1").agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    often = F.col("f") * HEAVY >= F.lit(total)
    for side, count in (("left", "l"), ("right", "r")):
        most = F.broadcast(shorter.where(often).select("lang", F.col("phrase").alias(side), F.col("f").alias("most")))
        rest = shorter.where(~often).select("lang", F.col("phrase").alias("key"), F.col("f").alias("some"))
        # What is found already goes on under a key of its own: no phrase holds a tab.
        key = F.when(F.col("most").isNull(), F.col(side)).otherwise(F.concat(F.lit("\t"), "phrase"))
        cuts = cuts.join(most, ["lang", side], "left").withColumn("key", key).join(rest, ["lang", "key"], "left")
        cuts = cuts.withColumn(count, F.coalesce("most", "some")).drop("most", "some", "key")
    d = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    cuts = cuts.withColumn("up", d("a", 15) * d("a", 15) * F.lit(1000000).cast("decimal(7,0)")).withColumn("down", d("l", 18) * d("r", 18))
    least = F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r"))
    return cuts.groupBy("lang", "phrase", "n_words", "a").agg(least.alias("cut")).select("lang", "phrase", "n_words", "a", "cut.l", "cut.r", "cut.score")


def subsumed(candidates: DataFrame) -> DataFrame:
    """lang, phrase, longer: of each part of a longer candidate, the highest count of a candidate around it."""
    word = F.split("phrase", " ", -1)
    inner = [(n, k, m) for m in range(3, LONGEST + 1) for n in range(2, m) for k in range(1, m - n + 2)]
    parts_ = F.array(*(F.when(F.col("n_words") == m, F.array_join(F.slice(word, k, n), " ")) for n, k, m in inner))
    rows = candidates.where("n_words > 2").select("lang", "a", F.explode(parts_).alias("phrase")).where("phrase is not null")
    return rows.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def first_of_each(rows: DataFrame, top: int = TOP) -> DataFrame:
    """rows with rank: the first of each language by score, count and phrase; salted groups first, so no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for salts in SALTS:
        salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
        rows = rows.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
        rows = rows.drop("salt") if salts == 1 else rows.drop("salt", "rank")
    return rows


def phrases(documents: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of 2 to 3 words."""
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counts = survivors(texts, width_of(total * LONGEST // 6), least)  # words have some six bytes with what is between them
    candidates = written(scored(counts), "phrase-scores")
    kept = candidates.join(subsumed(candidates), ["lang", "phrase"], "left").where("longer is null or 100 * longer < 50 * a")
    n = counts.where("n_words = 0").select("lang", F.col("f").alias("n"))
    best = first_of_each(kept, top).join(n, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
