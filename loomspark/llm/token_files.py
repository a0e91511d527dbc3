"""Token-ID files in patched frame-of-reference blocks.

A file holds the ids of a run of documents, in blocks of 512. A block subtracts its minimum and packs the rest at the
width of the value at PERCENTILE of its 512; what doesn't fit keeps its low bits in place and is patched from an
exception list. Layout, little-endian:

    b"LPFOR1\\0\\0"
    blocks:  u32 minimum, u8 width, u8 0, u16 n exceptions, 8 * width words u64 packed, u16 positions[n], u32 values[n]
    footer:  u64 block starts[n_blocks], i64 doc ids[n_docs] (the least i64: null), u64 token counts[n_docs]
    tail:    u64 n_ids, u64 n_blocks, u64 n_docs

The last block is padded with its own last value. Block starts let a reader decode any document alone.

Documents are range-partitioned by (doc_id, hash of the text), so that each task encodes and writes one run, streaming,
and the runs in order are the corpus in ascending doc_id (null first; repeated ids by the hash). A task's file has a
name of its own and counts only once the manifest, which Spark commits, names it: a lost or repeated task leaves at
most an unread file. Global starts need one number a file at the driver. Null texts are empty: just the end id.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import parts, pieces, shared_dir, ship, written

MAGIC, BLOCK, LANES, PERCENTILE, END_ID = b"LPFOR1\0\0", 512, 64, 95, 2
NULL_ID = -(1 << 63)
#: Distinct pieces and pre-tokens whose ids a worker remembers; beyond it, it starts over.
CHUNKS, WORDS = 600_000, 900_000


class Ragged:
    """Rows of ids of any length, one after the other."""

    def __init__(self):
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def append(self, flat: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.start = np.concatenate([self.start, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.used += len(flat)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows, one after the other, and how many come before each row, with the total."""
        before = np.zeros(len(rows) + 1, np.int64)
        size = self.size[rows]
        np.cumsum(size, out=before[1:])
        return self.flat[np.repeat(self.start[rows] - before[:-1], size) + np.arange(before[-1])], before


class Numbered(dict):
    """Numbers keys in the order in which they are first asked for; new holds those not taken yet."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = at = len(self)
        self.new.append(key)
        return at

    def taken(self) -> list:
        new, self.new = self.new, []
        return new


class ChunkEncoder:
    """Ids of texts by a byte-level tokenizer of the library, whose pre-tokens never run over the start of a single space.

    A text is cut before each space that follows a non-space, an unknown piece into its pre-tokens; the library encodes
    each distinct pre-token once. Pieces that may hold an added token go to the library whole.
    A piece's key is without its space; the piece that starts a text is a 1-tuple.
    """

    _run = re.compile(r"\s ")
    _rare = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
    _cut = re.compile(r"(?<=\S) ")
    #: The pre-tokens of the byte-level vocabulary.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library, self.find = Tokenizer.from_file(path), regex.compile(self.PATTERN).findall
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(1 + max(vocabulary.values()), bool)
        self.spaced[[i for token, i in vocabulary.items() if token[0] == "\u0120"]] = True  # the space's stand-in
        self.added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        #: What every added token holds; without added tokens, no text does.
        self.mark = os.path.commonprefix(self.added) if self.added else "\0none\0"
        self._reset()

    def _reset(self) -> None:
        self.chunks, self.words, self.chunk_ids, self.word_ids = Numbered(), Numbered(), Ragged(), Ragged()

    def _learn(self) -> None:
        keys = self.chunks.taken()
        if not keys:
            return
        found: list[str] = []
        size = np.zeros(len(keys), np.int64)
        for i, key in enumerate(keys):
            text = key[0] if isinstance(key, tuple) else " " + key
            if self.mark in text:
                found.append(text)
            else:
                found += self.find(text)
            size[i] = len(found)
        rows = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))
        new = self.words.taken()
        self._encode_words(new)
        flat, before = self.word_ids.take(rows)
        self.chunk_ids.append(flat, np.diff(before[size], prepend=0))

    def _runs(self, text: str) -> bool:
        """Whether a space follows white space."""
        if text.isascii():
            return "  " in text or "\n " in text or any(c in text for c in self._rare) and bool(self._run.search(text))
        return bool(self._run.search(text))

    def _encode_words(self, new: list[str]) -> None:
        """Words of a space and non-spaces go to the library by the thousand: a token that begins with the space begins a word."""
        plain = np.fromiter((w[0] == " " and len(w) > 1 and not w[1].isspace() for w in new), bool, len(new))
        order = np.argsort(~plain, kind="stable")
        n = int(plain.sum())
        words = list(map(new.__getitem__, order.tolist()))
        joined = ["".join(words[i : min(n, i + 1000)]) for i in range(0, n, 1000)]
        if any(x in text for x in self.added for text in joined):  # one stands in a word
            joined, n = [], 0
        got = [x.ids for x in self.library.encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.fromiter((y for x in got for y in x), np.uint32, sum(map(len, got)))
        first = np.flatnonzero(self.spaced[flat])
        rest = [x.ids for x in self.library.encode_batch_fast(words[n:], add_special_tokens=False)]
        size = np.concatenate([np.diff(first, append=len(flat)), np.fromiter(map(len, rest), np.int64, len(rest))])
        assert len(size) == len(new)
        own = Ragged()
        own.append(np.concatenate([flat, np.fromiter((y for x in rest for y in x), np.uint32, sum(map(len, rest)))]), size)
        place = np.zeros(len(new), np.int64)
        place[order] = np.arange(len(new))
        ids, before = own.take(place)
        self.word_ids.append(ids, np.diff(before))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the count of each text."""
        if len(self.words) > WORDS:
            self._reset()
        if len(self.chunks) > CHUNKS:
            self.chunks, self.chunk_ids = Numbered(), Ragged()
        plain = ["" if not t or self._runs(t) else t for t in texts]
        odd = [i for i, (t, p) in enumerate(zip(texts, plain, strict=True)) if t and not p]
        split = pc.split_pattern(pa.array(plain, pa.string()), " ")  # an empty text is one empty piece
        counts = np.diff(split.offsets.to_numpy())
        coded = split.flatten().dictionary_encode()
        rows = np.fromiter(map(self.chunks.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))[coded.indices.to_numpy()]
        first = np.cumsum(counts) - counts
        rows[first] = [self.chunks[(t.partition(" ")[0],)] for t in plain]
        runs, at = [], 0
        for i in odd:  # texts with runs of white space take the place of their empty piece
            own = self._cut.split(texts[i])
            runs += [rows[at : first[i]], np.array([self.chunks[(own[0],)], *map(self.chunks.__getitem__, own[1:])], np.int64)]
            at, counts[i] = first[i] + 1, len(own)
        rows = np.concatenate([*runs, rows[at:]]) if odd else rows
        self._learn()
        ids, before = self.chunk_ids.take(rows)
        return ids, np.diff(before[np.cumsum(counts)], prepend=0)


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder_of(path: str) -> ChunkEncoder:
    """One encoder for each worker process, which its tasks share."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """(n, 512) values below 2**width as (n, 8 * width) words."""
    if not width:
        return np.zeros((len(rows), 0), np.uint64)
    lanes = np.ascontiguousarray(rows.reshape(-1, LANES).T).astype(np.uint64)
    out = np.zeros((width, lanes.shape[1]), np.uint64)
    for i in range(LANES):
        word, shift = divmod(i * width, 64)
        out[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(len(rows), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros((len(words), BLOCK), np.uint32)
    lanes = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.zeros((LANES, lanes.shape[1]), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(LANES):
        word, shift = divmod(i * width, 64)
        x = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            x |= lanes[word + 1] << np.uint64(64 - shift)
        out[i] = x & mask
    return np.ascontiguousarray(out.T).reshape(len(words), BLOCK)


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of ids, whose number is a multiple of 512."""
    rows = ids.reshape(-1, BLOCK).astype(np.uint32)
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    at = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    high = np.partition(rest, at, axis=1)[:, at]
    widths = np.zeros(len(rows), np.int64)
    for w in range(32):
        widths += high >= (1 << w)
    out: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        packed = _pack(rest[own] & np.uint32((1 << width) - 1), width)
        over = rest[own] >> np.uint32(width) != 0 if width < 32 else np.zeros((len(own), BLOCK), bool)
        for k, row in enumerate(own.tolist()):
            where = np.flatnonzero(over[k]).astype("<u2")
            head = np.uint32(least[row]).tobytes() + bytes([width, 0]) + np.uint16(len(where)).tobytes()
            out[row] = b"".join([head, packed[k].astype("<u8").tobytes(), where.tobytes(), rest[row][where].astype("<u4").tobytes()])
    return out


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at starts in data."""
    raw = np.frombuffer(data, np.uint8)
    starts = starts.astype(np.int64)
    least = raw[starts[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    widths = raw[starts + 4].astype(np.int64)
    exceptions = raw[starts[:, None] + np.arange(6, 8)].copy().view("<u2")[:, 0].astype(np.int64)
    out = np.zeros((len(starts), BLOCK), np.uint32)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        words = raw[(starts[own] + 8)[:, None] + np.arange(64 * width)].copy().view("<u8") if width else np.zeros((len(own), 0), np.uint64)
        out[own] = _unpack(words, width)
    for row in np.flatnonzero(exceptions).tolist():
        n, at = int(exceptions[row]), int(starts[row] + 8 + 64 * widths[row])
        where = np.frombuffer(data, "<u2", n, at)
        out[row, where] = np.frombuffer(data, "<u4", n, at + 2 * n)
    return (out + least[:, None]).ravel()


class Writer:
    """Writes one file, streaming; needs the doc table and the block starts in memory, 24 bytes a document and a block or so."""

    def __init__(self, uri: str):
        system, path = pafs.FileSystem.from_uri(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(path)
        self.out.write(MAGIC)
        self.at, self.starts, self.rest, self.n_ids = len(MAGIC), [], np.zeros(0, np.uint32), 0
        self.docs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def _blocks(self, ids: np.ndarray) -> None:
        for block in pack_blocks(ids):
            self.starts.append(self.at)
            self.out.write(block)
            self.at += len(block)

    def add(self, docs: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs.append(docs)
        self.counts.append(counts)
        self.n_ids += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        if whole:
            self._blocks(ids[:whole])
        self.rest = ids[whole:]

    def close(self) -> None:
        if len(self.rest):
            self._blocks(np.pad(self.rest, (0, BLOCK - len(self.rest)), mode="edge"))
        docs, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.docs, self.counts))
        self.out.write(np.array(self.starts, "<u8").tobytes() + docs.astype("<i8").tobytes() + counts.astype("<u8").tobytes())
        self.out.write(np.array([self.n_ids, len(self.starts), len(docs)], "<u8").tobytes())
        self.out.close()


def read_documents(uri: str, blocks_at_once: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, ids one after the other, counts) of runs of whole documents, in the file's order."""
    system, path = pafs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        n_ids, n_blocks, n_docs = np.frombuffer(f.read_at(24, size - 24), "<u8").astype(np.int64).tolist()
        foot = size - 24 - 8 * n_blocks - 16 * n_docs
        table = f.read_at(size - 24 - foot, foot)
        starts = np.append(np.frombuffer(table, "<u8", n_blocks).astype(np.int64), foot)
        docs = np.frombuffer(table, "<i8", n_docs, 8 * n_blocks)
        counts = np.frombuffer(table, "<u8", n_docs, 8 * n_blocks + 8 * n_docs).astype(np.int64)
        ends = np.cumsum(counts)
        done, held, block = 0, np.zeros(0, np.uint32), 0
        while done < n_docs:
            to = min(n_blocks, block + blocks_at_once)
            if to > block:
                data = f.read_at(int(starts[to] - starts[block]), int(starts[block]))
                held = np.concatenate([held, unpack_blocks(data, starts[block:to] - starts[block])])
                block = to
            first = ends[done] - counts[done]
            whole = int(np.searchsorted(ends, first + len(held) if block < n_blocks else n_ids, side="right"))
            if whole > done:
                n = int(ends[whole - 1] - first)
                yield docs[done:whole], held[:n], counts[done:whole]
                done, held = whole, held[n:]


def write_files(documents: DataFrame, tokenizer: str, end_id: int | None = END_ID) -> DataFrame:
    """Encode documents(doc_id, text) into files in a new shared folder; the manifest (part, path, n_docs, n_ids), written too."""
    spark = documents.sparkSession
    ship(spark)
    folder = shared_dir(spark, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, path, n_docs = TaskContext.get().partitionId(), None, "", 0
        encoder = None
        for piece in pieces(batches, limit=4 << 20):
            if writer is None:
                path = f"{folder}/{part:06d}-{uuid.uuid4().hex}.pfor"
                encoder, writer = encoder_of(tokenizer), Writer(path)
            ids, counts = encoder.encode(piece.column(1).to_pylist())
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
            docs = piece.column(0).fill_null(NULL_ID).to_numpy()
            writer.add(docs, ids, counts)
            n_docs += len(docs)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, path, n_docs, writer.n_ids)], ["part", "path", "n_docs", "n_ids"])

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = own.repartitionByRange(*key).sortWithinPartitions(*key, F.col("text"))
    return written(rows.mapInArrow(run, "part long, path string, n_docs long, n_ids long"), "token-manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files that manifest names."""
    spark = manifest.sparkSession
    ship(spark)
    files = sorted(manifest.collect())  # a row for each file
    base = np.cumsum([0, *(x.n_ids for x in files)]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for docs, ids, counts in read_documents(path):
                    ends = np.cumsum(counts)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                    columns = [pa.array(docs, mask=docs == NULL_ID), pa.array(start + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(ends[-1])

    rows = spark.createDataFrame([(f.path, b) for f, b in zip(files, base, strict=False)], "path string, base long")
    return rows.repartition(max(parts(spark), len(files)), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
