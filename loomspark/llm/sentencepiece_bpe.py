"""Exact encoding and decoding with merge-type SentencePiece models, by backtracking instead of a queue of merges.

A sequence of tokens is the encoding of its string exactly if re-merging the characters of each two neighbours gives those
two again: no merge of the whole string can then be the first one over a boundary. So at each place the longest token that
an Aho-Corasick automaton matches is tried first, and taken if re-merging it with the token before keeps both; otherwise a
shorter one is tried, and where none fits the place is marked in a bitfield and the token before is taken back. The tokens
up to a place are the encoding of what stands before it, whatever was tried on the way, so a marked place has failed for good.

Works for models that change nothing in a text but space to U+2581, with one put in front, and whose pieces hold U+2581 at
their beginning only; others raise. Texts are cut before spaces and between letters and what no piece has beside letters; each distinct word is encoded once, in memory of
bounded size. A longer text goes through in slices of SLICE characters, so what a task holds besides the text itself does
not grow with it; a single unbroken word takes about 200 bytes a character. One pass without a shuffle; a lost task is rerun.

Defined results: a null text is empty, and an empty text has no ids; characters that are no piece become their bytes, or
the unknown id in a model without bytes; names of control pieces inside a text are ordinary characters; repeated rows are
encoded one by one; other columns are kept, those of the results' names are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from ._runtime import pieces, ship

SPACE = "▁"
#: Bytes of words, ids and texts that a worker remembers, about; beyond it, it starts over. ENTRY is what an entry takes beside its characters.
MEMORY, ENTRY = 288 << 20, 400
#: Characters of a text, and places of a word, that are worked on at once.
SLICE, WINDOW = 1 << 20, 1 << 14
#: Bytes of text that are encoded at once; a longer text makes a piece of its own.
PIECE = 1 << 20
NEVER = float("-inf")


class Model:
    """What a model file holds, in plain tables that any worker can use without the file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        if library.normalize("  ﬁ\t x ") != f"{SPACE * 3}ﬁ\t{SPACE}x{SPACE}":
            raise ValueError("the model changes more of a text than its spaces")
        n = library.get_piece_size()
        self.path, self.pieces = path, [library.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(n) if library.is_byte(i)}
        self.silent = {i for i in range(n) if library.is_control(i)}
        self.unknown = library.unk_id()
        self.texts = [p.replace(SPACE, " ") for p in self.pieces]
        self.texts[self.unknown] = " ⁇ "
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.special = {*self.byte_of, *self.silent}
        if any(library.is_unused(i) for i in range(n)):
            raise ValueError("the model has unused pieces")
        plain = [i for i in range(n) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece has a space inside")
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: library.get_score(i) for i in plain}
        #: Pairs of characters that stand side by side in a piece: between others nothing is ever merged.
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.usable = [p for p in self.ids if self.merged(p) == [p]]

    def pattern(self) -> str:
        """Words: runs of letters or of other characters, with the spaces before them. Letters are those that stand beside nothing else in any piece."""
        letters = {c for p in self.ids for c in p if c.isalpha()}
        while mixed := {c for pair in self.inner for c, d in (pair, pair[::-1]) if c in letters and d not in letters and d != SPACE}:
            letters -= mixed
        some = re.escape("".join(sorted(letters)))
        return f"{SPACE}*[{some}]+|{SPACE}*[^{SPACE}{some}]+|{SPACE}+" if some else f"{SPACE}*[^{SPACE}]+|{SPACE}+"

    def merged(self, text: str) -> list[str]:
        """The definition: the pair whose piece scores highest is merged, the leftmost of equals, until no pair makes a piece."""
        symbols, score = list(text), self.score.get
        due = [score(a + b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while due and (best := max(due)) > NEVER:
            k = due.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del due[k]
            if k:
                due[k - 1] = score(symbols[k - 1] + symbols[k], NEVER)
            if k < len(due):
                due[k] = score(symbols[k] + symbols[k + 1], NEVER)
        return symbols

    def decoded(self, ids: list[int], first: bool = True) -> str:
        """The text of any ids, as the library decodes them: bytes that are no UTF-8 become U+FFFD each; first: a space at the start goes."""
        if not first and self.special.isdisjoint(ids):
            return "".join(map(self.texts.__getitem__, ids))
        out, run = [], bytearray()
        byte_of = self.byte_of
        for i in ids:
            if i in self.silent:
                continue
            if i in byte_of:
                run.append(byte_of[i])
                first = False
                continue
            out.append(_text(run))
            run.clear()
            text = self.texts[i]
            out.append(text[1:] if first and i != self.unknown and text.startswith(" ") else text)
            first = False
        out.append(_text(run))
        return "".join(out)


def _text(run: bytes | bytearray) -> str:
    """UTF-8 with one U+FFFD for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(run[at : at + n]).decode())
            except UnicodeDecodeError:
                continue
            at += n
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


class Encoder:
    """Encodes texts; ids and decoded text of each distinct word, and which neighbours are compatible, are kept."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.split = model, re.compile(model.pattern()).findall
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece in model.usable:
            self.automaton.add_word(piece, len(piece))
        self.longest = max(map(len, model.usable), default=1)
        #: Of each token the size of the longest one that is a shorter beginning of it; without an entry, a character.
        known = set(model.usable)
        self.shorter = {p: next((k for k in range(len(p) - 1, 1, -1) if p[:k] in known), 1) for p in model.usable}
        self.names = list(map(str, range(len(model.pieces))))
        if model.usable:
            self.automaton.make_automaton()
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, tuple[int, str, str]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.used = 0

    def compatible(self, x: str, y: str) -> bool:
        """Whether the boundary between two tokens stays open when their characters are merged again."""
        if x[-1] + y[0] not in self.model.inner:
            return True
        found = self.pairs.get((x, y))
        if found is None:
            found = self.pairs[x, y] = self.model.merged(x + y) == [x, y]
            self.used += ENTRY // 2
        return found

    def _longest(self, word: str, a: int, b: int) -> list[int]:
        """For each place from a to b the size of the longest token that starts there; a character is a token even where it is no piece."""
        sizes = [1] * (b - a)
        if self.model.usable:
            for last, n in self.automaton.iter(word, a, min(len(word), b + self.longest - 1)):
                at = last + 1 - n  # matches come in the order of their ends, so longer ones of a place come later
                if at < b:
                    sizes[at - a] = n
        return sizes

    def _matches(self, word: str) -> Callable[[int], int]:
        """The size of the longest token by place, made for WINDOW places at once; a few windows are kept."""
        if len(word) <= WINDOW:
            return self._longest(word, 0, len(word)).__getitem__
        windows: dict[int, list[int]] = {}

        def longest(at: int) -> int:
            k = at // WINDOW
            if k not in windows:
                if len(windows) > 2:
                    windows.pop(min(windows) if k > min(windows) else max(windows))
                windows[k] = self._longest(word, k * WINDOW, min(len(word), (k + 1) * WINDOW))
            return windows[k][at - k * WINDOW]

        return longest

    def tokens(self, word: str) -> list[str]:
        """The encoding of a word by backtracking."""
        n = len(word)
        if n == 1:
            return [word]
        longest, shorter, compatible = self._matches(word), self.shorter.get, self.compatible
        failed, any_failed = bytearray(n // 8 + 1), False
        out: list[str] = []
        at, size, before = 0, longest(0), ""
        while True:
            while size:
                end = at + size
                token = word[at:end]
                if not (any_failed and failed[end >> 3] & (1 << (end & 7))) and (not before or compatible(before, token)):
                    break
                size = shorter(token, 1) if size > 1 else 0
            if size:
                out.append(token)
                if end == n:
                    return out
                before, at = token, end
                size = longest(at)
            else:
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                token = out.pop()
                at -= len(token)
                before = out[-1] if out else ""
                size = shorter(token, 1) if len(token) > 1 else 0

    def ids(self, word: str) -> list[int]:
        model, tokens = self.model, self.tokens(word)
        try:
            return [model.ids[t] for t in tokens]
        except KeyError:  # a character that is no piece
            pass
        ids: list[int] = []
        for token in tokens:
            i = model.ids.get(token)
            if i is not None:
                ids.append(i)
            elif model.bytes:
                ids += [model.bytes[b] for b in token.encode()]
            elif not ids or ids[-1] != model.unknown:
                ids.append(model.unknown)
        return ids

    def _entry(self, word: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and their decoded text."""
        ids = self.ids(word)
        entry = len(ids), ",".join(map(self.names.__getitem__, ids)), self.model.decoded(ids, first=False)
        self.used += ENTRY + 2 * len(word) + len(entry[1]) + len(entry[2])
        return entry

    def encode(self, text: str | None) -> Iterator[tuple[int, str, str]]:
        """Of each slice of a text the number of ids, the ids joined by commas, and what they decode to."""
        first = True
        for part in _slices(text or ""):
            if self.used > MEMORY:
                self._forget()
            words, known = self.split((SPACE if first else "") + part.replace(" ", SPACE)), self.words
            for word in set(words).difference(known):
                known[word] = self._entry(word)
            n, ids, texts = zip(*map(known.__getitem__, words), strict=True)
            decoded = "".join(texts)
            yield sum(n), ",".join(ids), decoded[1:] if first else decoded
            first = False


def _slices(text: str) -> Iterator[str]:
    """text in slices of about SLICE characters, each but the first one beginning with a space after another character."""
    at = 0
    while at < len(text):
        to = at + SLICE
        while 0 < to < len(text) and not (text[to] == " " and text[to - 1] not in (" ", SPACE)):
            to = text.find(" ", to + 1)
        to = len(text) if to < 0 else min(to, len(text))
        yield text[at:to]
        at = to


_ENCODERS: dict[str, Encoder] = {}


def _encoder(model: Model) -> Encoder:
    """One encoder for each worker process, which its tasks share."""
    if model.path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[model.path] = Encoder(model)
    return _ENCODERS[model.path]


def _run(documents: DataFrame, path: str, keep: list[str], schema: str, columns: Callable) -> DataFrame:
    """The columns to keep, and those of schema that columns(slices of each text) makes; nothing else leaves the worker."""
    spark = documents.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(Model(path))  # a vocabulary's tables: a few MB at any input size
    at = documents.schema.names.index("text")
    kept = [documents.schema.names.index(c) for c in keep]
    names = keep + [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=PIECE):
            encode = _encoder(model.value).encode
            more = columns(encode(t.as_py()) for t in piece.column(at))
            yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in kept), *more], names)

    types = StructType([*(documents.schema.fields[k] for k in kept), *_parse_datatype_string(schema).fields])
    return documents.mapInArrow(run, types)


def encode(documents: DataFrame, path: str) -> DataFrame:
    """documents with token_ids array<int> and decoded string; columns of these names are replaced."""

    def columns(texts) -> list[pa.Array]:
        ids, size, decoded = [], [0], []
        for slices in texts:
            parts = list(slices)
            ids += [np.fromstring(x, np.int32, sep=",") for n, x, _ in parts if n]
            size.append(size[-1] + sum(n for n, _, _ in parts))
            decoded.append("".join(x for _, _, x in parts))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return [pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(flat, pa.int32())), pa.array(decoded, pa.string())]

    own = documents.drop("token_ids", "decoded").withColumn("text", F.col("text").cast("string"))
    return _run(own, path, own.columns, "token_ids array<int>, decoded string", columns)


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids joined by commas) and decoded_sha256 of each row, of the same ids and texts as encode's."""

    def columns(texts) -> list[pa.Array]:
        rows = []
        for slices in texts:
            total, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
            for n, ids, decoded in slices:
                of_ids.update((("," if total else "") + ids).encode())
                of_text.update(decoded.encode())
                total += n
            rows.append((total, of_ids.hexdigest(), of_text.hexdigest()))
        n, ids, decoded = zip(*rows, strict=True)
        return [pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)]

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _run(own, path, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows with decoded string, the text of their token_ids (array<int>); null ids have no text, ids outside the vocabulary raise."""
    spark = rows.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(Model(path))
    own = rows.drop("decoded").withColumn("token_ids", F.col("token_ids").cast("array<int>"))
    at, names = own.columns.index("token_ids"), [*own.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else model.value.decoded(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return own.mapInArrow(run, StructType([*own.schema.fields, StructField("decoded", StringType())]))
