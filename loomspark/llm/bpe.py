"""BPE encoding by speculation: greedy longest match proposes a word's tokens, vectorised checks of all adjacent pairs
confirm them, and only words that fail a check are merged exactly, all of a batch side by side.

A sequence of tokens is the BPE encoding of its string if every token encodes to itself and no boundary between two
neighbours would have been merged over. Tokens that don't encode to themselves are left out of the match. A pair (x, y)
is checked by running time backwards: of x's right edge and y's left edge, the one that was merged last is split again,
and no pair of edges that stood side by side may have a merge that was due before the next split.

Works for vocabularies of byte-level symbols with a mark on a word's last symbol, whose pre-tokens hold no white space.
Texts are normalised and split as wholes, beyond Latin-1 by the piece between white space, and each distinct word is encoded
once, in memory of bounded size.
One pass without a shuffle; a lost task is rerun.

Defined results: a null text is empty (no ids, empty decoded text); added tokens inside a text become their ids, as in
the library; bytes without a symbol in the vocabulary are dropped, as in the library; repeated rows are encoded one by one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ._runtime import pieces, ship

#: Bytes of words, ids and tokens that a worker remembers, about; beyond half of it, it forgets what the other half had. ENTRY is what an entry takes beside its characters.
MEMORY, ENTRY = 128 << 20, 400
#: Bytes of text that are encoded at once; a longer text makes a piece of its own.
PIECE = 1 << 20
NEVER = np.int64(1 << 62)
#: Words of more symbols are merged by a heap; of the others, so many at once.
LONG, ROWS = 60, 1 << 12
#: White space for Python but not for the tokenizer's patterns.
ODD = re.compile(r"[\x1c-\x1f]")
SPACE = re.compile(r"[^\S\x1c-\x1f]+")


class Model:
    """Tables of a vocabulary file: 'born' is when a token's own last merge takes place (0: a single symbol)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, self.ids = path, model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        n = self.size = 1 + max([*self.ids.values(), *self.added.values()])
        self.text = [""] * n
        for token, i in (self.ids | self.added).items():
            self.text[i] = token
        self.merges: dict[tuple[int, int], int] = {}
        self.result: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[self.ids[a], self.ids[b]] = rank
            self.result.append(self.ids[a + b])
        keys = np.array([a * n + b for a, b in self.merges], np.int64)
        due = np.array(list(self.merges.values()), np.int64) + 1
        order = np.argsort(keys)
        self.keys, self.due = np.append(keys[order], NEVER), np.append(due[order], NEVER)
        self.made = np.array([*self.result, 0], np.int64)
        #: Ids of single symbols inside a word and at its end, by code point; -1 without one.
        last = max((ord(c) for t in self.ids if len(c := t.removesuffix(self.suffix)) == 1), default=0) + 2
        self.inner = np.array([self.ids.get(chr(c), -1) for c in range(last)], np.int64)
        self.final = np.array([self.ids.get(chr(c) + self.suffix, -1) for c in range(last)], np.int64)
        self.born, self.left, self.right = (np.zeros(n, np.int64) for _ in range(3))
        self.usable: dict[str, int] = {}
        for token, i in self.ids.items():
            if len(self.symbols(token.removesuffix(self.suffix) if self.suffix else token, self._closed(token))) == 1:
                self.usable[token] = i  # a single symbol
                continue
            found, last = self.merged(self.symbols(token.removesuffix(self.suffix) if self.suffix else token, self._closed(token)))
            if found == [i] and last:
                self.usable[token] = i
                self.left[i], self.right[i], self.born[i] = last
        #: The longest usable token by its first three symbols, the mark not counted.
        self.reach: dict[str, int] = {}
        for token in self.usable:
            n = len(token) - (len(self.suffix) if self._closed(token) else 0)
            self.reach[token[: min(3, n)]] = max(n, self.reach.get(token[: min(3, n)], 0))

    def _closed(self, token: str) -> bool:
        return bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix

    def symbols(self, word: str, closed: bool = True) -> list[int]:
        out = [self.ids.get(c) for c in word[:-1]]
        if word:
            out.append(self.ids.get(word[-1] + self.suffix if closed else word[-1]))
        return [x for x in out if x is not None]

    def merged(self, symbols: list[int]) -> tuple[list[int], tuple[int, int, int] | None]:
        """Exact: the least merge, leftmost first, until none is left; and the last merge made."""
        rank_of, last, none = self.merges.get, None, len(self.result)
        ranks = [rank_of(pair, none) for pair in zip(symbols, symbols[1:], strict=False)]
        while ranks and (rank := min(ranks)) < none:
            k = ranks.index(rank)
            last = (symbols[k], symbols[k + 1], rank + 1)
            symbols[k : k + 2] = [self.result[rank]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank_of((symbols[k - 1], symbols[k]), none)
            if k < len(ranks):
                ranks[k] = rank_of((symbols[k], symbols[k + 1]), none)
        return symbols, last

    def proposed(self, word: str) -> list[int] | None:
        """Greedy longest match; None where no usable token fits."""
        out, at, n = [], 0, len(word)
        usable, reach, closed = self.usable.get, self.reach.get, word + self.suffix
        while at < n:
            to = min(n, at + reach(word[at : at + 3], 2))
            while to > at:
                token = usable(word[at:to] if to < n else closed[at:])
                if token is not None:
                    break
                to -= 1
            else:
                return None
            out.append(token)
            at = to
        return out

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the boundary of each pair of tokens stays open."""
        good = np.ones(len(x), bool)
        live = np.arange(len(x))
        limit = np.full(len(x), NEVER)
        while len(live):
            key = x * self.size + y
            at = np.searchsorted(self.keys, key)
            closed = (self.keys[at] == key) & (self.due[at] < limit)
            good[live[closed]] = False
            go = ~closed & ((self.born[x] > 0) | (self.born[y] > 0))
            live, x, y = live[go], x[go], y[go]
            back = self.born[x] > self.born[y]  # of equal ones, the left one was merged first
            limit = np.where(back, self.born[x], self.born[y] + 1)
            x, y = np.where(back, self.right[x], x), np.where(back, y, self.left[y])
        return good

    def encode(self, words: list[str]) -> list[list[int]]:
        """The tokens of each word, given in byte-level symbols."""
        out = [self.proposed(w) for w in words]
        some = [i for i, x in enumerate(out) if x and len(x) > 1]
        flat = np.fromiter((t for i in some for t in out[i]), np.int64)
        size = np.fromiter((len(out[i]) for i in some), np.int64, len(some))
        owner = np.repeat(np.arange(len(some)), size)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        bad = inner[~self.compatible(flat[inner], flat[inner + 1])]
        for i in np.unique(owner[bad]).tolist():
            out[some[i]] = None
        rest = sorted((i for i, x in enumerate(out) if x is None), key=lambda i: len(words[i]))
        short = [i for i in rest if 1 < len(words[i]) <= LONG]
        for a in range(0, len(short), ROWS):
            some = short[a : a + ROWS]
            for i, x in zip(some, self._side_by_side([words[i] for i in some]), strict=True):
                out[i] = x
        return [self._exact(w) if x is None else x for w, x in zip(words, out, strict=True)]

    def _ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """When the pair of x and y is merged (from 1), or NEVER; -1 is no symbol."""
        key = np.where(y < 0, -1, x * self.size + y)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.due[at], NEVER)

    def _side_by_side(self, words: list[str]) -> list[list[int] | None]:
        """merged of the symbols of words of two or more, of about one length: each round makes one merge in every word. None where a symbol has no id."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        code = np.minimum(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), len(self.inner) - 1)
        row = np.repeat(np.arange(len(n)), n)
        symbols = np.full((len(n), n.max()), -1)
        symbols[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = self.inner[code]
        symbols[np.arange(len(n)), n - 1] = self.final[code[np.cumsum(n) - 1]]
        out: list[list[int] | None] = [None] * len(n)
        own = np.flatnonzero((symbols >= 0).sum(axis=1) == n)
        symbols, n = symbols[own], n[own]
        ranks = self._ranks(symbols[:, :-1], symbols[:, 1:])
        while len(own):
            k = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(own), np.int64)
            rank = ranks[np.arange(len(own)), k] if ranks.shape[1] else np.full(len(own), NEVER)
            done = rank == NEVER
            if done.any():
                for i, x, size in zip(own[done].tolist(), symbols[done].tolist(), n[done].tolist(), strict=True):
                    out[i] = x[:size]
                own, symbols, n, ranks, k, rank = (x[~done] for x in (own, symbols, n, ranks, k, rank))
                if not len(own):
                    break
            each, width = np.arange(len(own)), symbols.shape[1]
            symbols[each, k] = self.made[rank - 1]
            place = np.arange(width - 1)
            symbols = np.take_along_axis(symbols, place + (place > k[:, None]), axis=1)
            ranks = np.take_along_axis(ranks, place[:-1] + (place[:-1] >= k[:, None]), axis=1)
            n = n - 1
            left, right = k > 0, k < width - 2
            ranks[each[left], k[left] - 1] = self._ranks(symbols[each[left], k[left] - 1], symbols[each[left], k[left]])
            ranks[each[right], k[right]] = self._ranks(symbols[each[right], k[right]], symbols[each[right], k[right] + 1])
        return out

    def _exact(self, word: str) -> list[int]:
        """For long words, merges by a heap; the same result as merged."""
        symbols = self.symbols(word)
        if len(symbols) <= LONG:
            return self.merged(symbols)[0]
        from heapq import heapify, heappop, heappush

        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of = self.merges.get
        heap = [(m, k, a, b) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (m := rank_of((a, b))) is not None]
        heapify(heap)
        while heap:
            rank, k, a, b = heappop(heap)
            other = after[k]
            if symbols[k] != a or other >= n or symbols[other] != b:
                continue
            symbols[k], symbols[other] = self.result[rank], -1
            after[k] = after[other]
            if after[k] < n:
                before[after[k]] = k
                if (m := rank_of((symbols[k], symbols[after[k]]))) is not None:
                    heappush(heap, (m, k, symbols[k], symbols[after[k]]))
            if (p := before[k]) >= 0 and (m := rank_of((symbols[p], symbols[k]))) is not None:
                heappush(heap, (m, p, symbols[p], symbols[k]))
        return [x for x in symbols if x >= 0]


def _byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Encodes whole texts; ids and tokens of each distinct word are kept."""

    #: The pre-tokens of the vocabulary, and the same for Latin-1, which the standard library finds faster.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    LETTER, NUMBER, BLANK = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
    LATIN = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{BLANK}{LETTER}{NUMBER}]+"

    def __init__(self, model: Model):
        import regex
        from tokenizers import Tokenizer

        self.model, self.find, self.latin = model, regex.compile(self.PATTERN).findall, re.compile(self.LATIN).findall
        self.normal = Tokenizer.from_file(model.path).normalizer.normalize_str
        self.table = str.maketrans({chr(b): s for b, s in _byte_symbols().items()})
        self.number = list(map(str, range(model.size)))
        self.split = re.compile("(" + "|".join(map(re.escape, model.added)) + ")").split if model.added else None
        self.mark = min(model.added, key=len)[:2] if model.added else None
        self.before: tuple[dict[str, str], dict[str, str]] = {}, {}
        self._start()

    def _start(self) -> None:
        """Ids and tokens of words, each joined by spaces; words without ids; normal forms of pieces beyond Latin-1; about how many bytes that is."""
        self.ids: dict[str, str] = {}
        self.tokens: dict[str, str] = {}
        self.void: set[str] = set()
        self.normals: dict[str, str] = {}
        self.bytes = 0

    def _cut(self, text: str) -> list[str]:
        """Words of a text without added tokens. In Latin-1 the normal form is the lower case."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pieces = list(filter(None, SPACE.split(text))) if ODD.search(text) else text.split()
                for piece in set(pieces).difference(self.normals):
                    self.normals[piece] = self.normal(piece)
                    self.bytes += ENTRY // 2 + 2 * len(piece)
                return self.find(" ".join(map(self.normals.__getitem__, pieces)))
        return self.latin(text.lower())

    def _words(self, text: str) -> list[str]:
        """Words of a text; added tokens with a line feed before, which no word has."""
        if self.mark is None or self.mark not in text:
            return self._cut(text)
        return [w for part in self.split(text) for w in (["\n" + part] if part in self.model.added else self._cut(part))]

    def _learn(self, new: set[str]) -> None:
        """Enter words, from what was known before or anew."""
        ids, tokens = self.before
        old = [w for w in new if w in ids]
        words = list(new.difference(old))
        added = [w for w in words if w[0] == "\n"]
        if added:
            words = [w for w in words if w[0] != "\n"]
        own = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.table) for w in words]
        number, token = self.number.__getitem__, self.model.text.__getitem__
        found = [*self.model.encode(own), *([self.model.added[w[1:]]] for w in added)]
        every = words + added + old
        all_ids = [" ".join(map(number, x)) for x in found] + list(map(ids.__getitem__, old))
        all_tokens = [" ".join(map(token, x)) for x in found] + list(map(tokens.__getitem__, old))
        self.ids.update(zip(every, all_ids, strict=True))
        self.tokens.update(zip(every, all_tokens, strict=True))
        if "" in all_ids:
            self.void.update(w for w, x in zip(every, all_ids, strict=True) if not x)
        self.bytes += len(every) * ENTRY + sum(sum(map(len, x)) for x in (every, all_ids, all_tokens))

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Of each text the number of ids, the ids and their tokens, both joined by spaces."""
        if self.bytes > MEMORY // 2:  # words that come again are taken over
            self.before = self.ids, self.tokens
            self._start()
        split = [self._words(t) if t else [] for t in texts]
        if new := set().union(*split).difference(self.ids):
            self._learn(new)
        for words in split:
            if self.void and not self.void.isdisjoint(words):
                words = [w for w in words if w not in self.void]
            ids = " ".join(map(self.ids.__getitem__, words))
            yield ids.count(" ") + 1 if words else 0, ids, " ".join(map(self.tokens.__getitem__, words))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(model: Model) -> Encoder:
    """One encoder for each worker process, which its tasks share."""
    if model.path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[model.path] = Encoder(model)
    return _ENCODERS[model.path]


def _run(documents: DataFrame, path: str, keep: list[str], schema: str, columns: Callable) -> DataFrame:
    """The columns to keep, and those of schema that columns(encoded texts) makes; nothing else leaves the worker."""
    spark = documents.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(Model(path))  # a vocabulary's tables: a few MB at any input size
    at = documents.schema.names.index("text")
    kept = [documents.schema.names.index(c) for c in keep]
    names = keep + [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=PIECE):
            more = columns(_encoder(model.value).encode(piece.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in kept), *more], names)

    types = StructType([*(documents.schema.fields[k] for k in kept), *_parse_datatype_string(schema).fields])
    return documents.mapInArrow(run, types)


def _sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def _lists(n: list[int], ids: list[str]) -> pa.Array:
    """Ids as lists of 32-bit numbers, without a Python number for each."""
    flat = np.fromstring(" ".join(filter(None, ids)), np.int32, sep=" ") if any(n) else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(flat, pa.int32()))


def _own(documents: DataFrame) -> DataFrame:
    return documents.drop("token_ids", "decoded", "n_tokens", "decoded_sha256").withColumn("text", F.col("text").cast("string"))


def encode(documents: DataFrame, path: str) -> DataFrame:
    """documents with token_ids array<int> and decoded string; columns of these names are replaced (so are n_tokens and decoded_sha256)."""

    def columns(texts):
        n, ids, decoded = map(list, zip(*texts, strict=True))
        return [_lists(n, ids), pa.array(decoded, pa.string())]

    own = _own(documents)
    return _run(own, path, own.columns, "token_ids array<int>, decoded string", columns)


def token_rows(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and decoded_sha256 of each row: texts stay where they were read."""

    def columns(texts):
        n, ids, decoded = map(list, zip(*((n, ids, _sha(decoded)) for n, ids, decoded in texts), strict=True))
        return [pa.array(n, pa.int64()), _lists(n, ids), pa.array(decoded)]

    return _run(_own(documents).select("doc_id", "text"), path, ["doc_id"], "n_tokens long, token_ids array<int>, decoded_sha256 string", columns)


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, of the same ids and texts as encode's."""

    def columns(texts):
        n, ids, decoded = zip(*((n, _sha(ids), _sha(decoded)) for n, ids, decoded in texts), strict=True)
        return [pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)]

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _run(own, path, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)
