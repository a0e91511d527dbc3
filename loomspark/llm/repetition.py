"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, all in numpy over the bytes of a batch of texts, measure how many
characters of a text lie inside word n-grams that it holds twice or more, and inside lines that it repeats.
One pass without a shuffle: a text is judged alone, so any partitioning works and a lost task is simply rerun.

Defined results: a null text counts as empty (no words, base_failed, not kept); repeated rows are judged one by
one; extra columns of the input are ignored by ``coverage`` and kept by ``kept_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _hashing as H
from ._runtime import pieces, ship, utf8

#: n-gram lengths and the largest share of a text's word characters inside repeated ones, and the same for lines.
MAX_DUP_CHARS = {5: 0.15, 7: 0.13, 10: 0.10}
MAX_DUP_LINE_CHARS = 0.20
#: The base rules: fewest words; largest percentage of words inside repeated windows of three.
MIN_WORDS, BASE_N, MAX_REPEAT_PERCENT = 50, 3, 50
SYMBOLS = H.separators(b"#*$%&|<>")

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, "
    + ", ".join(f"dup{n}_chars long" for n in MAX_DUP_CHARS)
    + ", base_failed boolean, kept boolean"
)


def measure(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text data[at[i]:at[i + 1]]."""
    n_texts = len(at) - 1
    prefix = H.Prefix(data)
    a, b, text = H.words(data, at)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    chars = lead[b] - lead[a]
    salt = H.mix(np.arange(1, n_texts + 1, dtype=np.uint64))
    out = {
        "n_words": np.bincount(text, minlength=n_texts),
        "word_chars": np.bincount(text, chars, n_texts).astype(np.int64),
        "n_symbols": H.per_text(SYMBOLS[data], at),
    }

    breaks = np.flatnonzero(data == 10)
    filled = at[:-1][np.diff(at) > 0]
    start = np.union1d(filled, breaks + 1)
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))
    end = np.where((end > start) & (data[end - 1] == 10), end - 1, end) if len(start) else end[:0]
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~H.BLANK[data], out=solid[1:])
    worded = solid[end] > solid[start]
    start, end = start[worded], end[worded]
    line_text = np.searchsorted(at, start, side="right") - 1
    again = H.later(prefix.span(start, end) + salt[line_text])
    out["n_dup_lines"] = np.bincount(line_text[again], minlength=n_texts)
    visible = np.zeros(len(data) + 1, np.int64)
    np.cumsum(((data & 0xC0) != 0x80) & ~H.BLANK[data], out=visible[1:])
    out["dup_line_chars"] = np.bincount(line_text[again], (visible[end] - visible[start])[again], n_texts).astype(np.int64)

    hashes = prefix.span(a, b)
    for n in (BASE_N, *MAX_DUP_CHARS):
        keys = H.ngrams(hashes, n)
        inside = np.flatnonzero(text[: len(keys)] == text[n - 1 :]) if len(keys) else np.zeros(0, np.int64)
        hit = inside[H.repeated(keys[inside] + salt[text[inside]])]
        covered = np.zeros(len(a), bool)
        for k in range(n):
            covered[hit + k] = True
        if n == BASE_N:
            out["n_repeat_words"] = np.bincount(text[covered], minlength=n_texts)
        else:
            out[f"dup{n}_chars"] = np.bincount(text[covered], chars[covered], n_texts).astype(np.int64)

    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    fine = out["dup_line_chars"] <= MAX_DUP_LINE_CHARS * out["word_chars"]
    for n, most in MAX_DUP_CHARS.items():
        fine &= out[f"dup{n}_chars"] <= most * out["word_chars"]
    out["kept"] = ~out["base_failed"] & fine
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for piece in pieces(batches):
        data, at = utf8(piece.column(1))
        out = measure(data, at)
        yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(out[n]) for n in names[1:])], names)


def coverage(documents: DataFrame) -> DataFrame:
    """Counts and verdict of each row of documents(doc_id, text); more columns of it are not read."""
    ship(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_measured, SCHEMA)


def kept_documents(documents: DataFrame) -> DataFrame:
    """The rows of documents that pass, with their own columns; judged again beside the row, so that no join is needed."""
    ship(documents.sparkSession)
    fields = documents.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            data, at = utf8(piece.column(fields.index("text")))
            yield piece.filter(pa.array(measure(data, at)["kept"]))

    return documents.mapInArrow(run, documents.schema)
