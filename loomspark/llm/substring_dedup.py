"""Substring dedup by suffix arrays: bytes of any 50-byte string that also starts in a document with a smaller id go.

Sorting every suffix of the corpus would shuffle 50 times its size. Three passes leave only what needs sorting:

1. Anchors. The least hash of the Q-byte strings in each 50-byte window, leftmost first, is an anchor (about one byte in
   14). Equal windows have the same anchor at the same place, so a window can only repeat if its anchor does. Anchors'
   hashes, 4 bytes each, are counted by hash range; each range answers with a slice of a bitmap. The least of many hashes
   is a small one, so they are mixed once more first: ranges are of one size.
2. Surroundings. Each window has one anchor; the windows of an anchor in the bitmap cover up to 100 - Q bytes, whose hash
   comes along. Where all of that stands in a smaller document too, every one of these windows repeats: the inside of a
   repeated passage needs no more. Repeats in one piece of text are settled before the shuffle. What shares at least the
   anchor and half of the rest of a window with another document, the rims of passages, goes into a second bitmap.
3. Suffix arrays. The bytes around these anchors, by hash range, form shards of at most SHARD bytes. Each has its suffix
   array (Larsson-Sadakane: ranks by 7 bytes, then doubled for groups still tied) and common prefixes (Kasai's recurrence,
   run over eight interleaved lanes at once); runs of 50 or more common bytes give each string its smallest document.
   Several shards of one range exchange that by one sort of their distinct strings.

   Of equal segments only the smallest document's is left; a passage of a third of all texts is one. Before it is sorted,
   a segment is cut down to the strings whose 64-bit hash a second document has in the same shard, and equal ones go again.

Both bitmaps have a bounded size; what they can't tell apart costs work, not results. Spans to remove meet their text in one
join at the end. Hashes of 64 bits decide steps 1 and 2, so two different strings could be taken for equal with a
probability of about 2**-64 a pair in one anchor's group. One anchor's distinct surroundings meet in one task.

Defined results: null texts are empty; a null id is larger than every other; rows of equal ids don't count as smaller than
one another, so neither removes from the other; kept bytes may not be UTF-8 at a cut, where ``deduplicated`` drops the
broken characters. Other columns are ignored by ``removals`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _hashing as H
from ._runtime import parts, pieces, release, ship, tidy, utf8, written

LENGTH, Q = 50, 24
HALF = (LENGTH - Q + 1) // 2  # bytes that a window has before or after its anchor, at one side at least
SEGMENT = 2 * LENGTH - Q  # the most that an anchor's windows cover
#: Bits of a bitmap, as a power of 2: an eighth of the bytes of text, within these bounds (16 and 128 MB).
MAP_LEAST, MAP_MOST = 27, 30
#: Bytes of text whose anchors make one hash range, about.
RANGE_BYTES = 1 << 25
#: Shards of the third pass are finer by as many bits of the anchor's hash.
FINE = 2
#: Bytes that one suffix array covers.
SHARD = 1 << 19
#: Bytes that are hashed at once where a task holds more of them: prefix sums take many times their room.
BLOCK = 1 << 19
LAST = (1 << 63) - 1


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Positions of the anchors of texts data[at[i]:at[i + 1]], their hashes, their texts, the first and end byte of their windows.

    Each window has one anchor, so the windows of an anchor follow one another, and equal windows fall to equal anchors.
    """
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none.astype(np.uint64), none, none, none
    prefix = H.Prefix(data)
    m = len(data) - Q + 1
    hashes = H.mix((prefix.sums[Q:] - prefix.sums[:-Q]) * prefix.back[:m])
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    width, span = LENGTH - Q + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: n], least[width - span :][:n])
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    window = np.flatnonzero(np.arange(n) + LENGTH <= at[text + 1])
    if not len(window):
        return none, none.astype(np.uint64), none, none, none
    spot = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fresh = np.ones(len(spot), bool)
    fresh[1:] = spot[1:] != spot[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(spot)) - 1
    spot = spot[first]
    return spot, H.mix(hashes[spot]), text[window[first]], window[first], window[last] + LENGTH


# Suffix arrays


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The order of all suffixes (Larsson-Sadakane).

    Suffixes are first ranked by 7 bytes; then each round sorts only groups still tied, by the rank of what follows.
    A suffix's rank is its group's last place, as in a bucket sort, so ranks of settled groups never change.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view(">u8").ravel().astype(np.uint64)
    key = (key & ~np.uint64(255)) | np.minimum(np.arange(n, 0, -1), 8).astype(np.uint64)  # an end comes before a zero byte
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    rank = np.zeros(n + 1, np.int64)
    bounds = np.append(np.flatnonzero(new), n)
    rank[order] = np.repeat(bounds[1:], np.diff(bounds))  # from 1; 0 stands for the end
    h = 7
    while h < n:
        size = np.diff(bounds)
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            break
        own = order[tied]
        follow = rank[np.minimum(own + h, n)]
        again = np.argsort((rank[own].astype(np.uint64) << np.uint64(32)) | follow.astype(np.uint64))
        own, follow = own[again], follow[again]
        order[tied] = own
        new = np.zeros(n, bool)
        new[bounds[:-1]] = True
        apart = np.ones(len(own), bool)
        apart[1:] = follow[1:] != follow[:-1]
        new[tied[apart]] = True
        bounds = np.append(np.flatnonzero(new), n)
        rank[order] = np.repeat(bounds[1:], np.diff(bounds))
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, at most `most` bytes (Kasai).

    By Kasai, the value at position i is at least that at i - 1 less one. Positions i mod 8 = 0 count from nothing, all at
    once; then each next lane starts from the lane before.
    """
    n = len(data)
    before = np.full(n, n)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    padded = np.concatenate([data.astype(np.int16), np.full(most + 1, -1, np.int16)])
    other = np.concatenate([data.astype(np.int16), np.full(most + 1, -2, np.int16)])
    for lane in range(8):
        i = np.arange(lane, n, 8)
        length = np.maximum(out[i - 1] - 1, 0) if lane else np.zeros(len(i), np.int64)
        j = before[i]
        live = np.arange(len(i))
        while len(live):
            go = (length[live] < most) & (padded[i[live] + length[live]] == other[j[live] + length[live]])
            live = live[go]
            length[live] += 1
        out[i] = length
    return out[order]


def least_owner(data: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the 50-byte strings at starts: which of the distinct strings each is; those, sorted; and the smallest owner of each."""
    order = suffix_array(data)
    shared = common_prefixes(data, order, LENGTH)
    group = np.cumsum(shared < LENGTH) - 1
    place = np.empty(len(data), np.int64)
    place[order] = group
    used, own = np.unique(place[starts], return_inverse=True)
    least = np.full(len(used), LAST, np.int64)
    np.minimum.at(least, own, owner)
    first = np.zeros(len(used), np.int64)
    first[own] = starts
    return own, data[first[:, None] + np.arange(LENGTH)], least


def merged(shards: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The smallest owner, over all shards, of each shard's distinct strings (rows of bytes), by one sort of all of them."""
    owner = np.concatenate([o for _, o in shards])
    words = np.zeros((len(owner), -(-LENGTH // 8) * 8), np.uint8)
    np.concatenate([s for s, _ in shards], out=words[:, :LENGTH])
    words = words.view(np.uint64)
    order = np.lexsort(words.T)
    new = np.ones(len(order), bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1)
    start = np.flatnonzero(new)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(owner[order], start), np.diff(start, append=len(order)))
    return np.split(out, np.cumsum([len(o) for _, o in shards])[:-1])


# Passes


class Sizes(NamedTuple):
    """Bits of a hash that name its range, and of a bitmap's size; both follow the bytes of text."""

    bits: int
    map: int


def sizes(documents: DataFrame) -> Sizes:
    total = documents.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    ranges = max(parts(documents.sparkSession), total // RANGE_BYTES)
    return Sizes(max(8, (ranges - 1).bit_length()), min(MAP_MOST, max(MAP_LEAST, total.bit_length() - 3)))


def _cut(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, from, to) of sorted parts; work follows the parts that occur, however many there could be."""
    start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    return list(zip(part[start].tolist(), start.tolist(), [*start[1:].tolist(), len(part)], strict=False))


def _blobs(columns: dict[str, np.ndarray], cuts: list[tuple[int, int, int]]) -> pa.RecordBatch:
    arrays = [pa.array([p for p, _, _ in cuts], pa.int32())]
    arrays += [pa.array([x[a:b].tobytes() for _, a, b in cuts], pa.binary()) for x in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, ["part", *columns])


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(column)])


def _collected(slices: DataFrame, of: Sizes) -> np.ndarray:
    """The bitmap of all slices (part, bits): 2**of.map bits."""
    out = np.zeros((1 << of.bits, 1 << (of.map - of.bits - 3)), np.uint8)
    for batch in slices.toArrow().to_batches(1):
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out[part] = np.frombuffer(blob.as_buffer(), np.uint8)
    return out.ravel()


def _slice(keys: np.ndarray, of: Sizes) -> bytes:
    """A part's slice, with the bit of each key's low end set."""
    marks = np.zeros(1 << (of.map - of.bits), bool)
    marks[(keys & np.uint64((1 << (of.map - of.bits)) - 1)).astype(np.int64)] = True
    return np.packbits(marks).tobytes()


def _marked(bitmap: np.ndarray, part: np.ndarray, keys: np.ndarray, of: Sizes) -> np.ndarray:
    at = (part << (of.map - of.bits)) | (keys & np.uint64((1 << (of.map - of.bits)) - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def _texts(documents: DataFrame) -> DataFrame:
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.coalesce(doc, F.lit(LAST)).alias("owner"), F.xxhash64(doc, F.col("text").cast("string")).alias("row"), text.alias("text"))


def _freed(known, rows: DataFrame, name: str) -> DataFrame:
    """rows, written; then the broadcast that they needed goes."""
    out = written(rows, name)
    known.unpersist()
    return out


def repeated_anchors(documents: DataFrame, of: Sizes) -> np.ndarray:
    """Pass 1: the bitmap of anchors that occur in two documents or more."""
    bits = of.bits

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            data, at = utf8(piece.column(2))
            _, hashes, text, _, _ = anchors(data, at)
            once = ~H.later(hashes + H.mix(text.astype(np.uint64) + np.uint64(1)))
            hashes = np.sort(hashes[once])
            third = np.zeros(len(hashes), bool)
            third[2:] = hashes[2:] == hashes[:-2]  # two of a kind tell as much as more
            hashes = hashes[~third]
            low = (hashes >> np.uint64(32 - bits)).astype(np.uint32)
            yield _blobs({"low": low}, _cut((hashes >> np.uint64(64 - bits)).astype(np.int64)))

    def count(table: pa.Table) -> pa.Table:
        tidy()
        low = np.sort(_joined(table, "low", np.uint32))
        twice = low[1:][low[1:] == low[:-1]].astype(np.uint64)
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([_slice(twice, of)])})

    out = _texts(documents).mapInArrow(emit, "part int, low binary").groupBy("part").applyInArrow(count, "part int, bits binary")
    return _collected(written(out, "anchor-bits"), of)


def _seen(data: np.ndarray, at: np.ndarray, bitmap: np.ndarray | None, of: Sizes) -> dict[str, np.ndarray]:
    """Anchors in the bitmap, all without one: hash, part, text, first and end byte of their windows; hashes of all of these bytes, of the
    anchor with HALF bytes before and with HALF bytes after (0: not in the windows). Any window has one of these halves."""
    spot, hashes, text, a, b = anchors(data, at)
    part = (hashes >> np.uint64(64 - of.bits)).astype(np.int64)
    if bitmap is not None:
        own = np.flatnonzero(_marked(bitmap, part, hashes >> np.uint64(32 - of.bits), of))
        spot, hashes, part, text, a, b = (x[own] for x in (spot, hashes, part, text, a, b))
    prefix = H.Prefix(data)
    around = H.mix(prefix.span(a, b) + H.mix((spot - a).astype(np.uint64)) ^ hashes)
    left = np.where(spot - HALF >= a, prefix.span(np.maximum(spot - HALF, 0), spot + Q).astype(np.uint16) | 1, 0)
    right = np.where(spot + Q + HALF <= b, prefix.span(spot, np.minimum(spot + Q + HALF, len(data))).astype(np.uint16) | 1, 0)
    return {"hashes": hashes, "part": part, "text": text, "a": a, "b": b, "around": around, "left": left.astype(np.uint16), "right": right.astype(np.uint16)}


def _shared_halves(anchor: np.ndarray, half: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether another owner has the same half at the same anchor."""
    out = np.zeros(len(anchor), bool)
    key = (anchor.astype(np.uint64) << np.uint64(16)) | half
    order = np.argsort(key, kind="stable")
    order = order[half[order] > 0]
    if len(order):
        k, o = key[order], owner[order]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(start, append=len(k))
        out[order] = np.repeat(np.maximum.reduceat(o, start) > np.minimum.reduceat(o, start), size)
    return out


def settle(documents: DataFrame, bitmap: np.ndarray, of: Sizes) -> DataFrame:
    """Pass 2: rows (part, row, first, size) of surroundings that repeat as a whole, as blobs; or (part, bits) of the rest."""
    bits = of.bits
    known = documents.sparkSession.sparkContext.broadcast(bitmap)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            data, at = utf8(piece.column(2))
            owner, row = (piece.column(k).to_numpy() for k in (0, 1))
            x = _seen(data, at, known.value, of)
            x["owner"], x["row"] = owner[x["text"]], row[x["text"]]
            order = np.lexsort((x["owner"], x["around"], x["part"]))
            x = {k: v[order] for k, v in x.items()}
            new = np.ones(len(order), bool)
            new[1:] = x["around"][1:] != x["around"][:-1]
            done = x["owner"] > x["owner"][new][np.cumsum(new) - 1] if len(new) else new
            part, first = x["part"], (x["a"] - at[x["text"]]).astype(np.uint32)
            columns = {k: x[k] for k in ("around", "owner", "row", "left", "right")}
            columns |= {"first": first, "size": (x["b"] - x["a"]).astype(np.uint8), "anchor": (x["hashes"] >> np.uint64(32 - bits)).astype(np.uint32)}
            for state in (False, True):
                mine = done == state
                if mine.any():
                    out = _blobs({k: x[mine] for k, x in columns.items()}, _cut(part[mine]))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array([state] * out.num_rows)], [*out.schema.names, "done"])

    def decide(table: pa.Table) -> pa.Table:
        tidy()
        kinds = {"around": np.uint64, "owner": np.int64, "row": np.int64, "left": np.uint16, "right": np.uint16, "first": np.uint32, "size": np.uint8, "anchor": np.uint32}
        done = np.array(table.column("done").to_pylist(), bool)
        fixed, open_ = table.filter(pa.array(done)), table.filter(pa.array(~done))
        x = {k: _joined(open_, k, t) if open_.num_rows else np.zeros(0, t) for k, t in kinds.items()}
        order = np.lexsort((x["owner"], x["around"]))
        x = {k: v[order] for k, v in x.items()}
        new = np.ones(len(order), bool)
        new[1:] = x["around"][1:] != x["around"][:-1]
        repeat = x["owner"] > x["owner"][new][np.cumsum(new) - 1] if len(order) else new
        # Left: surroundings in their smallest document, which share one half at least with another document.
        own = {k: v[~repeat] for k, v in x.items()}
        several = _shared_halves(own["anchor"], own["left"], own["owner"]) | _shared_halves(own["anchor"], own["right"], own["owner"])
        rest = own["around"][several]
        spans = [np.concatenate([x[k][repeat], _joined(fixed, k, kinds[k]) if fixed.num_rows else np.zeros(0, kinds[k])]) for k in ("row", "first", "size")]
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([_slice(rest, of)]), **{k: pa.array([v.tobytes()]) for k, v in zip(("row", "first", "size"), spans, strict=True)}})

    blobs = _texts(documents).mapInArrow(emit, "part int, around binary, owner binary, row binary, left binary, right binary, first binary, size binary, anchor binary, done boolean")
    return _freed(known, blobs.groupBy("part").applyInArrow(decide, "part int, bits binary, row binary, first binary, size binary"), "settled")


def _hashed(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of raw[a[i]:b[i]] for ascending a, in blocks."""
    out = np.empty(len(a), np.uint64)
    i = 0
    while i < len(a):
        j = int(np.searchsorted(a, a[i] + BLOCK))
        low = a[i]
        out[i:j] = H.Prefix(raw[low : b[i:j].max()]).span(a[i:j] - low, b[i:j] - low)
        i = j
    return out


def _larger_copies(raw: np.ndarray, off: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether a segment equals one of a smaller owner."""
    key = _hashed(raw, off[:-1], off[1:])
    order = np.lexsort((owner, key))
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    out = np.zeros(len(order), bool)
    if len(order):
        out[order] = owner[order] > owner[order][new][np.cumsum(new) - 1]
    return out


def _with_repeats(raw: np.ndarray, off: np.ndarray, row: np.ndarray, owner: np.ndarray, first: np.ndarray, size: np.ndarray):
    """The same segments cut down to the windows whose hash another owner has too; what has none needs no sorting."""
    count = size - LENGTH + 1
    seg = np.repeat(np.arange(len(size), dtype=np.int32), count)
    start = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
    at = off[seg] + start
    key = _hashed(raw, at, at + LENGTH)
    del at
    maybe = np.flatnonzero(H.repeated(key))
    order = maybe[np.argsort(key[maybe], kind="stable")]
    if not len(order):
        return raw[:0], row[:0], owner[:0], first[:0], size[:0]
    k, o = key[order], owner[seg[order]]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    two = np.repeat(np.maximum.reduceat(o, begin) > np.minimum.reduceat(o, begin), np.diff(begin, append=len(k)))
    hit = np.sort(order[two])
    own, begin = np.unique(seg[hit], return_index=True)
    low, high = start[hit[begin]], start[hit[np.append(begin[1:], len(hit)) - 1]] + LENGTH if len(hit) else start[:0]
    size = high - low
    ends = np.cumsum(np.append(0, size))
    raw = raw[np.repeat(off[own] + low - ends[:-1], size) + np.arange(ends[-1])]
    return raw, row[own], owner[own], (first[own] + low).astype(np.uint32), size


def sort_rims(documents: DataFrame, rims: np.ndarray, of: Sizes) -> DataFrame:
    """Pass 3: rows (part, row, first, size) of repeated strings at the rims of passages, as blobs. The anchors' bitmap is not needed for it: few others' surroundings are in rims."""
    bits = of.bits
    known = documents.sparkSession.sparkContext.broadcast(rims)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            data, at = utf8(piece.column(2))
            owner, row = (piece.column(k).to_numpy() for k in (0, 1))
            x = _seen(data, at, None, of)
            own = _marked(known.value, x["part"], x["around"], of)
            x = {k: v[own] for k, v in x.items()}
            order = np.lexsort((owner[x["text"]], x["around"], x["part"]))
            new = np.ones(len(order), bool)
            new[1:] = x["around"][order][1:] != x["around"][order][:-1]
            mine = owner[x["text"][order]]
            order = order[mine == mine[new][np.cumsum(new) - 1]]  # larger owners' were settled in pass 2
            part, text, a, b = (x[k][order] for k in ("part", "text", "a", "b"))
            if not len(part):
                continue
            size = b - a
            off = np.cumsum(np.append(0, size))
            raw = data[np.repeat(a - off[:-1], size) + np.arange(off[-1])]
            fine_part = (part << FINE) | (x["hashes"][order] >> np.uint64(64 - bits - FINE)).astype(np.int64) & ((1 << FINE) - 1)
            again = np.argsort(fine_part, kind="stable")
            cuts = _cut(fine_part[again])
            out = _blobs({"owner": owner[text][again], "row": row[text][again], "first": (a - at[text]).astype(np.uint32)[again], "size": size.astype(np.uint8)[again]}, cuts)
            size, start = size[again], off[:-1][again]
            ends = np.cumsum(np.append(0, size))
            raw = raw[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
            texts = pa.array([raw[ends[i] : ends[j]].tobytes() for _, i, j in cuts], pa.binary())
            yield pa.RecordBatch.from_arrays([out.column(0), texts, *out.columns[1:]], ["part", "bytes", "owner", "row", "first", "size"])

    def sort(table: pa.Table) -> pa.Table:
        tidy()
        raw, owner, row, first, size = (_joined(table, k, t) for k, t in (("bytes", np.uint8), ("owner", np.int64), ("row", np.int64), ("first", np.uint32), ("size", np.uint8)))
        size = size.astype(np.int64)
        whole = []
        for cut in (False, True):
            off = np.cumsum(np.append(0, size))
            if cut:
                raw, row, owner, first, size = _with_repeats(raw, off, row, owner, first, size)
                off = np.cumsum(np.append(0, size))
            # Equal segments: all but the smallest owner's go as a whole; what is left is cut down (once more).
            again = _larger_copies(raw, off, owner)
            whole.append((row[again], first[again].astype(np.uint32), size[again].astype(np.uint8)))
            rest = ~again
            raw = raw[np.repeat(rest, size)]
            row, owner, first, size = row[rest], owner[rest], first[rest], size[rest]
        raw, row, owner, first, size = _with_repeats(raw, np.cumsum(np.append(0, size)), row, owner, first, size)
        off = np.cumsum(np.append(0, size))
        found, tables, i = [], [], 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(off, off[i] + SHARD, side="right")) - 1)
            count = size[i:j] - LENGTH + 1
            seg = np.repeat(np.arange(i, j), count)
            start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            data, places = raw[off[i] : off[j]], off[seg] - off[i] + start
            which, strings, owners = least_owner(data, places, owner[seg])
            found.append((seg, start, which))
            tables.append((strings, owners))
            i = j
        best = merged(tables) if len(tables) > 1 else [owners for _, owners in tables]
        found = [(seg, start, least[which]) for (seg, start, which), least in zip(found, best, strict=True)]
        seg, start, least = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(3))
        gone = owner[seg] > least
        sorted_out = row[seg][gone], (first[seg] + start)[gone].astype(np.uint32), np.full(gone.sum(), LENGTH, np.uint8)
        spans = [np.concatenate(x) for x in zip(*whole, sorted_out, strict=True)]
        return pa.table({"part": table.column("part").slice(0, 1), **{k: pa.array([v.tobytes()]) for k, v in zip(("row", "first", "size"), spans, strict=True)}})

    blobs = _texts(documents).mapInArrow(emit, "part int, bytes binary, owner binary, row binary, first binary, size binary")
    return _freed(known, blobs.groupBy("part").applyInArrow(sort, "part int, row binary, first binary, size binary"), "rims")


def spans(documents: DataFrame) -> DataFrame:
    """row (a hash of id and text), spans (u32 first and end of each maximal run to remove, sorted) of the rows that lose bytes."""
    spark = documents.sparkSession
    of = sizes(documents)
    bits = of.bits
    bitmap = repeated_anchors(documents, of)
    release(spark)
    settled = settle(documents, bitmap, of)
    rims = _collected(settled.select("part", "bits"), of)
    release(spark)
    sorted_ = sort_rims(documents, rims, of)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row, first, size = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in ((1, np.int64), (2, np.uint32), (3, np.uint8)))
                part = (H.mix(row.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                if len(order):
                    yield _blobs({"row": row[order], "first": first[order], "size": size[order]}, _cut(part[order]))

    def gather(table: pa.Table) -> pa.Table:
        row, first, size = (_joined(table, k, t) for k, t in (("row", np.int64), ("first", np.uint32), ("size", np.uint8)))
        order = np.lexsort((first, row))
        row, first = row[order], first[order].astype(np.int64)
        end = first + size[order]
        new = np.ones(len(row), bool)
        new[1:] = row[1:] != row[:-1]
        doc = np.cumsum(new) - 1
        reach = np.maximum.accumulate(end + (doc << 34)) - (doc << 34)  # the furthest end so far in the row
        run = new.copy()
        run[1:] |= first[1:] > reach[:-1]
        starts = np.flatnonzero(run)
        ends = reach[np.append(starts[1:], len(row)) - 1]
        pairs = np.stack([first[starts], ends], axis=1).astype(np.uint32)
        cut = np.append(np.searchsorted(doc[starts], np.arange(doc[-1] + 1)), len(starts))
        return pa.table({"row": pa.array(row[new]), "spans": pa.array([pairs[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())})

    both = settled.select("part", "row", "first", "size").unionAll(sorted_)
    dealt = both.mapInArrow(deal, "part int, row binary, first binary, size binary")
    out = written(dealt.groupBy("part").applyInArrow(gather, "row long, spans binary"), "spans")
    release(spark)
    return out


def kept(raw: bytes, pairs: bytes | None) -> tuple[bytes, int]:
    """What is left of raw, and the number of runs removed."""
    if not pairs:
        return raw, 0
    bounds = np.frombuffer(pairs, np.uint32).tolist()
    inner = [0, *bounds, len(raw)]
    return b"".join(raw[a:b] for a, b in zip(inner[::2], inner[1::2], strict=True)), len(bounds) // 2


def removals(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of documents(doc_id, text)."""
    ship(documents.sparkSession)
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = own.withColumn("row", F.xxhash64("doc_id", "text")).join(spans(documents), "row", "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            out = []
            for text, pairs in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                left, n = kept(raw, pairs)
                out.append((len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest()))
            n_bytes, removed, n, sha = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, removed, n)), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(documents: DataFrame) -> DataFrame:
    """documents with what is left of each text, in their own columns; a null text stays null."""
    ship(documents.sparkSession)
    fields = documents.schema.names
    own = documents.withColumn("__row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    found = spans(documents).select(F.col("row").alias("__row"), F.col("spans").alias("__spans"))
    joined = own.join(found, "__row", "left").select(*(own[c] for c in fields), "__spans")
    at = fields.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            texts = [t if t is None else kept(t.encode(), p)[0].decode(errors="ignore") for t, p in zip(piece.column(at).to_pylist(), piece.column(len(fields)).to_pylist(), strict=True)]
            columns = piece.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, fields)

    return joined.mapInArrow(run, documents.schema)
