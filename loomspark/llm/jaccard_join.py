"""N-gram Jaccard join: an exact similarity join in the metric space of shingle sets.

The Jaccard distance d is a metric, and so is the size of the symmetric difference |A ^ B|; texts link at d <= 0.2, which is
S |A ^ B| <= T (|A| + |B|) with S = 180, T = 20. Copies (equal sets) are one node. Then

1. Meetings. For each of BANDS random orders of the shingles, the nodes with the same first shingle meet, and the least of
   them is measured against those that it meets twice. These links leave few components of near copies.
2. Regions. Almost all other pairs are at distance 1 of one another and of every document, where the triangle inequality
   says nothing: a window of any use would copy every node to every cell. There the space is split by its
   smallest points instead: d(A, {s}) < 1 only if A holds shingle s, and if A and B link, they share one of the
   |A| - ceil(0.8 |A|) + 1 first shingles of any fixed order. So a node is replicated to the regions of its rarest
   shingles, and nothing is missed. Regions whose members are already one component are done.
3. Cells. Regions of more than SMALL members get a pivot document p each, their least node; those with the same one become
   its Voronoi cell. Every member x is measured against p, exactly. Symmetric differences don't change if all sets of a
   cell are shifted to D_x = x ^ p: |x ^ y| = |D_x ^ D_y|. Near copies share almost all they hold, but hardly anything of D.
   Only pairs of different components are still asked for, so one of the two is farther from p than a link: with
   E_x = S |D_x| - T |x|, its E is above T |p|, every member's is above -T |p|, and a link needs (E_x + E_y) / 2S common
   shingles of D_x and D_y, one at least. By the triangle inequality S | |D_x| - |D_y| | <= T (|x| + |y|), the window in which x looks for y.
   So x is replicated to the regions (cell, t) of the first t of D_x only, in an order that estimates how many of the cell's D hold t.
4. These regions are joined in the same way, each with a pivot of its own, as long as each round halves them, until none has more
   than SMALL members. Members of regions that are not split further meet in pairs: bounds from sizes, windows, the place of the first common shingle and
   parity bitmaps, whose Hamming distance is at most that of the sets, leave few to be measured exactly.

Rarity counts every shingle of every text: numpy blocks by hash range, pre-summed in each piece of text. Only the order
uses it, so the list of frequent shingles that goes to the tasks can be cut to HEAVY_MAX (8 bytes each), by frequency.
Nothing of the order of the corpus reaches the driver. Large groups of copies are pre-aggregated; near copies meet their
pivot and those few that differ from it in the same way, not each other.

Shingles and nodes are 64-bit hashes (two of N sets collide with a probability of N**2 / 2**65), the order's keys have 40
bits and up; their collisions cost time, not results.

Defined results: words by white space, A-Z lowered; texts without words (null too) have no shingles and are their own
component; rows that repeat an id are rows of their own, whose component's id is the smallest of all its texts; a null
id is never the smallest unless alone. Other columns are ignored by ``linked`` and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _hashing as H
from ._runtime import parts, pieces, release, ship, tidy, utf8, written
from .graph import components, extended

N, BANDS, MEETS = 5, 6, 2
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Bits of a set's parity bitmap: each shingle flips one, so two sets differ in at least as many shingles as their bitmaps in bits.
SIGN = 1024
#: Classes of frequency are powers of 2; the least that may count as frequent, and how many frequent shingles at most.
HEAVY_CLASS, HEAVY_MAX = 3, 1 << 20
#: The most row keys that are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Members of a region that meet in pairs. Larger regions become cells of a pivot, if they have halved since the last time.
SMALL = 512
S, T = 100 + PERCENT, 100 - PERCENT
#: Bytes of one hash range, about, when ranges are made.
RANGE_BYTES = 1 << 25
SALTS = H.mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingles(data: np.ndarray, at: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text and the text of each, in the texts' order. A shorter text is one shingle."""
    data = H.lower_ascii(data)
    a, b, text = H.words(data, at)
    hashes = H.Prefix(data).span(a, b)
    keys = H.ngrams(hashes, n)
    inside = np.flatnonzero(text[: len(keys)] == text[n - 1 :]) if len(keys) else np.zeros(0, np.int64)
    keys, owner = keys[inside], text[inside]
    words = np.bincount(text, minlength=len(at) - 1)
    first = np.cumsum(words) - words
    extra = [(H.ngrams(hashes, k)[first[short]], short) for k in range(1, n) if len(short := np.flatnonzero(words == k))]
    if extra:
        keys = np.concatenate([keys, *(x for x, _ in extra)])
        owner = np.concatenate([owner, *(x for _, x in extra)])
        order = np.argsort(owner, kind="stable")
        keys, owner = keys[order], owner[order]
    fresh = ~H.later(keys + H.mix(owner.astype(np.uint64) + np.uint64(1)))
    return keys[fresh], owner[fresh]


def nodes_of(keys: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the number of shingles, the hash of the set (as int64), where its shingles start."""
    size = np.bincount(owner, minlength=n_texts)
    start = np.cumsum(size) - size
    total = np.zeros(n_texts, np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        total[some] = np.add.reduceat(H.mix(keys ^ H.BASE), start[some])
    return size, H.mix(total + size.astype(np.uint64)).view(np.int64), start


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        data, at = utf8(piece.column(2))
        keys, owner = shingles(data, at)
        size, node, start = nodes_of(keys, owner, piece.num_rows)
        some = np.flatnonzero(size)
        mins = np.zeros((piece.num_rows, BANDS), np.uint64)
        for k in range(BANDS if len(some) else 0):
            mins[some, k] = np.minimum.reduceat(H.mix(keys ^ SALTS[k]), start[some])
        odd = np.bincount(owner * SIGN + (keys & np.uint64(SIGN - 1)).astype(np.int64), minlength=piece.num_rows * SIGN) & 1
        signs = np.packbits(odd.astype(np.uint8)).view(np.int64)
        signs = pa.FixedSizeListArray.from_arrays(pa.array(signs), SIGN // 64).cast(pa.list_(pa.int64()))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(mins.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
        columns = [piece.column(0), piece.column(1), pa.array(size), pa.array(node, mask=size == 0), lists, signs]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n", "node", "mins", "signs"])


def _texts(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("row"), text.alias("text"))


def sketches(documents: DataFrame) -> DataFrame:
    """doc_id, row (a hash of id and text), n, node (null: no shingles), mins, signs of each row; written."""
    return written(_texts(documents).mapInArrow(_sketched, "doc_id long, row long, n long, node long, mins array<long>, signs array<long>"), "sketches")


def _sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, tokens (sorted, 8 bytes each) of the rows of wanted(row)."""
    texts = _texts(documents)
    few = wanted.count() <= BROADCAST_ROWS
    picked = texts.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), "row", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            keys, owner = shingles(*utf8(piece.column(2)))
            size, node, start = nodes_of(keys, owner, piece.num_rows)
            sets = [np.sort(keys[a : a + n]).tobytes() for a, n in zip(start.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(sets, pa.binary())], ["node", "tokens"])

    return picked.mapInArrow(run, "node long, tokens binary").dropDuplicates(["node"])


def _estimate(tokens: np.ndarray, heads: np.ndarray, classes: np.ndarray, drop: np.uint64) -> np.ndarray:
    """About how many sets hold each token: 1, or for frequent ones the power of 2 of their class."""
    out = np.ones(len(tokens), np.int64)
    if len(heads):
        head = tokens >> drop
        at = np.minimum(np.searchsorted(heads, head), len(heads) - 1)
        often = heads[at] == head
        out[often] = np.int64(1) << classes[at[often]].astype(np.int64)
    return out


def _shifted(p: np.ndarray, y: np.ndarray, cell: int, peers: int, order) -> tuple[list[int], int]:
    """The regions of y in a cell with pivot p, one for each of the first shingles of their difference, and how many of them may meet any member."""
    both = np.concatenate([p, y])
    both = both[np.argsort(both, kind="stable")]
    same = np.zeros(len(both) + 1, bool)
    same[1:-1] = both[1:] == both[:-1]
    d = both[~(same[1:] | same[:-1])]
    at = np.minimum(np.searchsorted(p, d), max(0, len(p) - 1))
    in_p = p[at] == d if len(p) else np.zeros(len(d), bool)
    held = _estimate(d, *order)
    held = np.where(in_p, np.maximum(peers - held, 1), held)  # members that lack it, for p's own
    d = d[np.lexsort((H.mix(d), np.log2(held).astype(np.int64)))]
    e, n = S * len(d) - T * len(y), len(y)
    window = e - 2 * T * (100 * n // PERCENT + 1)
    needed = [max(1, -(-(e + max(bound, window)) // (2 * S))) for bound in (T * len(p) + 1, 1 - T * len(p))]
    shallow, deep = (max(0, len(d) - k + 1) for k in needed)
    outside = e > T * len(p)
    return H.mix(d[: deep if outside else shallow] ^ H.mix(np.array([cell]).view(np.uint64))).view(np.int64).tolist(), shallow


def distances(documents: DataFrame, sketch: DataFrame, pairs: DataFrame, order=None) -> DataFrame:
    """a, b, shared, either (sizes of intersection and union) of the nodes of pairs(a, b), measured exactly; written.

    Where pairs have a cell of pivot a (null: none) and peers (its size), also n, d (sizes of b and of its difference to a),
    centre (the size of a), and b's regions in the cell and how many of them are shallow. order is what ``heavy`` says, broadcast.
    """
    if "cell" not in pairs.columns:
        pairs = pairs.withColumns({"cell": F.lit(None).cast("long"), "peers": F.lit(None).cast("long")})
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = written(sketch.where("node is not null").groupBy("node").agg(F.min("row").alias("row")).join(ends, "node", "left_semi").select("row"), "wanted")
    sets = _sets(documents, wanted)
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell, peers, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                shared = int((q[at] == p).sum())
                either = len(p) + len(q) - shared
                out.append((shared, either, len(q), either - shared, len(p), *(([], 0) if cell is None else _shifted(p, q, cell, peers, order.value))))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), [*[pa.int64()] * 5, pa.list_(pa.int64()), pa.int64()], strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], ["a", "b", "cell", "peers", "shared", "either", "n", "d", "centre", "regions", "shallow"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "cell", "peers", "x", "y")
    schema = "a long, b long, cell long, peers long, shared long, either long, n long, d long, centre long, regions array<long>, shallow long"
    out = written(joined.mapInArrow(run, schema), "distances")
    release(documents.sparkSession)
    return out


LINKED = f"shared * 100 >= either * {PERCENT}"


def _close(n: str, m: str) -> F.Column:
    """Whether sets of these sizes can link."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def _alike(x: str, y: str) -> F.Column:
    """Whether the parity bitmaps of sets leave room for a link: |A ^ B| <= (1 - j) / (1 + j) * (|A| + |B|) at similarity j."""
    differ = sum((F.bit_count(F.get(f"{x}.signs", F.lit(k)).bitwiseXOR(F.get(f"{y}.signs", F.lit(k)))) for k in range(SIGN // 64)), F.lit(0))
    return differ * (100 + PERCENT) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (100 - PERCENT)


def meetings(sketch: DataFrame) -> DataFrame:
    """Step 1: (a: pivot, b: node) that meet in MEETS bands or more, of sizes that can link."""
    nodes = sketch.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("mins").alias("mins"))
    rows = nodes.select("node", "n", F.posexplode("mins").alias("band", "value"))
    pivots = rows.groupBy("band", "value").agg(F.min(F.struct("node", "n")).alias("p"), F.count("*").alias("c")).where("c > 1")
    met = rows.join(pivots, ["band", "value"]).where(F.col("node") != F.col("p.node")).where(_close("n", "p.n"))
    return met.groupBy(F.col("p.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("meets")).where(F.col("meets") >= MEETS).select("a", "b")


def _bits(sketch: DataFrame) -> int:
    """Bits of a hash that name its range, so that one range of all shingles has RANGE_BYTES at 4 bytes each, about."""
    total = sketch.agg(F.sum("n")).first()[0] or 0
    return max(8, (max(parts(sketch.sparkSession), 4 * total // RANGE_BYTES) - 1).bit_length())


def _by_part(tokens: np.ndarray, bits: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The parts of sorted tokens, their top bits, and the bounds of each."""
    part = (tokens >> np.uint64(64 - bits)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    return part[start], list(zip(start.tolist(), [*start[1:].tolist(), len(part)], strict=True)) if len(part) else []


def _distinct(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles and texts of a piece with each set once; sizes and nodes of its texts."""
    keys, owner = shingles(*utf8(piece.column(2)))
    size, node, _ = nodes_of(keys, owner, piece.num_rows)
    first = np.zeros(piece.num_rows, bool)
    first[np.unique(node, return_index=True)[1]] = True
    own = first[owner]
    return keys[own], owner[own], size, node


def heavy(documents: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """The most frequent shingles' 40-bit (or longer) heads, sorted, their classes of frequency, and the bits that heads lack."""
    drop = np.uint64(64 - bits - 32)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            heads = np.sort(_distinct(piece)[0])
            some, cuts = _by_part(heads, bits)
            low = (heads >> drop).astype(np.uint32)
            blobs = [low[i:j].tobytes() for i, j in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def count(table: pa.Table) -> pa.Table:
        tidy()
        low = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("blob")]))
        start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        size = np.diff(start, append=len(low))
        own = size >= 1 << HEAVY_CLASS
        heads = (np.uint64(table.column("part")[0].as_py()) << np.uint64(32)) | low[start[own]].astype(np.uint64)
        return pa.table({"class": pa.array(np.log2(size[own]).astype(np.int32)), "head": pa.array(heads.view(np.int64))})

    blobs = _texts(documents).mapInArrow(emit, "part int, blob binary")
    found = written(blobs.groupBy("part").applyInArrow(count, "class int, head long"), "frequent-shingles")
    release(documents.sparkSession)
    least, total = 64, 0
    for row in sorted(found.groupBy("class").count().collect(), reverse=True):  # 64 rows at most
        total += row["count"]
        if total > HEAVY_MAX:
            break
        least = row["class"]
    rows = found.where(F.col("class") >= least).toArrow().sort_by("head")  # HEAVY_MAX rows at most
    return rows.column("head").to_numpy().astype(np.int64).view(np.uint64), rows.column("class").to_numpy().astype(np.uint64), drop


def regions(documents: DataFrame, frequent, bits: int) -> DataFrame:
    """Step 2: region, node, n, q (shingles from the common one on) of the members of each region of two nodes or more; written."""
    spark = documents.sparkSession

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, classes, drop = frequent.value
        for piece in pieces(batches):
            keys, owner, size, node = _distinct(piece)
            rank = keys >> np.uint64(1)
            if len(heads):
                head = keys >> drop
                at = np.minimum(np.searchsorted(heads, head), len(heads) - 1)
                often = np.flatnonzero(heads[at] == head)
                rank[often] = (np.uint64(1) << np.uint64(63)) | (classes[at[often]] << np.uint64(56)) | (keys[often] >> np.uint64(8))
            order = np.lexsort((rank, owner))
            keys, owner = keys[order], owner[order]
            place = np.arange(len(keys)) - np.searchsorted(owner, owner)
            mine = place < (size - (PERCENT * size + 99) // 100 + 1)[owner]
            keys, owner, left = keys[mine], owner[mine], (size[owner] - place)[mine].astype(np.uint32)
            order = np.argsort(keys)
            keys, owner, left = keys[order], owner[order], left[order]
            some, cuts = _by_part(keys, bits)
            low, ids, ns = (keys >> drop).astype(np.uint32), node[owner], size[owner].astype(np.uint32)
            cut = lambda x: pa.array([x[i:j].tobytes() for i, j in cuts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), cut(low), cut(ids), cut(ns), cut(left)], ["part", "low", "nodes", "sizes", "left"])

    def meet(table: pa.Table) -> pa.Table:
        tidy()
        kinds = (("low", np.uint32), ("nodes", np.int64), ("sizes", np.uint32), ("left", np.uint32))
        low, ids, ns, left = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)]) for c, t in kinds)
        order = np.argsort(low, kind="stable")
        same = np.zeros(len(low) + 1, bool)
        same[1:-1] = low[order][1:] == low[order][:-1]
        order = order[same[1:] | same[:-1]]
        order = order[np.lexsort((-left[order].astype(np.int64), ids[order], low[order]))]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (low[order][1:] != low[order][:-1]) | (ids[order][1:] != ids[order][:-1])
        order = order[fresh]
        region = (np.uint64(table.column("part")[0].as_py()) << np.uint64(32)) | low[order].astype(np.uint64)
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = region[1:] == region[:-1]
        many = same[1:] | same[:-1]
        region, nodes, n, left = region[many], ids[order][many], ns[order][many].astype(np.int64), left[order][many].astype(np.int64)
        if len(region):  # regions of the same members have the same name, and so become one
            start = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
            region = np.repeat(H.mix(np.add.reduceat(H.mix(nodes.view(np.uint64) + H.BASE), start)), np.diff(start, append=len(region)))
        return pa.table({"region": region.view(np.int64), "node": nodes, "n": n, "q": left})

    blobs = _texts(documents).mapInArrow(emit, "part int, low binary, nodes binary, sizes binary, left binary")
    met = blobs.groupBy("part").applyInArrow(meet, "region long, node long, n long, q long")
    out = written(met.groupBy("region", "node").agg(F.first("n").alias("n"), F.max("q").alias("q")), "regions")
    release(spark)
    return out


def _mixed(members: DataFrame, merged: DataFrame) -> DataFrame:
    """members with root, the component, and size of their region, of the regions where several components can meet; written."""
    owned = members.join(merged, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kinds = owned.groupBy("region").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size"), F.min("node").alias("pivot"), F.min("above").alias("above"), F.bool_or(~F.col("deep")).alias("any"))
    return written(owned.drop("above").join(kinds.where("r0 <> r1 and any").select("region", "size", "pivot", "above"), "region"), "mixed-regions")


def _possible() -> F.Column:
    """Whether members x and y of a small region may link, by all that is known of them without their sets."""
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    sizes = (x("root") < y("root")) & _close("x.n", "y.n") & (F.abs(x("d") - y("d")) * S <= (x("n") + y("n")) * T)
    rest = F.least(x("q"), y("q")) * (2 * S) >= x("e") + y("e")
    return sizes & rest & (~x("deep") | y("inside")) & (~y("deep") | x("inside")) & _alike("x", "y")


def links(documents: DataFrame, sketch: DataFrame) -> DataFrame:
    """node, root: the component of every node that has a link and isn't the root itself."""
    bits = _bits(sketch)
    frequent = documents.sparkSession.sparkContext.broadcast(heavy(documents, bits))
    merged = components(distances(documents, sketch, meetings(sketch)).where(LINKED).select("a", "b"))
    nodes = sketch.where("node is not null").groupBy("node").agg(F.first("signs").alias("signs"))
    no, none = F.lit(False), F.lit(None).cast("long")
    level = 0
    members = regions(documents, frequent, bits).select("*", F.col("n").alias("d"), (F.col("n") * (S - T)).alias("e"), no.alias("inside"), no.alias("deep"), F.lit(1 << 62).alias("above"))
    while True:  # log2 of the nodes times at most
        mixed = _mixed(members, merged)
        large = (F.col("size") > SMALL) & (F.col("size") * 2 <= F.col("above"))
        signed = mixed.where(~large).join(nodes, "node")
        x, y = signed.alias("x"), signed.alias("y")
        near = x.join(y, (F.col("x.region") == F.col("y.region")) & _possible()).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        # Later regions have cells of their own: those of one pivot would be as large again as the cell that they came from.
        cell = (F.col("region") if level else F.xxhash64("pivot")).alias("cell")
        cells = mixed.where(large & (F.col("pivot") != F.col("node"))).select(F.col("pivot").alias("a"), F.col("node").alias("b"), cell).distinct()
        cells = cells.join(cells.groupBy("cell").agg(F.count("*").alias("peers")), "cell").select("a", "b", "cell", "peers")
        level += 1
        found = distances(documents, sketch, near.select("a", "b", none.alias("cell"), none.alias("peers")).unionAll(cells), frequent)
        merged = extended(merged, found.where(LINKED).select("a", "b"))
        shifted = found.where("cell is not null")
        if shifted.isEmpty():
            break
        e = (F.col("d") * S - F.col("n") * T).alias("e")
        inside = (F.col("d") * S <= (F.col("n") + F.col("centre")) * T).alias("inside")
        members = shifted.select(F.col("b").alias("node"), "n", "d", e, inside, "peers", "shallow", F.posexplode("regions").alias("pos", "region"))
        members = members.select("region", "node", "n", (F.col("d") - F.col("pos")).alias("q"), "d", "e", "inside", (F.col("pos") >= F.col("shallow")).alias("deep"), F.col("peers").alias("above"))
    frequent.unpersist()
    return merged


def linked(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of documents(doc_id, text)."""
    return _labelled(documents).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _labelled(documents: DataFrame) -> DataFrame:
    ship(documents.sparkSession)
    sketch = sketches(documents)
    roots = links(documents, sketch)
    least = sketch.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = written(least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id"), "components")
    return sketch.drop("mins", "signs").join(named, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows of documents that carry the smallest id of their component, with their own columns; of rows that repeat it, the least hash;
    of rows equal in id and text, the one with the least other columns. Rows without words are in no group and all stay.

    Rows without an id in a component without any are one group too.
    """
    ship(documents.sparkSession)
    labelled = written(_labelled(documents), "labelled")
    first = labelled.where("node is not null").groupBy("component_id").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("keep"))
    again = labelled.where("node is not null").groupBy("row").count().where("count > 1").select("row", F.lit(True).alias("again"))
    named = first.select(F.col("keep").alias("row")).join(again, "row", "left").select(F.col("row").alias("__row"), F.coalesce("again", F.lit(False)).alias("__again"))
    kept = written(named.unionAll(labelled.where("node is null").select("row", F.lit(False))).distinct(), "kept")
    own = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    few = kept.count() <= BROADCAST_ROWS
    rows = documents.withColumn("__row", own).join(F.broadcast(kept) if few else kept, "__row")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    repeated = rows.where("__again").groupBy("__row").agg(F.min(F.struct(*columns)).alias("__least"))
    return rows.where("not __again").select(*columns).unionAll(repeated.select("__least.*"))
