"""Exact vector search: vectors and queries are dealt into blocks, and every block of one meets every block of the other in a task.

Neither table passes through the driver, and a task holds one block of each. A task keeps k neighbours a query; those of all blocks
are merged in two steps, so no task gathers more than a share of the blocks' answers to a query.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTOR_BLOCK, QUERY_BLOCK, SHARES = 1 << 16, 1 << 14, 64


def _matrix(table: pa.Table, key: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column(key).to_numpy()
    return ids, table.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """query, rank, id, distance: exact L2 top k of vectors (id, embedding) for each of queries (id, embedding); ties to the smaller id.

    A vector is no neighbour of the query of its own id; a query has fewer rows where there are fewer others. Rows without an id or embedding are left out.
    """
    vectors, queries = (df.select(F.col("id").cast("long").alias("id"), "embedding").where("id is not null and embedding is not null") for df in (vectors, queries))
    blocks, parts = (max(1, -(-df.count() // size)) for df, size in ((vectors, VECTOR_BLOCK), (queries, QUERY_BLOCK)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    v = vectors.select("id", "embedding", dealt(blocks).alias("block"), each(parts).alias("part"))
    # Names of their own: both tables may stem from the same rows.
    q = queries.select(F.col("id").alias("query"), F.col("embedding").alias("wanted"), dealt(parts).alias("q_part"), each(blocks).alias("q_block"))

    def search(asked: pa.Table, known: pa.Table) -> pa.Table:
        best_d, best_i, ids = np.zeros((0, k)), np.zeros((0, k), np.int64), np.zeros(0, np.int64)
        if asked.num_rows and known.num_rows:
            (ids, own), (others, x) = _matrix(asked, "query", "wanted"), _matrix(known, "id", "embedding")
            best_d, best_i = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for a in range(0, len(others), 256):
                for c in range(0, len(ids), 64):
                    some = slice(c, c + 64)
                    d = ((own[some, None] - x[None, a : a + 256]) ** 2).sum(axis=2)
                    d[ids[some, None] == others[None, a : a + 256]] = np.inf
                    d, i = np.concatenate([best_d[some], d], axis=1), np.concatenate([best_i[some], np.broadcast_to(others[a : a + 256], d.shape)], axis=1)
                    order = np.lexsort((i, d), axis=1)[:, :k]
                    best_d[some], best_i[some] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        keep = np.isfinite(best_d)
        return pa.table({"query": np.repeat(ids, k)[keep.ravel()], "id": best_i[keep], "d": best_d[keep]})

    found = q.groupBy("q_block", "q_part").cogroup(v.groupBy("block", "part")).applyInArrow(search, "query long, id long, d double")
    top = lambda df, *by: df.groupBy("query", *by).agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, k).alias("top"))
    if blocks > SHARES:
        found = top(found.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(SHARES))), "share").select("query", F.explode("top").alias("t")).select("query", "t.*")
    return top(found).select("query", F.posexplode("top").alias("rank", "t")).select("query", (F.col("rank") + 1).alias("rank"), "t.id", F.col("t.d").alias("distance"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
