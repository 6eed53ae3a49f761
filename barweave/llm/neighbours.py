"""Exact nearest neighbours by a block matrix join: int8 product tiles with error bounds, float64 recomputation
of the pairs that survive, heaps to merge tiles."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranges

#: Rows of a tile's sides.
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
#: Queries of a tile that are multiplied at once.
STRIP = 256


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers of int8 range, scale, norm of what quantising lost, norm of what it kept."""
    top = np.abs(x).max(axis=1)
    scale = np.where(top > 0, top / 127.0, 1.0)
    whole = np.rint(x / scale[:, None])
    kept = whole * scale[:, None]
    return whole, scale, np.linalg.norm(x - kept, axis=1), np.linalg.norm(kept, axis=1)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dim)


def _tile(k: int):
    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            dim = len(left.column("vector")[0])
            q_ids, c_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
            queries, rows = _matrix(left.column("vector"), dim), _matrix(right.column("vector"), dim)
            vectors, of = np.unique(rows, axis=0, return_inverse=True)
            order = np.lexsort((c_ids, of.ravel()))
            of, c_ids = of.ravel()[order], c_ids[order]
            fresh = np.concatenate([[True], (of[1:] != of[:-1]) | (c_ids[1:] != c_ids[:-1])])  # a repeated row counts once
            of, c_ids = of[fresh], c_ids[fresh]
            place = np.arange(len(of)) - np.maximum.accumulate(np.where(np.concatenate([[True], of[1:] != of[:-1]]), np.arange(len(of)), 0))
            of, c_ids = of[place <= k], c_ids[place <= k]  # of equal vectors the k + 1 smallest ids suffice, the query's own among them
            first = np.searchsorted(of, np.arange(len(vectors) + 1))
            exact = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # sums of int8 products stay whole
            c_int, c_scale, c_lost, _ = _quantised(vectors)
            c_norm, c_int = np.linalg.norm(vectors, axis=1), c_int.T.astype(exact)
            copies = np.diff(first)
            for at in range(0, len(queries), STRIP):
                some = queries[at : at + STRIP]
                q_int, q_scale, q_lost, q_kept = _quantised(some)
                near = (q_int.astype(exact) @ c_int).astype(np.float64) * q_scale[:, None] * c_scale
                room = (q_lost[:, None] * c_norm + q_kept[:, None] * c_lost) * (1 + 1e-9) + 1e-12 * np.linalg.norm(some, axis=1)[:, None] * c_norm
                for i, query in enumerate(some):
                    low, high = near[i] - room[i], near[i] + room[i]
                    if len(low) > k + 1:  # k + 1 distinct vectors hold k candidates besides the query's own
                        least = np.partition(low, len(low) - k - 1)[len(low) - k - 1]
                        hit = np.flatnonzero(high >= least)
                    else:
                        hit = np.arange(len(low))
                    scores = (vectors[hit] * query).sum(axis=1)
                    which = np.repeat(np.arange(len(hit)), copies[hit])
                    ids = np.concatenate([c_ids[first[h] : first[h + 1]] for h in hit.tolist()])
                    own = ids != q_ids[at + i]
                    ids, found = ids[own], scores[which][own]
                    best = np.lexsort((ids, -found))[:k]
                    out_q.append(np.full(len(best), q_ids[at + i]))
                    out_v.append(ids[best])
                    out_s.append(found[best])
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
        return pa.table({"query_id": cat(out_q, "<i8"), "vec_id": cat(out_v, "<i8"), "score": cat(out_s, "<f8")})

    return one


def _merge(k: int):
    """For mapInArrow over rows sorted by query: a heap of the k nearest per query."""

    def run(batches: Iterator) -> Iterator:
        now, heap, done = None, [], []

        def close() -> None:
            best = sorted(set(heap), key=lambda x: (-x[0], -x[1]))
            done.extend((now, r, -v, s) for r, (s, v) in enumerate(best, 1))

        for batch in batches:
            for q, v, s in zip(*(c.to_pylist() for c in batch.columns)):
                if q != now:
                    if heap:
                        close()
                    now, heap = q, []
                item = (s, -v)  # the least comes out first: lowest score, then largest id
                if len(heap) < k:
                    if item not in heap:
                        heapq.heappush(heap, item)
                elif item > heap[0] and item not in heap:
                    heapq.heapreplace(heap, item)
            if len(done) > 10_000:
                yield _batch(done)
                done.clear()
        if heap:
            close()
        if done:
            yield _batch(done)

    return run


def _batch(done: list) -> pa.RecordBatch:
    q, r, v, s = zip(*done)
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r, pa.int32()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "rank", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each query row the ``k`` rows of ``vectors`` with the largest inner product.

    The score is the double-precision inner product of the original vectors; ties go to the smaller id; a row
    of the query's own id is no candidate. Null ids and unusable vectors (null, zero, null or non-finite
    components) take no part; vectors of another length are no candidates. A repeated row counts once; equal
    vectors under different ids all count. Empty tables give an empty result, other columns are ignored.
    """

    def side(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
        df = df.where(F.col("id").isNotNull() & usable(F.col("vector")))
        return df.select("id", F.transform("vector", lambda x: x.cast("double")).alias("vector"), F.size("vector").alias("dim"))

    cands, asked = side(vectors), side(queries)
    n_c, n_q = (max(1, -(-vectors.count() // CANDIDATE_BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK)))
    to_blocks = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = to_blocks(asked, "q", n_q, "c", n_c), to_blocks(cands, "c", n_c, "q", n_q)
    key = ["dim", "q", "c"]
    tiles = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_tile(k), "query_id long, vec_id long, score double")
    found = tiles.repartition(ranges(vectors.sparkSession), "query_id").sortWithinPartitions("query_id")
    return found.mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")
