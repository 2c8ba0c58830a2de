"""Exact top-k search with block-at-a-time pruning.

Vectors are quantised to integers and stay where they are stored; a block is a
range of ids among the rows that a task reads together.  For each term
(dimension) a block keeps its largest and smallest weight; their sum over a
query's terms bounds every score in the block.  A query visits the blocks from
the highest bound down, scores a block through its forward index (the vectors
themselves), and stops when the next bound falls below its k-th best score.
That score comes from all that the task has read so far, and at first from a
bounded sample of the rows, which every task is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from goldweave.llm.common import in_arrow, table

SCALE = 1024.0
#: Queries that meet a block at once: bounds a task's score matrix.
TILE = 2048


def quantised(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``v``, floor(1024 * x) of each component; without rows that are null or hold a null, NaN or infinite component, or have no id."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def matrices(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, matrix) for each length of vector in an Arrow batch."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, starts = vectors.flatten().to_numpy(), vectors.offsets.to_numpy()[:-1] - vectors.offsets[0].as_py()
    every = ids.to_numpy()
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, every[rows], flat[starts[rows][:, None] + np.arange(size)]


def narrow(matrix: np.ndarray) -> np.ndarray:
    """The same integers in the least of 16, 32 and 64 bits that holds them."""
    for kind in (np.int16, np.int32):
        if not matrix.size or np.iinfo(kind).min <= matrix.min() and matrix.max() <= np.iinfo(kind).max:
            return matrix.astype(kind)
    return matrix


def kind_for(a: np.ndarray, b: np.ndarray) -> type:
    """A type in which inner products of rows of ``a`` and ``b`` are exact: float64 holds integers below 2**53."""
    most = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))), 1)
    largest = most(a) * most(b) * max(1, a.shape[1])
    return np.float64 if largest < 1 << 52 else np.int64 if largest < 1 << 62 else object


@dataclass
class Best:
    """The k best (score, id) of each query so far, best first; a free place has the lowest score and the highest id."""

    score: np.ndarray
    vec: np.ndarray

    @classmethod
    def none(cls, queries: int, k: int) -> Best:
        return cls(np.full((queries, k), np.iinfo(np.int64).min, dtype=np.int64), np.full((queries, k), np.iinfo(np.int64).max, dtype=np.int64))

    def take(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray, least: np.ndarray) -> None:
        """Merge the ``scores`` of ``rows`` (queries) by ``ids``; a query's ``own`` id doesn't count, nor scores below ``least``."""
        k = self.score.shape[1]
        scores = scores.astype(np.int64)
        floor = np.maximum(self.score[rows, -1], least[rows])
        good = (scores >= floor[:, None]) & (ids[None, :] != own[rows, None])
        crowded = np.flatnonzero(good.sum(axis=1) > 4 * k)
        if len(crowded):  # of many, those below the block's own k-th best can't stay
            inside = np.where(good[crowded], scores[crowded], np.iinfo(np.int64).min)
            kth = np.partition(inside, inside.shape[1] - k, axis=1)[:, inside.shape[1] - k]
            good[crowded] &= scores[crowded] >= kth[:, None]
        q, v = np.nonzero(good)
        if not len(q):
            return
        touched = np.unique(q)
        place = np.searchsorted(touched, q)
        old_s, old_v = self.score[rows[touched]], self.vec[rows[touched]]
        every_q = np.concatenate((place, np.repeat(np.arange(len(touched)), k)))
        every_s = np.concatenate((scores[q, v], old_s.ravel()))
        every_v = np.concatenate((ids[v], old_v.ravel()))
        # ~s, not -s: the lowest integer has no negative
        order = np.lexsort((every_v, ~every_s, every_q))
        starts = np.searchsorted(every_q[order], np.arange(len(touched)))
        top = order[starts[:, None] + np.arange(k)]
        self.score[rows[touched]], self.vec[rows[touched]] = every_s[top], every_v[top]


def search_blocks(own: np.ndarray, queries: np.ndarray, least: np.ndarray, best: Best, ids: np.ndarray, vectors: np.ndarray, block: int) -> tuple[int, int]:
    """Merge the rows (``ids``, ``vectors``) into ``best``, block by block; (blocks scored, blocks met) over all queries."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    starts = np.arange(0, len(ids), block)
    top, low = np.maximum.reduceat(vectors, starts, axis=0), np.minimum.reduceat(vectors, starts, axis=0)
    kind = kind_for(queries, vectors)
    vectors, top, low = (a.astype(kind) for a in (vectors, top, low))
    scored = 0
    for a in range(0, len(queries), TILE):
        tile = queries[a : a + TILE].astype(kind)
        zero = 0 if kind is object else kind(0)
        bounds = np.maximum(tile, zero).dot(top.T) + np.minimum(tile, zero).dot(low.T)
        ranks = np.argsort(-bounds, axis=1, kind="stable")
        live = np.arange(len(tile))
        for r in range(len(starts)):
            at = ranks[live, r]
            # an equal bound may still bring a smaller id
            on = bounds[live, at] >= np.maximum(best.score[a + live, -1], least[a + live])
            live, at = live[on], at[on]
            if not len(live):
                break
            scored += len(live)
            by = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.diff(at[by])) + 1
            for group in np.split(by, cuts):
                b, rows = at[group[0]], live[group]
                part = slice(starts[b], starts[b] + block)
                best.take(a + rows, tile[rows].dot(vectors[part].T), ids[part], own, least)
    return scored, len(queries) * len(starts)


def _lower_bounds(own: np.ndarray, queries: np.ndarray, sample: tuple[np.ndarray, np.ndarray], k: int, block: int) -> np.ndarray:
    """A score that each query's k-th best row reaches at least: its k-th best in the sample."""
    lowest = np.full(len(queries), np.iinfo(np.int64).min, dtype=np.int64)
    if not len(sample[0]):
        return lowest
    best = Best.none(len(queries), k)
    search_blocks(own, queries, lowest, best, *sample, block)
    return best.score[:, -1]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 256, slice_bytes: int = 16 << 20, sample_rows: int = 16_384) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's ``k`` best rows of ``vectors``.

    Both inputs hold ``vec_id`` and an integer array ``v``; vectors of another
    length than the query's don't meet it.  The vectors are never exchanged:
    the stated queries go to them in slices of ``slice_bytes`` at most, one
    pass over the vectors for each, and a task sends on k rows of a query at
    most.  ``sample_rows`` rows at most only set the score at which a task may begin to
    skip blocks; every row is met.  Repeated rows are candidates of their own;
    a repeated query is asked once, and different vectors of one id are
    different queries.  Queries without any candidate have no row.
    """
    spark = vectors.sparkSession
    queries = queries.select("vec_id", "v").dropDuplicates(["vec_id", "v"])
    stats = queries.agg(F.count("*").alias("n"), F.sum(F.size("v") * 8 + 16).alias("bytes")).first()
    slices = max(1, -(-(stats["bytes"] or 0) // slice_bytes))
    schema = "query_id long, asked long, vec_id long, score long"
    # as many rows as slice_bytes hold, if those are fewer
    sample = vectors.limit(min(sample_rows, slice_bytes * stats["n"] // stats["bytes"])).toArrow() if stats["n"] else None
    found = None
    for part in range(slices):
        # a hash of id and vector splits evenly, so a slice stays near slice_bytes
        held = queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(slices)) == part).toArrow().combine_chunks()
        asked = []  # (own ids, numbers, matrix, lower bounds) for each length of vector
        for batch in held.to_batches():
            for rows, ids, matrix in matrices(batch.column("vec_id"), batch.column("v")):
                few = [m for b in sample.combine_chunks().to_batches() for m in matrices(b.column("vec_id"), b.column("v")) if m[2].shape[1] == matrix.shape[1]]
                few = (np.concatenate([m[1] for m in few]), np.concatenate([m[2] for m in few])) if few else (np.zeros(0, dtype=np.int64), matrix[:0])
                asked.append((ids, rows.astype(np.int64) * slices + part, narrow(matrix), _lower_bounds(ids, matrix, few, k, block)))
        shared = spark.sparkContext.broadcast(asked)  # slice_bytes at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            best = [Best.none(len(x[0]), k) for x in asked]
            for b in batches:
                for _, ids, matrix in matrices(b.column("vec_id"), b.column("v")):
                    for (own, _, wanted, least), found in zip(asked, best, strict=True):
                        if wanted.shape[1] == matrix.shape[1]:
                            search_blocks(own, wanted, least, found, ids, matrix, block)
            for (own, number, _, _), found in zip(asked, best, strict=True):
                q, place = np.nonzero(found.vec != np.iinfo(np.int64).max)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own[q], number[q], found.vec[q, place], found.score[q, place])], names=["query_id", "asked", "vec_id", "score"])

        one = in_arrow(vectors.select("vec_id", "v"), run, schema)
        found = one if found is None else found.unionByName(one)
    best = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows of ``embeddings`` for every row whose id is divisible by 100."""
    rows = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0))
