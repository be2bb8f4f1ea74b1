"""Exact top-k search by inner product: columnar branch-and-bound.

Vectors of whole numbers lie in blocks of vertical layout, a row for each dimension.
A task holds one part of the candidates and lets the query blocks stream past. For a
query block it adds up the products of the dimensions with most mass for a chunk of
candidates at once; then STEP dimensions at a time for those pairs only whose sum so far
and the product of both sides' remaining norms (which no rest of an inner product can
exceed) still reach the query's k-th best score. The pairs are compacted after every
step. Nothing is approximate: a pair is dropped only if it can't be among the k best.

Candidates are shuffled once, a query block goes to every part; neither side is broadcast
or collected. Parts are made of blocks, not of ids, so a row that repeats very often is
spread like any other.

Vectors that are null or hold null or non-finite components and rows without an id take
no part. Vectors of different lengths don't meet; empty vectors score 0 with each other.
Rows that repeat an id count once as candidates, with their highest score; a query that
does asks with its smallest vector. A query's own id isn't its candidate. No rows, no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.blocks import as_exact, in_blocks, unpacked, whole_numbers
from folioflow.llm.storage import written

#: Vectors of a stored block, of a query block, of a chunk, and of a part at most (about).
BLOCK, QUERIES, CHUNK, PART = 4096, 256, 4096, 1 << 18
#: Candidates that are scored in full before there is a bound.
FIRST = 256
#: Dimensions between two looks at the bounds.
STEP = 8


def search(vectors: DataFrame, asking: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row that `asking` is true of, ties to the smaller id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole_numbers(F.col(f"`{vector_col}`"), scale).alias("v"), F.coalesce(asking, F.lit(False)).alias("asks"))
    rows = rows.where("id is not null and v is not null")
    stored = written(in_blocks(rows.select("id", "v", F.lit(0).alias("carried")), BLOCK).drop("carried"), "candidates")
    n = stored.agg(F.sum("n")).first()[0] or 0
    parts = max(1, math.ceil(n / PART), min(math.ceil(n / BLOCK), 2 * spark.sparkContext.defaultParallelism))
    queries = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"), F.lit(1).alias("carried"))
    asked = in_blocks(queries, QUERIES).drop("carried").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = stored.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")).withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)))
    found = dealt.repartition(parts, "part").sortWithinPartitions("part", "kind", "block").mapInArrow(_searcher(k), "query_id long, vec_id long, score long")
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks, part = None, {}, {}
        for batch in batches:
            places, kinds, dims, sizes = (batch.column(c).to_numpy() for c in ("part", "kind", "dim", "n"))
            for i in range(len(batch)):
                if places[i] != at:
                    at, blocks, part = places[i], {}, {}
                dim = int(dims[i])
                ids = batch.column("ids")[i].values.to_numpy(zero_copy_only=False)
                whole = unpacked(batch.column("data")[i].as_buffer(), dim, int(sizes[i]))
                if kinds[i] == 0:
                    blocks.setdefault(dim, []).append((ids.copy(), whole.copy()))
                    continue
                if dim in blocks:  # the first query block: all of the part's candidates are here
                    part[dim] = Part(*zip(*blocks.pop(dim), strict=True))
                if dim in part:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in part[dim].best(ids, whole, k)], ["query_id", "vec_id", "score"])

    return run


class Part:
    """Candidates of one length, dimensions by falling mass, with their norms from each step on."""

    def __init__(self, ids: tuple[np.ndarray, ...], wholes: tuple[np.ndarray, ...]):
        self.ids, columns = np.concatenate(ids), np.concatenate(wholes, axis=1)
        mass = np.array([np.dot(c := row.astype(np.float64), c) for row in columns])
        self.order = np.argsort(-mass, kind="stable")
        self.columns = columns[self.order]
        self.steps = [*range(0, len(columns), STEP), len(columns)]
        self.rest = self._rest(self.columns)

    def _rest(self, columns: np.ndarray) -> np.ndarray:
        """steps x vectors: the norm of what follows each step, none too small."""
        left = np.zeros((len(self.steps), columns.shape[1]))
        for s in range(len(self.steps) - 2, -1, -1):
            block = columns[self.steps[s] : self.steps[s + 1]].astype(np.float64)
            left[s] = left[s + 1] + np.einsum("ij,ij->j", block, block)
        return np.sqrt(left) * (1 + 1e-12)

    def best(self, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, candidate ids and scores: each query's k best in this part. looked_at says how often a pair was taken a step further."""
        queries = queries[self.order]
        rest = self._rest(queries)
        bound = rest[0].max(initial=0) * self.rest[0].max(initial=0)
        top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        least, self.looked_at = np.full(len(ids), -np.inf), 0
        low = 0
        while low < len(self.ids):
            high = min(len(self.ids), low + (CHUNK if low else FIRST))
            q, c, score = self._survivors(ids, queries, rest, least, low, high, bound)
            top = _merged(top, (q, self.ids[low:high][c], score.astype(np.int64)), k)
            full = np.bincount(top[0], minlength=len(ids)) == k
            ends = np.searchsorted(top[0], np.arange(len(ids)), "right") - 1
            least[full] = top[2][ends[full]]
            low = high
        return ids[top[0]], top[1], top[2]

    def _survivors(self, ids, queries, rest, least, low: int, high: int, bound: float):
        """Pairs of a chunk that reach their query's bound, with full scores."""
        own = self.ids[low:high]
        a, b = as_exact(queries, self.columns[:, low:high], bound=bound)
        half = max(1, (len(self.steps) - 1) // 2) if len(a) else 0
        at = self.steps[half] if len(a) else 0
        head = a[:at].T @ b[:at]
        slack = 0.5 + 1e-9 * bound if bound >= 2.0**52 else 0.5
        ahead = self.rest[half if len(a) else -1, low:high]
        q, c = np.nonzero(head + rest[half if len(a) else -1][:, None] * ahead + slack >= least[:, None])
        keep = ids[q] != own[c]
        q, c = q[keep], c[keep]
        score = head[q, c]
        for s in range(half, len(self.steps) - 1):
            d = slice(self.steps[s], self.steps[s + 1])
            self.looked_at += len(q)
            score = score + np.einsum("ij,ij->j", a[d][:, q], b[d][:, c])
            keep = score + rest[s + 1][q] * self.rest[s + 1, low:high][c] + slack >= least[q]
            q, c, score = q[keep], c[keep], score[keep]
        return q, c, score


def _merged(top: tuple, more: tuple, k: int) -> tuple:
    """The k best of both by query, score and smaller id, an id once."""
    q, c, score = (np.concatenate(x) for x in zip(top, more, strict=True))
    order = np.lexsort((-score, c, q))
    q, c, score = q[order], c[order], score[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
    q, c, score = q[new], c[new], score[new]
    order = np.lexsort((c, -score, q))
    q, c, score = q[order], c[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], c[keep], score[keep]
