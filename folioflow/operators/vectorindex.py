"""Nearest neighbours by cosine from a stored inverted file: vectors in folders by cell.

Centroids are fitted on a bounded sample (SAMPLE vectors, those of the least hashes of
their ids), every vector is stored in the cell of its nearest centroid. A query looks into
the cells whose centroids are nearest to it and ranks what it finds there by exact cosines.
That finds most of its nearest neighbours (`share` says how many of the cells); with exact=True a
second pass also looks into every other cell that could hold a better one: a cell's vectors
lie within its radius, an angle, around the centroid.

Cells and a few queries meet in a task for each (cell, slice): a large cell is stored and searched
in slices of about SLICE vectors, a slice is held while the queries that want it stream
by, BATCH at a time. So a crowded cell doesn't make a task large.

Of many queries, such as all vectors at once, copies for the cells would be many times the table.
These queries lie in blocks, as the stored vectors then do, and every two blocks meet in a Cartesian product,
which reads both sides' files and shuffles nothing. There a query looks at the same cells as else.
A task holds one query block, and its best so far, while stored vectors of about PART numbers pass.
The work still grows with queries times vectors; the disk with either, and a query's best stand there once for each PART. In both ways pairs aren't made as
rows: a task gives each query's best only.

Vectors that are null, of length zero or with null or non-finite components have no
direction; they aren't in the index and find nothing. Equal scores go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.sources.scratch import new_dir, ship, written

#: Vectors that centroids are fitted on at most, cells at most, vectors of a slice, queries at a time, rounds of fitting.
SAMPLE, CELLS, SLICE, BATCH, ROUNDS = 1 << 14, 1024, 1 << 14, 1024, 12
#: Queries whose cells are looked up at a time, rows that are handed on at a time, scores that are held at a time.
ASKED, COPIES, SCORES = 256, 1 << 12, 1 << 20
#: Vectors of a block at most, blocks of a file, numbers of the stored vectors that pass a query block in one task (about): half a million vectors of 64.
BLOCK, FILE, PART = 1 << 12, 8, 1 << 25
#: Digits of a score; the share of the cells that a query looks into.
DIGITS, SHARE = 6, 0.6


def _fit(vectors: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of unit vectors: each round takes the mean direction of a centroid's vectors, an idle one goes to the vector that is farthest from its own."""
    centroids = vectors[np.linspace(0, len(vectors) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        near = vectors @ centroids.T
        cell = near.argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, vectors)
        idle = np.flatnonzero(np.bincount(cell, minlength=cells) == 0)
        sums[idle] = vectors[np.argsort(near.max(1), kind="stable")[: len(idle)]]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 0, sums / np.where(size > 0, size, 1), centroids)
    return centroids


def directed(vectors: DataFrame) -> DataFrame:
    """id, vector of the vectors that have a direction, in their own precision, which is single or double."""
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    vector = F.col("vector") if _type(vectors) == "array<float>" else F.col("vector").cast("array<double>")
    return vectors.select("id", vector.alias("vector")).where(F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))


def _type(rows: DataFrame, column: str = "vector") -> str:
    return dict(rows.dtypes)[column]


def _units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of those of a batch that have dim components, and which they are."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dim)
    return _directions(column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), dim), at


def _directions(numbers: np.ndarray, dim: int) -> np.ndarray:
    rows = numbers.astype(np.float64).reshape(-1, dim)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@dataclass(frozen=True)
class VectorIndex:
    """A stored index: centroids (bounded, held here) with each cell's radius and number of slices, and the number of vectors."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    radius: np.ndarray
    slices: np.ndarray
    size: int
    id_type: str
    vector_type: str

    @classmethod
    def build(cls, spark: SparkSession, path: str, vectors: DataFrame, cells: int | None = None) -> VectorIndex:
        """Index vectors (id, vector), all of the length that most of the sample have; cells: about the square root of their number unless given."""
        ship(spark)
        vectors = directed(vectors)
        n = vectors.count()
        sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
        lengths = [len(r.vector) for r in sample]
        dim = max(sorted(set(lengths)), key=lengths.count, default=0)
        rows = [r.vector for r in sample if len(r.vector) == dim]
        rows = np.array(rows, np.float64).reshape(len(rows), dim)
        cells = min(max(1, len(rows) // 4), CELLS, cells or max(1, round(n**0.5)))
        centroids = _fit(rows / np.linalg.norm(rows, axis=1, keepdims=True), cells) if len(rows) else np.zeros((0, dim))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                units, at = _units(batch.column("vector"), dim)
                near = units @ centroids.T
                cell = near.argmax(1) if len(centroids) else np.zeros(len(at), np.int64)
                # of equal directions either side may round up to a little over 1
                closeness = np.minimum(near[np.arange(len(at)), cell], 1.0) if len(at) else np.zeros(0)
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("vector"), pa.array(closeness), pa.array(cell, pa.int32())], ["id", "vector", "closeness", "cell"])

        id_type, vector_type = _type(vectors, "id"), _type(vectors)
        schema = f"id {id_type}, vector {vector_type}, closeness double, cell int"
        placed = vectors.mapInArrow(assign, schema)
        placed.hint("rebalance", "cell").sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{path}/vectors")
        sizes = spark.read.schema(schema).parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.min("closeness").alias("least"))
        radius, slices, size = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64), 0
        for r in sizes.collect():  # a row for each cell
            radius[r.cell], slices[r.cell] = np.arccos(np.clip(r.least, -1, 1)) + 1e-7, -(-r.n // SLICE)
            size += r.n
        return cls(spark, path, centroids, radius, slices, size, id_type, vector_type)

    def nearest(self, queries: DataFrame, top: int, share: float = SHARE, exact: bool = False) -> DataFrame:
        """query_id, rank, id, score: each query's (id, vector) nearest vectors but the one of its own id, from that share of the cells, and with exact also from all others that could hold a nearer one."""
        probes = self._probes(share)
        queries = directed(queries).where(F.size("vector") == self.centroids.shape[1])
        best = self._meeting(queries, probes, top)
        first = best(queries)
        if not exact:
            return _ranked(first, top)
        first = written(first, "first")
        least = _ranked(first, top).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        bound = F.when(F.col("n") == top, F.col("least")).otherwise(F.lit(-2.0))
        queries = queries.join(least.select(F.col("query_id").alias("id"), bound.alias("least")), "id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
        return _ranked(first.unionByName(best(queries, beyond=True)), top)

    def neighbours(self, top: int, share: float = SHARE) -> DataFrame:
        """query_id, rank, id, score: the nearest vectors of every vector that is stored."""
        if len(self.centroids) < 2:  # as nearest would have it
            return self.nearest(self.vectors().select("id", "vector"), top, share)
        stored = self._stored()
        return _ranked(self._met(stored, self.vector_type, self._parts(stored, self.size), self._probes(share), top), top)

    def _probes(self, share: float) -> int:
        return max(1, math.ceil(share * len(self.centroids)))

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(f"id {self.id_type}, vector {self.vector_type}, closeness double, cell int").parquet(f"{self.path}/vectors")

    def _meeting(self, queries: DataFrame, probes: int, top: int) -> Callable[..., DataFrame]:
        """The way for such queries to meet the stored vectors: as copies for the cells if all cells' copies are no more than the stored vectors, else in blocks."""
        n = queries.count()
        if n * len(self.centroids) <= self.size:
            return lambda queries, beyond=False: self._best(self._wanted(queries, probes, beyond), top)
        stored = self._parts(self._stored(), n)

        def best(queries: DataFrame, beyond: bool = False) -> DataFrame:
            asked = _blocks(queries.select("id", "vector", (F.col("least") if beyond else F.lit(0.0)).alias("mark")))
            return self._met(asked, _type(queries), stored, probes, top, beyond)

        return best

    def _stored(self) -> DataFrame:
        return _blocks(self.vectors().select("id", "vector", F.col("cell").cast("double").alias("mark")))

    def _parts(self, stored: DataFrame, n: int) -> DataFrame:
        """Stored blocks in the parts that n queries meet: each query gives its best of each, so few queries can have more parts for the cores, many only as many as memory asks for."""
        cores = -(-2 * self.spark.sparkContext.defaultParallelism // -(-n // BLOCK))
        return stored.coalesce(max(-(-self.size * self.centroids.shape[1] // PART), min(cores, -(-self.size // BLOCK))))

    def _wanted(self, queries: DataFrame, probes: int, beyond: bool = False) -> DataFrame:
        """Queries once for each slice of each cell that they look into: the nearest ones, or of all others those that may hold a score of `least`."""
        looks, slices, dim = self._looks(probes, beyond), self.slices, self.centroids.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, len(batch), ASKED):
                    some = batch.slice(first, ASKED)
                    units, _ = _units(some.column("vector"), dim)
                    wants = looks(units, some.column("least").to_numpy(zero_copy_only=False) if beyond else None)
                    at, cell = np.nonzero(wants & (slices[None, :] > 0))
                    times = slices[cell]
                    part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    at, cell = np.repeat(at, times), np.repeat(cell, times)
                    # a query's vector stands in each row, so all rows of a batch at once would be as many copies as cells
                    for k in range(0, len(at), COPIES):
                        kept = some.take(pa.array(at[k : k + COPIES]))
                        yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("vector"), pa.array(cell[k : k + COPIES], pa.int32()), pa.array(part[k : k + COPIES], pa.int32())], ["id", "vector", "cell", "slice"])

        return queries.mapInArrow(run, f"id {_type(queries, 'id')}, vector {_type(queries)}, cell int, slice int")

    def _looks(self, probes: int, beyond: bool) -> Callable[[np.ndarray, np.ndarray | None], np.ndarray]:
        """Which cells each query looks into, of unit vectors: the nearest ones, or of all others those that may hold a score of `least`."""
        centroids, radius, used = self.centroids, self.radius, min(probes, len(self.centroids))

        def looks(units: np.ndarray, least: np.ndarray | None) -> np.ndarray:
            near = units @ centroids.T
            nearest = np.argsort(-near, axis=1, kind="stable")[:, :used]
            wants = np.zeros(near.shape, bool)
            np.put_along_axis(wants, nearest, True, axis=1)
            if beyond:
                reach = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - radius[None, :]))
                wants = ~wants & (reach >= least[:, None] - 2 * 10.0**-DIGITS)
            return wants

        return looks

    def _met(self, asked: DataFrame, vector_type: str, stored: DataFrame, probes: int, top: int, beyond: bool = False) -> DataFrame:
        """query_id, id, score: the best of each part of the stored blocks for each query of many, asked in blocks."""
        both = asked.crossJoin(stored.select(*[F.col(c).alias(f"s_{c}") for c in ("ids", "vectors", "marks")]).hint("shuffle_replicate_nl"))
        forms = {"": FORMS[vector_type], "s_": FORMS[self.vector_type]}
        looks, dim = self._looks(probes, beyond), self.centroids.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = None
            for batch in batches:
                number = batch.column("block").to_numpy()
                for k in range(len(batch)):
                    if block is None or block.number != number[k]:
                        if block is not None:
                            yield block.found()
                        block = _Asking(number[k], *_unpacked(batch, k, "", forms, dim), looks, top)
                    block.meet(*_unpacked(batch, k, "s_", forms, dim))
            if block is not None:
                yield block.found()

        id_type = _type(asked, "ids").removeprefix("array<").removesuffix(">")
        return both.mapInArrow(run, f"query_id {id_type}, id {self.id_type}, score double")

    def _best(self, wanted: DataFrame, top: int) -> DataFrame:
        """query_id, id, score: each query's best of each slice that it looks into."""
        dim, id_type = self.centroids.shape[1], _type(wanted, "id")
        slices = F.array(*[F.lit(int(s)) for s in self.slices]) if len(self.slices) else F.array(F.lit(1))
        stored = self.vectors().select("id", "vector", "cell", F.pmod(F.xxhash64("id"), F.get(slices, F.col("cell"))).cast("int").alias("slice"))
        both = stored.withColumn("kind", F.lit(0)).unionByName(wanted.withColumn("kind", F.lit(1)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, units, ids = None, [], None, None
            for batch in batches:
                cell, part, kind = (batch.column(c).to_numpy() for c in ("cell", "slice", "kind"))
                cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
                for low, high in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                    if low == high:
                        continue
                    if at != (cell[low], part[low]):
                        at, held, units = (cell[low], part[low]), [], None
                    rows = batch.slice(low, high - low)
                    if kind[low] == 0:
                        held.append(rows.select(["id", "vector"]))
                        continue
                    if units is None:  # the first query: all of the slice is here
                        found = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
                        held, ids = [], found[0].column("id") if found else None
                        units = _units(found[0].column("vector"), dim)[0] if found else np.zeros((0, dim))
                    at_once = max(1, min(BATCH, SCORES // max(1, len(units))))
                    for k in range(0, len(rows), at_once):
                        if len(units):
                            yield _best_of(rows.slice(k, at_once), ids, units, top)

        spread = both.repartition("cell", "slice").sortWithinPartitions("cell", "slice", "kind")
        return spread.mapInArrow(run, f"query_id {id_type}, id {id_type}, score double")


def _best_of(queries: pa.RecordBatch, ids: pa.Array, units: np.ndarray, top: int) -> pa.RecordBatch:
    """The best of a slice for each query: by rounded score, then by id."""
    own, _ = _units(queries.column("vector"), units.shape[1])
    names = pa.concat_arrays([ids, queries.column("id")])
    order = np.unique(names.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    order, asked = order[: len(ids)], order[len(ids) :]
    score = np.round(own @ units.T, DIGITS) + 0.0
    score[asked[:, None] == order[None, :]] = -3.0
    if len(units) > top:  # all that reach the k-th best, and of them the first by id
        least = np.partition(score, len(units) - top, axis=1)[:, len(units) - top]
    else:
        least = np.full(len(own), -2.0)
    q, c = np.nonzero((score >= least[:, None]) & (score > -3.0))
    by = np.lexsort((order[c], -score[q, c], q))
    q, c = q[by], c[by]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < top
    q, c = q[keep], c[keep]
    return pa.RecordBatch.from_arrays([queries.column("id").take(pa.array(q)), ids.take(pa.array(c)), pa.array(score[q, c])], ["query_id", "id", "score"])


#: How a vector's numbers lie in a block's bytes.
FORMS = {"array<float>": "<f4", "array<double>": "<f8"}


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (id, vector, mark) as stored blocks: a number, ids, and vectors and marks as bytes."""
    form = FORMS[_type(rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while len(batch):
                held.append(batch.slice(0, BLOCK - n))
                n += len(held[-1])
                batch = batch.slice(len(held[-1]))
                if n == BLOCK:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        all_ = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        vectors, marks = (x.to_numpy(zero_copy_only=False) for x in (all_.column("vector").flatten(), all_.column("mark")))
        ids = pa.ListArray.from_arrays(pa.array([0, len(all_)], pa.int32()), all_.column("id"))
        data = [pa.array([x.astype(f).tobytes()], pa.binary()) for x, f in ((vectors, form), (marks, "<f8"))]
        return pa.RecordBatch.from_arrays([ids, *data], ["ids", "vectors", "marks"])

    session = rows.sparkSession
    path = f"{new_dir(session)}/blocks"
    blocks = rows.mapInArrow(run, f"ids array<{_type(rows, 'id')}>, vectors binary, marks binary").withColumn("block", F.monotonically_increasing_id())
    blocks.write.option("maxRecordsPerFile", FILE).parquet(path)
    return session.read.schema(blocks.schema).parquet(path)


def _unpacked(batch: pa.RecordBatch, row: int, prefix: str, forms: dict[str, str], dim: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, unit vectors and marks of a block."""
    vectors, marks = (np.frombuffer(batch.column(prefix + c)[row].as_buffer(), f) for c, f in (("vectors", forms[prefix]), ("marks", "<f8")))
    return batch.column(f"{prefix}ids")[row].values, _directions(vectors, dim), marks


class _Asking:
    """A block of queries and the best of what it has met."""

    def __init__(self, number: int, ids: pa.Array, units: np.ndarray, least: np.ndarray, looks: Callable, top: int):
        self.number, self.queries, self.units, self.top = number, ids, units, top
        self.own = ids.to_numpy(zero_copy_only=False)
        wants = [looks(units[k : k + ASKED], least[k : k + ASKED]) for k in range(0, len(units), ASKED)]
        self.wants = np.ascontiguousarray(np.concatenate(wants).T)
        self.score = np.full((len(units), top), -3.0)
        self.ids = None

    def meet(self, ids: pa.Array, units: np.ndarray, cells: np.ndarray) -> None:
        """Look at a stored block, in runs of a cell."""
        self.id_type, names = ids.type, ids.to_numpy(zero_copy_only=False)
        if self.ids is None:
            self.ids = np.zeros(self.score.shape, names.dtype)
        cuts = np.flatnonzero(cells[1:] != cells[:-1]) + 1
        for low, high in zip([0, *cuts], [*cuts, len(cells)], strict=True):
            asking = np.flatnonzero(self.wants[int(cells[low])])
            at_once = max(1, SCORES // (high - low))
            for k in range(0, len(asking), at_once):
                self._meet(asking[k : k + at_once], names[low:high], units[low:high])

    def _meet(self, asking: np.ndarray, names: np.ndarray, units: np.ndarray) -> None:
        score = self.units[asking] @ units.T
        least = self.score[asking, -1]
        new = np.flatnonzero(least == -3.0)
        if len(new) and len(units) > self.top:  # without a full list yet, at most what reaches this run's k-th best
            some = score[new]
            some[self.own[asking[new]][:, None] == names[None, :]] = -3.0
            least[new] = np.partition(some, len(units) - self.top, axis=1)[:, len(units) - self.top]
        q, c = np.divmod(np.flatnonzero(score >= least[:, None] - 10.0**-DIGITS), len(units))
        rounded = np.round(score[q, c], DIGITS) + 0.0
        q = asking[q]
        other = self.own[q] != names[c]
        if other.any():
            self._keep(q[other], names[c[other]], rounded[other])

    def _keep(self, q: np.ndarray, names: np.ndarray, score: np.ndarray) -> None:
        """Put these among their queries' best: by rounded score, then by id."""
        rows = np.unique(q)
        i, j = np.nonzero(self.score[rows] > -3.0)
        q, names, score = (np.concatenate(x) for x in ((rows[i], q), (self.ids[rows[i], j], names), (self.score[rows[i], j], score)))
        by = np.lexsort((np.unique(names, return_inverse=True)[1], -score, q))
        q, names, score = q[by], names[by], score[by]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.top
        self.ids[q[kept], place[kept]], self.score[q[kept], place[kept]] = names[kept], score[kept]

    def found(self) -> pa.RecordBatch:
        q, j = np.nonzero(self.score > -3.0)
        return pa.RecordBatch.from_arrays([self.queries.take(pa.array(q)), pa.array(self.ids[q, j], self.id_type), pa.array(self.score[q, j])], ["query_id", "id", "score"])


def _ranked(found: DataFrame, top: int) -> DataFrame:
    place: Column = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place.cast("long")).where(F.col("rank") <= top).select("query_id", "rank", "id", "score")
