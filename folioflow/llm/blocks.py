"""Whole-number vectors in blocks of vertical layout: a row of a block for each dimension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

#: Components saturate here, so that products of vectors stay exact in 64 bits.
LIMIT = 1 << 24
#: Sums below this are exact in 64-bit floating point, which numpy multiplies faster.
EXACT = 2.0**52


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x as a double, at most LIMIT from zero; null for a vector that is null or holds null or non-finite components."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    floors = F.transform(vector, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x.cast("double") * F.lit(float(scale))))).cast("int"))
    return F.when(finite, floors)


def in_blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of at most `rows` vectors of one length: block, n, dim, ids, data, carried.

    vectors has id (long), v (array of int) and carried (any type). data holds little-endian
    numbers of two bytes where they fit, else four. A task's blocks follow its rows, so a
    task that runs again makes the same ones, and rows of one id aren't brought together.
    """
    carried = vectors.schema["carried"].dataType
    schema = StructType([
        StructField("block", LongType()), StructField("n", IntegerType()), StructField("dim", IntegerType()),
        StructField("ids", ArrayType(LongType())), StructField("data", BinaryType()), StructField("carried", ArrayType(carried)),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, waiting = TaskContext.get().partitionId() << 40, {}, 0
        for batch in batches:
            v = batch.column("v")
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            flat, starts = v.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                whole = flat[starts[at][:, None] + np.arange(dim)].T
                held.setdefault(dim, []).append((batch.column("id").take(pa.array(at)), whole, batch.column("carried").take(pa.array(at))))
            waiting += len(batch)
            if waiting >= rows:
                for b in _packed(held, rows, False):
                    yield _batch(block, *b)
                    block += 1
                waiting = sum(x[1].shape[1] for parts in held.values() for x in parts)
                if waiting >= 4 * rows:  # many lengths: don't let them pile up
                    for b in _packed(held, rows, True):
                        yield _batch(block, *b)
                        block += 1
                    waiting = 0
        for b in _packed(held, rows, True):
            yield _batch(block, *b)
            block += 1

    return vectors.select("id", "v", "carried").mapInArrow(run, schema)


def _packed(held: dict, rows: int, all_of_it: bool) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
    """Full blocks of what is held, and with all_of_it the rest; held keeps what isn't given."""
    for dim in sorted(held):
        ids, carried = (pa.concat_arrays([x[k] for x in held[dim]]) for k in (0, 2))
        whole = np.concatenate([x[1] for x in held[dim]], axis=1)
        end = len(ids) if all_of_it else len(ids) // rows * rows
        for low in range(0, end, rows):
            high = min(end, low + rows)
            yield ids[low:high], whole[:, low:high], carried[low:high]
        held[dim] = [(ids[end:], whole[:, end:], carried[end:])]
        if end == len(ids):
            del held[dim]


def _batch(block: int, ids: pa.Array, whole: np.ndarray, carried: pa.Array) -> pa.RecordBatch:
    kind = "<i2" if not whole.size or np.abs(whole).max() < 1 << 15 else "<i4"
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    columns = [pa.array([block], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([len(whole)], pa.int32()), one(ids), pa.array([np.ascontiguousarray(whole).astype(kind).tobytes()], pa.binary()), one(carried)]
    return pa.RecordBatch.from_arrays(columns, ["block", "n", "dim", "ids", "data", "carried"])


def unpacked(data: bytes, dim: int, n: int) -> np.ndarray:
    """A block's numbers: a row for each dimension."""
    kind = "<i4" if len(data) == 4 * dim * n else "<i2"
    return np.frombuffer(data, kind).reshape(dim, n)


def as_exact(*arrays: np.ndarray, bound: float) -> list[np.ndarray]:
    """The arrays as doubles where sums up to bound are exact in them, else as 64-bit integers."""
    return [a.astype(np.float64 if bound < EXACT else np.int64) for a in arrays]
