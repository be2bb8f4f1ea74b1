"""Tables written in the folder that all executors share, maps over texts, and memory that is given back."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from folioflow.sources.scratch import delete, ship, shared_dir, sweep, write_table, written  # noqa: F401  for this subpackage


def give_back() -> None:
    """Return to the system what this process has freed; its allocators would keep it as long as it lives."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not on every system
        ctypes.CDLL(None).malloc_trim(0)


def freeing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map over batches that gives back at its end what it has freed, as workers live on for the stages that follow."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def map_texts(docs: DataFrame, fn: Callable[[], Callable], fields: str, id_col: str, text_col: str, keep: bool = False) -> DataFrame:
    """Columns that a map over whole texts adds.

    fn() is called once a task and returns what turns an Arrow text column into one
    array for each of the fields. Returns the id and the fields, or with keep all
    columns of docs and the fields, where a field replaces a column of its name.
    """
    added = StructType.fromDDL(fields)
    rest = [c for c in docs.columns if keep and c not in (id_col, text_col)]
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []))
    carried = ["id", *(["text"] if keep else []), *(["rest"] if rest else [])]
    names = [f"new_{i}" for i in range(len(added))]
    schema = StructType([given.schema[c] for c in carried] + [StructField(n, f.dataType) for n, f in zip(names, added, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = fn()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *of(batch.column("text"))], [*carried, *names])

    out = given.mapInArrow(freeing(run), schema)
    shown = {id_col: F.col("id")} | ({text_col: F.col("text")} if keep else {}) | {c: F.col(f"rest.`{c}`") for c in rest}
    shown = {c: shown[c] for c in docs.columns if c in shown} | {f.name: F.col(n) for n, f in zip(names, added, strict=True)}
    return out.select(*[v.alias(k) for k, v in shown.items()])
