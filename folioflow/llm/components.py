"""Connected components of links by forests that tasks make of their own links, in tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from folioflow.llm.storage import freeing, written

#: Links that a task holds beside those of its forest before it makes one of both.
HELD = 1 << 20


def roots(high: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the numbers 0 to n - 1 that each is connected with by links (high, low)."""
    root = np.arange(n)
    while True:
        a, b = root[high], root[low]
        on = a != b
        if not on.any():
            return root
        a, b = a[on], b[on]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up


def _forests(links: DataFrame) -> DataFrame:
    """id, low, foreign: for each partition's links (id, low) a link of each of its ids with the smallest connected there.

    foreign is true of ids that the partition had on the low side only. A partition holds
    its forest and at most HELD links beside it, twice the forest where that is more.
    """
    kind = links.schema["id"].dataType.simpleString()

    def forest(held: list[tuple[pa.Array, pa.Array, np.ndarray]]) -> tuple[pa.Array, pa.Array, np.ndarray]:
        high, low = (pa.concat_arrays([x[k] for x in held]) for k in (0, 1))
        own = np.concatenate([x[2] for x in held])
        ids = pa.concat_arrays([high, low]).unique()
        ids = ids.take(pc.sort_indices(ids))
        places = [pc.index_in(x, ids).to_numpy() for x in (high, low)]
        root, keyed = roots(*places, len(ids)), np.zeros(len(ids), bool)
        keyed[places[0][own]] = True
        at = np.flatnonzero(root != np.arange(len(ids)))
        return ids.take(pa.array(at)), ids.take(pa.array(root[at])), keyed[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, bound = [], 0, HELD
        for batch in batches:
            held.append((batch.column("id"), batch.column("low"), np.ones(len(batch), bool)))
            waiting += len(batch)
            if waiting > bound:
                held = [forest(held)]
                waiting = len(held[0][0])
                bound = max(HELD, 2 * waiting) + waiting
        if waiting:
            high, low, keyed = forest(held)
            yield pa.RecordBatch.from_arrays([high, low, pa.array(~keyed)], ["id", "low", "foreign"])

    return links.select("id", "low").mapInArrow(freeing(run), f"id {kind}, low {kind}, foreign boolean")


def _dealt(links: DataFrame, seen: Observation) -> DataFrame:
    """The forests of links dealt by id, written. Links of one id are first reduced to one a task, so none is hot."""
    rows = _forests(_forests(links).repartition("id"))
    return written(rows.observe(seen, F.max("foreign").alias("foreign")), "forests")


def components(links: DataFrame) -> DataFrame:
    """id, component: the smallest id that each id of links (id, other) is connected with.

    A link points from an id to a smaller one. Each round deals the links by id, makes
    forests of every task's links and points each id at what the smaller one points at,
    so that long chains halve. Ends when no smaller id points anywhere and every id was
    in one task; no links, no rows.
    """
    links = links.where("id <> other").select(F.greatest("id", "other").alias("id"), F.least("id", "other").alias("low"))
    seen = Observation()
    forests = _dealt(links, seen)
    while True:
        foreign, seen, moved = seen.get.get("foreign"), Observation(), Observation()
        above = forests.where("not foreign").select(F.col("id").alias("low"), F.col("low").alias("above"))
        met = forests.join(above.hint("merge"), "low", "left").observe(moved, F.max(F.col("above").isNotNull()).alias("moved"))
        forests = _dealt(met.select("id", F.coalesce("above", "low").alias("low")), seen)
        if not foreign and not moved.get.get("moved"):
            # every low end is the smallest of its component, and linked with itself
            ends = forests.select(F.col("low").alias("id"), F.col("low").alias("component")).distinct()
            return written(forests.select("id", F.col("low").alias("component")).unionByName(ends), "components")
