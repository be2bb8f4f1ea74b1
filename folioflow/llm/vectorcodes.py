"""Vector codes: vectors cut into parts, each named by its nearest codebook entry (heap Lloyd).

Lloyd's rounds, exact in whole numbers, with one bounded number for each part: the gap
between the distance to the second nearest entry and that to its own, as of when it was
last looked at. While entries move, an entry's cumulative drift (its own moves and the
largest other move of each round) says by how much that gap may have shrunk. A block of
vectors keeps a heap for each codebook entry, keyed by the gap plus the drift at that time,
so the least key is the first to be overtaken: a round pops only parts whose key the
drift has reached, measures them against all entries, and pushes them where they belong.
All others can't have changed. A heap is kept as sorted runs, one for the parts that a
round pushed; popping all keys up to a bound takes the front of each run.

Blocks are carried from round to round in tables in the shared folder, a round's table
is deleted when the next is there. Between rounds only sums by codebook entry meet (the
changed parts' by difference), numbers that don't grow with the data; vectors are never
shuffled.

Rows whose vector is null or holds null or non-finite components are left out, and so are
vectors whose length isn't that of the smallest kept id's (the least such vector) among
those that `parts` divides. Rows that repeat are rows like any other; rows with a null id
are coded, but start no codebook. With fewer rows than entries there are fewer entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from folioflow.llm.blocks import as_exact, in_blocks, unpacked, whole_numbers
from folioflow.llm.skew import look_up
from folioflow.llm.storage import delete, write_table

PARTS, ENTRIES, ROUNDS, BLOCK = 8, 16, 6, 8192
#: More than rounding can add to a distance or a drift.
SLACK = 1e-6


class Heaps:
    """The parts of a block at one position: each one's entry, and a heap for each entry."""

    def __init__(self, n: int, code: np.ndarray | None = None, order: np.ndarray | None = None, keys: np.ndarray | None = None, runs: np.ndarray | None = None):
        self.code = np.zeros(n, np.uint8) if code is None else code
        self.order = np.zeros(0, np.int32) if order is None else order
        self.keys = np.zeros(0) if keys is None else keys
        #: entry, first, end of each sorted run
        self.runs = np.zeros((0, 3), np.int32) if runs is None else runs

    def pop(self, drift: np.ndarray) -> np.ndarray:
        """The parts whose key their entry's drift has reached, taken off."""
        out = []
        for run in self.runs:
            entry, first, end = run.tolist()
            stop = first + int(np.searchsorted(self.keys[first:end], drift[entry] + SLACK, "right"))
            out.append(self.order[first:stop])
            run[1] = stop
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def push(self, at: np.ndarray, code: np.ndarray, keys: np.ndarray) -> None:
        """Parts onto the heaps of their entries: a sorted run for each."""
        self.code[at] = code
        order = np.lexsort((keys, code))
        cuts = np.searchsorted(code[order], np.arange(257))
        base = len(self.order)
        added = [(e, base + cuts[e], base + cuts[e + 1]) for e in np.unique(code).tolist()]
        self.order, self.keys = np.concatenate((self.order, at[order].astype(np.int32))), np.concatenate((self.keys, keys[order]))
        left = [run for run in self.runs.tolist() if run[1] < run[2]]
        self.runs = np.array([*left, *added], np.int32).reshape(-1, 3)
        if len(self.order) > 2 * len(self.code):
            self._tidy()

    def _tidy(self) -> None:
        """The runs of each entry merged into one and what was popped forgotten."""
        live = np.concatenate([np.arange(a, b) for _, a, b in self.runs.tolist()] or [np.zeros(0, np.int64)]).astype(np.int64)
        at, keys = self.order[live], self.keys[live]
        self.order, self.keys, self.runs = self.order[:0], self.keys[:0], self.runs[:0]
        self.push(at, self.code[at], keys)


def distances(part: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """entries x vectors: exact squared distances of a part's numbers (a row for each dimension)."""
    most = float(max(np.abs(part).max(initial=0), np.abs(entries).max(initial=0)))
    x, c = as_exact(part, entries, bound=4 * most * most * max(1, len(part)))
    return (c * c).sum(1)[:, None] - 2 * (c @ x) + (x * x).sum(0)[None, :]


def settle(part: np.ndarray, heaps: Heaps, entries: np.ndarray, drift: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round at one position: the parts looked at, their old entries and their new ones."""
    at = np.arange(part.shape[1], dtype=np.int32) if first else heaps.pop(drift)
    was = heaps.code[at]
    if len(at):
        far = distances(part[:, at], entries)
        code = far.argmin(0)
        near = np.sqrt(far[code, np.arange(len(at))].astype(np.float64))
        far[code, np.arange(len(at))] = np.iinfo(np.int64).max
        second = np.sqrt(far.min(0).astype(np.float64)) if len(entries) > 1 else np.full(len(at), np.inf)
        heaps.push(at, code.astype(np.uint8), second - near + drift[code])
    return at, was, heaps.code[at]


def moved_sums(part: np.ndarray, at: np.ndarray, was: np.ndarray, now: np.ndarray, entries: int, first: bool) -> np.ndarray:
    """entries x (dimensions + 1): what the looked-at parts change in each entry's sums and count."""
    out = np.zeros((entries, len(part) + 1), np.int64)
    changed = np.ones(len(at), bool) if first else was != now
    rows = np.concatenate((part[:, at[changed]].T.astype(np.int64), np.ones((int(changed.sum()), 1), np.int64)), axis=1)
    np.add.at(out, now[changed], rows)
    if not first:
        np.subtract.at(out, was[changed], rows)
    return out


class Codebooks:
    """Entries (position, entry, dimension), the sums of their parts, and their cumulative drift."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        self.sums = np.zeros((*entries.shape[:2], entries.shape[2] + 1), np.int64)
        self.drift = np.zeros(entries.shape[:2])

    def move(self, change: np.ndarray) -> None:
        """Every used entry to the floored mean of its parts."""
        self.sums += change
        counts = self.sums[:, :, -1:]
        new = np.where(counts > 0, self.sums[:, :, :-1] // np.maximum(counts, 1), self.entries)
        step = np.sqrt(((new - self.entries).astype(np.float64) ** 2).sum(2))
        order = np.sort(step, axis=1)
        second = order[:, -2:-1] if step.shape[1] > 1 else np.zeros((len(step), 1))
        others = np.where(step == order[:, -1:], np.where((step == order[:, -1:]).sum(1, keepdims=True) > 1, order[:, -1:], second), order[:, -1:])
        self.drift = (self.drift + step + others) * (1 + 1e-12)
        self.entries = new

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _first_rows(vectors: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Codebooks (position, entry, dimension) of the vectors of smallest ids."""
    fit = vectors.where((F.size("v") > 0) & (F.size("v") % parts == 0) & F.col("id").isNotNull()).select("id", "v")
    least = fit.orderBy("id", "v").limit(1).collect()
    if not least:
        return None
    dim = len(least[0].v)
    rows = fit.where(F.size("v") == dim).orderBy("id", "v").limit(entries).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), parts, dim // parts).transpose(1, 0, 2)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, code, error, label_error, codebooks_sha256 of every kept row, and n_scans: how often its parts were measured after the first round.

    code has two hexadecimal digits for each part. label_error sums errors over rows of one
    label, null labels together; null where the sum is beyond 64 bits. An empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    label = F.col(f"`{label_col}`").cast("string")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole_numbers(F.col(f"`{vector_col}`"), scale).alias("v"), label.alias("carried")).where("v is not null")
    first = _first_rows(rows, parts, entries)
    if first is None:
        return spark.createDataFrame([], f"{id_col} long, code string, error long, label_error long, codebooks_sha256 string, n_scans long")
    books = Codebooks(first)
    dim = parts * first.shape[2]
    table, path = in_blocks(rows.where(F.size("v") == dim), BLOCK), None
    for k in range(rounds):
        table, new = write_table(table.mapInArrow(_round(books, k == 0), _state_schema(table)), "round")
        if path:
            delete(spark, path)
        path = new
        change = table.select(F.posexplode("change").alias("place", "x")).groupBy("place").agg(F.sum("x").alias("x")).collect()
        total = np.zeros(books.sums.size, np.int64)
        for r in change:
            total[r.place] = r.x
        books.move(total.reshape(books.sums.shape))
    coded, _ = write_table(table.mapInArrow(_coded(books, rounds == 0), _CODED), "codes")
    if path:
        delete(spark, path)
    coded = coded.withColumn("group", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    of_label = coded.groupBy("group").agg(F.expr("try_sum(error)").alias("label_error"))
    out = look_up(coded, of_label, "group", by="spread")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"), "n_scans")


_CODED = StructType([StructField("id", LongType()), StructField("label", StringType()), StructField("code", StringType()), StructField("error", LongType()), StructField("n_scans", LongType()), StructField("spread", IntegerType())])
_STATE = "codes binary, order binary, keys binary, runs binary, scans binary, change array<long>"


def _state_schema(table: DataFrame) -> StructType:
    block = [f for f in table.schema.fields if f.name in ("block", "n", "dim", "ids", "data", "carried")]
    return StructType([*block, *StructType.fromDDL(_STATE).fields])


def _loaded(batch: pa.RecordBatch, i: int, books: Codebooks, fresh: bool) -> tuple[np.ndarray, list[Heaps], np.ndarray]:
    """A block's numbers, its heaps by position, and how often each vector's parts were measured."""
    n, dim = batch.column("n")[i].as_py(), batch.column("dim")[i].as_py()
    whole = unpacked(batch.column("data")[i].as_buffer(), dim, n)
    if fresh:
        return whole, [Heaps(n) for _ in books.entries], np.zeros(n, np.int32)
    read = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind).copy()
    codes, order, keys, runs = read("codes", np.uint8).reshape(-1, n), read("order", np.int32), read("keys", np.float64), read("runs", np.int32).reshape(-1, 4)
    heaps, low = [], 0
    sizes = read("scans", np.int32)
    for p in range(len(books.entries)):
        size = int(sizes[n + p])
        heaps.append(Heaps(n, codes[p], order[low : low + size], keys[low : low + size], runs[runs[:, 0] == p][:, 1:]))
        low += size
    return whole, heaps, sizes[:n]


def _round(books: Codebooks, fresh: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                whole, heaps, scans = _loaded(batch, i, books, fresh)
                width, change = books.entries.shape[2], []
                for p, entries in enumerate(books.entries):
                    part = whole[p * width : (p + 1) * width]
                    at, was, now = settle(part, heaps[p], entries, books.drift[p], fresh)
                    change.append(moved_sums(part, at, was, now, len(entries), fresh))
                    if not fresh:
                        scans[at] += 1
                runs = np.concatenate([np.insert(h.runs, 0, p, axis=1) for p, h in enumerate(heaps)]).astype(np.int32)
                sizes = np.array([len(h.order) for h in heaps], np.int32)
                state = [np.concatenate([h.code for h in heaps]), np.concatenate([h.order for h in heaps]), np.concatenate([h.keys for h in heaps]), runs, np.concatenate((scans, sizes))]
                kept = [batch.column(c)[i : i + 1] for c in ("block", "n", "dim", "ids", "data", "carried")]
                sums = np.concatenate([c.ravel() for c in change])
                columns = [*kept, *(pa.array([x.tobytes()], pa.binary()) for x in state), pa.array([sums], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["block", "n", "dim", "ids", "data", "carried", "codes", "order", "keys", "runs", "scans", "change"])

    return run


def _coded(books: Codebooks, fresh: bool):
    """The last assignment, and what each vector's parts are away from their entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                whole, heaps, scans = _loaded(batch, i, books, fresh)
                width, error = books.entries.shape[2], 0
                for p, entries in enumerate(books.entries):
                    part = whole[p * width : (p + 1) * width]
                    at, _, _ = settle(part, heaps[p], entries, books.drift[p], fresh)
                    if not fresh:
                        scans[at] += 1
                    error = error + ((part - entries[heaps[p].code].T) ** 2).sum(0)
                text = np.stack([h.code for h in heaps], axis=1).tobytes().hex()
                size, n = 2 * len(heaps), whole.shape[1]
                codes = [text[j * size : (j + 1) * size] for j in range(n)]
                columns = [batch.column("ids")[i].values, batch.column("carried")[i].values, pa.array(codes, pa.string()), pa.array(error, pa.int64()), pa.array(scans.astype(np.int64)), pa.array(np.arange(n, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(columns, _CODED.names)

    return run
