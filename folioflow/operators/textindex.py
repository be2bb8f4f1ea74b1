"""Keyword search by a stored index of positional trigrams.

A text's trigrams are three neighbouring code points (A-Z folded) and the places at which
they stand. Texts are taken in blocks of about BLOCK code points, one after another, and a
row has a trigram's places in a block, as distances of 7 bits a byte; a further row names the
block's texts and their ends. Each task stores its blocks in folders by the trigram's hash,
so that nothing is shuffled and a place takes about two bytes. A query's literal pieces are
covered by trigrams: a piece stands where all of these do, each at its distance, so
intersecting the places of a few trigrams finds it without a look at any text. Parts between
the query's wildcards (% any text, _ one code point) must follow one another, in one text.
Texts are read for candidates only, and only where a piece is shorter than a trigram or a
part has a _ at its edge; a query without any trigram is looked for in all texts.

The index changes by segments: add() writes one with the new texts, remove() the ids that are
gone; a text counts if its item wasn't removed after it was added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import like_anywhere
from folioflow.sources.scratch import ship

#: Folders of an index, the one after them for names; code points of a block.
PARTS, BLOCK = 16, 1 << 20
#: Bits of a code point.
_BITS = 21


def _packed(codes: np.ndarray) -> np.ndarray:
    """The trigram at each place of a text's code points, as a number."""
    codes = codes.astype(np.int64)
    codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    return (codes[:-2] << 2 * _BITS) | (codes[1:-1] << _BITS) | codes[2:]


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


@dataclass(frozen=True)
class Piece:
    """A part of a query between two %: its length, its literal runs (offset, text), and whether trigrams alone decide."""

    length: int
    runs: tuple[tuple[int, str], ...]
    exact: bool

    def grams(self) -> list[tuple[int, int]]:
        """Offsets and trigrams that cover the runs of three code points or more."""
        out = []
        for at, run in self.runs:
            grams = _packed(_code_points(run)).tolist()
            out += [(at + k, grams[k]) for k in sorted({*range(0, len(grams), 3), len(grams) - 1}) if grams]
        return out


def pieces(query: str) -> list[Piece]:
    """The parts of a query."""
    out = []
    for part in filter(None, query.strip().split("%")):
        runs, at = [], 0
        for run in part.split("_"):
            if run:
                runs.append((at, run))
            at += len(run) + 1
        exact = bool(runs) and all(len(r) >= 3 for _, r in runs) and part[0] != "_" and part[-1] != "_"
        out.append(Piece(len(part), tuple(runs), exact))
    return out


@dataclass(frozen=True)
class TextIndex:
    """Texts (item_id, unit, body) and their trigrams in a folder; add() and remove() make a new index and leave this one as it is."""

    spark: SparkSession
    path: str
    version: int = -1
    removed: tuple[int, ...] = ()
    #: Types of item_id and unit, as the first texts have them.
    types: tuple[str, str] = ("string", "string")

    def add(self, texts: DataFrame) -> TextIndex:
        """The index with more texts; (item_id, unit) of those that count must be new. Null bodies are left out."""
        ship(self.spark)
        at = self.version + 1
        texts = texts.where("body is not null").select("item_id", "unit", "body")
        texts.withColumn("part", _folder(F.xxhash64("item_id"))).sortWithinPartitions("part", "item_id").write.partitionBy("part").parquet(f"{self.path}/texts/version={at}")
        types = dict(texts.dtypes)["item_id"], dict(texts.dtypes)["unit"]
        blocks = texts.mapInArrow(partial(_blocks, size=BLOCK), f"{_GRAMS.format(*types)}, part int")
        blocks.sortWithinPartitions("part", "gram").write.partitionBy("part").option("compression", "zstd").parquet(f"{self.path}/grams/version={at}")
        return replace(self, version=at, types=types)

    def remove(self, items: DataFrame) -> TextIndex:
        """The index without all texts that these items (item_id) have so far."""
        if self.version < 0:
            return self
        at = self.version + 1
        items.select("item_id").where("item_id is not null").distinct().write.parquet(f"{self.path}/removed/version={at}")
        return replace(self, version=at, removed=(*self.removed, at))

    def hits(self, query: str) -> DataFrame:
        """item_id of the items with a text that holds the query."""
        parts = pieces(query)
        if any(p.grams() for p in parts):
            found = self._candidates(parts)
            if not all(p.exact for p in parts):
                found = self._texts.join(found, ["item_id", "unit", "part"], "left_semi").where(like_anywhere(F.col("body"), query))
        else:
            found = self._texts.where(like_anywhere(F.col("body"), query))
        return found.select("item_id").distinct()

    def search(self, items: DataFrame, query: str) -> DataFrame:
        """Items with the query in a text of theirs; an empty query takes all."""
        if not query.strip():
            return items
        return items.join(self.hits(query).withColumnRenamed("item_id", "id"), "id", "left_semi")

    def _candidates(self, parts: list[Piece]) -> DataFrame:
        """The texts whose trigrams stand as the query's parts need them."""
        wanted = sorted({g for p in parts for _, g in p.grams()})
        folders = sorted({g % PARTS for g in wanted})
        rows = self._grams.where(F.col("part").isin(*folders) & F.col("gram").isin(*wanted))
        held = rows.groupBy("version", "block").agg(F.collect_list(F.struct("gram", "places")).alias("held")).where(F.size("held") == len(wanted))
        names = self._grams.where(F.col("part") == PARTS).select("version", "block", "item_ids", "units", "ends")
        needed = [(p.length, p.grams()) for p in parts if p.grams()]
        found = held.join(names, ["version", "block"]).select("held", "item_ids", "units", "ends", "version")
        found = found.mapInArrow(partial(_found, needed=needed), f"item_id {self.types[0]}, unit {self.types[1]}, version int")
        return self._counting(found).select("item_id", "unit", _folder(F.xxhash64("item_id")).alias("part"))

    @cached_property
    def _texts(self) -> DataFrame:
        return self._counting(self._stored("texts"))

    @cached_property
    def _grams(self) -> DataFrame:
        return self._stored("grams")

    def _stored(self, table: str) -> DataFrame:
        """A table's rows up to this version; its files are listed once."""
        own = f"item_id {self.types[0]}, unit {self.types[1]}, body string" if table == "texts" else _GRAMS.format(*self.types)
        schema = f"{own}, version int, part int"
        if self.version < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}").where(F.col("version") <= self.version)

    def _counting(self, rows: DataFrame) -> DataFrame:
        """The rows (item_id, version) of the texts that count."""
        if not self.removed:
            return rows
        gone = self.spark.read.schema(f"item_id {self.types[0]}, version int").option("basePath", f"{self.path}/removed").parquet(*[f"{self.path}/removed/version={v}" for v in self.removed])
        last = gone.groupBy("item_id").agg(F.max("version").alias("since"))
        return rows.join(last, "item_id", "left").where("since is null or version > since").drop("since")


#: A row has a trigram's places in a block, or (in the folder of names) the block's texts.
_GRAMS = "block long, gram long, places binary, item_ids array<{}>, units array<{}>, ends array<int>"


def _folder(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(PARTS)).cast("int")


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The blocks of texts (item_id, unit, body): a row for each distinct trigram, and one of names."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        codes, length, first = [], 0, 0
        for k, body in enumerate(batch.column("body")):
            codes.append(_code_points(body.as_py()))
            length += len(codes[-1])
            if length >= size or k == len(batch) - 1:
                yield _block(block, codes, batch.slice(first, k + 1 - first))
                block, codes, length, first = block + 1, [], 0, k + 1


def _block(block: int, codes: list[np.ndarray], texts: pa.RecordBatch) -> pa.RecordBatch:
    lengths = np.array([len(c) for c in codes])
    ends = np.cumsum(lengths)
    packed = _packed(np.concatenate(codes)) if ends[-1] >= 3 else np.zeros(0, np.int64)
    places = np.flatnonzero(np.arange(3, len(packed) + 3) <= np.repeat(ends, lengths)[: len(packed)])  # within a text
    packed = packed[places]
    order = np.argsort(packed, kind="stable")
    packed, places = packed[order], places[order]
    first = np.flatnonzero(np.diff(packed, prepend=-1))
    steps = np.diff(places, prepend=0)
    steps[first] = places[first]
    data, at = _bytes_of(steps)
    n, nothing = len(first), lambda kind, k: pa.nulls(k, pa.list_(kind))
    held = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(at[first], len(data)).astype(np.int32)), pa.py_buffer(data)])
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    named = [one(texts.column("item_id")), one(texts.column("unit")), one(pa.array(ends, pa.int32()))]
    columns = {
        "block": pa.array(np.full(n + 1, block)),
        "gram": pa.array(np.append(packed[first], -1)),
        "places": pa.concat_arrays([held, pa.nulls(1, pa.binary())]),
        **{name: pa.concat_arrays([nothing(c.type.value_type, n), c]) for name, c in zip(("item_ids", "units", "ends"), named, strict=True)},
        "part": pa.array(np.append(packed[first] % PARTS, PARTS), pa.int32()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _bytes_of(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 as bytes of 7 bits, lowest first, all but a number's last with the top bit; and where each starts."""
    sizes = np.ones(len(numbers), np.int64)
    for bits in (7, 14, 21, 28):
        sizes += numbers >= 1 << bits
    starts = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        on = sizes > k
        data[starts[on] + k] = (numbers[on] >> 7 * k & 127) | np.where(sizes[on] > k + 1, 128, 0)
    return data, starts


def _numbers_of(data: bytes) -> np.ndarray:
    of = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(of < 128)
    starts = np.append(0, ends[:-1] + 1)
    shift = np.arange(len(of)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((of & 127).astype(np.int64) << 7 * shift, starts)


def _found(batches: Iterator[pa.RecordBatch], needed: list[tuple[int, list[tuple[int, int]]]]) -> Iterator[pa.RecordBatch]:
    """The texts of blocks (held, item_ids, units, ends, version) in which the parts (length, trigrams at offsets) stand one after another."""
    for batch in batches:
        for k in range(len(batch)):
            of = {row["gram"]: np.cumsum(_numbers_of(row["places"])) for row in batch.column("held")[k].as_py()}
            ends = batch.column("ends")[k].values.to_numpy()
            # where each text is passed so far; a place that isn't there lies behind all texts
            at, out = np.append(0, ends[:-1]).astype(np.int64), np.int64(1) << 40
            for length, grams in needed:
                starts = reduce(partial(np.intersect1d, assume_unique=True), [of[gram] - offset for offset, gram in grams])
                starts = np.append(starts, out)
                at = starts[np.minimum(np.searchsorted(starts, at), len(starts) - 1)] + length
                at[at > ends] = out
            on = pa.array(np.flatnonzero(at <= ends))
            names = [batch.column(c)[k].values.take(on) for c in ("item_ids", "units")]
            yield pa.RecordBatch.from_arrays([*names, pa.array(np.full(len(on), batch.column("version")[k].as_py()), pa.int32())], ["item_id", "unit", "version"])


def library_texts(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """The texts that a library's search looks at: titles, descriptions and chunks (item_id, unit, body)."""
    of = lambda column: items.select(F.col("id").alias("item_id"), F.lit(column).alias("unit"), F.col(column).alias("body"))
    named = chunks.select("item_id", F.concat(F.lit("chunk:"), F.col("seq").cast("string")).alias("unit"), "body")
    return of("title").unionByName(of("description")).unionByName(named)

