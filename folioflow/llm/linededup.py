"""Line dedup with sharded cuckoo filters over exact reference-count tables.

A line's key is the line without white space at its ends, A-Z lower-cased, hashed to
128 bits. The index of a corpus is three tables in the shared folder: postings (a row
for every key and document), reference counts (documents and largest document of
every key) and, for the keys that enough documents share, cuckoo filters in shards
of a bounded number of keys. Postings meet the filters shard by shard: only those that
a filter lets through, usually few, are looked up in the exact counts.

As cuckoo filters can forget, documents can be added and deleted again. Each table is a
list of segments: a change adds one with what it touched, the batch's postings (or the
ids deleted), the new counts of its keys and the filters of shards that gained or lost
keys, and the newest row of a key stands. A shard that fills up is built anew from the
exact counts, and so are all, in more shards, when there are too many keys for them. Once
there are more than SEGMENTS of a table the index is compacted: one segment of each, with
what stands. Where postings meet counts, a key's rows are dealt to many tasks by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from folioflow.llm import textbytes as tb
from folioflow.llm.skew import look_up
from folioflow.llm.storage import freeing, written

U = np.uint64
#: Code points a key needs, documents that share a key to be dropped.
MIN_CHARS, MIN_DOCS = 20, 3
#: Keys in a shard, about; parts in which a shard's postings meet its filter; share of a filter's seats that may be taken.
SHARD_KEYS, PARTS, MOST_FULL = 1 << 14, 16, 0.85
#: Segments of a table beyond which an index is compacted.
SEGMENTS = 8
FILTER = "shard int, cells binary, spare array<bigint>"
_SECOND_CODES = tb.mix(tb.BYTE_CODES + U(tb._STEP))[tb.LOWER]


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket; keys it can't seat are kept whole."""

    KICKS = 200

    def __init__(self, table: np.ndarray, spare: set[int] | None = None):
        self.table, self.spare = table, spare or set()

    @classmethod
    def sized(cls, n: int) -> Cuckoo:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(n, 1) / 4 / 0.8))))
        return cls(np.zeros((buckets, 4), np.uint16))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = U(len(self.table) - 1)
        prints = (keys >> U(48)) % U(65535) + U(1)
        one = keys & mask
        return prints, one, one ^ (tb.mix(prints) & mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, one, two = self._places(keys)
        prints = prints.astype(np.uint16)[:, None]
        hit = (self.table[one.astype(np.int64)] == prints).any(1) | (self.table[two.astype(np.int64)] == prints).any(1)
        return hit | np.isin(keys, np.array(sorted(self.spare), U)) if self.spare else hit

    def insert(self, keys: np.ndarray) -> None:
        for key, print_, one, two in zip(keys.tolist(), *(x.tolist() for x in self._places(keys)), strict=True):
            if not (self._seat(one, print_) or self._seat(two, print_) or self._kick(one, print_)):
                self.spare.add(key)

    def _seat(self, bucket: int, print_: int) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if len(free):
            self.table[bucket, free[0]] = print_
        return bool(len(free))

    def _kick(self, bucket: int, print_: int) -> bool:
        moves = []
        for step in range(self.KICKS):
            slot = (print_ + step) % 4
            moves.append((bucket, slot, int(self.table[bucket, slot])))
            self.table[bucket, slot], print_ = print_, moves[-1][2]
            bucket ^= int(tb.mix(np.array([print_], U))[0]) & (len(self.table) - 1)
            if self._seat(bucket, print_):
                return True
        for bucket, slot, was in reversed(moves):  # nobody loses a seat for one who finds none
            self.table[bucket, slot] = was
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Forget keys that were inserted."""
        for key, print_, one, two in zip(keys.tolist(), *(x.tolist() for x in self._places(keys)), strict=True):
            if key in self.spare:
                self.spare.remove(key)
                continue
            for bucket in (one, two):
                at = np.flatnonzero(self.table[bucket] == print_)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break

    def crowded(self) -> bool:
        return bool(self.spare) or np.count_nonzero(self.table) > MOST_FULL * self.table.size

    def dump(self) -> tuple[bytes, list[int]]:
        return self.table.tobytes(), sorted(np.array(sorted(self.spare), U).view(np.int64).tolist())

    @classmethod
    def load(cls, table: bytes, spare) -> Cuckoo:
        keys = np.array([] if spare is None else list(spare), np.int64).view(U)
        return cls(np.frombuffer(table, np.uint16).reshape(-1, 4).copy(), set(keys.tolist()))


def line_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of texts: start, end, both halves of the key, code points of the key; and each
    text's first line's index. An empty text has one empty line."""
    feeds = np.flatnonzero(data == 0x0A)
    n = len(offsets) - 1
    starts = np.concatenate((offsets[:-1], feeds + 1))
    ends = np.concatenate((offsets[1:], feeds))
    owner = np.concatenate((np.arange(n), np.searchsorted(offsets, feeds, "right") - 1))
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    ends = np.sort(np.concatenate((offsets[1:], feeds)), kind="stable")
    first = np.searchsorted(owner, np.arange(n + 1))
    solid = np.concatenate((np.flatnonzero(~tb.SPACE[data]), [len(data)]))
    low = np.minimum(solid[np.searchsorted(solid, starts)], ends)
    high = np.searchsorted(solid, ends) - 1
    high = np.where(high >= 0, solid[high] + 1, 0)
    high = np.maximum(low, np.minimum(high, ends))
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    hi, lo = tb.span_hashes(data, low, high, tb.LOWER_CODES), tb.span_hashes(data, low, high, _SECOND_CODES)
    return starts, ends, hi, lo, chars[high] - chars[low], first


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """hi, lo, doc: a row for every document and distinct key of its own. Rows without id have none."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, data, offsets in tb.chunks(batch.column(1)):
                _, _, hi, lo, chars, first = line_keys(data, offsets)
                rows = np.flatnonzero(chars >= min_chars)
                owner = tb.owners(first)[rows]
                order = np.lexsort((lo[rows], hi[rows], owner))
                rows, owner = rows[order], owner[order]
                new = np.ones(len(rows), bool)
                new[1:] = (hi[rows][1:] != hi[rows][:-1]) | (lo[rows][1:] != lo[rows][:-1]) | (owner[1:] != owner[:-1])
                rows, owner = rows[new], owner[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hi[rows].view(np.int64)), pa.array(lo[rows].view(np.int64)), batch.column(0).take(pa.array(owner + low))], ["hi", "lo", "doc"]
                )

    given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(freeing(run), f"hi bigint, lo bigint, doc {kind}")


def _count(found: DataFrame) -> DataFrame:
    return found.groupBy("hi", "lo").agg(F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("last"))


def _together(segments: tuple[DataFrame, ...]) -> DataFrame:
    rows = segments[0]
    for later in segments[1:]:
        rows = rows.unionByName(later)
    return rows


def _newest(segments: tuple[DataFrame, ...], *keys: str) -> DataFrame:
    """The newest row of each key in segments, oldest first."""
    if len(segments) == 1:
        return segments[0]
    rest = [c for c in segments[0].columns if c not in keys]
    every = [s.withColumn("version", F.lit(k)) for k, s in enumerate(segments)]
    newest = _together(tuple(every)).groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("r"))
    return newest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(segments[0].columns)


@dataclass(frozen=True)
class LineIndex:
    """What is known of a corpus's lines; insert() and delete() make a new one and leave this one as it is."""

    #: Segments of (hi, lo, doc, version), (doc, version), (hi, lo, n_docs, last) and the filters.
    postings: tuple[DataFrame, ...]
    deleted: tuple[DataFrame, ...]
    counts: tuple[DataFrame, ...]
    filters: tuple[DataFrame, ...]
    version: int
    n_live: int
    shards: int
    min_docs: int
    min_chars: int

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        found = written(postings(docs, id_col, text_col, min_chars).withColumn("version", F.lit(0)), "postings")
        index = cls((found,), (), (written(_count(found), "counts"),), (), 0, 0, 1, min_docs, min_chars)
        return index._sharded(index.live().count())

    def live(self) -> DataFrame:
        """The counts of keys that enough documents share."""
        return _newest(self.counts, "hi", "lo").where(F.col("n_docs") >= self.min_docs)

    def standing(self) -> DataFrame:
        """hi, lo, doc of the documents that aren't deleted."""
        found = _together(self.postings)
        if self.deleted:
            last = _together(self.deleted).groupBy("doc").agg(F.max("version").alias("since"))
            found = found.join(last, "doc", "left").where("since is null or version > since")
        return found.select("hi", "lo", "doc")

    def compact(self) -> LineIndex:
        """The same index in one segment of each table: the postings that stand, the newest counts and filters."""
        postings_ = written(self.standing().withColumn("version", F.lit(self.version)), "postings")
        counts = written(_newest(self.counts, "hi", "lo").where("n_docs > 0"), "counts")
        filters = written(_newest(self.filters, "shard"), "filters")
        return replace(self, postings=(postings_,), deleted=(), counts=(counts,), filters=(filters,))

    def _kept_short(self) -> LineIndex:
        return self.compact() if max(map(len, (self.postings, self.deleted, self.counts, self.filters))) > SEGMENTS else self

    def shard(self) -> Column:
        return F.shiftrightunsigned("hi", 20).bitwiseAND(self.shards - 1).cast("int").alias("shard")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index with documents added. Documents whose id stands already are left out: delete them first to change them.

        Reads the batch, the ids of the postings and the count segments; shuffles the batch's
        keys and the counts that these have, and writes just these.
        """
        at = self.version + 1
        found = postings(docs, id_col, text_col, self.min_chars).withColumn("version", F.lit(at))
        found = written(found.join(self.standing().select("doc").distinct(), "doc", "left_anti").select("hi", "lo", "doc", "version"), "postings")
        batch = _count(found).withColumnsRenamed({"n_docs": "more", "last": "later"})
        touched = batch.join(self._counts_of(found), ["hi", "lo"], "left")
        last = F.greatest("last", "later")  # the one that isn't null
        after = touched.select("hi", "lo", F.coalesce("n_docs", F.lit(0)).alias("was"), (F.coalesce("n_docs", F.lit(0)) + F.col("more")).alias("n_docs"), last.alias("last"))
        return replace(self, postings=(*self.postings, found), version=at)._counted(after)._kept_short()

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """The index without the documents of these ids, as if they had never been added.

        Reads the postings for what these documents held, and writes the ids and new counts of
        those keys; where one was the last of its key, the key's other postings tell the new last.
        """
        at = self.version + 1
        gone = written(ids.select(F.col(id_col).alias("doc"), F.lit(at).alias("version")).where("doc is not null").distinct(), "deleted")
        taken = written(self.standing().join(gone.select("doc"), "doc", "left_semi").select("hi", "lo", "doc"), "taken")
        new = replace(self, deleted=(*self.deleted, gone), version=at)
        batch = _count(taken).withColumnsRenamed({"n_docs": "fewer", "last": "highest"})
        touched = written(batch.join(self._counts_of(taken), ["hi", "lo"]), "touched")
        open_ = touched.where("highest = last and n_docs > fewer").select("hi", "lo")
        found = look_up(new.standing(), open_, "hi", "lo", by="doc").groupBy("hi", "lo").agg(F.max("doc").alias("next"))
        last = F.when(F.col("n_docs") > F.col("fewer"), F.when(F.col("highest") == F.col("last"), F.col("next")).otherwise(F.col("last")))
        after = touched.join(found, ["hi", "lo"], "left").select("hi", "lo", F.col("n_docs").alias("was"), (F.col("n_docs") - F.col("fewer")).alias("n_docs"), last.alias("last"))
        return new._counted(after)._kept_short()

    def _counts_of(self, found: DataFrame) -> DataFrame:
        """The newest counts of the keys in found."""
        keys = found.select("hi", "lo").distinct()
        return _newest(tuple(c.join(keys, ["hi", "lo"], "left_semi") for c in self.counts), "hi", "lo")

    def _counted(self, after: DataFrame) -> LineIndex:
        """The index with new counts of some keys (was: their documents before), and its filters made to fit."""
        after = written(after, "counts")
        new = replace(self, counts=(*self.counts, after.drop("was")))
        gained = (F.col("was") < self.min_docs) & (F.col("n_docs") >= self.min_docs)
        lost = (F.col("was") >= self.min_docs) & (F.col("n_docs") < self.min_docs)
        n_live = self.n_live + (after.agg(F.count_if(gained) - F.count_if(lost)).first()[0] or 0)
        if n_live > 2 * SHARD_KEYS * self.shards:
            return new._sharded(n_live)
        moved = after.where(gained | lost).select("hi", gained.alias("gained"), self.shard())
        held = _newest(self.filters, "shard").join(moved.select("shard").distinct(), "shard", "left_semi")
        updated = written(held.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(_update, f"{FILTER}, crowded boolean"), "filters")
        again = new.live().withColumn("shard", self.shard()).join(updated.where("crowded").select("shard"), "shard", "left_semi")
        rebuilt = again.select("hi", "shard").groupBy("shard").applyInPandas(_build, FILTER)
        fresh = written(updated.where("not crowded").drop("crowded").unionByName(rebuilt), "filters")
        return replace(new, filters=(*self.filters, fresh), n_live=n_live)

    def _sharded(self, n_live: int) -> LineIndex:
        """The index with all filters built anew for so many keys."""
        new = replace(self, n_live=n_live, shards=1 << max(0, int(np.ceil(np.log2(max(1, n_live) / SHARD_KEYS)))))
        return replace(new, filters=(written(new.live().select("hi", new.shard()).groupBy("shard").applyInPandas(_build, FILTER), "filters"),))

    def candidates(self) -> DataFrame:
        """hi, lo, doc of the postings that a filter lets through.

        A shard's postings are dealt to PARTS by document, so that no key, however many
        documents hold it, is one task's; each part gets the shard's filter first and then
        streams past it.
        """
        found = self.standing()
        kind = dict(found.dtypes)["doc"]
        parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
        none = {"hi": F.lit(None).cast("bigint"), "lo": F.lit(None).cast("bigint"), "doc": F.lit(None).cast(kind)}
        first = _newest(self.filters, "shard").withColumns(none).withColumn("part", parts)
        rows = found.withColumns({"shard": self.shard(), "cells": F.lit(None).cast("binary"), "spare": F.lit(None).cast("array<bigint>"), "part": F.pmod(F.xxhash64("doc"), F.lit(PARTS)).cast("int")})
        both = first.unionByName(rows).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("cells").isNull())

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, filter_ = None, None
            for batch in batches:
                shard, part = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "part"))
                cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1])) + 1
                for low, high in zip([0, *cuts], [*cuts, len(shard)], strict=True):
                    if low == high:
                        continue
                    if (here := (shard[low], part[low])) != at:
                        at, filter_ = here, None
                    if (cells := batch.column("cells")[int(low)].as_py()) is not None:
                        filter_, low = Cuckoo.load(cells, batch.column("spare")[int(low)].as_py()), low + 1
                    rows = batch.slice(low, high - low).select(["hi", "lo", "doc"])
                    if filter_ is not None and len(rows):
                        yield rows.filter(pa.array(filter_.contains(rows.column("hi").to_numpy(zero_copy_only=False).astype(np.int64).view(U))))

        return both.select("shard", "part", "cells", "spare", "hi", "lo", "doc").mapInArrow(freeing(probe), f"hi bigint, lo bigint, doc {kind}")


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    filter_ = Cuckoo.sized(len(rows))
    filter_.insert(np.sort(rows["hi"].to_numpy(np.int64).view(U)))
    return pd.DataFrame([(rows["shard"].iloc[0], *filter_.dump())], columns=["shard", "cells", "spare"])


def _update(old: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
    keys, gained = moved["hi"].to_numpy(np.int64).view(U), moved["gained"].to_numpy(bool)
    filter_ = Cuckoo.load(old["cells"].iloc[0], old["spare"].iloc[0]) if len(old) else Cuckoo.sized(len(moved))
    filter_.delete(keys[~gained])
    filter_.insert(keys[gained])
    shard = (old if len(old) else moved)["shard"].iloc[0]
    return pd.DataFrame([(shard, *filter_.dump(), filter_.crowded())], columns=["shard", "cells", "spare", "crowded"])


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of docs with text without the lines dropped, and n_lines, n_dropped.

    Lines whose key has at least min_chars code points and stands in at least
    min_docs documents are dropped everywhere but in the document of the largest id
    that holds it (there all of them stay). Null and empty texts are one empty line.
    Rows with the same id count as one document. Rows with a null id aren't counted
    and keep all lines. A column named n_lines or n_dropped is replaced; other names
    don't matter. A text of any length is read whole; an empty table gives none.
    """
    index = index or LineIndex.build(docs, id_col, text_col, min_chars, min_docs)
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    # null ids meet nothing in the join and are spread
    spread = F.when(F.col(id_col).isNull(), F.pmod(F.xxhash64(text_col), F.lit(1 << 10))).otherwise(0).alias("spread")
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)]).alias("rest"), spread)
    # a line in a third of all documents has as many candidates: they are dealt by document
    passed = written(index.candidates(), "candidates")
    gone = look_up(passed, index.live().select("hi", "lo", "last"), "hi", "lo", by="doc").where("doc <> last")
    gone = gone.groupBy(F.col("doc").alias("id")).agg(F.collect_set(F.struct("hi", "lo")).alias("gone")).withColumn("spread", F.lit(0).cast("bigint"))
    joined = given.join(gone, ["id", "spread"], "left").select("id", "text", "rest", F.col("gone.hi").alias("hi"), F.col("gone.lo").alias("lo"))
    fields = StructType([*joined.drop("hi", "lo").schema, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    out = joined.mapInArrow(freeing(_drop), fields)
    shown = {id_col: F.col("id"), text_col: F.col("text")} | {c: F.col(f"rest.c{k}") for k, c in enumerate(rest)}
    shown = {c: shown[c] for c in docs.columns} | {"n_lines": F.col("n_lines"), "n_dropped": F.col("n_dropped")}
    return out.select(*[v.alias(k) for k, v in shown.items()])


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents without their lines whose keys are listed as gone."""
    for batch in batches:
        listed = [batch.column(c) for c in ("hi", "lo")]
        sizes = pc.fill_null(pc.list_value_length(listed[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first_gone = np.concatenate(([0], np.cumsum(sizes)))
        gone_hi, gone_lo = (pc.list_flatten(c).to_numpy(zero_copy_only=False).astype(np.int64).view(U) for c in listed)
        texts, n_lines, n_dropped = [], [], []
        for low, high, data, offsets in tb.chunks(batch.column("text")):
            starts, ends, hi, lo, _, first = line_keys(data, offsets)
            owner = tb.owners(first)
            theirs = slice(first_gone[low], first_gone[high])
            whose = np.repeat(np.arange(high - low), sizes[low:high])
            drop = np.isin(_named(owner, hi, lo), _named(whose, gone_hi[theirs], gone_lo[theirs]))
            stays = np.flatnonzero(~drop)
            # each line that stays, with the line feed after it where another of its text follows
            follows = np.zeros(len(stays), np.int64)
            follows[:-1] = owner[stays[1:]] == owner[stays[:-1]]
            size = ends[stays] - starts[stays] + follows
            kept = data[np.repeat(starts[stays] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            places = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(owner[stays], np.arange(high - low + 1))]
            texts.append(pa.LargeStringArray.from_buffers(high - low, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(kept)).cast(pa.string()))
            n_lines.append(np.diff(first))
            n_dropped.append(tb.sums(drop.astype(np.int64), first))
        joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n_lines, n_dropped)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.concat_arrays(texts) if texts else pa.array([], pa.string()), batch.column("rest"), *map(pa.array, joined)], ["id", "text", "rest", "n_lines", "n_dropped"]
        )


def _named(owner: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """One hash of a text's place and a key."""
    with np.errstate(over="ignore"):
        return tb.mix(tb.mix(hi + owner.astype(U) * U(tb._STEP)) ^ lo)
