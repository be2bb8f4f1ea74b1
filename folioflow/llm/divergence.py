"""Source divergence audit: how far each source's words lie from the other sources' and from its language's.

Texts are tokenised as bytes: a lookup table over the concatenated UTF-8 buffers of many
documents marks the bytes of terms, whose runs are the terms; their slices are grouped by
xxhash, and each slice's bytes are compared with its group's first, so equal hashes of
different bytes are told apart. Counts of a chunk of documents leave a task summed by
(language, source, term), Spark sums them on. A language keeps the terms of at least
MIN_DOCS of its documents. Every group gives each kept term, counted there or not, a share
in parts of SCALE, smoothed by one; divergences are sums of (p - q) squared over q, in
whole numbers.

Pairs of sources are compared in blocks of terms and tiles of sources: a task has the
counts of a block as sparse rows (a CSR matrix) and sums the differences that stored cells
make, by reduceat; what all cells would give if none were stored is added once a pair. So
no task has all terms of a language or all pairs of its sources, and frequent terms,
having as many cells as there are sources, aren't hot.

Null texts, languages and sources count as empty strings; rows that repeat are documents
of their own; a group whose documents have no kept terms still has its pairs. Without
documents there is nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.skew import look_up
from folioflow.llm.storage import written
from folioflow.llm.textbytes import LOWER, chunks, owners, spans

MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: SCALE as two factors, so that shares of counts below 2**63 / LARGE stay within 64 bits.
LARGE, SMALL = 100_000, 10_000
#: Bytes of text of a chunk, cells of a block of terms (about), sources of a tile (about).
CHUNK, CELLS, TILE = 2 << 20, 16_384, 256
#: Bytes of terms: letters, and all that isn't ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def group_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: Callable[[memoryview], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """Each slice's group, and each group's first slice: groups are of equal bytes."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    view = memoryview(data)
    hashes = np.fromiter(map(hashed, map(view.__getitem__, map(slice, starts.tolist(), ends.tolist()))), np.uint64, len(starts))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = ends - starts
    as_first = first[group]
    odd = np.flatnonzero(sizes != sizes[as_first])
    if not len(odd):
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        differs = data[np.repeat(starts, sizes) + place] != data[np.repeat(starts[as_first], sizes) + place]
        odd = np.unique(np.repeat(np.arange(len(starts)), sizes)[differs]) if differs.any() else odd
    if len(odd):  # equal hashes of different bytes: all by their bytes
        known: dict[bytes, int] = {}
        group = np.array([known.setdefault(bytes(view[a:b]), len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        first = np.unique(group, return_index=True)[1]
    return group, first


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices as strings."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    place = np.arange(int(sizes.sum())) - np.repeat(offsets[:-1], sizes) + np.repeat(starts, sizes)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data[place]).tobytes()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in chunks(batch.column("text"), CHUNK):
            folded = np.ascontiguousarray(LOWER[data])
            starts, ends, first = spans(TERM[data], offsets)
            if not len(starts):
                continue
            term, example = group_slices(folded, starts, ends)
            keys = [batch.column(c)[low:high].dictionary_encode() for c in ("lang", "source")]
            codes = [k.indices.to_numpy(zero_copy_only=False).astype(np.int64) for k in keys]
            group = codes[0] * len(keys[1].dictionary) + codes[1]
            # documents x terms, then groups x terms
            cell, n = np.unique(owners(first) * len(example) + term, return_counts=True)
            doc, term = np.divmod(cell, len(example))
            cell = group[doc] * len(example) + term
            order = np.argsort(cell, kind="stable")
            cell, n = cell[order], n[order]
            heads = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            group, term = np.divmod(cell[heads], len(example))
            lang, source = np.divmod(group, len(keys[1].dictionary))
            docs = np.diff(np.concatenate((heads, [len(cell)])))
            words = _slices(folded, starts[example], ends[example]).take(pa.array(term))
            yield pa.RecordBatch.from_arrays([keys[0].dictionary.take(pa.array(lang)), keys[1].dictionary.take(pa.array(source)), words, pa.array(np.add.reduceat(n, heads), pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it): every term of every whole text."""
    said = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    parts = said.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(n: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exactly."""
    up, down = n + 1, total + terms
    return 1 + up * LARGE // down * SMALL + up * LARGE % down * SMALL // down


def _share(n: str, total: str) -> Column:
    up = f"(({n} + 1) * {LARGE}L)"
    return F.expr(f"1 + ({up} div ({total} + terms)) * {SMALL}L + (({up} % ({total} + terms)) * {SMALL}L) div ({total} + terms)")


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, **columns: str) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: every other source of the language, by how far the source's shares are from
    it. Part `term`: the `top` terms that the source has more of than its language, by what
    they add to its distance from the language.
    """
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs, **columns).withColumns({"in_lang": F.sum("n").over(of_term), "n_docs": F.sum("docs").over(of_term), "leads": F.row_number().over(of_term.orderBy("source")) == 1})
    cells = written(counts.where(F.col("n_docs") >= min_docs).drop("docs", "n_docs"), "cells")
    names = {c: columns.get(f"{c}_col", c) for c in ("lang", "source")}
    every = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for n, c in names.items()]).distinct()
    held = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("leads").alias("leads"), F.count("*").alias("cells"))
    of_lang = Window.partitionBy("lang")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("total", "leads", "cells")}
    groups = every.join(held, ["lang", "source"], "left").withColumns(zero)
    groups = groups.withColumns({"terms": F.sum("leads").over(of_lang), "lang_total": F.sum("total").over(of_lang), "blocks": F.ceil(F.greatest(F.lit(1), F.sum("cells").over(of_lang)) / CELLS).cast("int"), "tiles": F.ceil(F.count("*").over(of_lang) / TILE).cast("int")})
    groups = written(groups.drop("leads", "cells"), "groups")
    found = written(look_up(cells, groups, "lang", "source", by="term"), "found")
    return _pairs(found, groups).unionByName(_terms(found, top))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", place.alias("rank"))


def _terms(cells: DataFrame, top: int) -> DataFrame:
    rows = cells.select("lang", "source", F.col("term").alias("item"), _share("n", "total").alias("p"), _share("in_lang", "lang_total").alias("q")).where("p > q")
    return _ranked(rows.withColumn("value", F.expr("((p - q) * (p - q)) div q")), "term").where(F.col("rank") <= top)


def _tiled(rows: DataFrame) -> DataFrame:
    """Each row once for each pair of tiles that its source's tile is in: as row (side 0), and as column (side 1) of another tile."""
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    as_row = F.transform(others, lambda o: F.struct(tile.alias("i"), o.alias("j"), F.lit(0).alias("side")))
    as_column = F.transform(F.filter(others, lambda o: o != tile), lambda o: F.struct(o.alias("i"), tile.alias("j"), F.lit(1).alias("side")))
    return rows.withColumn("at", F.explode(F.concat(as_row, as_column))).select(*rows.columns, "at.i", "at.j", "at.side")


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    cells = cells.select("lang", "source", "term", "n", "tiles", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"))
    cells = _tiled(cells).select("lang", "block", "i", "j", "side", "source", "term", "n")
    groups = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = _tiled(groups).select("lang", "block", "i", "j", "side", "source", "total", "terms")
    keys = ["lang", "block", "i", "j"]
    schema = "lang string, source string, item string, value long"
    sums = groups.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInPandas(_compared, schema)
    return _ranked(sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")


class Rows:
    """A CSR matrix of shares: the groups' cells in a block of terms."""

    def __init__(self, groups: pd.DataFrame, cells: pd.DataFrame, term: np.ndarray):
        self.names = groups["source"].to_numpy()
        self.total = groups["total"].to_numpy(np.int64)
        row = groups.reset_index(drop=True).reset_index().set_index("source")["index"].reindex(cells["source"]).to_numpy(np.int64)
        order = np.argsort(row, kind="stable")
        terms = groups["terms"].to_numpy(np.int64)
        self.first = np.searchsorted(row[order], np.arange(len(groups) + 1))
        self.row, self.term = row[order], term[order]
        self.none = shares(np.zeros(len(groups), np.int64), self.total, terms) if len(terms) and terms[0] else np.zeros(len(groups), np.int64)
        self.share = shares(cells["n"].to_numpy(np.int64)[order], self.total[self.row], terms[self.row])

    def reduced(self, values: np.ndarray) -> np.ndarray:
        """Sums of the cells' values by row."""
        out, full = np.zeros(len(self.names), np.int64), self.first[1:] > self.first[:-1]
        if full.any():
            out[full] = np.add.reduceat(values, self.first[:-1][full])
        return out


def _compared(key: tuple, groups: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
    """What a block of terms adds to the distance of each row's source to each column's; block 0 adds what all terms would give that neither has."""
    _, block, i, j = key
    term, n_terms = pd.factorize(cells["term"])
    n_terms = len(n_terms)
    sides = [Rows(groups[groups.side == s], cells[cells.side == s], term[(cells.side == s).to_numpy()]) for s in ((0,) if i == j else (0, 1))]
    of, to = sides[0], sides[-1]
    n_kept = int(groups["terms"].iloc[0]) if len(groups) else 0
    if not n_kept or not len(to.names):
        value = np.zeros((len(of.names), len(to.names)), np.int64)
    else:
        value = np.empty((len(of.names), len(to.names)), np.int64)
        for r in range(len(of.names)):
            mine = slice(of.first[r], of.first[r + 1])
            p = np.full(n_terms, of.none[r], np.int64)
            p[of.term[mine]] = of.share[mine]
            at = p[to.term]
            stored = to.reduced(apart(at, to.share) - apart(at, to.none[to.row]))
            seen, times = np.unique(of.share[mine], return_counts=True)
            base = apart(of.none[r], to.none)
            own = ((apart(seen[:, None], to.none[None, :]) - base[None, :]) * times[:, None]).sum(0)
            value[r] = stored + own + (n_kept * base if block == 0 else 0)
    a, b = np.nonzero(of.names[:, None] != to.names[None, :])
    return pd.DataFrame({"lang": key[0], "source": of.names[a], "item": to.names[b], "value": value[a, b]})
