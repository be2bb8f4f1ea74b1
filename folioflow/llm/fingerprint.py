"""Document fingerprints by locally consistent parsing.

A text's UTF-8 bytes are parsed into phrases level by level. Runs of one symbol are
first joined into one. Deterministic coin tossing then gives each symbol a small
label that depends only on the symbol and a few before it: the lowest bit in which
it differs from its neighbour, and that bit's value, repeated until at most six
labels are left. A phrase begins where the label is a local maximum, and its name is
a hash of what it holds. So equal substrings are parsed alike but near their ends,
wherever they stand, and share the names of their interior phrases.

A fingerprint lists the smallest hashes of the distinct names at each level as
hexadecimal digits, levels parted by full stops; the likeness of two is the
resemblance that these bottom-k sketches estimate at the highest level where both
have a few names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import textbytes as tb

U = np.uint64
#: How many names of each level are listed at most, and how many a level needs for a comparison.
LISTED, FEW = (12, 24, 48), 6
#: Texts to a range of ids, about; ranges between quantiles of the ids, and equal steps of each, at most.
PER_PART, MAX_RANGES, MAX_STEPS = 4000, 2048, 64
CHUNK = 1 << 19


def _coin(width: int) -> np.ndarray:
    """The label of every pair (neighbour, symbol) of so many values: 2 * lowest differing bit + that bit."""
    a, b = np.meshgrid(np.arange(width), np.arange(width), indexing="ij")
    low = (a ^ b) & -(a ^ b)
    bit = np.where(low > 0, np.log2(np.maximum(low, 1)).astype(np.int64), 0)
    return np.where(a == b, 0, 2 * bit + ((b >> bit) & 1)).astype(np.uint8).ravel()


_SECOND, _THIRD, _LAST = _coin(128), _coin(16), _coin(8)


def _before(labels: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Each place's neighbour before it; at a document's beginning, a label of its own."""
    out = np.empty_like(labels)
    out[1:] = labels[:-1]
    out[begins] = labels[begins] ^ 1
    return out


def cuts(symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where phrases begin in symbols of which no two neighbours are equal."""
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[begins] = ~symbols[begins]
    differ = symbols ^ before
    low = differ & (~differ + U(1))
    bit = np.frexp(low.astype(np.float64))[1].astype(np.int64) - 1
    bit = np.maximum(bit, 0)
    labels = (2 * bit + ((symbols >> bit.astype(U)) & U(1)).astype(np.int64)).astype(np.uint8)
    for table, shift in ((_SECOND, 7), (_THIRD, 4), (_LAST, 3)):
        labels = table[(_before(labels, begins).astype(np.int32) << shift) | labels]
    left = _before(labels, begins)
    right = np.empty_like(labels)
    right[:-1] = labels[1:]
    right[-1:] = 0
    right[begins[1:] - 1] = 0
    at = (labels > left) & (labels >= right)
    at[begins] = True
    return np.flatnonzero(at)


def parse(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the phrases of one level up, and each document's first one's index."""
    full = np.flatnonzero(first[:-1] < first[1:])
    if not len(full):
        return symbols[:0], np.zeros_like(first)
    # a run of one symbol becomes one symbol
    new = np.ones(len(symbols), bool)
    new[1:] = symbols[1:] != symbols[:-1]
    new[first[full]] = True
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(symbols)))
    with np.errstate(over="ignore"):
        runs = np.where(size > 1, tb.mix(symbols[at] + size.astype(U) * U(tb._STEP)), symbols[at])
    first = np.searchsorted(at, first)
    # joined runs could equal a neighbour only by a hash's chance; they are then cut apart
    begins = cuts(runs, first[full])
    ends = np.append(begins[1:], len(runs))
    up, down = tb._power_tables(len(runs) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(runs) + 1, U)
        np.cumsum(runs * up[: len(runs)], out=total[1:])
        names = tb.mix((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(U))
    return names, np.searchsorted(begins, first)


def sketches(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Of each text, for each level, the least LISTED distinct 32-bit name hashes, ascending."""
    names, first, levels = tb.BYTE_CODES[data], offsets, []
    for most in LISTED:
        names, first = parse(names, first)
        short = (tb.mix(names + U(tb._STEP)) >> U(32)).astype(np.uint32)
        levels.append([np.unique(short[a:b])[:most] for a, b in zip(first[:-1], first[1:], strict=True)])
    return list(zip(*levels, strict=True))


def listed(sketch: tuple[np.ndarray, ...]) -> str:
    return ".".join(level.astype(">u4").tobytes().hex() for level in sketch)


def likeness(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    """The resemblance of two texts' names as their sketches estimate it; two empty ones are alike."""
    for x, y, most in reversed(list(zip(a, b, LISTED, strict=True))):
        if min(len(x), len(y)) >= FEW:
            break
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.union1d(x, y)[:most]
    return float(np.isin(both, np.intersect1d(x, y, assume_unique=True)).sum() / len(both))


def edit(text: str, following: str) -> str:
    """The last half of the text's code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, fingerprint. Null text: empty, with an empty fingerprint.

    Rows that repeat an id, also a null one, give a row each, equal texts equal
    fingerprints; a text of any length is read whole; other columns don't matter. A map
    over documents: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, prints = [], []
            for _, _, data, offsets in tb.chunks(batch.column(1), CHUNK):
                chars.append(tb.code_points(data, offsets))
                prints += map(listed, sketches(data, offsets))
            chars = np.concatenate(chars) if chars else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chars), pa.array(prints, pa.string())], ["id", "n_chars", "fingerprint"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return out.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, n_chars bigint, fingerprint string").withColumnRenamed("id", id_col)


def _compare(ids: list, texts: list[str], kind: pa.DataType) -> pa.RecordBatch:
    """Rows of the documents but the last, which only follows."""
    after = [edit(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    found = []
    for group in (texts, after):
        found.append([s for _, _, data, offsets in tb.chunks(pa.array(group, pa.string()), CHUNK) for s in sketches(data, offsets)])
    own, edited = found
    columns = [
        pa.array(ids[:-1], kind),
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in after], pa.string()),
        pa.array([listed(s) for s in own[:-1]], pa.string()),
        pa.array([listed(s) for s in edited], pa.string()),
        pa.array([likeness(a, b) for a, b in zip(own[:-1], edited, strict=True)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own[:-1], own[1:], strict=True)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, COLUMNS)


SCHEMA = "doc_id {}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_part: int = PER_PART) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The next document is that of the next id (null ids come first, ties go by a hash of
    the text); after the last comes the first. Null and empty texts are empty; rows that
    repeat an id follow each other and give a row each; a text of any length is read
    whole; columns beside id and text don't matter. Ids may be of any type that has an
    order.

    Documents are dealt to ranges of ids, each text once; a range's first document also
    goes to the range before as its last row's successor. There is a range for per_part
    documents: its limits are quantiles of the ids, up to MAX_RANGES of them, and beyond
    that each is parted into up to MAX_STEPS equal steps of ids, if these are whole
    numbers. Only limits and first ids, so many at most, come to the driver; each range is
    a task of its own, sorted by Spark and read as a stream.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, least, most = texts.agg(F.count("*"), F.min("id"), F.max("id")).first()
    parts = max(1, -(-n // per_part))
    ranges = min(MAX_RANGES, parts)
    limits = []
    if ranges > 1 and least is not None:
        limits = texts.approxQuantile("id", [k / ranges for k in range(1, ranges)], 0.1 / ranges) if whole else _quantiles(texts, n, ranges)
    limits = sorted({int(x) if whole else x for x in limits})
    if whole and least is not None:
        part = _range_of(F.col("id"), [least, *limits, most + 1], min(MAX_STEPS, -(-parts // ranges)))
    else:
        part = _count_up_to(F.col("id"), limits)
    part = F.when(F.col("id").isNull(), 0).otherwise(part).cast("int")
    texts = texts.withColumns({"part": part, "tie": F.xxhash64("text")})
    firsts = [tuple(r) for r in texts.groupBy("part").agg(F.min(F.struct("id", "tie")).alias("x")).select("part", "x.id", "x.tie").orderBy("part").collect()]
    if not firsts:
        return spark.createDataFrame([], SCHEMA.format(kind)).withColumnRenamed("doc_id", id_col)
    moved = spark.createDataFrame([(i, t, p) for (_, i, t), (p, *_) in zip(firsts, firsts[-1:] + firsts[:-1], strict=True)], f"i {kind}, t bigint, before int")
    heads = texts.join(F.broadcast(moved), F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")))
    heads = heads.groupBy("before").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.first("tie").alias("tie"))
    heads = heads.select("id", "text", F.col("before").alias("part"), "tie", F.lit(True).alias("head"))
    both = texts.withColumn("head", F.lit(False)).unionByName(heads)
    dealt = both.repartitionById(firsts[-1][0] + 1, "part").sortWithinPartitions("part", "head", F.col("id").asc_nulls_first(), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, size, at = [], [], 0, None
        for batch in batches:
            for i, text, p, head in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if p != at:
                    ids, rows, size, at = [], [], 0, p
                ids.append(i)
                rows.append(text)
                size += len(text)
                if head or size > CHUNK and len(rows) > 1:
                    yield _compare(ids, rows, batch.column(0).type)
                    ids, rows, size = [i], [text], len(text)

    return dealt.select("id", "text", "part", "head").mapInArrow(run, SCHEMA.format(kind)).withColumnRenamed("doc_id", id_col)


def _quantiles(texts: DataFrame, n: int, ranges: int) -> list:
    """Ids that part the texts into about equal ranges, by the ids whose hashes are smallest, about 16 a range."""
    share = min(1.0, 16 * ranges / n)
    taken = texts.where((F.pmod(F.xxhash64(F.lit("limits"), "id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1) & F.col("id").isNotNull())
    ids = sorted(r["id"] for r in taken.select("id").distinct().collect())
    return [ids[k * len(ids) // ranges] for k in range(1, ranges)] if ids else []


def _range_of(value, limits: list[int], steps: int):
    """The number of the value's range between neighbouring limits, each parted into equal steps."""

    def step(k: int):
        width = max(1, -(-(limits[k + 1] - limits[k]) // steps))
        return F.lit(k * steps) + F.floor((value - limits[k]) / width) if steps > 1 else F.lit(k)

    return _count_up_to(value, limits[1:-1], step)


def _count_up_to(value, limits: list[int], of=F.lit):
    """How many of the sorted limits are at most the value (or `of` of that), by a balanced tree of comparisons."""

    def tree(low: int, high: int):
        if low == high:
            return of(low)
        middle = (low + high) // 2
        return F.when(value < limits[middle], tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(limits))
