"""Quality scores by a factorisation machine.

Inputs are a document's hashed words (log counts, scaled to length one), statistics
of its structure and its length as metadata. With linear weights w and a short
factor v for every input,

    score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)),

so that all pairwise interactions cost one pass over the inputs that aren't zero.
Labels, language, source and ids are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import labelled
from folioflow.llm import textbytes as tb

#: Buckets for hashed words; buckets for the length's order of magnitude.
BUCKETS, SIZES = 1 << 16, 32
STATISTICS = (
    "upper", "digit", "symbol", "bar", "not_ascii", "newline", "word_length", "distinct", "repeated", "commonest", "shouted", "symbol_end", "word_count",
)
FEATURES = BUCKETS + SIZES + len(STATISTICS)
FACTORS = 8
#: Labelled documents of each class that are fitted on, at most.
PER_CLASS = (3000, 3000)
FOLDS, HELD_OUT, CUT = 5, 0, 0.3


class Model(NamedTuple):
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*chars]] = True
    return table


_UPPER = _class(bytes(range(65, 91)))
_DIGIT = _class(b"0123456789")
_SYMBOL = _class(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_PLAIN = _class(b".,;:'\"!?-()")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs of texts that aren't zero: numbers, values, and each text's first one's index.

    A text has FEATURES of them at most, however long it is."""
    n = len(offsets) - 1
    starts, ends, first = tb.spans(~tb.SPACE[data], offsets)
    hashes = tb.span_hashes(data, starts, ends, tb.LOWER_CODES)
    owner, words = tb.owners(first), np.diff(first)
    per_byte, per_word = 1 / np.maximum(np.diff(offsets), 1), 1 / np.maximum(words, 1)

    def share(inside: np.ndarray) -> np.ndarray:
        return tb.sums(inside.astype(np.int64), offsets) * per_byte

    def word_share(inside: np.ndarray) -> np.ndarray:
        return tb.sums(inside.astype(np.int64), first) * per_word

    repeated = np.zeros(len(hashes), bool)
    repeated[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    upper_before = np.concatenate(([0], np.cumsum(_UPPER[data])))
    shouted = upper_before[ends] - upper_before[starts] >= 2
    odd_end = (_SYMBOL & ~_PLAIN)[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    buckets = (hashes % tb.U(BUCKETS)).astype(np.int64)
    order = np.lexsort((buckets, owner))
    sorted_buckets, sorted_owner = buckets[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_buckets[1:] != sorted_buckets[:-1]) | (sorted_owner[1:] != sorted_owner[:-1])
    at = np.flatnonzero(new)
    counts, docs = np.diff(np.append(at, len(order))), sorted_owner[at]
    distinct_first = np.searchsorted(docs, np.arange(n + 1))
    commonest = np.zeros(n)
    np.maximum.at(commonest, docs, counts)
    statistics = np.stack(
        [
            share(_UPPER[data]) * 4, share(_DIGIT[data]) * 10, share(_SYMBOL[data]) * 6, share(data == 0x7C) * 10, share(data >= 0x80) * 2, share(data == 0x0A) * 20,
            np.minimum(np.diff(offsets) * per_word / 10, 3), np.diff(distinct_first) * per_word, word_share(repeated) * 2, commonest * per_word * 2,
            word_share(shouted) * 2, word_share(odd_end) * 2, np.log1p(words) / 10,
        ],
        axis=1,
    )
    values = np.log1p(counts)
    values /= np.sqrt(np.maximum(tb.sums(values**2, distinct_first), 1e-9))[docs]
    size = np.minimum(np.log2(np.diff(offsets) + 1.0).astype(np.int64), SIZES - 1)
    fixed = np.concatenate((np.arange(BUCKETS + SIZES, FEATURES)[None, :].repeat(n, 0), (BUCKETS + size)[:, None]), axis=1)
    fixed_values = np.concatenate((statistics, np.ones((n, 1))), axis=1)
    numbers = np.concatenate((sorted_buckets[at], fixed.ravel()))
    values = np.concatenate((values, fixed_values.ravel()))
    order = np.argsort(np.concatenate((docs, np.arange(n).repeat(fixed.shape[1]))), kind="stable")
    return numbers[order], values[order], distinct_first + np.arange(n + 1) * fixed.shape[1]


def raw_scores(model: Model, numbers: np.ndarray, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    weighted = model.factors[numbers] * values[:, None]
    pairs = tb.sums(weighted, first) ** 2 - tb.sums(weighted**2, first)
    return model.bias + tb.sums(model.linear[numbers] * values, first) + 0.5 * pairs.sum(1)


def fit(texts: pa.Array, labels: np.ndarray, **settings) -> Model:
    """A model of texts and their labels, by `fit_features`."""
    parts = [features(data, offsets) for _, _, data, offsets in tb.chunks(texts)] or [features(np.zeros(0, np.uint8), np.zeros(1, np.int64))]
    numbers, values = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    return fit_features(numbers, values, np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts])))), labels, **settings)


def fit_features(numbers: np.ndarray, values: np.ndarray, first: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.05, shrink: float = 1e-4, seed: int = 7) -> Model:
    """Adagrad on the logistic loss, both classes weighing the same. One class or no rows: its prior."""
    labels = np.asarray(labels, float)
    share = (labels.sum() + 1) / (len(labels) + 2)
    generator = np.random.default_rng(seed)
    linear, factors = np.zeros(FEATURES), generator.normal(0, 0.02, (FEATURES, FACTORS))
    bias = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return Model(bias, linear, factors * 0)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    bias, seen_linear, seen_factors = 0.0, np.full(FEATURES, 1e-2), np.full((FEATURES, FACTORS), 1e-2)
    for _ in range(epochs):
        order = generator.permutation(len(labels))
        for low in range(0, len(order), batch):
            docs = order[low : low + batch]
            sizes = first[docs + 1] - first[docs]
            at = np.repeat(first[docs] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            n, x, here = numbers[at], values[at], np.concatenate(([0], np.cumsum(sizes)))
            weighted = factors[n] * x[:, None]
            total = tb.sums(weighted, here)
            raw = bias + tb.sums(linear[n] * x, here) + 0.5 * (total**2 - tb.sums(weighted**2, here)).sum(1)
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[docs]) * weight[docs] / len(docs)
            owner = np.repeat(np.arange(len(docs)), sizes)
            used, which = np.unique(n, return_inverse=True)
            slope_linear = np.bincount(which, slope[owner] * x, len(used)) + shrink * linear[used]
            grown = (slope[owner] * x)[:, None] * (total[owner] - weighted)
            slope_factors = np.stack([np.bincount(which, grown[:, f], len(used)) for f in range(FACTORS)], 1) + shrink * factors[used]
            seen_linear[used] += slope_linear**2
            seen_factors[used] += slope_factors**2
            linear[used] -= rate * slope_linear / np.sqrt(seen_linear[used])
            factors[used] -= rate * slope_factors / np.sqrt(seen_factors[used])
            bias -= rate * slope.sum()
    return Model(bias, linear, factors)


def fit_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: tuple[int, int] = PER_CLASS, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    """A model of at most per_class labelled documents of each class outside the held-out fold.

    Executors read the texts; only inputs, FEATURES a document at most, come to the
    driver. Without rows of both classes every text scores the prior.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in tb.chunks(batch.column("text")):
                numbers, values, first = features(data, offsets)
                lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x)) for x in (numbers.astype(np.int32), values.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(low, high - low) for c in ("id", "tie", "label")), *lists], ["id", "tie", "label", "numbers", "values"])

    sampled = labelled.sample(docs, labels, label, folds, held_out, per_class)
    kind = dict(sampled.dtypes)["id"]
    rows = labelled.one_each(sampled.mapInArrow(run, f"id {kind}, tie bigint, label int, numbers array<int>, values array<float>").toPandas())
    numbers, values = (np.concatenate([*rows[c], np.zeros(0)]) for c in ("numbers", "values"))
    return fit_features(numbers.astype(np.int64), values, np.concatenate(([0], np.cumsum([len(x) for x in rows["numbers"]]))).astype(np.int64), rows["label"].to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score from 0 to 1. Null and empty texts get the score of no words.

    Rows that repeat an id, also with a null one, each get the score of their own text,
    and equal texts the same. A text of any length is read whole; other columns, of
    whatever name, don't matter. A map over documents; the model, whose size is fixed, is
    broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [raw_scores(shared.value, *features(data, offsets)) for _, _, data, offsets in tb.chunks(batch.column(1))]
            raw = np.clip(np.concatenate(raw) if raw else np.zeros(0), -30, 30)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-raw)))], ["id", "score"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return out.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, score double").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, model).select(
        "doc_id", (labelled.fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
