"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A word's input joins a hashed embedding of the word with the componentwise maximum
of the hashed embeddings of its character trigrams, 4-grams and longer beginnings. A
text is cut into overlapping windows of words; two gated recurrences, one from either side, read a window, attention pools
their states, and a logistic unit scores it. A document's score is that of its
highest window, so every word of a text counts, wherever it stands.

Trained in numpy: the document's label is that of its highest window, so each epoch
scores all windows of the sample and learns from the highest of each document (and,
of documents with label 0, from a random one too). The first component of each
embedding is the signed root of the likelihood ratio statistic of its document counts
in both classes. In the fit a document sees these counts less itself, or else words
that it alone has would seem to tell its label; the other components learn slowly, so
that rare words aren't memorised.
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
from folioflow.llm.storage import freeing, map_texts

#: Words in a window and from one window's start to the next; buckets and widths of the embeddings; units each way.
WINDOW, STRIDE = 96, 72
WORD_BUCKETS, GRAM_BUCKETS, WIDTH, UNITS = 1 << 18, 1 << 17, 4, 8
#: Lengths of the beginnings of a word that are inputs, in bytes with the edge before it.
PREFIXES = (5, 6, 8)
#: Labelled documents of label 0 and of label 1 that are fitted on, at most, and the longest of them in code points.
PER_CLASS, MAX_FIT_CHARS = (3000, 1200), 20_000
#: How much slower the embeddings learn.
SLOW = 0.05
#: The share of all weight that label 1 has in the fit.
PRIOR = 0.3
STEPS = 240
FOLDS, HELD_OUT, CUT = 4, 2, 0.3
#: Bytes of text whose windows are scored together.
CHUNK = 1 << 19


class Words(NamedTuple):
    """The distinct words of some texts and the windows over them (index len(word): padding)."""

    word: np.ndarray
    grams: np.ndarray
    gram_first: np.ndarray
    windows: np.ndarray
    window_first: np.ndarray


def windows_of(first: np.ndarray, pad: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping windows of every document's words; a text without words has none."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
    window_first = np.concatenate(([0], np.cumsum(count)))
    owner = np.repeat(np.arange(len(n)), count)
    at = first[owner] + (np.arange(len(owner)) - window_first[owner]) * STRIDE
    place = at[:, None] + np.arange(WINDOW)
    return np.append(which, pad).astype(np.int32)[np.where(place < first[owner + 1][:, None], place, len(which))], window_first


def read(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, first = tb.spans(~tb.SPACE[data], offsets)
    hashes, at, which = np.unique(tb.span_hashes(data, starts, ends, tb.LOWER_CODES), return_index=True, return_inverse=True)
    low, size = starts[at], (ends - starts)[at]
    # each distinct word between two zero bytes, its trigrams and 4-grams, and its beginnings
    place = np.cumsum(size + 2) - size - 2
    text = np.zeros(int((size + 2).sum()), np.uint8)
    inner = np.repeat(place + 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())
    text[inner] = tb.LOWER[data[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())]]
    letters = tb.BYTE_CODES[text]
    codes = np.concatenate((tb.rolling(letters, 3), tb.rolling(letters, 4)))
    count = 2 * size - 1
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    longer = np.repeat(size, count)
    inner += np.where(inner >= longer, max(0, len(text) - 2) - longer, 0)
    fronts = [tb.span_hashes(text, place, place + np.minimum(k, size + 2)) for k in PREFIXES]
    grams = np.concatenate((codes[np.repeat(place, count) + inner], *fronts))
    order = np.argsort(np.concatenate((np.repeat(np.arange(len(size)), count), *[np.arange(len(size))] * len(fronts))), kind="stable")
    grams, gram_first = grams[order], np.concatenate(([0], np.cumsum(count + len(fronts))))
    windows, window_first = windows_of(first, len(hashes), which)
    return Words((hashes % tb.U(WORD_BUCKETS)).astype(np.int32), (grams % tb.U(GRAM_BUCKETS)).astype(np.int32), gram_first, windows, window_first)


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    inputs, both = 2 * WIDTH, 2 * UNITS
    model = {
        "word": rng.normal(0, 0.05, (WORD_BUCKETS, WIDTH)),
        "gram": rng.normal(0, 0.05, (GRAM_BUCKETS, WIDTH)),
        "attend": rng.normal(0, 0.3, (both, UNITS)),
        "query": rng.normal(0, 0.3, UNITS),
        "out": rng.normal(0, 0.3, both),
        "bias": np.zeros(1),
    }
    for side in ("f", "b"):
        model |= {
            f"in_{side}": rng.normal(0, 0.5 / np.sqrt(inputs), (inputs, 3 * UNITS)),
            f"gate_{side}": np.zeros(3 * UNITS),
            f"state_{side}": rng.normal(0, 0.5 / np.sqrt(UNITS), (UNITS, 3 * UNITS)),
        }
    return {k: v.astype(np.float32) for k, v in model.items()}


def _gram_maxima(rows: np.ndarray, words: Words) -> np.ndarray:
    """The greatest of each word's grams' rows, by component."""
    return np.maximum.reduceat(rows, words.gram_first[:-1], axis=0) if len(words.word) else np.zeros((0, WIDTH), np.float32)


def inputs_of(model: dict[str, np.ndarray], words: Words, seen: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Each distinct word's input, and a row of zeros for padding. seen: other first columns of the embeddings."""
    word, gram = model["word"][words.word], model["gram"][words.grams]
    if seen is not None:  # both are copies, of the rows in use
        word[:, 0], gram[:, 0] = seen["word"][words.word], seen["gram"][words.grams]
    x = np.concatenate((word, _gram_maxima(gram, words)), axis=1)
    return np.concatenate((x, np.zeros((1, x.shape[1]), np.float32)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(model: dict[str, np.ndarray], x: np.ndarray, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Logits of windows; keep, if given, gets what backward() needs."""
    n, mask = len(windows), (windows < len(x) - 1).astype(np.float32)
    states = np.zeros((WINDOW, n, 2 * UNITS), np.float32)
    for side, span in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
        ready, inner = x @ model[f"in_{side}"] + model[f"gate_{side}"], model[f"state_{side}"]
        h, part = np.zeros((n, UNITS), np.float32), slice(0, UNITS) if side == "f" else slice(UNITS, None)
        for t in span:
            given, own = ready[windows[:, t]], h @ inner
            gates = _sigmoid(given[:, : 2 * UNITS] + own[:, : 2 * UNITS])
            z, r = gates[:, :UNITS], gates[:, UNITS:]
            new = np.tanh(given[:, 2 * UNITS :] + r * own[:, 2 * UNITS :])
            step = (1 - z) * (new - h) * mask[:, t, None]
            if keep is not None:
                keep.append((side, t, h, z, r, new, own[:, 2 * UNITS :]))
            h = h + step
            states[t, :, part] = h
    heard = np.tanh(states @ model["attend"])
    weight = heard @ model["query"]
    weight = np.exp(weight - weight.max(0)) * mask.T
    weight /= np.maximum(weight.sum(0), 1e-9)
    pooled = np.einsum("tn,tnd->nd", weight, states)
    if keep is not None:
        keep.append((states, heard, weight, pooled, mask))
    return pooled @ model["out"] + model["bias"][0]


def backward(model: dict[str, np.ndarray], x: np.ndarray, words: Words, windows: np.ndarray, kept: list, slope: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """The loss's slopes by every parameter, from its slopes by the logits; those of the embeddings as (rows, slopes), where rows may repeat."""
    states, heard, weight, pooled, mask = kept[-1]
    slopes = {"out": pooled.T @ slope, "bias": np.array([slope.sum()], np.float32)}
    by_pooled = slope[:, None] * model["out"]
    by_states = weight[:, :, None] * by_pooled[None]
    by_weight = np.einsum("nd,tnd->tn", by_pooled, states)
    by_score = weight * (by_weight - (weight * by_weight).sum(0))
    slopes["query"] = np.einsum("tn,tnu->u", by_score, heard)
    by_heard = by_score[:, :, None] * model["query"] * (1 - heard**2)
    slopes["attend"] = np.einsum("tnd,tnu->du", states, by_heard)
    by_states = by_states + by_heard @ model["attend"].T
    by_x = np.zeros_like(x)
    for side in ("f", "b"):
        part, inner = slice(0, UNITS) if side == "f" else slice(UNITS, None), model[f"state_{side}"]
        by_h, by_inner, by_ready = np.zeros((len(windows), UNITS), np.float32), np.zeros_like(inner), np.zeros((len(x), 3 * UNITS), np.float32)
        for _, t, h, z, r, new, own in reversed([k for k in kept[:-1] if k[0] == side]):
            by_h = by_h + by_states[t, :, part]
            moved = by_h * mask[:, t, None]
            by_new = moved * (1 - z) * (1 - new**2)
            by_z = -moved * (new - h) * z * (1 - z)
            by_r = by_new * own * r * (1 - r)
            by_own = np.concatenate((by_z, by_r, by_new * r), axis=1)
            by_inner += h.T @ by_own
            np.add.at(by_ready, windows[:, t], np.concatenate((by_z, by_r, by_new), axis=1))
            by_h = by_h - moved * (1 - z) + by_own @ inner.T
        by_ready[-1] = 0
        slopes[f"state_{side}"], slopes[f"in_{side}"], slopes[f"gate_{side}"] = by_inner, x.T @ by_ready, by_ready.sum(0)
        by_x += by_ready @ model[f"in_{side}"].T
    grams = model["gram"][words.grams]
    owner = np.repeat(np.arange(len(words.word)), np.diff(words.gram_first))
    by_gram = np.where(grams == _gram_maxima(grams, words)[owner], by_x[owner, WIDTH:], 0)
    return slopes, {"word": (words.word, by_x[:-1, :WIDTH]), "gram": (words.grams, by_gram)}


def _by_row(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and the sums of their slopes."""
    rows, place = np.unique(np.concatenate([r for r, _ in parts]), return_inverse=True)
    total = np.zeros((len(rows), WIDTH), np.float32)
    np.add.at(total, place, np.concatenate([g for _, g in parts]))
    return rows, total


def _document_counts(words: Words, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Documents of label 0 and of label 1 that hold each bucket of words and of grams."""
    docs, inside = tb.owners(words.window_first), words.windows < len(words.word)
    pairs = np.unique(np.repeat(docs, inside.sum(1)).astype(np.int64) * len(words.word) + words.windows[inside])
    docs, which = pairs // max(1, len(words.word)), pairs % max(1, len(words.word))
    size = np.diff(words.gram_first)[which]
    at = np.repeat(words.gram_first[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    counts = {}
    for name, buckets, owner, most in (("word", words.word[which], docs, WORD_BUCKETS), ("gram", words.grams[at], np.repeat(docs, size), GRAM_BUCKETS)):
        pairs = np.unique(owner * most + buckets)
        counts[name] = np.stack([np.bincount((pairs % most)[labels[pairs // most] == c], minlength=most) for c in (0, 1)])
    return counts


def _telling(no: np.ndarray, yes: np.ndarray, share: float) -> np.ndarray:
    """Signed root of the likelihood ratio statistic of document counts, scaled."""
    both = np.maximum(yes + no, 1)
    log = yes * np.log(np.maximum(yes, 1) / (both * share)) + no * np.log(np.maximum(no, 1) / (both * (1 - share)))
    return np.clip(np.sign(yes / both - share) * np.sqrt(np.maximum(2 * log, 0)) / 5, -1, 3)


def _window_logits(model: dict[str, np.ndarray], words: Words, seen: dict[str, np.ndarray] | None = None, step: int = 1 << 12) -> np.ndarray:
    x = inputs_of(model, words, seen)
    found = [forward(model, x, words.windows[i : i + step]) for i in range(0, len(words.windows), step)]
    return np.concatenate(found) if found else np.zeros(0, np.float32)


def _first_look(model: dict[str, np.ndarray], words: Words, seen: dict[str, np.ndarray]) -> np.ndarray:
    """Each window's largest sum of the first components of a word's input."""
    x = inputs_of(model, words, seen)
    x = np.append(x[:-1, 0] + x[:-1, WIDTH], -9)
    return x[words.windows].max(1) if len(words.windows) else np.zeros(0)


def _joined(parts: list[Words]) -> Words:
    """The windows of all parts over the words of all parts."""
    base = np.cumsum([0, *(len(p.word) for p in parts)])
    windows = [np.where(p.windows < len(p.word), p.windows + low, base[-1]).astype(np.int32) for p, low in zip(parts, base, strict=False)]

    def chained(firsts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(np.concatenate([np.diff(f) for f in firsts] or [[]])))).astype(np.int64)

    none = np.zeros(0, np.int32)
    return Words(
        np.concatenate([none, *(p.word for p in parts)]),
        np.concatenate([none, *(p.grams for p in parts)]),
        chained([p.gram_first for p in parts]),
        np.concatenate([np.zeros((0, WINDOW), np.int32), *windows]),
        chained([p.window_first for p in parts]),
    )


def _highest(logits: np.ndarray, window_first: np.ndarray) -> np.ndarray:
    """Each document's highest logit; minus infinity where it has no window."""
    full = window_first[:-1] < window_first[1:]
    out = np.full(len(full), -np.inf)
    if full.any():
        out[full] = np.maximum.reduceat(logits, window_first[:-1][full])
    return out


def fit(texts: pa.Array, labels: np.ndarray, epochs: int = 0, batch: int = 128, rate: float = 0.02, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam (Adagrad for the embeddings) on the logistic loss, label 1 weighing PRIOR of all. epochs 0:
    so many that there are STEPS steps, 6 to 40. One class or no words: its prior."""
    labels, model, rng = np.asarray(labels, np.float32), initial(seed), np.random.default_rng(seed)
    spans = list(tb.chunks(texts, CHUNK))
    parts = [read(data, offsets) for _, _, data, offsets in spans]
    words = _joined(parts)
    full = np.flatnonzero(np.diff(words.window_first))
    if len(set(labels[full].tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        model["out"][:], model["bias"][:] = 0, np.log(share / (1 - share))
        return model
    owner = tb.owners(words.window_first)
    counts = {"word": np.zeros((2, WORD_BUCKETS), np.int64), "gram": np.zeros((2, GRAM_BUCKETS), np.int64)}
    for part, (low, high, *_) in zip(parts, spans, strict=True):
        for name, found in _document_counts(part, labels[low:high]).items():
            counts[name] += found
    # what a document of either label sees in the fit: the counts of all documents but itself
    seen = [{k: _telling(np.maximum(no - (c == 0), 0), np.maximum(yes - (c == 1), 0), labels.mean()).astype(np.float32) for k, (no, yes) in counts.items()} for c in (0, 1)]

    def looked(look) -> np.ndarray:
        """What each window of the sample gives, under the counts that its document sees."""
        found = []
        for part, (low, high, *_) in zip(parts, spans, strict=True):
            own, logits = np.repeat(labels[low:high], np.diff(part.window_first)), np.zeros(len(part.windows))
            for c in (0, 1):
                at = np.flatnonzero(own == c)
                logits[at] = look(model, part._replace(windows=part.windows[at]), seen[c])
            found.append(logits)
        return np.concatenate(found)

    share = labels[full].mean()
    epochs = epochs or int(np.clip(STEPS * batch // len(full), 6, 40))
    first, second, steps = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}, 0
    for epoch in range(epochs):
        pace = rate * (1 - 0.9 * epoch / epochs)
        # before anything is learned, the window with the most telling words stands for its document; then
        # the highest by the network, which is asked again after 1, 2, 4, 8 ... epochs, as it changes less and less
        if epoch & (epoch - 1) == 0:
            ranked = np.lexsort((looked(_window_logits if epoch else _first_look), owner))
        picked = ranked[words.window_first[full + 1] - 1]
        plain = full[labels[full] == 0]
        picked = np.concatenate((picked, words.window_first[plain] + rng.integers(0, np.diff(words.window_first)[plain])))
        order = rng.permutation(picked)
        for low in range(0, len(order), batch):
            steps += 1
            at = order[low : low + batch]
            parts_, inputs, slope_of = [], [], []
            for c in (0, 1):  # each label's windows with what its documents see, then all in one pass
                own = at[labels[owner[at]] == c]
                used, local = np.unique(np.append(words.windows[own].ravel(), len(words.word)), return_inverse=True)
                parts_.append(_subset(words, used[:-1])._replace(windows=local[:-1].reshape(len(own), WINDOW), window_first=np.array([0, len(own)])))
                inputs.append(inputs_of(model, parts_[-1], seen[c])[:-1])
                slope_of.append(np.full(len(own), (PRIOR / share if c else 0.5 * (1 - PRIOR) / (1 - share)) / len(at)))
            both, kept, truth = _joined(parts_), [], np.repeat([0, 1], [len(w) for w in slope_of])
            x = np.concatenate((*inputs, np.zeros((1, 2 * WIDTH), np.float32)))
            chance = _sigmoid(forward(model, x, both.windows, kept))
            slopes, of_rows = backward(model, x, both, both.windows, kept, ((chance - truth) * np.concatenate(slope_of)).astype(np.float32))
            for k, found in of_rows.items():  # only the rows in use
                at, g = _by_row([found])
                second[k][at] += g**2
                model[k][at] -= pace * SLOW * g / (np.sqrt(second[k][at]) + 1e-6)
            for k, g in slopes.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g**2
                model[k] -= pace * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.99**steps)) + 1e-6)
    for k, (no, yes) in counts.items():
        model[k][:, 0] = _telling(no, yes, labels.mean())
    return model


def _subset(words: Words, at: np.ndarray) -> Words:
    size = np.diff(words.gram_first)[at]
    place = np.repeat(words.gram_first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return Words(words.word[at], words.grams[place], np.concatenate(([0], np.cumsum(size))), words.windows[:0], words.window_first[:1])


def fit_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: tuple[int, int] = PER_CLASS, folds: int = FOLDS, held_out: int = HELD_OUT, max_chars: int = MAX_FIT_CHARS) -> dict[str, np.ndarray]:
    """A model of at most per_class labelled documents of each class outside the held-out
    fold, picked among those of at most max_chars code points. Without any, all texts
    that have words score the prior.

    One task fits it on this sample, whose size is bounded; the driver gets the model alone."""
    rows = labelled.sample(docs, labels, label, folds, held_out, per_class, max_chars).select("id", "tie", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (given := list(batches)):
            return
        given = pa.Table.from_batches(given)
        order = labelled.one_each(given.select(["id", "tie", "label"]).to_pandas().assign(at=np.arange(len(given))))
        texts = given.column("text").combine_chunks().take(pa.array(order["at"].to_numpy()))
        del given
        for name, values in fit(texts, order["label"].to_numpy()).items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([list(values.shape)], pa.list_(pa.int32())), pa.array([values.tobytes()], pa.binary())], ["name", "shape", "data"])

    found = rows.repartition(1).mapInArrow(freeing(run), "name string, shape array<int>, data binary").collect()
    model = {r["name"]: np.frombuffer(r["data"], np.float32).reshape(r["shape"]) for r in found}
    return model or fit(pa.array([], pa.string()), np.zeros(0))


def score_column(model: dict[str, np.ndarray], column: pa.Array) -> np.ndarray:
    found = []
    for _, _, data, offsets in tb.chunks(column, CHUNK):
        words = read(data, offsets)
        found.append(_highest(_window_logits(model, words), words.window_first))
    raw = np.concatenate(found) if found else np.zeros(0)
    return np.where(np.isneginf(raw), 0.0, _sigmoid(raw.astype(np.float64)))


def score(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per document: id (with keep: every column) and score from 0 to 1. Null,
    empty and blank texts score 0.

    Rows that repeat an id, also with a null one, each get the score of their own text,
    and equal texts the same. A text of any length is scored whole, window by window. With
    keep, a column named score is replaced; other names don't matter. A map over
    documents; the model, whose size is fixed, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda: lambda texts: [pa.array(score_column(shared.value, texts), pa.float64())], "score double", id_col, text_col, keep)


def classify(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, model).select(
        "doc_id", (labelled.fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
