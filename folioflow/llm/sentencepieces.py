"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

A text gets a space in front and is parted before every run of spaces; no piece
spans such a place, so each part is searched by itself and each distinct part of a
chunk once. Parts of equal length advance together: hashes of all their substrings
of a length probe the sorted hashes of the pieces, and at each end position the
best sum of scores and its piece are kept as the backpointer. A byte that no piece
covers takes its byte piece at a score below every other, so every text can be
encoded and decoding gives it back exactly. Among equal sums the longest last piece
wins. U+2581 in a text, with which models write a space, is encoded by bytes.

A model whose scores are merge ranks gives no log-probabilities. For these the
score of the piece of rank r is -log(r + 2), as if its frequency followed Zipf's law
(``scores="zipf"``); ``scores="model"`` takes the file's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioflow.llm import textbytes as tb
from folioflow.llm.storage import freeing

#: Bytes of text whose distinct parts are searched together, and matrix cells at once.
CHUNK, CELLS, STEP = 1 << 21, 1 << 18, 1 << 18
U = np.uint64


class Pieces(NamedTuple):
    """A vocabulary; spaces stand as spaces, byte pieces are single bytes."""

    ids: np.ndarray
    texts: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    size: int


def load_pieces(path: str, scores: str = "zipf") -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, texts, weights, byte_ids = [], [], [], np.full(256, -1, np.int32)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            ids.append(i)
            texts.append(piece.replace("▁", " ").encode())
            weights.append(model.get_score(i))
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces, so it can't encode every text")
    weights = np.array(weights)
    if scores == "zipf":
        weights = -np.log(np.argsort(np.argsort(-weights, kind="stable")) + 2.0)
    return Pieces(np.array(ids, np.int32), texts, weights, byte_ids, model.get_piece_size())


def _plain_hash(text: bytes) -> int:
    total = 0
    for k, byte in enumerate(text):
        total += int(tb.BYTE_CODES[byte]) * pow(tb._BASE, k, 1 << 64)
    return total % (1 << 64)


class Codec:
    def __init__(self, pieces: Pieces):
        usable = [i for i, t in enumerate(pieces.texts) if t and b" " not in t.lstrip(b" ")]
        keys = np.array([_plain_hash(pieces.texts[i]) for i in usable], U)
        lengths = np.array([len(pieces.texts[i]) for i in usable])
        order = np.argsort(keys)
        self.keys, self.lengths = keys[order], lengths[order]
        self.ids, self.scores = pieces.ids[usable][order], pieces.scores[usable][order]
        self.byte_ids, self.byte_score = pieces.byte_ids, float(pieces.scores.min()) - 10.0
        self.all_lengths = np.unique(lengths)
        self.some = np.zeros(1 << 20, bool)
        self.some[(self.keys >> U(44)).astype(np.int64)] = True
        by_id = [b""] * pieces.size
        for i, text in zip(pieces.ids, pieces.texts, strict=True):
            by_id[i] = text
        for byte, i in enumerate(pieces.byte_ids):
            by_id[i] = bytes([byte])
        self.piece_sizes = np.array([len(t) for t in by_id])
        self.piece_starts = np.concatenate(([0], np.cumsum(self.piece_sizes)))
        self.piece_bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def _matches(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces stand in rows of equal length: row, start, end, place among the keys; by end."""
        n, size = parts.shape
        up, down = tb._power_tables(size + 1)
        found = []
        with np.errstate(over="ignore"):
            sums = np.zeros((n, size + 1), U)
            np.cumsum(tb.BYTE_CODES[parts] * up[:size], axis=1, out=sums[:, 1:])
            for k in self.all_lengths[self.all_lengths <= size]:
                hashes = (sums[:, k:] - sums[:, :-k]) * down[: size - k + 1]
                row, start = np.nonzero(self.some[(hashes >> U(44)).astype(np.int64)])
                at = np.searchsorted(self.keys, hashes[row, start])
                at[at == len(self.keys)] = 0
                good = (self.keys[at] == hashes[row, start]) & (self.lengths[at] == k)
                found.append((row[good], start[good], start[good] + k, at[good]))
        row, start, end, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((start, row, end))
        return row[order], start[order], end[order], at[order]

    def search(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best pieces of rows of equal length: all ids in a row, and how many each row has."""
        n, size = parts.shape
        row, start, end, at = self._matches(parts)
        cuts = np.searchsorted(end, np.arange(size + 2))
        best = np.zeros((size + 1, n))
        came, piece = np.zeros((size + 1, n), np.int32), np.zeros((size + 1, n), np.int32)
        for e in range(1, size + 1):
            best[e] = best[e - 1] + self.byte_score
            came[e], piece[e] = e - 1, self.byte_ids[parts[:, e - 1]]
            low, high = cuts[e], cuts[e + 1]
            if low == high:
                continue
            rows, starts = row[low:high], start[low:high]
            sums = best[starts, rows] + self.scores[at[low:high]]
            np.maximum.at(best[e], rows, sums)
            # of equal sums the longest piece: written last, so that it stands
            win = np.flatnonzero(sums == best[e][rows])[::-1]
            came[e][rows[win]], piece[e][rows[win]] = starts[win], self.ids[at[low:high][win]]
        steps, place, every = [], np.full(n, size), np.arange(n)
        while (place > 0).any():
            on = place > 0
            steps.append(np.where(on, piece[place, every], -1))
            place = np.where(on, came[place, every], 0)
        table = np.array(steps[::-1]).T if steps else np.zeros((n, 0), np.int32)
        return table[table >= 0], (table >= 0).sum(1)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, all in a row, and n + 1 offsets into them. An empty text has none."""
        full = offsets[:-1] < offsets[1:]
        data = np.insert(data, offsets[:-1][full], 0x20)
        offsets = offsets + np.concatenate(([0], np.cumsum(full)))
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        begins = data == 0x20
        begins[1:] &= data[:-1] != 0x20
        begins[offsets[:-1][full]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        hashes = np.concatenate([self._hashes(data, starts[i : i + 50_000], ends[i : i + 50_000]) for i in range(0, len(starts), 50_000)])
        _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        starts_u, sizes = starts[at], (ends - starts)[at]
        order = np.argsort(sizes, kind="stable")
        made, counts = [], []
        low = 0
        while low < len(order):
            size = sizes[order[low]]
            high = min(int(np.searchsorted(sizes[order], size, "right")), low + max(1, CELLS // int(size)))
            parts = data[starts_u[order[low:high]][:, None] + np.arange(size)]
            ids, count = self.search(parts)
            made.append(ids)
            counts.append(count)
            low = high
        made, counts = np.concatenate(made), np.concatenate(counts)
        place, count = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        place[order], count[order] = np.cumsum(counts) - counts, counts
        ids = _gather(made, place[which], count[which])
        first = np.searchsorted(starts, offsets)
        return ids.astype(np.int32), np.concatenate(([0], np.cumsum(count[which])))[first]

    @staticmethod
    def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return tb.span_hashes(data[starts[0] : ends[-1]], starts - starts[0], ends - starts[0])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes and n + 1 offsets: the pieces' bytes less the space in front."""
        sizes = self.piece_sizes[ids]
        data = _gather(self.piece_bytes, self.piece_starts[ids], sizes)
        offsets = np.concatenate(([0], np.cumsum(sizes)))[offsets]
        full = offsets[:-1] < offsets[1:]
        data = np.delete(data, offsets[:-1][full & (data[np.minimum(offsets[:-1], max(0, len(data) - 1))] == 0x20 if len(data) else full)])
        return data, offsets - np.concatenate(([0], np.cumsum(full)))


def _gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranges of values, one after another; places are made for about STEP values at a time."""
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, values.dtype)
    low = done = 0
    while low < len(counts):
        high = max(low + 1, int(np.searchsorted(ends, done + STEP, "right")))
        last = int(ends[high - 1])
        shift = np.repeat(starts[low:high] - (ends[low:high] - counts[low:high]), counts[low:high])
        out[done:last] = values[np.arange(done, last) + shift]
        low, done = high, last
    return out


def _schema(df: DataFrame, id_col: str, extra: str) -> str:
    return f"id {dict(df.dtypes)[id_col]}, {extra}"


def encode_documents(docs: DataFrame, model_path: str, scores: str = "zipf", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_pieces, pieces array<int>, decoded_sha256, round_trip.

    decoded_sha256 is of the text decoded from the pieces again and round_trip says
    whether that is the text, byte for byte. Null and empty texts have no pieces and
    decode to the empty text. Rows that repeat an id, also a null one, give a row each,
    equal texts equal pieces; columns beside id and text, of whatever name, don't matter.
    A text of any length is encoded whole, part by part. A map over documents: no shuffle; the vocabulary,
    bounded by its file, is broadcast.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(model_path, scores))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(pieces.value)
        for batch in batches:
            for low, high, data, offsets in tb.chunks(batch.column(1), CHUNK):
                ids, at = codec.encode(data, offsets)
                again, places = codec.decode(ids, at)
                raw, was = again.tobytes(), data.tobytes()
                texts = [raw[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
                same = [t == was[a:b] for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array(np.diff(at)),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                        pa.array(same, pa.bool_()),
                    ],
                    ["id", "n_pieces", "pieces", "decoded_sha256", "round_trip"],
                )

    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = _schema(docs, id_col, "n_pieces bigint, pieces array<int>, decoded_sha256 string, round_trip boolean")
    return out.mapInArrow(freeing(encode), schema).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """One row per row of pieces: id, text. Null and empty lists give the empty text.

    Pieces that aren't whole UTF-8 in a row decode with replacement characters. Rows that
    repeat an id, also a null one, give a row each; other columns don't matter.
    """
    pieces = encoded.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(pieces.value)
        for batch in batches:
            lists = batch.column(1).to_pylist()
            sizes = [len(x or ()) for x in lists]
            ids = np.array([i for x in lists for i in x or ()], np.int32)
            data, at = codec.decode(ids, np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))))
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    out = encoded.select(encoded[id_col].alias("id"), encoded[pieces_col].alias("pieces"))
    return out.mapInArrow(decode, _schema(encoded, id_col, "text string")).withColumnRenamed("id", id_col)
