"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces are counted without being built. The vocabulary
is a trie; a node's failure link leads to where matching goes on once the longest
piece (or pieces) at the node's front has been taken off, and its popped count says
how many pieces that were. So every character is read once, however often a match
fails (the linear WordPiece algorithm of Song et al., 2021).

Words are maximal runs of non-space. A word starts with the mark U+2581; pieces
without the mark continue one. A word that the vocabulary can't cover counts as
one unknown token.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioflow.llm import textbytes as tb

MARK = "▁"
#: Words whose counts a task remembers at most; forgetting costs time only.
MEMO = 400_000
#: Bytes of text whose distinct words are counted together.
CHUNK = 1 << 22


def load_pieces(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model file, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)]


class LongestMatch:
    """The automaton. States are numbers: 0 starts a word, 1 is the trie of continuing pieces."""

    def __init__(self, pieces: Iterable[str]):
        pieces = [p for p in dict.fromkeys(pieces) if p and MARK not in p[1:]]
        self.next: list[dict[str, int]] = [{}, {}]
        piece_end = [False, False]
        for piece in pieces:
            state = 0 if piece[0] == MARK else 1
            for char in piece:
                at = self.next[state].get(char)
                if at is None:
                    at = self.next[state][char] = len(self.next)
                    self.next.append({})
                    piece_end.append(False)
                state = at
            piece_end[state] = True
        # fail[s]: the state after taking off the pieces at the front of s's string; -1: it can't be covered.
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        todo = deque((at, root, char) for root in (0, 1) for char, at in self.next[root].items())
        while todo:
            state, parent, char = todo.popleft()
            if piece_end[state]:
                self.fail[state], self.popped[state] = 1, 1
            else:
                back, popped = self.fail[parent], self.popped[parent]
                while back >= 0 and char not in self.next[back]:
                    popped += self.popped[back]
                    back = self.fail[back]
                if back >= 0:
                    self.fail[state], self.popped[state] = self.next[back][char], popped
            todo.extend((at, state, c) for c, at in self.next[state].items())

    def count(self, word: str) -> int:
        """Greedy pieces of the marked word; 0 if it can't be covered."""
        following, fail, popped, state, n = self.next, self.fail, self.popped, 0, 0
        for char in MARK + word:
            while (at := following[state].get(char)) is None:
                n += popped[state]
                state = fail[state]
                if state < 0:
                    return 0
            state = at
        while state != 1:
            n += popped[state]
            state = fail[state]
            if state < 0:
                return 0
        return n


class WordCounter:
    """Counts per document, each distinct word of a chunk going through the automaton once."""

    def __init__(self, pieces: list[str]):
        self.automaton, self.known = LongestMatch(pieces), {}

    def words(self, hashes: np.ndarray, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        if len(self.known) > MEMO:
            self.known.clear()
        for i, (key, word) in enumerate(zip(hashes.tolist(), words, strict=True)):
            n = self.known.get(key)
            if n is None:
                n = self.known[key] = self.automaton.count(word)
            out[i] = n
        return out

    def column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, tokens and unknown words of each text."""
        parts = []
        for _, _, data, offsets in tb.chunks(column, CHUNK):
            starts, ends, first = tb.spans(~tb.SPACE[data], offsets)
            hashes, at, which = np.unique(tb.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            raw = data.tobytes()
            n = self.words(hashes, [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at], ends[at], strict=True)])
            n = n[which] if len(n) else np.zeros(0, np.int64)
            parts.append((np.diff(first), tb.sums(np.maximum(n, 1), first), tb.sums((n == 0).astype(np.int64), first)))
        return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_tokens, n_unknown.

    Null and empty texts have none of each. Rows that repeat an id, also a null one,
    give a row each; columns beside id and text, of whatever name, don't matter. A text
    of any length is counted whole, each distinct word of a chunk once. A map over
    documents: the vocabulary, bounded by its file, is read once on the driver and
    broadcast; no shuffle.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(model_path))
    kind = dict(docs.dtypes)[id_col]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordCounter(pieces.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counter.column(batch.column(1)))], ["id", "n_words", "n_tokens", "n_unknown"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return out.mapInArrow(count, f"id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint").withColumnRenamed("id", id_col)
