"""Secret scans: pattern spans, and windows of high Shannon entropy.

Candidates for the entropy test are maximal runs of key characters. A window of
fixed width slides over each; the window's character counts change by one that
leaves and one that enters, and with them the sum of c*log2(c) from which the
entropy follows. Each character class has its own threshold. Windows above it
that touch are one span. An allow list suppresses candidates that look random
but aren't secret.

A map over documents: no shuffle. Null text counts as empty and has no spans.
Repeated rows, also of a null id, give repeated results; columns beside id and text,
of whatever name, don't matter. A text of any length is scanned whole, in time linear
in its length; positions are code points, ends exclusive. Spans that start together
stand in the order of KINDS, equal ones of a kind by their end.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioflow.llm import textbytes as tb

#: The kinds, in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
WINDOW = 20
#: Bits per character in a window, at least, by the candidate's class: what about 98 of 100 random windows
#: reach over 10 digits, 16 hex digits, 26 letters of one case, 32 characters of one case, 52 characters.
THRESHOLDS = {"digits": 2.55, "hex": 2.9, "letters": 3.25, "single": 3.35, "mixed": 3.6}
#: Whole candidates that are no secrets: UUIDs, dates and times; and words, by looks_worded.
ALLOWED = re.compile(
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
    r"|[0-9]{4}-[0-9]{2}-[0-9]{2}[0-9T:_-]*"
)
_JOINTS = re.compile(r"[-_/=+]+")
_PART = re.compile(r"([A-Za-z]+)[0-9]{0,4}|[0-9]{1,8}")
_HUMPS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_HARD = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}|[aeiou]{5}", re.IGNORECASE)
_VOWEL = re.compile(r"[aeiouy]", re.IGNORECASE)
_RARE = re.compile(r"[jkqvwxyz]", re.IGNORECASE)
#: Digits in words at most: a date and a time.
MOST_DIGITS = 14
#: Words without a vowel.
_SPELT = frozenset("html http https xhtml mysql".split())

_KEY = np.zeros(256, bool)
_KEY[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True


def character_class(text: str) -> str:
    if re.fullmatch("[0-9]+", text):
        return "digits"
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", text):
        return "hex"
    if re.fullmatch("[a-z_/+=-]+|[A-Z_/+=-]+", text):
        return "letters"
    return "single" if re.fullmatch("[a-z0-9_/+=-]+|[A-Z0-9_/+=-]+", text) else "mixed"


def looks_worded(text: str) -> bool:
    """Whether a candidate is words, with short numbers, joined by - _ / = + or capitals.

    Words of four letters or more have a vowel, and neither five consonants nor five
    vowels in a row; words have three letters on average, and letters that are rare in
    most languages are a fifth at most.
    """
    humps = []
    for part in filter(None, _JOINTS.split(text)):
        whole = _PART.fullmatch(part)
        if whole is None:
            return False
        humps += _HUMPS.findall(whole[1] or "")
    letters = "".join(humps)
    if len(letters) < 3 * len(humps) or 5 * len(_RARE.findall(letters)) > len(letters):
        return False
    if sum(c.isdigit() for c in text) > MOST_DIGITS:
        return False
    return all(len(h) < 4 or h.lower() in _SPELT or (_VOWEL.search(h) and not _HARD.search(h)) for h in humps)


def entropy_spans(text: str, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> list[tuple[int, int]]:
    """Unions of the candidate's windows whose entropy reaches its class's threshold.

    A candidate shorter than the window has none.
    """
    if len(text) < window or ALLOWED.fullmatch(text) or looks_worded(text):
        return []
    least = thresholds[character_class(text)]
    log = [0.0, *(c * math.log2(c) for c in range(1, window + 1))]
    counts: dict[str, int] = {}
    total, found = 0.0, []
    for i, char in enumerate(text):
        if i >= window:
            c = counts[gone := text[i - window]]
            counts[gone] = c - 1
            total += log[c - 1] - log[c]
        c = counts.get(char, 0)
        counts[char] = c + 1
        total += log[c + 1] - log[c]
        if i >= window - 1 and math.log2(window) - total / window >= least - 1e-9:
            if found and found[-1][1] >= i - window + 1:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((i - window + 1, i + 1))
    return found


def scan_text(text: str, hex_runs: list[tuple[int, int]], candidates: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """All spans of a text whose hex runs and candidates are known."""
    found = []
    folded = text.lower()
    if any(word in folded for word in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [("hex", *x) for x in hex_runs]
    for low, high in candidates:
        found += [("entropy", low + a, low + b) for a, b in entropy_spans(text[low:high])]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _places(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of at least so many bytes, and their documents."""
    starts, ends, _ = tb.spans(inside, offsets)
    keep = ends - starts >= least
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def scan_column(column: pa.Array) -> Iterator[list[tuple[str, int, int]]]:
    """The spans of each text of a string column."""
    for _, _, data, offsets in tb.chunks(column):
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        by_doc: dict[int, tuple[list, list]] = {}
        for kind, places in enumerate((_places(data, offsets, _HEX[data], MIN_HEX), _places(data, offsets, _KEY[data], WINDOW))):
            for start, end, doc in zip(*places, strict=True):
                low = int(chars[start] - chars[offsets[doc]])
                by_doc.setdefault(int(doc), ([], []))[kind].append((low, low + int(end - start)))
        raw = data.tobytes()
        for doc in range(len(offsets) - 1):
            text = raw[offsets[doc] : offsets[doc + 1]].decode("utf-8", "replace")
            yield scan_text(text, *by_doc.get(doc, ((), ())))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and its spans as (kind, start, end), sorted."""
    kind = dict(docs.dtypes)[id_col]
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in scan_column(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span_type)], ["id", "spans"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(
        scan, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    )
    return out.withColumnRenamed("id", id_col)


def digest(spans: list[tuple[str, int, int]]) -> tuple[str, str]:
    """The two strings of the contract, for tests."""
    said = [f"{k}:{a}:{b}" for k, a, b in spans]
    base = ",".join(x for x in said if not x.startswith("entropy"))
    return hashlib.sha256(base.encode()).hexdigest(), ",".join(said)
