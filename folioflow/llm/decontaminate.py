"""Benchmark decontamination by template canonicalisation.

Numbers (in digits or words), units after numbers and names (capitalised inside a sentence,
and where such a name opens another sentence of the text) are replaced by typed
placeholders; what they stood for are the slots. Windows of the
resulting template, and of the plain words, are hashed and joined with those of the
benchmark's items; some windows leave one word free, so that words beside a changed one
match too. Matching windows of one document and item on one diagonal must
fill slots consistently: a value of the item always by the same value of the
document. So a question asked again with other numbers or names is caught, and a
chance likeness of templates isn't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import textbytes as tb
from folioflow.llm.skew import look_up
from folioflow.llm.storage import freeing, written

U = np.uint64
#: Words in a window; items of fewer words are one window, of plain words only if they have fewer than the second.
WINDOW, SHORTEST = 8, 4
#: (words, the free one's place or -1) of the windows of items: of each size as a whole, with any one word free, and with the middle word free.
WHOLE, ANY_FREE, SPLIT = [(n, -1) for n in range(1, WINDOW + 1)], [(WINDOW, k) for k in range(WINDOW)], (WINDOW + 1, WINDOW // 2)
#: Words of an item that are a leak if they match on one diagonal.
LONG = 13
#: In a window's slots, the free word; slots are odd.
FREE = 2
#: The share of an item's windows whose words must match, next to each other or not, and of a window's words, those that must be literal on a diagonal of templates, at least.
SHARE, LITERAL = 0.5, 0.6
#: Bits of the filter of a benchmark's windows that is broadcast (8 MB, whatever the benchmark's size), and how many a window sets.
FILTER_BITS, PROBES = 26, 2
# Units and numbers as words of the corpus's languages, but for those that are everyday words of another (once, seize, cent, neuf).
UNITS = (
    "mm cm m km inch inches feet ft yard yards mile miles mg g kg t lb lbs oz ml l liter liters litre litres gallon gallons pound pounds ounce ounces "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents "
    "mph kmh degrees watt watts kwh volt volts meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms ton tons tonne tonnes "
    "metern kilometern zentimeter stunde stunden minuten sekunde sekunden tag tage tagen woche wochen monat monate jahr jahre jahren gramm kilogramm kilo tonnen pfund prozent grad meilen "
    "mètre mètres kilomètre kilomètres centimètre centimètres heure heures seconde secondes jour jours semaine semaines mois ans année années gramme grammes degrés "
    "metro metros kilómetro kilómetros centímetro centímetros hora horas minuto minutos segundo segundos día días semana semanas mes meses año años gramo gramos kilos litro litros tonelada toneladas grados millas"
).split()
_TENS = {
    "en": "twenty thirty forty fifty sixty seventy eighty ninety", "de": "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig", "fr": "vingt trente quarante cinquante soixante", "es": "veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa",
}
_ONES = {
    "en": "one two three four five six seven eight nine", "de": "ein zwei drei vier fünf sechs sieben acht neun", "fr": "un deux trois quatre cinq six sept huit", "es": "dos tres cuatro cinco seis siete ocho nueve",
}
_MORE = (
    "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn hundert tausend "
    "dix onze douze treize quatorze quinze vingts mille diez doce trece catorce quince cien ciento"
).split()


def _number_words() -> set[str]:
    """All of these, and the ones after or before the tens, joined as punctuation leaves them (twenty-five, fünfundzwanzig, vingt-cinq)."""
    tens, ones = ({k: v.split() for k, v in words.items()} for words in (_TENS, _ONES))
    joined = [t + o for k in ("en", "fr") for t in tens[k] for o in ones[k]] + [f"{o}und{t}" for t in tens["de"] for o in ones["de"]]
    single = [w for words in (*tens.values(), *ones.values()) for w in words if w not in ("ein", "un")]
    return {*_MORE, *joined, *single}


NUMBER_WORDS = _number_words()
#: Signs of currency that aren't ASCII, which part no number from its digits.
SIGNS = "€£"

_KEPT = np.zeros(256, bool)
_KEPT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_KEPT |= tb.SPACE
_ENDS = np.zeros(256, bool)
_ENDS[[*b".!?:;\n\"|"]] = True
_UNIT_HASHES, _NUMBER_HASHES = (np.sort([tb.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]), tb.LOWER_CODES)[0] for w in words]) for words in (UNITS, NUMBER_WORDS))
_NUMBER, _UNIT, _NAME = tb.mix(np.arange(101, 104, dtype=U))
_PLAIN = U(0x5851F42D4C957F2D)


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word, punctuation left out: its hash, its template's hash, its slot value (0: literal); and
    each document's first word's index."""
    kept = _KEPT[data]
    for sign in SIGNS:
        bytes_ = sign.encode()
        hit = np.flatnonzero(data == bytes_[0])
        for k, byte in enumerate(bytes_[1:], 1):
            hit = hit[data[np.minimum(hit + k, len(data) - 1)] == byte]
        for k in range(len(bytes_)):
            kept[hit + k] = False
    at = np.flatnonzero(kept)
    text, offsets = data[at], np.concatenate(([0], np.cumsum(kept)))[offsets]
    starts, ends, first = tb.spans(~tb.SPACE[text], offsets)
    words = tb.span_hashes(text, starts, ends, tb.LOWER_CODES)
    if not len(words):
        return words, words, words, first
    opened = np.cumsum(_ENDS[data])[at[starts]]
    begins = np.ones(len(words), bool)
    begins[1:] = opened[1:] > opened[:-1]
    edge = first[:-1][first[:-1] < first[1:]]
    begins[edge] = True
    digits = np.concatenate(([0], np.cumsum((text >= 0x30) & (text <= 0x39))))
    number = (text[starts] >= 0x30) & (text[starts] <= 0x39) & (2 * (digits[ends] - digits[starts]) >= ends - starts) | np.isin(words, _NUMBER_HASHES)
    after = np.zeros(len(words), bool)
    after[1:] = number[:-1]
    after[edge] = False
    unit = np.zeros(len(words), bool)
    unit[after] = np.isin(words[after], _UNIT_HASHES)
    head, second = text[starts], text[np.minimum(starts + 1, len(text) - 1)]
    capital = ((head >= 0x41) & (head <= 0x5A)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    capital &= (ends - starts > 1) & ~number
    name = capital & ~begins
    own = tb.mix(words + tb.owners(first).astype(U) * U(tb._STEP))
    name |= capital & np.isin(own, own[name])
    template = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, words)))
    return words, template, np.where(number | unit | name, words | U(1), U(0)), first


def _windows(rolled: Callable[[bool, int], np.ndarray], slots: np.ndarray, first: np.ndarray, size: int, free: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(hashes, first word) of the windows of so many words: plain ones, then templates with slots."""
    owner = tb.owners(first)
    at = np.flatnonzero(np.arange(len(slots)) + size <= first[1:][owner]) if len(slots) else np.zeros(0, np.int64)

    def hashes(templated: bool, at: np.ndarray) -> np.ndarray:
        if free < 0:
            return rolled(templated, size)[at]
        out = np.full(len(at), tb.mix(np.array([1000 * size + free], U))[0])
        for low, n in ((0, free), (free + 1, size - free - 1)):
            if n:
                out = tb.mix(out ^ rolled(templated, n)[at + low])
        return out

    yield hashes(False, at) ^ _PLAIN, at, False
    filled = np.concatenate(([0], np.cumsum(slots != 0)))
    n = filled[at + size] - filled[at]
    if free >= 0:
        n -= slots[at + free] != 0
    at = at[n > 0]
    yield hashes(True, at), at, True


def window_filter(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter of the column hash, as packed bits. Spark ors the bits together; the driver gets at most 2**FILTER_BITS of them."""
    places = F.explode(F.array(*[F.shiftrightunsigned("hash", 64 - FILTER_BITS * (k + 1)).bitwiseAND((1 << FILTER_BITS) - 1) for k in range(PROBES)]))
    bits = wanted.select(places.alias("place")).groupBy(F.shiftright("place", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(place & 7 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    out[bits["byte"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.uint8)
    return out


def _coarse(bits: np.ndarray) -> np.ndarray:
    """Whether any hash with the first bits, FILTER_BITS - 6 of them, can pass: a look at little memory that settles most."""
    return bits.reshape(-1, 8).any(1)


def _passes(bits: np.ndarray, coarse: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Indexes of the hashes that the filter lets through."""
    at = np.flatnonzero(coarse[(hashes >> U(70 - FILTER_BITS)).astype(np.int64)])
    for k in range(PROBES):
        place = ((hashes[at] >> U(64 - FILTER_BITS * (k + 1))) & U((1 << FILTER_BITS) - 1)).astype(np.int64)
        at = at[(bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
    return at


def windows(docs: DataFrame, id_col: str, text_col: str, shapes: list[tuple[int, int]], bits: np.ndarray | None = None, whole: bool = False) -> DataFrame:
    """id, hash, place, slots, size, free, n_words: the windows of each text, or those that pass a filter.

    With whole, a text of fewer words than WINDOW is one window; longer ones have all of
    that size, and from WINDOW + 1 words on those with any one word free, from twice
    WINDOW on with the middle word of WINDOW + 1 free. A text of fewer words than
    SHORTEST has no template then.
    """
    kind = dict(docs.dtypes)[id_col]
    shared = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse = None if shared is None else _coarse(shared.value)
        for batch in batches:
            for low, _, data, offsets in tb.chunks(batch.column(1)):
                words, template, slots, first = canonical(data, offsets)
                owner, n_words = tb.owners(first), np.diff(first)
                rolled = cache(lambda templated, n, of=(words, template): tb.rolling(of[templated], n))
                for size, free in shapes:
                    for hashes, at, templated in _windows(rolled, slots, first, size, free):
                        if shared is not None:
                            keep = _passes(shared.value, coarse, hashes)
                        elif whole and (size, free) == SPLIT:
                            keep = n_words[owner[at]] >= 2 * WINDOW
                        elif whole and free >= 0:
                            keep = (n_words[owner[at]] > WINDOW) & (n_words[owner[at]] < 2 * WINDOW)
                        elif whole:
                            keep = ((n_words[owner[at]] == size) & (size >= SHORTEST or not templated)) | ((n_words[owner[at]] >= size) & (size == WINDOW))
                        else:
                            keep = np.arange(len(at))
                        at, hashes = at[keep], hashes[keep]
                        taken = slots[at[:, None] + np.arange(size)].view(np.int64) if templated else np.zeros((len(at), 0), np.int64)
                        if templated and free >= 0:
                            taken[:, free] = FREE
                        lists = pa.ListArray.from_arrays(pa.array((np.arange(len(at) + 1) * taken.shape[1]).astype(np.int32)), pa.array(taken.ravel()))
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0).take(pa.array(owner[at] + low)), pa.array(hashes.view(np.int64)), pa.array(at - first[owner[at]]), lists,
                                pa.array(np.full(len(at), size)), pa.array(np.full(len(at), free)), pa.array(n_words[owner[at]]),
                            ],
                            ["id", "hash", "place", "slots", "size", "free", "n_words"],
                        )

    given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(freeing(run), f"id {kind}, hash bigint, place bigint, slots array<bigint>, size bigint, free bigint, n_words bigint")


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """id, item, n_words, n_matched, n_verbatim: a row for each document and item that it holds.

    Held means that as many of the item's words match as the share of its windows holds
    where they're next to each other, or LONG words on one diagonal; on diagonals whose
    slots are consistent and which match as many literal words, all windows together,
    as the share LITERAL of one window; other diagonals count by plain words. Items of
    fewer than SHORTEST words are held where all their words stand in a row; items
    without words are held by nothing. Null and empty texts hold nothing; rows with null
    ids are left out; rows that repeat an id count as one document; a text of any length
    is read whole; columns beside id and text, of whatever name, don't matter; empty
    tables give no rows.

    The filter of the items' windows has a fixed size. What it lets through of the
    documents is joined with the items' windows, a hot window dealt to many tasks.
    """
    wanted = written(windows(benchmark, item_col, "text", [*WHOLE, *ANY_FREE, SPLIT], whole=True), "benchmark_windows")
    shapes = sorted(tuple(r) for r in wanted.select("size", "free").distinct().collect())
    bits = window_filter(wanted)
    wanted = wanted.select(F.col("id").alias("item"), "hash", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), "size", "free", "n_words")
    covered = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("size") - 1), lambda i: i != F.col("free")), lambda i: i + F.col("item_place"))
    literal = F.filter(F.transform("item_slots", lambda v, i: F.when(v == 0, F.col("item_place") + i)), lambda w: w.isNotNull())
    wanted = wanted.withColumns({"words": covered, "literal": literal, "least": F.ceil(LITERAL * F.least(F.size("item_slots"), F.lit(WINDOW)))}).drop("size", "free")
    hits = written(windows(docs, id_col, text_col, shapes, bits).select("id", "hash", "place", "slots"), "hits")
    found = look_up(hits, wanted, "hash", by="id")
    pairs = F.filter(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")), lambda p: (p["a"] != 0) & (p["a"] != FREE))
    found = found.select(
        "id", "item", "n_words", "words", (F.col("place") - F.col("item_place")).alias("diagonal"), (F.size("slots") == 0).alias("plain"), "literal", "least", pairs.alias("pairs")
    )

    def union(column):
        return F.array_distinct(F.flatten(F.collect_set(column)))

    lined = found.groupBy("id", "item", "diagonal").agg(
        F.max("n_words").alias("n_words"),
        union("words").alias("words"),
        union(F.when(F.col("plain"), F.col("words"))).alias("verbatim"),
        union("pairs").alias("pairs"),
        (F.size(union("literal")) >= F.max("least")).alias("literal"),
    )
    consistent = F.col("literal") & (F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))))
    lined = lined.withColumn("words", F.when(consistent, F.col("words")).otherwise(F.col("verbatim")))
    merged = lined.groupBy("id", "item").agg(
        F.max("n_words").alias("n_words"),
        F.size(union("words")).cast("long").alias("n_matched"),
        F.size(union("verbatim")).cast("long").alias("n_verbatim"),
        F.max(F.size("words")).alias("longest"),
    )
    size = F.least(F.col("n_words"), F.lit(WINDOW))
    held = (F.col("n_matched") >= share * (F.col("n_words") - size + 1) + size - 1) | (F.col("longest") >= LONG)
    return merged.where(held).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_words", "n_matched", "n_verbatim")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, that hold no item, as leaks() tells. Rows with a null id stay; rows that repeat an id go or stay together."""
    held = leaks(docs, benchmark, id_col=id_col, text_col=text_col).select(id_col).distinct()
    return docs.join(held, id_col, "left_anti").select(docs.columns)
