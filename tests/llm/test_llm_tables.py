"""Whole tables and pipeline stages against plain Python that shares no code with the operators but word hashes and model files."""

import hashlib
import math
import os

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_llm_operators import ODD, drop_lines, held_by_hand, linked, odd

import corpus_pipeline
from folioflow.llm import fingerprint, queries, sentencepieces, skew, storage, tokencount, toxicity
from folioflow.llm import textbytes as tb

BLANK = " \t\n\x0b\x0c\r"
STAGES = dict(corpus_pipeline.STAGES)


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in BLANK:
            out, word = out + [word] * bool(word), ""
        else:
            word += c
    return out + [word] * bool(word)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def rows(documents):
    return [tuple(r) for r in documents.select("doc_id", "text").collect()]


# ---- 4 and 6


def test_token_counts_of_a_table(documents, rows):
    pieces = set(tokencount.load_pieces(queries.MODEL))
    longest, known = max(map(len, pieces)), {}

    def greedy(word):
        at, n = 0, 0
        while at < len(word):
            size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces and (at > 0 or word[at] == "▁")), 0)
            if not size:
                return 0
            at, n = at + size, n + 1
        return n

    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in tokencount.count_tokens(documents, queries.MODEL).collect()}
    for doc, text in rows:
        counts = [known.setdefault(w, greedy("▁" + w)) for w in words_of(text)]
        assert got[doc] == (len(counts), sum(max(1, n) for n in counts), counts.count(0))


def test_pieces_of_a_table_are_the_best(documents, rows):
    model = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
    weight = {model.id_to_piece(i).replace("▁", " "): -math.log(k + 2) for k, i in enumerate(ranked)}
    weight = {p: w for p, w in weight.items() if " " not in p.lstrip(" ")}
    of_id = {i: weight.get(model.id_to_piece(i).replace("▁", " ")) for i in plain}
    worst, longest, known = min(weight.values()) - 10, max(map(len, weight)), {}

    def best(part):
        sums = [0.0] + [-math.inf] * len(part)
        for e in range(1, len(part) + 1):
            sums[e] = sums[e - 1] + worst * len(part[e - 1].encode())
            for s in range(max(0, e - longest), e):
                if part[s:e] in weight:
                    sums[e] = max(sums[e], sums[s] + weight[part[s:e]])
        return sums[-1]

    got = {r.doc_id: r for r in sentencepieces.encode_documents(documents, queries.MODEL).collect()}
    for doc, text in rows:
        marked, parts = (" " + text if text else ""), []
        for c in marked:
            if c == " " and not (parts and parts[-1].strip(" ") == ""):
                parts.append(c)
            else:
                parts[-1] += c
        total = sum(known.get(p) or known.setdefault(p, best(p)) for p in parts)
        assert got[doc].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest() and got[doc].round_trip
        assert sum(worst if of_id.get(i) is None else of_id[i] for i in got[doc].pieces) == pytest.approx(total, abs=1e-6)


# ---- 8


def plain_score(model, text):
    """The network by loops over one text's windows and words."""
    rows = {}

    def hashed(raw):
        return tb.span_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0]

    def vector(word):
        if word not in rows:
            raw = word.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode()
            edged = b"\0" + raw + b"\0"
            letters = tb.BYTE_CODES[np.frombuffer(edged, np.uint8)]
            grams = [tb.rolling(letters[i : i + k], k)[0] for k in (3, 4) for i in range(len(edged) - k + 1)] + [hashed(edged[: min(k, len(edged))]) for k in toxicity.PREFIXES]
            parts = [model["gram"][int(g) % toxicity.GRAM_BUCKETS] for g in grams]
            rows[word] = np.concatenate([model["word"][int(hashed(raw)) % toxicity.WORD_BUCKETS], np.max(parts, axis=0)]).astype(float)
        return rows[word]

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def states(given, side):
        h, out, u = np.zeros(toxicity.UNITS), [], toxicity.UNITS
        for x in given:
            own, new = h @ model[f"state_{side}"], x @ model[f"in_{side}"] + model[f"gate_{side}"]
            z, r = sigmoid(new[:u] + own[:u]), sigmoid(new[u : 2 * u] + own[u : 2 * u])
            h = z * h + (1 - z) * np.tanh(new[2 * u :] + r * own[2 * u :])
            out.append(h)
        return out

    words, best, low = words_of(text), -math.inf, 0
    while words:
        x = [vector(w) for w in words[low : low + toxicity.WINDOW]]
        both = [np.concatenate(p) for p in zip(states(x, "f"), states(x[::-1], "b")[::-1], strict=True)]
        weight = np.exp([np.tanh(s @ model["attend"]) @ model["query"] for s in both])
        best = max(best, float(np.average(both, axis=0, weights=weight) @ model["out"] + model["bias"][0]))
        if low + toxicity.WINDOW >= len(words):
            return float(sigmoid(best))
        low += toxicity.STRIDE
    return 0.0


def test_toxicity_scores_equal_plain_loops(rows):
    rng = np.random.default_rng(4)
    model = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in toxicity.initial().items()}
    texts = [t for _, t in rows if len(t or "") < 6000][:60] + [None, "", " \n", "one", "É日 x"]
    got = toxicity.score_column(model, pa.array(texts, pa.string()))
    assert got == pytest.approx([plain_score(model, t) for t in texts], abs=1e-4)


# ---- 10


def plain_parse(symbols):
    """The names of the phrases one level up, symbol by symbol."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    with np.errstate(over="ignore"):
        named = [int(tb.mix(np.array([s], np.uint64) + np.array([n], np.uint64) * np.uint64(tb._STEP))[0]) if n > 1 else s for s, n in runs]

    def labelled(values, first):
        out = []
        for i, v in enumerate(values):
            other = values[i - 1] if i else first(v)
            bit = ((v ^ other) & -(v ^ other)).bit_length() - 1
            out.append(0 if v == other else 2 * bit + (v >> bit & 1))
        return out

    labels = labelled(named, lambda v: v ^ (1 << 64) - 1)
    for _ in range(3):
        labels = labelled(labels, lambda v: v ^ 1)
    begins = [i for i, v in enumerate(labels) if i == 0 or v > labels[i - 1] and (i + 1 == len(labels) or v >= labels[i + 1])]
    out = []
    for low, high in zip(begins, begins[1:] + [len(named)], strict=True):
        total = sum(n * pow(tb._BASE, k, 1 << 64) for k, n in enumerate(named[low:high])) + high - low
        out.append(int(tb.mix(np.array([total % (1 << 64)], np.uint64))[0]))
    return out


def plain_fingerprint(text):
    symbols, levels = [int(x) for x in tb.BYTE_CODES[np.frombuffer(text.encode(), np.uint8)]], []
    for most in fingerprint.LISTED:
        symbols = plain_parse(symbols)
        with np.errstate(over="ignore"):
            short = {int(tb.mix(np.array([n], np.uint64) + np.uint64(tb._STEP))[0]) >> 32 for n in symbols}
        levels.append("".join(f"{x:08x}" for x in sorted(short)[:most]))
    return ".".join(levels)


def plain_likeness(a, b):
    parts = [[{x[i : i + 8] for i in range(0, len(x), 8)} for x in text.split(".")] for text in (a, b)]
    level = next((k for k in (2, 1, 0) if min(len(p[k]) for p in parts) >= fingerprint.FEW), 0)
    x, y = parts[0][level], parts[1][level]
    if not x or not y:
        return float(len(x) == len(y))
    union = sorted(x | y)[: fingerprint.LISTED[level]]
    return sum(v in x and v in y for v in union) / len(union)


@pytest.mark.parametrize("as_text", [False, True])
def test_fingerprints_and_their_likeness_equal_plain_ones(spark, rows, as_text):
    some = sorted((f"d{d:04}" if as_text else d, t or "") for d, t in rows if len(t or "") < 3000)[:60]
    docs = spark.createDataFrame(some, f"doc_id {'string' if as_text else 'long'}, text string")
    got = {r.doc_id: r for r in fingerprint.compare_edits(docs, per_part=9).collect()}
    for (d, t), (_, u) in zip(some, some[1:] + some[:1], strict=True):
        half = len(t) // 2
        prints = [plain_fingerprint(x) for x in (t, t[: len(t) - half] + u[:half], u)]
        assert (got[d].fingerprint, got[d].edited_fingerprint) == tuple(prints[:2])
        assert got[d].near_edited == pytest.approx(plain_likeness(*prints[:2])) and got[d].near_next == pytest.approx(plain_likeness(prints[0], prints[2]))


# ---- the pipeline


def kept_rows(stage, spark, docs, sf="/root/testdata/sf0.001"):
    return sorted(((r.doc_id, r.text) for r in stage(spark, docs, sf).collect()), key=repr)


def test_stages_equal_plain_python(spark, small, documents, rows):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.fit_documents(documents, labels)
    short = [r for r in rows if len(r[1] or "") < 5000]
    fine = [r for r in short if plain_score(model, r[1]) < toxicity.CUT]
    got = kept_rows(STAGES["toxicity"], spark, documents)
    assert [r for r in got if r in set(short)] == sorted(fine, key=repr)
    lines = sorted(((d, t) for d, _, _, t in drop_lines(rows)), key=repr)
    assert kept_rows(STAGES["line_dedup"], spark, documents) == lines
    component = {d: c for d, _, c in linked(rows, 5, 80)}
    assert kept_rows(STAGES["near_duplicates"], spark, documents) == sorted((r for r in rows if component[r[0]] == r[0]), key=repr)
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    held = {d for d, _ in held_by_hand(rows, items)}
    assert held and kept_rows(STAGES["decontamination"], spark, documents) == sorted((r for r in rows if r[0] not in held), key=repr)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, small, name):
    docs = odd(spark).withColumnsRenamed({"id": "lang"}).withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    for clash in ("goes", "row", "place", "id", "item", "gone", "spread", "tie"):
        docs = docs.withColumn(clash, F.lit(1))
    out = STAGES[name](spark, docs, small)
    got = out.collect()
    ids = sorted((r.doc_id for r in got), key=str)
    assert None in ids and {1, 2, 3, 8} <= set(ids)
    if name != "sentencepiece":
        assert out.columns == docs.columns
    if name == "near_duplicates":  # 5 and its repetition, and 6 with the same text
        assert ids == sorted({d for d, *_ in ODD} - {6}, key=str)
    else:
        assert ids == sorted((d for d, *_ in ODD), key=str)
    assert STAGES[name](spark, docs.limit(0), small).count() == 0


def test_near_duplicates_of_repeated_ids(spark, small):
    one, two = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    docs = [(1, one), (2, one), (2, two), (2, two), (3, two), (4, "x"), (4, "x"), (None, "x"), (None, "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = kept_rows(STAGES["near_duplicates"], spark, frame)
    assert {(1, one), (2, two), (4, "x"), (None, "x")} <= set(got) and got.count((2, two)) == got.count((4, "x")) == 1 and got.count((None, "x")) == 2


def test_near_duplicates_leave_texts_in_place(spark, small, tmp_path):
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 1 << 60, 1200).tolist())) for _ in range(200)]
    rows = [*enumerate(texts), (300, texts[7]), (301, texts[8] + " more"), (None, texts[9])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    frame = spark.read.parquet(f"{tmp_path}/docs")
    sent = lambda: (spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(), spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite())[1]
    was, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), sent()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = kept_rows(STAGES["near_duplicates"], spark, frame)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == sorted([*enumerate(texts), (None, texts[9])], key=repr)
    assert sent() - before < sum(map(len, texts)) / 4


@pytest.mark.parametrize("words", [1, 1 << 17])
def test_rows_parted_by_ids(spark, monkeypatch, words):
    monkeypatch.setattr(skew, "WORDS", words)  # with one word the filter rules little out
    rows = spark.createDataFrame([(k if k < 300 else None, k, "x") for k in range(303)], "`id` long, `a.b` long, word string")
    without, within = skew.parted(rows, spark.createDataFrame([(k,) for k in [*range(0, 300, 3), 999]], "id long"), "id")
    assert without.columns == within.columns == rows.columns
    assert sorted(r[1] for r in within.collect()) == list(range(0, 300, 3))
    assert sorted(r[1] for r in without.collect()) == [k for k in range(303) if k >= 300 or k % 3]


def test_written_tables_are_swept(spark):
    storage.sweep(spark)
    kept = storage.written(spark.range(5), "five")
    folder = kept.inputFiles()[0].rsplit("/", 2)[0].removeprefix("file:").replace("///", "/")
    assert kept.count() == 5 and os.path.isdir(folder) and storage.sweep(spark) == 1 and not os.path.isdir(folder) and storage.sweep(spark) == 0
