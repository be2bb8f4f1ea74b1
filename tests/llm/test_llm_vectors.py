"""Exact top-k, vector codes and source divergence against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import divergence, topk, vectorcodes
from folioflow.llm.blocks import LIMIT, in_blocks, unpacked, whole_numbers

VECTORS = "vec_id long, embedding array<float>, label int, score string, block string, id int"
ODD = [None, [], [float("nan"), 1.0], [None, 0.5], [float("inf")], [float("-inf"), 0.0]]


def whole(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [max(-LIMIT, min(LIMIT, math.floor(scale * float(np.float32(x))))) for x in v]


def table(spark, rows):
    """Rows (id, vector, label) as a table whose other columns have the operators' own names."""
    return spark.createDataFrame([(i, v, x, "s", None, k % 2) for k, (i, v, x) in enumerate(rows)], VECTORS).repartition(3)


def random_rows(seed, n, dim, spread=1.0):
    rng = random.Random(seed)
    return [(k, [round(rng.gauss(0, spread), 2) for _ in range(dim)], rng.choice([0, 1, 1, None])) for k in range(n)]


def test_whole_numbers(spark):
    given = [[0.5, -0.25, -0.0001], [1e30, -1e30], *ODD]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(given)], "k int, v array<float>").select("k", whole_numbers(F.col("v"), 1024).alias("w")).collect()
    assert {r.k: r.w for r in rows} == {k: whole(v, 1024) for k, v in enumerate(given)}


def test_blocks_hold_every_vector_once(spark):
    rows = [(k, [k, -k, 70_000 * (k % 5 == 0)][: 1 + k % 3], str(k)) for k in range(50)]
    df = spark.createDataFrame(rows, "id long, v array<int>, carried string").repartition(2)
    found = []
    for b in in_blocks(df, 4).collect():
        assert b.n <= 4
        numbers = unpacked(bytes(b.data), b.dim, b.n)
        found += [(i, numbers[:, k].tolist(), c) for k, (i, c) in enumerate(zip(b.ids, b.carried, strict=True))]
    assert sorted(found) == sorted(rows)


def brute_topk(rows, k, asks):
    kept = [(i, w) for i, v, _ in rows if i is not None and (w := whole(v, 1024)) is not None]
    queries = {}
    for i, w in kept:
        if asks(i):
            queries[i] = min(queries.get(i, w), w)
    out = set()
    for q, a in queries.items():
        best = {}
        for i, b in kept:
            if i != q and len(a) == len(b):
                best[i] = max(best.get(i, -(10**30)), sum(x * y for x, y in zip(a, b, strict=True)))
        out |= {(q, r, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1)}
    return out


@pytest.mark.parametrize("kind", ["plain", "odd", "hot", "few", "large"])
def test_topk_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "CHUNK", 16)
    monkeypatch.setattr(topk, "FIRST", 8)
    monkeypatch.setattr(topk, "BLOCK", 8)
    rows = random_rows(3, 150, 20)
    if kind == "odd":
        rows += [(200 + k, v, None) for k, v in enumerate(ODD)] + [(None, [0.1] * 20, 1), (300, [1.0], 0), (310, [2.0], 0), (400, [], 0)]
    if kind == "hot":  # one vector, one id with several vectors, and rows that repeat
        rows += [(500 + k, [1.0] * 20, 1) for k in range(90)] + [(500, [0.5 * (k % 3)] * 20, 2) for k in range(30)] + rows[:40]
    if kind == "few":
        rows = rows[:5]
    if kind == "large":
        rows += [(600 + k, [9e3 * (-1) ** (k + j) for j in range(20)], 0) for k in range(12)]
    found = topk.search(table(spark, rows), F.col("vec_id") % 10 == 0, 7).collect()
    assert [c for c in found[0].asDict()] == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found)) == sorted(brute_topk(rows, 7, lambda i: i % 10 == 0))


def test_topk_of_nothing(spark):
    assert topk.search(table(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    assert topk.search(table(spark, [(10, None, 0), (20, [1.0], 0)]), F.col("vec_id") % 10 == 0).collect() == []


def test_bounds_leave_most_pairs():
    """With mass in few dimensions, a step after the first half is seldom needed."""
    rng = np.random.default_rng(5)
    scale = 1000 * 0.8 ** np.arange(64)
    near = (rng.normal(size=(64, 20_000)) * scale[:, None]).astype(np.int32)
    part = topk.Part((np.arange(20_000),), (near,))
    q, c, s = part.best(np.arange(5), near[:, :5], 10)
    assert part.looked_at < 0.05 * 4 * 5 * 20_000  # four steps follow the first half
    exact = near.T.astype(np.int64) @ near[:, :5].astype(np.int64)
    for k in range(5):
        order = sorted((x for x in range(20_000) if x != k), key=lambda x: (-exact[x, k], x))[:10]
        assert c[q == k].tolist() == order and s[q == k].tolist() == exact[order, k].tolist()


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, w, x) for i, v, x in rows if (w := whole(v, 4096)) is not None and len(w) and len(w) % parts == 0]
    starts = sorted((i, w) for i, w, _ in kept if i is not None)
    kept = [r for r in kept if len(r[1]) == len(starts[0][1])]
    starts = [w for _, w in starts if len(w) == len(starts[0][1])][:entries]
    width = len(starts[0]) // parts
    cut = lambda w, p: w[p * width : (p + 1) * width]
    books = [[cut(w, p) for w in starts] for p in range(parts)]
    nearest = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, w, _ in kept:
                members[nearest(cut(w, p), books[p])[1]].append(cut(w, p))
            books[p] = [[sum(x) // len(members[e]) for x in zip(*members[e], strict=True)] if members[e] else c for e, c in enumerate(books[p])]
    out, by_label = [], Counter()
    for i, w, x in kept:
        best = [nearest(cut(w, p), books[p]) for p in range(parts)]
        by_label[x] += sum(d for d, _ in best)
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), x))
    digest = hashlib.sha256(",".join(str(n) for book in books for c in book for n in c).encode()).hexdigest()
    return sorted(((i, code, d, by_label[x], digest) for i, code, d, x in out), key=repr)


@pytest.mark.parametrize("kind", ["plain", "odd", "ties", "few", "large"])
def test_codes_equal_plain_lloyd(spark, monkeypatch, kind):
    monkeypatch.setattr(vectorcodes, "BLOCK", 32)
    rows = random_rows(7, 200, 16)
    if kind == "odd":
        rows = [(None, [0.5] * 16, None)] * 20 + rows + [(-1 - k, v, 1) for k, v in enumerate(ODD)] + [(-50, [1.0] * 7, 1), (900, [1.0] * 8, 1), (901, [1.0] * 24, 0)]
    if kind == "ties":
        rows = [(k % 90, [0.25 * ((k >> j) % 2) for j in range(16)], k % 2) for k in range(180)] + [(1000 + k, [0.125] * 16, None) for k in range(90)]
    if kind == "few":
        rows = rows[:3]
    if kind == "large":
        rows = [(i, [x * 3e3 for x in v], label) for i, v, label in rows]
    found = vectorcodes.compress(table(spark, rows)).drop("n_scans").collect()
    assert sorted(map(tuple, found), key=repr) == brute_codes(rows)


def test_codes_of_nothing(spark):
    assert vectorcodes.compress(table(spark, [])).collect() == []
    assert vectorcodes.compress(table(spark, [(1, None, 0), (2, [1.0] * 9, 0), (None, [1.0] * 8, 0)])).collect() == []


def test_heaps_pop_what_drift_has_reached():
    rng = np.random.default_rng(1)
    heaps, keys, code = vectorcodes.Heaps(500), rng.uniform(0, 10, 500), rng.integers(0, 4, 500).astype(np.uint8)
    heaps.push(np.arange(500, dtype=np.int32), code, keys)
    drift = np.array([1.0, 0.0, 5.0, 20.0])
    at = heaps.pop(drift)
    assert sorted(at.tolist()) == np.flatnonzero(keys <= drift[code]).tolist()
    assert not len(heaps.pop(drift))
    keys[at], code[at] = keys[at] + 6, (code[at] + 1) % 4
    heaps.push(at, code[at], keys[at])
    for _ in range(4):  # several runs, merged on the way
        drift = drift + 2
        at = heaps.pop(drift)
        left = sorted(heaps.order[a:b].tolist() for _, a, b in heaps.runs.tolist())
        assert sorted(at.tolist() + [x for run in left for x in run]) == list(range(500)) and (keys[at] <= drift[code[at]] + 1e-5).all()
        assert all((keys[run] > drift[code[run]]).all() for run in left)
        keys[at] += 9
        heaps.push(at, code[at], keys[at])


def test_settled_clusters_are_not_measured_again(spark):
    """Far clusters that the first entries hit: after the entries have come to rest, heaps give nothing."""
    rng = random.Random(2)
    centres = [[40 * rng.random() for _ in range(16)] for _ in range(16)]
    rows = [(k, [c + rng.gauss(0, 0.01) for c in centres[k % 16]], 0) for k in range(800)]
    scans = [r.n_scans for r in vectorcodes.compress(table(spark, rows)).collect()]
    assert sum(scans) < 0.1 * 6 * 8 * len(rows)
    assert sorted((tuple(r)[:5] for r in vectorcodes.compress(table(spark, rows)).collect()), key=repr) == brute_codes(rows)


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_audit(docs, min_docs=3, top=200):
    counts, n_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        terms = [t.translate(FOLD) for t in TERM.findall(text)]
        groups.add((lang, source))
        counts[lang, source].update(terms)
        n_docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in n_docs[lang].items() if n >= min_docs]
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update({t: counts[g][t] for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        p, q = share(counts[lang, source]), share(whole)
        far = lambda a, b: sum((a[t] - b[t]) ** 2 // b[t] for t in kept)  # noqa: B023, E731
        pairs = [(far(p, share(counts[g])), g[1]) for g in groups if g[0] == lang and g[1] != source]
        terms = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(rows, key=lambda r: (-r[0], r[1].encode()))[:most]
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def documents(spark, docs):
    schema = "doc_id long, text string, lang string, source string, n long, term string, total long, block int"
    return spark.createDataFrame([(k, *d, 1, "x", 5, 6) for k, d in enumerate(docs)], schema).repartition(3)


def corpus(seed, n, sources, words):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["a", "Ä", "ß", "é", "漢", "z"]) + "abcdefgh"[k % 8] * (k // 8 + 1) for k in range(words)]
    out = []
    for _ in range(n):
        said = [rng.choice(vocabulary[: rng.choice([3, words])]) for _ in range(rng.randint(0, 40))]
        text = "".join(w.upper() * (rng.random() < 0.2) or w for w in (x + rng.choice([" ", "1", "\n", "-", "\x00", "'"]) for x in said))
        out.append((text, rng.choice(["en", "de", None]), rng.choice([f"s{k}" for k in range(sources)] + [None])))
    return out


@pytest.mark.parametrize(("sources", "cells", "tile"), [(4, 16_384, 256), (7, 100, 3)])
def test_audit_equals_brute_force(spark, monkeypatch, sources, cells, tile):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "TILE", tile)
    docs = corpus(sources, 80, sources, 30)
    docs += [(None, "en", "silent"), ("", "fr", "a"), ("!?", "fr", "b"), (None, None, None), ("once upon", "es", "only"), ("Long" + "x" * 300_000 + " end", "en", "s0")] + docs[:5] * 3
    rows = divergence.audit(documents(spark, docs)).collect()
    assert [c for c in rows[0].asDict()] == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, rows)) == brute_audit(docs)


def test_audit_of_top_terms_and_other_columns(spark):
    docs = corpus(1, 60, 3, 25)
    df = documents(spark, docs).select(F.col("text").alias("body"), F.col("lang").alias("tongue"), F.col("source").alias("site"), F.lit(0).alias("lang"))
    rows = divergence.audit(df, min_docs=2, top=3, text_col="body", lang_col="tongue", source_col="site").collect()
    assert sorted(map(tuple, rows)) == brute_audit(docs, 2, 3)
    assert divergence.audit(documents(spark, [])).collect() == []


def test_slices_of_equal_hash_are_told_apart():
    data = np.frombuffer(b"cat dog cat bird dog cow", np.uint8)
    starts, ends = np.array([0, 4, 8, 12, 17, 21]), np.array([3, 7, 11, 16, 20, 24])
    for hashed in (lambda view: 7, lambda view: view[0], lambda view: len(view)):
        group, first = divergence.group_slices(data, starts, ends, hashed)
        words = [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)]
        assert [words[first[g]] for g in group] == words and len(set(group.tolist())) == len(first) == 4


def test_shares_of_large_counts_are_exact():
    n, total, terms = 2**45 + 12345, 2**46 + 99, 10**9 + 7
    assert int(divergence.shares(np.array([n]), np.array([total]), np.array([terms]))[0]) == 1 + 10**9 * (n + 1) // (total + terms)
