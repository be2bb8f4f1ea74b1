"""Stored indexes and counts by difference against plain Python."""

import math
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folioflow.functions.vectors import difference_hash
from folioflow.functions import pagetext
from folioflow.functions.text import like_anywhere
from folioflow.operators import chains, facets, graph, ingest, jobs, media, quality, rankindex, retrieval, textindex, vectorindex
from folioflow.operators.rankindex import RankIndex
from folioflow.operators.textindex import TextIndex, pieces
from folioflow.operators.vectorindex import VectorIndex
from folioflow.plans import core
from folioflow.sources.scratch import new_dir


def like(text, query):
    """LIKE '%query%' of one text, letter by letter; A-Z fold."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pattern = "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in query.strip().translate(fold))
    return text is not None and re.search(pattern, text.translate(fold), re.S) is not None


def random_texts(seed, n):
    rng = random.Random(seed)
    return [(k % 17, f"u{k}", "".join(rng.choice("abAB é\n😀%_\\") for _ in range(rng.randint(0, 25)))) for k in range(n)]


QUERIES = ["ABA", "aba%bab", "a_a", "_aba", "aba_", "ab%%😀a", "aba__ab%bb", "\\", "aab%zzz"]


def test_text_index_equals_like(spark, tmp_path):
    rows = [*random_texts(1, 150), (3, "null", None), (4, "empty", ""), (99, "long", "ab" * 40_000 + "é😀a")]
    texts = spark.createDataFrame(rows, "item_id long, unit string, body string")
    index = TextIndex(spark, str(tmp_path)).add(texts)
    for query in QUERIES:
        assert sorted(r.item_id for r in index.hits(query).collect()) == sorted({i for i, _, t in rows if like(t, query)}), query
    items = spark.createDataFrame([(k,) for k in range(20)], "id long")
    assert index.search(items, "  ").count() == 20 and index.search(items, "%").count() == len({i for i, _, t in rows if t is not None and i < 20})


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_text_index_in_blocks(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(textindex, "BLOCK", size)
    rows = [(1, "a", "xxabc"), (2, "b", "defyy"), (2, "c", ""), (3, "d", "ab"), (4, "e", "cdef abcdef"), (5, "f", "abc--def"), (5, "g", "x" * 300 + "abc"), *((9 + i, u, t) for i, u, t in random_texts(8, 60))]
    index = TextIndex(spark, str(tmp_path)).add(spark.createDataFrame(rows, "item_id long, unit string, body string").coalesce(1))
    for query in ["abcdef", "abc%def", "abc__def", "xabc", "_abcdef", "abc_", *QUERIES[:3]]:
        assert sorted(r.item_id for r in index.hits(query).collect()) == sorted({i for i, _, t in rows if like(t, query)}), query


def test_text_index_is_small_and_not_shuffled(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows = [(k, "u", " ".join(rng.choices(words, k=4000))) for k in range(60)]
    texts = spark.createDataFrame(rows, "item_id long, unit string, body string")
    sent = lambda: (spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(), spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite())[1]
    before = sent()
    TextIndex(spark, str(tmp_path)).add(texts)
    stored, n = sum(f.stat().st_size for f in (tmp_path / "grams").rglob("*.parquet")), sum(len(t) for *_, t in rows)
    assert sent() - before < n / 10 and stored < 2.5 * n


def test_text_index_changes(spark, tmp_path):
    of = lambda *rows: spark.createDataFrame(rows, "item_id string, unit string, body string")
    hits = lambda index, q: sorted(r.item_id for r in index.hits(q).collect())
    none = TextIndex(spark, str(tmp_path))
    assert hits(none, "abc") == hits(none.remove(of()), "ab") == hits(none.add(of()), "abc") == []
    first = TextIndex(spark, str(tmp_path / "1")).add(of(("a", "t", "one text"), ("b", "t", "another text")))
    second = first.remove(of(("a", "", ""), ("x", "", ""))).add(of(("a", "t", "it changed"), ("c", "t", "text")))
    assert hits(first, "text") == ["a", "b"] and hits(second, "text") == ["b", "c"] and hits(second, "chang_d") == ["a"] and hits(second, "ch") == ["a"]
    plan = second.hits("text")._jdf.queryExecution().executedPlan().toString()
    assert "/texts" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan  # no text is read
    assert [p.exact for p in pieces("abc%a_bcd%_abc")] == [True, False, False]


def test_wildcards_are_found_in_one_pass(spark):
    texts = [t for _, _, t in random_texts(5, 120)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    for query in QUERIES:
        assert {r.k for r in df.where(like_anywhere(F.col("t"), query)).collect()} == {k for k, t in enumerate(texts) if like(t, query)}, query
    hard = spark.createDataFrame([("ab" * 200_000,)], "t string")  # a pattern that gives parts up again would not end here
    assert hard.where(like_anywhere(F.col("t"), "a%a%a%a%a%b%b%c")).count() == 0


def brute_nearest(vectors, queries, top):
    out = set()
    for q, v in queries:
        a = np.array(v, float)
        found = [(-(round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 6) + 0.0), i) for i, w in vectors if i != q and len(w or []) == len(v) and any(w) and all(map(math.isfinite, w)) for b in [np.array(w, float)]]
        out |= {(q, k, i, -s) for k, (s, i) in enumerate(sorted(found)[:top], 1)}
    return out


@pytest.mark.parametrize("crowd", [0, 300])
def test_nearest_by_cells(spark, monkeypatch, crowd):
    monkeypatch.setattr(vectorindex, "SLICE", 64)
    rng = np.random.default_rng(3)
    rows = [(k, [round(float(x), 3) for x in rng.normal(size=12)]) for k in range(400)]
    rows += [(1000 + k, rows[7][1]) for k in range(crowd)] + [(5000, None), (5001, [0.0] * 12), (5002, [float("nan")] * 12), (5003, [1.0]), (5004, []), (5005, [2 * x for x in rows[3][1]])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    index = VectorIndex.build(spark, new_dir(spark), df)
    asked = [r for r in rows if r[0] % 50 == 0 and r[1] and len(r[1]) == 12]
    exact = brute_nearest(rows, [r for r in asked if any(r[1])], 5)
    found = {(r.query_id, r.rank, r.id, r.score) for r in index.nearest(df.where("id % 50 = 0"), 5, 0.2, exact=True).collect()}
    assert found == exact
    near = {(r.query_id, r.id) for r in index.nearest(df.where("id % 50 = 0"), 5).collect()}
    assert len(near & {(q, i) for q, _, i, _ in exact}) >= (0.9 if not crowd else 0.6) * len(exact)
    if crowd:
        assert max(index.slices) > 3
    every = index.neighbours(3).groupBy("query_id").count().collect()
    assert len(every) == index.vectors().count() == 401 + crowd and {r["count"] for r in every} == {3}


def test_nearest_recall_and_nothing(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = VectorIndex.build(spark, new_dir(spark), df)
    exact = {(r.query_id, r.id) for r in index.nearest(df.where("id % 50 = 0"), 10, 0.2, exact=True).collect()}
    near = {(r.query_id, r.id) for r in index.nearest(df.where("id % 50 = 0"), 10).collect()}
    assert len(exact) == 100 and len(near & exact) >= 90
    empty = VectorIndex.build(spark, new_dir(spark), df.limit(0))
    assert empty.nearest(df, 3).count() == empty.neighbours(3).count() == 0


WORDS = "the apache license of a new deal und or Ä".split()


def test_rank_index_equals_bm25(spark, monkeypatch):
    monkeypatch.setattr(rankindex, "RANGE", 4)
    monkeypatch.setattr(rankindex, "FIRST", 2)
    rng = random.Random(4)
    text = lambda: " ".join(rng.choices(WORDS, [9, 2, 2, 3, 3, 1, 1, 1, 1, 1], k=rng.choice([0, 1, 3, 8, 30, 90])))
    rows = {k: text() for k in range(160)}
    of = lambda keys: spark.createDataFrame([(k, rows[k]) for k in keys], "id long, body string")
    index = RankIndex(spark, new_dir(spark)).put(of(range(100)))
    steps = [lambda: index.put(of(range(100, 130))), lambda: index.remove(spark.createDataFrame([(3,), (5,), (999,)], "id long")), lambda: index.put(of([0, 1, 2, 140])), lambda: index.compacted(new_dir(spark))]
    for step in steps:
        if step is steps[2]:
            rows |= {0: "the the apache", 1: "", 2: "license"}
        index = step()
        live = {r.id for r in index.live().collect()}
        for query, top in ((["the"], 5), (["Apache", "license"], 7), (["nothing"], 5), ([], 5)):
            got = [tuple(r) for r in index.search(query, top).orderBy("rank").collect()]
            assert got == [tuple(r) for r in retrieval.bm25(of(sorted(live)), query, top).orderBy("rank").collect()] if query else got == []
    assert live == {*range(130), 140} - {3, 5}
    read = index.reading(["the"], 5).first()
    assert 0 < read.blocks_read < read.blocks
    assert RankIndex(spark, new_dir(spark)).search(["the"]).count() == RankIndex(spark, new_dir(spark)).put(of([])).search(["the"]).count() == 0


def test_facets_change_by_difference(spark, monkeypatch):
    monkeypatch.setattr(facets.Facets, "MOST", 3)
    rng, rows = random.Random(8), {}
    frames = lambda keys: (
        spark.createDataFrame([(k, rows[k][0], rows[k][1]) for k in keys], "id long, platform string, status string"),
        spark.createDataFrame([(k, t) for k in keys for t in rows[k][2]], "item_id long, topic string"),
        spark.createDataFrame([(k, t) for k in keys for t in rows[k][3]], "item_id long, tag string"),
    )
    fresh = lambda: (rng.choice(["web", "x"]), rng.choice(["ready", "queued"]), rng.sample(["a", "b"], rng.randint(0, 2)), rng.sample("pqrs", rng.randint(0, 3)))
    kept = facets.Facets(spark, new_dir(spark))
    assert kept.counts().count() == kept.processing().first().processing == 0
    for batch in range(6):
        keys = rng.sample(range(30), 8)
        old = frames([k for k in keys if k in rows])
        rows |= {k: fresh() for k in keys}
        if batch == 5:
            rows.pop(keys[0])
        kept = kept.change(old, frames([k for k in keys if k in rows]))
        want = Counter({("platform", r[0]): 0 for r in rows.values()})
        for platform, status, topics, tags in rows.values():
            want.update([("platform", platform), *(("topic", t) for t in topics), *(("tag", t) for t in tags), *([("processing", "")] if status == "queued" else [])])
        assert {(r.facet, r.value): r.n for r in kept.counts().collect()} == dict(want) and len(kept.segments) <= 3
    tags = [tuple(r) for r in kept.tags().collect()]
    assert tags == sorted(((v, n) for (f, v), n in want.items() if f == "tag"), key=lambda t: (-t[1], t[0]))


def test_renames_chain(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("x", "q"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("to", "r2"), ("self", "self"), ("n", None), *((f"k{i:02}", f"k{i + 1:02}") for i in range(40))]
    got = {r.tag: (r.final, r.cycle) for r in chains.resolve(spark.createDataFrame(rows, "tag string, into string")).collect()}
    assert {k: got[k] for k in "abcx"} == {"a": ("d", None), "b": ("d", None), "c": ("d", None), "x": ("q", None)}
    assert {got[k] for k in ("r1", "r2", "r3", "to")} == {("r1", "r1")} and got["k00"] == got["k39"] == ("k40", None) and not {"self", "n"} & set(got)
    ring = [(f"z{i:02}", f"z{(i + 1) % 23:02}") for i in range(23)]
    assert {r.final for r in chains.resolve(spark.createDataFrame(ring, "tag string, into string")).collect()} == {"z00"}
    assert chains.resolve(spark.createDataFrame([], "tag string, into string")).count() == 0
    links = spark.createDataFrame([(1, "a"), (1, "d"), (2, "x"), (3, "other"), (4, None)], "item_id long, tag string")
    merged = ingest.merge_tags(links, spark.createDataFrame(rows, "tag string, into string")).collect()
    assert sorted((tuple(r) for r in merged), key=repr) == sorted([(1, "d"), (2, "q"), (3, "other"), (4, None)], key=repr)


def test_neighbours_are_handed_on_in_pieces(spark, monkeypatch):
    """All cells' copies of a batch's queries were made at once. Whatever the pieces' sizes, the neighbours are the same."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(300, 8)))], "id long, vector array<double>")
    index = VectorIndex.build(spark, new_dir(spark), df)
    want = sorted(map(tuple, index.neighbours(3).collect()))
    for name, n in (("ASKED", 7), ("COPIES", 5), ("SCORES", 40)):
        monkeypatch.setattr(vectorindex, name, n)
    assert index._wanted(df, 9).count() == 2700 and sorted(map(tuple, index.neighbours(3).collect())) == want


@pytest.mark.parametrize("id_type", ["long", "string"])
def test_many_queries_meet_in_blocks(spark, monkeypatch, id_type):
    """Every query's vector was shuffled once for each of its cells. In blocks nothing is shuffled before the meeting, and the neighbours are those that copies find."""
    monkeypatch.setattr(vectorindex, "SLICE", 16)
    rng = np.random.default_rng(9)
    rows = [(k, [round(float(x), 2) for x in rng.normal(size=6)]) for k in range(230)] + [(300 + k, [1.0] + [0.0] * 5) for k in range(40)] + [(5, [0.5] * 6)]
    rows = [(k if id_type == "long" else f"é{k}", v) for k, v in rows]
    df = spark.createDataFrame(rows, f"id {id_type}, vector array<double>")
    index = VectorIndex.build(spark, new_dir(spark), df)
    queries = index.vectors().select("id", "vector")
    want = sorted(map(tuple, vectorindex._ranked(index._best(index._wanted(queries, 9), 4), 4).collect()))
    for name, n in (("BLOCK", 32), ("PART", 600), ("FILE", 1), ("SCORES", 90), ("ASKED", 7)):
        monkeypatch.setattr(vectorindex, name, n)
    found = index._meeting(queries, 9, 4)(queries)
    assert sorted(map(tuple, vectorindex._ranked(found, 4).collect())) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert found.count() <= 4 * index.size * 4 and index.size == len(rows)  # a query's best once for each of the parts
    exact = {t for t in brute_nearest(rows, [r for r in rows if r[0] not in (5, "é5")], 4)}
    assert {tuple(r) for r in index.nearest(df.where(df.id != rows[5][0]), 4, share=0.1, exact=True).collect()} == exact
    assert {tuple(r) for r in index.neighbours(4, share=1.0).where(F.col("query_id") != rows[5][0]).collect()} == exact


@pytest.mark.parametrize("ids", [[0, 50], range(200)])
def test_vectors_of_either_precision_meet(spark, ids):
    """Few and many queries in double precision, vectors stored in single, and the other way."""
    rng = np.random.default_rng(10)
    rows = [(k, [float(x) / 8 for x in rng.integers(-20, 20, 6)] if k else [1.0] * 6) for k in range(200)]
    exact = brute_nearest(rows, [r for r in rows if r[0] in ids], 4)
    double = spark.createDataFrame(rows, "id long, vector array<double>")
    single = double.withColumn("vector", F.col("vector").cast("array<float>"))
    for stored, asking in ((single, double), (double, single)):
        index = VectorIndex.build(spark, new_dir(spark), stored)
        assert index.vectors().schema["vector"].dataType == stored.schema["vector"].dataType
        assert {tuple(r) for r in index.nearest(asking.where(F.col("id").isin(*ids)), 4, share=0.2, exact=True).collect()} == exact


def test_words_are_counted_where_they_stand(spark, monkeypatch):
    """Each word of each text was shuffled to be counted."""
    monkeypatch.setattr(retrieval, "TEXTS", 2)
    texts = {1: "a b a é", 2: "", 3: "b", 4: "é é a", 5: "", 6: "c " * 50}
    listed = spark.createDataFrame([(k, len(t.split()), t.split()) for k, t in texts.items()], "id long, size int, w array<string>")
    counted = retrieval.counted_words(listed)
    assert sorted(map(tuple, counted.collect())) == sorted((k, len(t.split()), w, n) for k, t in texts.items() for w, n in Counter(t.split()).items())
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert retrieval.counted_words(listed.where("size = 0")).count() == 0


def test_renames_stay_off_the_driver(spark):
    """Renames were broadcast, and so sent to the driver, as long as their files were small."""
    renames = spark.createDataFrame([("a", "b"), ("b", "a"), ("x", "a"), ("p", "q")], "tag string, into string")
    ends = chains.resolve(renames)
    assert sorted(tuple(r) for r in ends.where("cycle is not null").collect()) == [("a", "a", "a"), ("b", "a", "a"), ("x", "a", "a")]
    merged = ingest.merge_tags(spark.createDataFrame([(1, "p"), (1, "x")], "item_id long, tag string"), renames)
    for df in (ends, merged):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_websites_keep_their_paths(spark):
    urls = spark.createDataFrame([("h", "h/a"), ("h", "h/a"), ("h", "h/b"), ("i", "i/")], "host string, url string")
    assert sorted(map(tuple, graph.website_paths(urls).collect())) == [("h", "h/a", 2, 2), ("h", "h/b", 1, 2), ("i", "i/", 1, 1)]
    assert sorted(map(tuple, graph.merge_websites(urls).collect())) == [("h", 2, 3, "h/a"), ("i", 1, 1, "i/")]


def test_alike_hashes(spark, monkeypatch):
    monkeypatch.setattr(media, "CROWD", 4)
    rng = random.Random(6)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    hashes = {h for s in seeds for _ in range(12) for h in [s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5)))]} | {0, (1 << 64) - 1, 0b1111}
    signed = sorted(h - (1 << 64) if h >> 63 else h for h in hashes)
    df = spark.createDataFrame([(k, h) for k, h in enumerate([*signed, signed[0], None])], "id long, hash long")
    apart = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    want = {(a, b, apart(a, b)) for a in signed for b in signed if a < b and apart(a, b) <= 4}
    assert {tuple(r) for r in media.alike_pairs(df).collect()} == want
    group = {h: h for h in signed}
    for _ in signed:
        for a, b, _n in want:
            group[a] = group[b] = min(group[a], group[b])
    rows = {r.id: r for r in media.alike_classes(df).collect()}
    assert len(rows) == len(signed) + 2 and all(rows[k]["class"] == group[h] for k, h in enumerate(signed))
    assert all(rows[k].n_alike == sum(h in p[:2] for p in want) for k, h in enumerate(signed)) and rows[len(signed) + 1]["class"] is None


def test_alike_hashes_in_blocks(spark, monkeypatch):
    """Hashes of few bits nearly all share a band: its blocks meet in many tasks, and no pair is shuffled to leave out doubles."""
    monkeypatch.setattr(media, "CROWD", 64)
    monkeypatch.setattr(media, "AT_ONCE", 1 << 9)
    rng = random.Random(7)
    hashes = sorted({sum({1 << b for b in rng.sample(range(56), 3)}) for _ in range(300)})
    pairs = media.alike_pairs(spark.createDataFrame([(h,) for h in hashes], "hash long"))
    assert sorted(map(tuple, pairs.collect())) == [(a, b, (a ^ b).bit_count()) for a in hashes for b in hashes if a < b and (a ^ b).bit_count() <= 4]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0] and media.CROWD < len(hashes)


def test_hashes_are_made_once_for_classes(spark, tmp_path):
    spark.createDataFrame([(1, 0), (2, 3), (3, -1), (4, None)], "id long, hash long").write.parquet(f"{tmp_path}/given")
    out = media.alike_classes(spark.read.parquet(f"{tmp_path}/given"))
    assert sorted(map(tuple, out.collect())) == [(1, 0, 0, 1), (2, 3, 0, 1), (3, -1, -1, 0), (4, None, None, 0)]
    assert "/given" not in out._jdf.queryExecution().executedPlan().toString()


def test_pixels_are_made_once(spark):
    """The pixels' expression stood in the lambda of each bit, and was made for each of them."""
    hashed = spark.createDataFrame([([0.5 - k % 3 / 10 for k in range(72)],)], "e array<double>").select(difference_hash(F.transform("e", lambda x: F.floor(x * 127.0))).alias("hash"))
    assert hashed._jdf.queryExecution().optimizedPlan().toString().count("127.0") == 1
    bits = "".join(str(int((k // 8 * 9 + k % 8) % 3 != 2)) for k in range(64))
    assert hashed.first().hash & ((1 << 64) - 1) == int(bits, 2)


def odd_pictures(small, to):
    """Tables of which embeddings has components that single and double precision put on either side of a whole number, and rows that are null, short or not finite."""
    for name in oracle.TABLES:
        if name != "embeddings":
            (to / f"{name}.parquet").symlink_to(f"{small}/{name}.parquet")
    one = np.float32(1)
    some = np.random.default_rng(2).uniform(-0.9, 0.9, 400_000).astype(np.float32)
    single, double = np.floor((some + one) * np.float32(127)), np.floor((some.astype(float) + 1) * 127)
    edge = some[single != double]
    assert len(edge) and edge.dtype == np.float32
    plain = [k / 100 for k in range(64)]
    rows = [[float(x), float(np.nextafter(np.float32((np.floor((x + one) * 127) - 0.5) / 127 - 1), one))] * 32 for x in edge[:20]]
    nan, inf, cut = math.nan, math.inf, float(np.float32(0.15))
    rows += [None, [], plain[:9], [None, *plain[1:]], [nan, *plain[1:]], [inf, nan] * 32, [-inf, 0.0] * 32, [1e30, 1e20] * 32, [0.0, cut, *[0.0] * 62], plain]
    rows = pa.table({"vec_id": range(len(rows)), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32())})
    pq.write_table(rows, to / "embeddings.parquet")
    return str(to)


def test_pictures_are_hashed_in_single_precision(spark, small, tmp_path):
    """Components were widened to double precision, and short rows failed."""
    rows, expected = oracle.both(spark, odd_pictures(small, tmp_path), core.QUERIES["image_hash"], core.ORACLE_SQL["image_hash"])
    assert rows == expected and len(set(rows)) > 10


@pytest.mark.parametrize("name", ["alike_frames", "alike_coarse"])
def test_alike_pictures_in_single_precision(spark, small, tmp_path, name):
    """Classes stood on hashes in double precision; the coarse pictures' 0.15 was one, too."""
    rows, expected = oracle.both(spark, odd_pictures(small, tmp_path), core.QUERIES[name], core.ORACLE_SQL[name])
    assert rows == expected and rows


def test_call_schedule(spark):
    day = datetime(2024, 1, 1)
    at = lambda s: day + timedelta(seconds=s)
    rows = [(1, "p", at(0), 0), (2, "p", at(1), 40), (3, "p", at(2), None), (4, "q", at(2), 0), (5, "p", at(500), 1), (6, None, at(0), 0), (7, "p", None, 0)]
    rows += [(100 + k, "full", at(86_000 + k), 0) for k in range(35)] + [(200, "full", at(3 * 86_400), 0)]
    got = {r.id: (r.starts - day).total_seconds() for r in jobs.schedule(spark.createDataFrame(rows, "id long, provider string, at timestamp_ntz, took_s int")).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4, 5)} == {1: 0, 2: 15, 3: 55, 4: 2, 5: 500} and not {6, 7} & set(got)
    # a start each 15 s while the day lasts, 30 at most; the rest on the next day
    full = [got[100 + k] for k in range(35)]
    assert full == [*(86_000 + 15 * k for k in range(27)), *(86_405 + 15 * k for k in range(8))] and got[200] == 3 * 86_400
    many = spark.createDataFrame([(k, "p", at(0), 0) for k in range(70)], "id long, provider string, at timestamp_ntz, took_s int")
    starts = sorted((r.starts for r in jobs.schedule(many).collect()))
    assert Counter(s.date().day for s in starts) == {1: 30, 2: 30, 3: 10} and all((b - a).total_seconds() >= 15 for a, b in zip(starts, starts[1:], strict=False))


PAGES = {
    "<html><head><title>T</title></head><body><nav><a href='/'>Home</a> <a href='/b'>All the other pages of this site</a></nav><div class='ad'>Buy one of these now, they are cheap today only!</div>"
    "<article><h1>Heading</h1><p>The first paragraph is long enough to be read as text.<p>The second one says &amp; adds more, with a <a href='#'>link</a> in it.</article><footer>&copy; all rights reserved by the one who wrote this</footer></body></html>":
    "Heading The first paragraph is long enough to be read as text. The second one says & adds more, with a link in it.",
    "<div><a href='1'>one long link among others</a></div><div><a href='2'>two long links among others</a></div><div>A plain sentence that stands in a division, without any article at all.</div>": "A plain sentence that stands in a division, without any article at all.",
    "<article>First article, which is a little longer than the other one here.</article><article>Second article, it isn't swallowed up.</article>": "First article, which is a little longer than the other one here. Second article, it isn't swallowed up.",
    "plain text without a tag": "plain text without a tag",
    "<p>unclosed <b>bold and <i>more words than a block costs": "unclosed bold and more words than a block costs",
    "<script>var x = '<p>not a text at all, though it is long enough';</script>": "",
    "<div class=\"sidebar left\">Words beside the article that go on for a good while, longer than it.</div><p>The article itself goes on, long enough.</p>": "The article itself goes on, long enough.",
    "": "", None: "",
    "<p>a</p>": "a",
}


def test_page_text_by_density(spark):
    df = spark.createDataFrame([(k, h) for k, h in enumerate(PAGES)], "k long, html string")
    got = {r.k: r.text for r in df.select("k", pagetext.page_text(F.col("html")).alias("text")).collect()}
    assert got == dict(enumerate(PAGES.values()))
    long = spark.createDataFrame([("<p>" + "word " * 40_000 + "<div " * 20_000,)], "html string").select(pagetext.page_text(F.col("html")).alias("t")).first().t
    assert len(long) == 60_000 and long.startswith("word word")


def test_packed_chunks(spark):
    sentence = "One two three four five six. "
    assert retrieval.pack(sentence * 3, 12, 4) == [(0, 57, 12), (58, 86, 6)] and retrieval.pack(sentence * 3, 12, 6) == [(0, 57, 12), (29, 86, 12)]
    assert retrieval.pack("a b c d e", 2, 1) == [(0, 3, 2), (4, 7, 2), (8, 9, 1)] and retrieval.pack("", 5, 1) == retrieval.pack(" \n ", 5, 1) == []
    rng = random.Random(2)
    texts = {k: " ".join(rng.choice(["word", "Ünd", "end.", "stop!", "日本"]) for _ in range(rng.randint(0, 120))) for k in range(20)}
    chunks = retrieval.packed_chunks(spark.createDataFrame([*texts.items(), (99, None)], "item_id long, body string"), 20, 5)
    for r in chunks.collect():
        assert texts[r.item_id][r.start : r.end] == r.body and len(r.body.split()) == r.n_words <= 20
    for k, text in texts.items():
        spans = sorted((r.start, r.end) for r in chunks.where(F.col("item_id") == k).collect()) if k < 4 else []
        covered = {c for a, b in spans for c in range(a, b)}
        assert not spans or all(c in covered for c in range(len(text)) if text[c] != " ")
    evidence = [(k, f"e{j}", a, a + rng.randint(0, 9_000)) for k in texts for j, a in enumerate(rng.sample(range(400), 4))]
    got = retrieval.with_evidence(chunks, spark.createDataFrame(evidence, "item_id long, id string, start long, end long")).collect()
    assert len(got) == chunks.count()
    for r in got:
        assert r.evidence_ids == sorted(i for k, i, a, b in evidence if k == r.item_id and b > a and a < r.end and b > r.start)


def test_passages_by_rare_anchors(spark):
    rng = random.Random(9)
    texts = [(k, " ".join(rng.choice(["aa", "bb", "cc", "dd\tee", "ff\ngg"]) for _ in range(40))) for k in range(25)]
    passages = [(k, t[a : a + rng.randint(0, 25)]) for k, (_, t) in enumerate(texts) for a in [rng.randint(0, 60)]] + [(100, "never said here"), (101, None), (102, "aa bb aa bb aa bb aa bb cc"), (103, "x"), (104, "a b")]
    got = quality.literal_occurrence(spark.createDataFrame([*texts, (99, None), (98, "")], "item_id long, body string"), spark.createDataFrame(passages, "id long, excerpt string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, p) for i, t in [*texts, (98, "")] for p, e in passages if e is not None and e in t)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "Cartesian" not in plan
