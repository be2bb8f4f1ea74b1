from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folioflow.operators import detail, graph, ingest, jobs, library, media, pages, quality, retrieval, state
from folioflow.sources import demo
from folioflow.sources.catalog import Catalog, check_rows, read_files


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_import_twice_is_one_item(spark):
    links = ingest.admit(frame(spark, [(0, "https://example.com/notes?utm_source=test"), (1, "https://example.com/notes"), (2, "https://example.com/other")], "place long, url string"))
    done = ingest.outcomes(links, frame(spark, [], "key string"))
    assert [r.outcome for r in done.orderBy("place").collect()] == ["created", "existing", "created"]
    items = ingest.new_items(done, F.lit(datetime(2024, 1, 1)))
    assert [(r.title, r.status, r.platform) for r in items.collect()] == [("example.com", "queued", "web")] * 2
    assert ingest.first_jobs(items, F.lit(datetime(2024, 1, 1))).count() == ingest.first_chunks(items).count() == 2
    known = frame(spark, [("https://example.com/notes",)], "key string")
    assert [r.outcome for r in ingest.outcomes(links, known).orderBy("place").collect()] == ["existing", "existing", "created"]


def test_import_lines_limits(spark):
    body = "\n".join(["a", " a ", "", "b"] + [f"u{k}" for k in range(30)])
    got = values(ingest.import_lines(frame(spark, [(1, body), (2, "x" * 40_001), (3, None)], "request_id long, body string")), "place")
    assert len(got) == 20 and got[:3] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "u0")]


def test_paging_covers_everything_once(spark):
    items = frame(spark, [(k, k // 3) for k in range(25)], "id long, created_order long")
    pages = [r.id for o in range(0, 25, 7) for r in library.page(items, 7, o).collect()]
    assert pages == sorted(range(25), key=lambda k: (-(k // 3), -k))
    assert library.page(items, 0, -4).count() == 20 and library.page(items, 999).count() == 25


def test_search_filters(spark):
    items = frame(spark, [(1, "Type", "a page", "web"), (2, "Motion", None, "x"), (3, "other", "TYPE", "web")], "id long, title string, description string, platform string")
    chunks = frame(spark, [(2, 0, "about types"), (2, 1, "more types"), (9, 0, None)], "item_id long, seq long, body string")
    topics, tags = frame(spark, [(1, "design"), (3, "design")], "item_id long, topic string"), frame(spark, [(3, "t")], "item_id long, tag string")
    ids = lambda **k: sorted(r.id for r in library.search(items, chunks, topics, tags, **k).collect())
    assert ids() == ids(query="type") == ids(query="t_pe") == [1, 2, 3]
    assert ids(query="type", topic="design", platform="web", tag="t") == [3] and ids(query="nothing") == [] and ids(query="motion") == [2]
    assert values(library.first_match(chunks, "types")) == [(2, "about types", 0)]


def test_catalog_survives_reopening(spark, tmp_path):
    path, now = str(tmp_path / "db"), F.lit(datetime(2024, 1, 5))
    first = Catalog(spark, path)
    assert first.read("items").count() == 0 and first.versions("items") == [] and [r.slug for r in first.read("topics").orderBy("display_order").collect()][:2] == ["design", "typography"]
    row = lambda i: frame(spark, [(i, f"title {i}", "web", "ready", datetime(2024, 1, 1))], "id string, title string, platform string, status string, created_at timestamp")
    first.write("items", row("a"))
    again = Catalog(spark.newSession(), path)
    assert [r.id for r in again.read("items").collect()] == ["a"]
    again.write("items", again.read("items").unionByName(row("b"), allowMissingColumns=True))
    assert sorted(r.id for r in first.read("items").collect()) == ["a", "b"] and first.versions("items") == [0, 1]
    # a version that was never committed isn't read and isn't written over
    (tmp_path / "db/items/v2").mkdir()
    (tmp_path / "db/items/v2/part-0.parquet").write_bytes(b"half")
    assert Catalog(spark, path).read("items").count() == 2
    first.write("items", row("c"))
    assert [r.id for r in again.read("items").collect()] == ["c"] and first.versions("items") == [0, 1, 3] and (tmp_path / "db/items/v2/part-0.parquet").read_bytes() == b"half"
    first.forget("items", 1)
    assert Catalog(spark, path).versions("items") == [3] and again.read("items").count() == 1
    first.migrate(now).migrate(now)
    assert first.read("migrations").count() == 1
    first.write("topics", first.read("topics").where("slug <> 'other'"))
    assert Catalog(spark, path).read("topics").where("slug = 'other'").count() == 1


def test_demo_is_added_once(spark, tmp_path):
    now = datetime(2024, 1, 5)
    catalog = Catalog(spark, str(tmp_path))
    demo.seed_demo(catalog, now)
    catalog.write("items", catalog.read("items").where("id <> 'demo-item-2'"))
    for table in ("item_topics", "mentions", "websites"):
        rows = catalog.read(table)
        catalog.write(table, rows.where("not (id like '%-2' or item_id = 'demo-item-2')" if {"id", "item_id"} <= set(rows.columns) else "item_id <> 'demo-item-2'" if "item_id" in rows.columns else "id <> 'demo-site-2'"))
    demo.seed_demo(catalog, now)
    assert sorted(values(catalog.read("items").select("id", "created_at"))) == [(f"demo-item-{k + 1}", now - timedelta(days=k)) for k in range(4)]
    topics = frame(spark, [("0", "typography")], "item_id string, topic string")
    counts = {r.slug: r.item_count for r in library.topic_counts(catalog.read("topics"), catalog.read("item_topics").unionByName(topics)).collect()}
    assert counts == {"design": 1, "typography": 2, "animation": 1, "learning": 1, "development": 0, "ai-tools": 0, "photography": 0, "other": 0}
    assert catalog.read("mentions").count() == catalog.read("websites").count() == 4 and values(library.processing_count(catalog.read("items"))) == [(0,)]


def test_graph_of_demo(spark):
    items = frame(spark, [(k, f"t{k}" if k else "", "web", k) for k in range(3)], "id long, title string, platform string, created_order long")
    topics = frame(spark, [("a", "A", 0), ("b", "B", 1)], "slug string, label string, display_order long")
    item_topics = frame(spark, [(0, "b"), (0, "a"), (1, "b")], "item_id long, topic string")
    sites, mentions = frame(spark, [(7, "S"), (8, "T")], "id long, name string"), frame(spark, [(0, 7), (0, 7), (1, 7), (2, 8), (99, 8)], "item_id long, website_id long")
    shown, prime = graph.graph_items(items), graph.primary_topic(items, item_topics)
    assert values(prime, "id") == [(0, "a"), (1, "b"), (2, "other")]
    used = graph.website_usage(sites, mentions)
    nodes = {r.id: (r.label, r.subtitle, r.x, r.y) for r in graph.nodes(topics, shown, prime, used).collect()}
    assert nodes["item:0"] == ("Untitled source", "web", 320, 120) and nodes["item:1"] == ("t1", "web", 510, 240) and nodes["item:2"][3] == 120
    assert nodes["website:7"] == ("S", "3 mentions", 1120, 100) and nodes["website:8"] == ("T", "2 mentions", 1120, 168)
    edges = graph.edges(graph.topic_edges(shown, prime), graph.website_edges(shown, used, mentions))
    assert values(graph.summary(shown)) == [(3, False)] and [r.id for r in graph.capped_nodes(graph.nodes(topics, shown, prime, used)).collect()] == ["topic:a", "topic:b", "item:0", "item:1", "item:2", "website:7", "website:8"]
    assert [r.id for r in edges.collect()] == ["topic-edge:a:0", "topic-edge:b:1", "topic-edge:other:2", "website-edge:7:0", "website-edge:7:1", "website-edge:8:2"]


def test_state_changes(spark):
    old, new = frame(spark, [(1, "a", 1), (2, "b", 5)], "k long, v string, t long"), frame(spark, [(1, "c", 1), (2, "d", 4), (3, "e", 0)], "k long, v string, t long")
    assert values(state.upsert(old, new, "k", "t"), "k") == [(1, "c", 1), (2, "b", 5), (3, "e", 0)]
    items, assets = frame(spark, [(1, "ready"), (2, "queued")], "id long, status string"), frame(spark, [(1, "original", 5), (1, "capture", 1), (2, "original", 9)], "item_id long, role string, bytes long")
    stamped = state.stamp_deleted(items.withColumn("original_deleted_at", F.lit(None).cast("timestamp")), frame(spark, [(1,), (2,)], "item_id long"), F.lit(datetime(2024, 1, 1)))
    assert values(stamped, "id") == [(1, "ready", datetime(2024, 1, 1)), (2, "queued", None)]
    left, removed = state.delete_originals(assets, items)
    assert values(left, "item_id") == [(1, "capture", 1), (2, "original", 9)] and values(removed) == [(1, 1, 5)]
    assert values(ingest.unique_violations(frame(spark, [(1, None), (1, None), (2, "x"), (2, "x")], "a long, b string"), "a", "b")) == [(2, "x", 2)]
    trash = frame(spark, [(1, datetime(2024, 1, 1)), (2, datetime(2024, 2, 20))], "id long, deleted_at timestamp")
    assert [r.id for r in state.restorable(trash, F.lit(datetime(2024, 3, 1))).collect()] == [2]


SATELLITES = {
    "item_tags": "item_id long, tag string", "item_topics": "item_id long, topic string", "segments": "item_id long, start_ms long, end_ms long, text string",
    "revisions": "item_id long, revision long, title string, summary string, key_points_json string", "mentions": "item_id long, seq long, website_id long, unresolved_name string",
    "websites": "id long, name string", "evidence": "id string, item_id long, seq long, kind string, excerpt string, start_ms long", "collections": "id long, name string",
    "members": "collection_id long, item_id long", "notes": "item_id long, body string",
}


def satellites(spark, **rows):
    return [frame(spark, rows.get(name, []), schema) for name, schema in SATELLITES.items()]


def test_detail(spark):
    items = frame(spark, [(1, "T", "d"), (2, "U", None)], "id long, title string, description string")
    points = '[{"text":"one","evidenceIds":["e1","e2"]}]'
    got = detail.nested(items, *satellites(
        spark, item_tags=[(1, "b"), (1, "a")], item_topics=[(1, "x")], segments=[(1, 5, 6, "s"), (1, 0, 1, "r")], revisions=[(1, 1, "old", "old", None), (1, 2, "new title", "new", points)],
        mentions=[(1, 2, None, "given"), (1, 1, 7, "not this")], websites=[(7, "Site")], evidence=[("e1", 1, 0, "page", "said", None)], collections=[(3, "Z"), (4, "A")], members=[(3, 1), (4, 1)], notes=[(1, "mine")],
    ))
    rows = {r.id: r for r in got.collect()}
    assert rows[1].tags == ["a", "b"] and (rows[1].title, rows[1].summary, rows[1].note) == ("new title", "new", "mine") and [s.text for s in rows[1].transcript] == ["r", "s"]
    assert rows[1].websites == ["Site", "given"] and rows[1].collections == ["A", "Z"] and [(p.text, p.evidenceIds) for p in rows[1].key_points] == [("one", ["e1", "e2"])]
    assert rows[2].tags == rows[2].key_points == [] and rows[2].summary is None and rows[2].title == "U"
    said = {r.id: r.json for r in detail.as_json(got).collect()}
    assert "summary" not in said[2] and '"start_ms":null' not in said[1] and '"excerpt":"said"' in said[1]
    assert {r.id: r.markdown for r in detail.as_markdown(got).collect()}[1] == "# new title\n\nnew\n\nTags: a, b\n\n- one [e1, e2]\n\nmine\n\n> said (e1)"
    evidence = frame(spark, [(1, "p"), (2, "q")], "id long, excerpt string")
    assert values(detail.passages(evidence, [1, 3])) == [(1, "p", True)] and values(detail.passages(evidence, [1, 1])) == [(1, "p", False)]
    captures = frame(spark, [(1, 10, "capture", 900), (1, 11, "capture", None), (1, 12, "original", 1)], "item_id long, id long, role string, timestamp_ms long")
    assert [r.id for r in detail.item_captures(captures).orderBy("place").collect()] == [11, 10]
    bad = spark.createDataFrame([("[]",), (None,), ("no json",), ('["a","b"]',)], "j string").select(detail.first_evidence(F.col("j"))).collect()
    assert [r[0] for r in bad] == [None, None, None, "a"]


def test_page_results(spark):
    html = "<title>Own &amp; title</title><article>" + "word " * 200 + "</article>"
    read = pages.read_pages(frame(spark, [(1, "item title", html), (2, "item title", "<p>short</p>")], "item_id long, title string, html string"))
    writes = pages.page_writes(read, frame(spark, [(7, 1, "running"), (8, 3, "running")], "id long, item_id long, status string"))
    items = {r.id: r for r in writes["items"].collect()}
    assert items[1].title == "Own & title" and len(items[1].description) == 600 and items[2].title == "item title" and items[2].description == "short"
    assert [(r.id, r.status, r.message) for r in writes["jobs"].collect()] == [(7, "done", None)]
    assert [(r.topics, [(p.text, len(p.evidenceIds)) for p in r.key_points]) for r in writes["revisions"].where("item_id = 2").collect()] == [(["other"], [("short", 1)])]
    old = frame(spark, [(1, 1, "was"), (1, 2, "stays"), (2, 2, "stays")], "item_id long, revision long, title string")
    assert values(pages.with_revisions(old, writes["revisions"].select("item_id", "revision", "title")), "item_id", "revision") == [(1, 1, "Own & title"), (1, 2, "stays"), (2, 1, "item title"), (2, 2, "stays")]
    assert sorted(r.seq for r in pages.next_seq(frame(spark, [(1, 4)], "item_id long, seq long"), frame(spark, [(1, "b"), (1, "a"), (2, "c")], "item_id long, id string"), "id").collect()) == [0, 5, 6]


def test_trash_and_names(spark):
    now = F.lit(datetime(2024, 3, 1))
    rows = frame(spark, [(1, None), (2, datetime(2024, 2, 20)), (3, datetime(2024, 1, 1)), (4, datetime(2024, 2, 20))], "id long, deleted_at timestamp")
    assert dict(values(state.trash_state(rows, now))) == {1: "kept", 2: "trash", 3: "gone", 4: "trash"}
    assert values(state.restore(rows, frame(spark, [(2,), (3,)], "id long"), now), "id") == [(1, None), (2, None), (4, datetime(2024, 2, 20))]
    named = state.rename(frame(spark, [("a", "A"), ("b", "B")], "slug string, label string"), frame(spark, [("a", "New")], "slug string, new_name string"), "slug", "label")
    assert values(named, "slug") == [("a", "New"), ("b", "B")]


def test_pause_and_cancel(spark):
    rows = [(1, 1, "queued"), (2, 1, "running"), (3, 2, "queued"), (4, 2, "running"), (5, 2, "done"), (6, 3, "queued")]
    asked = frame(spark, [(1, "cancel", 1), (1, "pause", 2), (2, "cancel", 5), (3, "pause", 1), (3, "resume", 2)], "item_id long, request string, at long")
    got = jobs.between_stages(jobs.flagged(frame(spark, rows, "id long, item_id long, status string"), asked))
    assert values(got, "id") == [(1, "queued", "paused"), (2, "running", None), (3, "canceled", "canceled"), (4, "canceled", "canceled"), (5, "done", None), (6, "queued", None)]


def test_queue_rules(spark):
    now = F.lit(datetime(2024, 1, 2))
    rows = [(1, 1, "queued", None, datetime(2024, 1, 1, 2)), (2, 1, "queued", datetime(2024, 1, 3), datetime(2024, 1, 1)), (3, 2, "queued", None, datetime(2024, 1, 1)), (4, 1, "queued", None, datetime(2024, 1, 1, 2)), (5, 1, "running", None, datetime(2024, 1, 1))]
    queue = frame(spark, rows, "id long, item_id long, status string, next_attempt_at timestamp, created_at timestamp").withColumns({"stage": F.lit("acquire"), "attempt": F.lit(0)})
    items = frame(spark, [(1, "queued"), (2, "paused")], "id long, status string")
    assert [r.id for r in jobs.next_jobs(queue, items, now, 9).collect()] == [1, 4]
    claimed = jobs.claim(jobs.next_jobs(queue, items, now), now).first()
    assert (claimed.status, claimed.attempt, claimed.item_status) == ("running", 1, "downloading") and claimed.lease_expires_at == datetime(2024, 1, 2, 0, 1)
    waits = frame(spark, [("429", 0, None), ("429", 1, None), ("429", 2, None), ("429", 5, 99999), ("5xx", 2, None), ("5xx", 3, None), ("401", 0, 5)], "e string, a int, r long")
    assert [r[0] for r in waits.select(jobs.retry_seconds(F.col("e"), F.col("a"), F.col("r"))).collect()] == [900, 3600, None, 86400, 600, None, None]


def test_retrieval(spark, tmp_path):
    a, b = frame(spark, [(1, 1), (2, 2)], "id long, rank long"), frame(spark, [(2, 1), (3, 2)], "id long, rank long")
    assert values(retrieval.fuse(a, b), F.desc("score")) == values(retrieval.fuse(b, a), F.desc("score"))
    assert retrieval.fuse(a, b).orderBy(F.desc("score")).first().id == 2
    docs = frame(spark, [(1, " ".join(str(k) for k in range(400))), (2, ""), (3, None), (4, "one")], "item_id long, body string")
    chunks = values(retrieval.chunk(docs), "item_id", "seq")
    assert [(c[0], c[1], c[2]) for c in chunks] == [(1, 0, 220), (1, 1, 220), (4, 0, 1)]
    corpus = frame(spark, [("en1", "the red fox"), ("en2", "the blue dog"), ("fr1", "le renard rouge")], "id string, body string")
    assert [r.id for r in retrieval.bm25(corpus, ["Renard", "rouge"]).collect()] == ["fr1"] and retrieval.bm25(corpus, []).count() == retrieval.bm25(corpus, ["hered"]).count() == 0
    retrieval.store_index(corpus, str(tmp_path / "index"))
    of = lambda *q: values(retrieval.bm25_of(spark, str(tmp_path / "index"), list(q)))
    for q in (["the", "fox"], ["Rouge"], ["nothing"], []):
        assert of(*q) == values(retrieval.bm25(corpus, q))
    plan = retrieval.bm25_of(spark, str(tmp_path / "index"), ["the"])._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan and "PartitionFilters: [part#" in plan.replace("isnotnull(", "") or "PartitionFilters: [isnotnull(part" in plan
    scored = frame(spark, [(1, 0.5, 0), (2, 0.5, 0), (3, 0.5, 0)], "item_id long, score double, seq long")
    sites, mentions = frame(spark, [(9, "Own Site", "own.example")], "id long, name string, hostname string"), frame(spark, [(3, 9), (1, 8)], "item_id long, website_id long")
    for asked in ("own site", " OWN.example"):
        assert [r.item_id for r in retrieval.roll_up(scored, exact=retrieval.exact_sites(mentions, sites, asked)).collect()] == [3, 1, 2]


def test_media(spark):
    frames = frame(spark, [(1, k * 500, (1 << (k % 60)) - 1) for k in range(100)], "item_id long, at_ms long, hash long")
    kept = media.distinct_frames(frames)
    assert kept.orderBy("at_ms").first().change == 64
    changing = frames.withColumn("change", F.col("at_ms") % 7)
    chosen = media.select_frames(changing, frame(spark, [(1, 20_100), (1, 20_200), (1, 21_300), (1, 30_250)], "item_id long, at_ms long"))
    rows = chosen.collect()
    assert len(rows) == 32 and sorted(r.at_ms for r in rows if r.pick == 0) == [0, 6500, 12500, 19000, 25000, 31000, 37500, 43500]
    assert sorted(r.at_ms for r in rows if r.pick == 1) == [20_000, 21_500, 30_000]
    rest = sorted(r.at_ms for r in rows if r.pick == 2)
    assert len(rest) == 21 and max(b - a for a, b in zip([0, *rest], [*rest, 49_500], strict=True)) <= 2 * 49_501 / 21 + 500
    assert values(media.batches(chosen.select("item_id", "at_ms")).groupBy("batch").count(), "batch") == [(k, 8) for k in range(4)]
    many = frame(spark, [(1, k * 100) for k in range(100)], "item_id long, at_ms long")
    assert media.batches(many).count() == 32
    segments = frame(spark, [(1, k * 1000, k * 1000 + 900, f"s{k}") for k in range(60)] + [(1, 0, 60_000, "all")], "item_id long, start_ms long, end_ms long, text string")
    near = media.nearby(frame(spark, [(1, t) for t in (0, 7_950, 16_000, 59_000, 200_000)], "item_id long, at_ms long"), segments)
    want = sorted((t, x) for t in (0, 7_950, 16_000, 59_000) for x, a, b in [*((f"s{k}", k * 1000, k * 1000 + 900) for k in range(60)), ("all", 0, 60_000)] if a <= t + 8000 and b >= t - 8000)
    assert sorted((r.at_ms, r.text) for r in near.collect()) == want
    assert media.sample_plan(frame(spark, [(1, 1000), (2, 200_000), (3, 0), (4, None)], "item_id long, duration_ms long")).groupBy("item_id").count().orderBy("item_id").collect() == [(1, 2), (2, 100)]


def test_quality(spark):
    texts = frame(spark, [(1, "say the magic passage here now"), (2, "the magic passage here"), (3, ""), (4, "ab cd"), (5, None)], "item_id long, body string")
    passages = frame(spark, [(7, "the magic passage here"), (8, "b c"), (9, "e magic passage her")], "id long, excerpt string")
    assert values(quality.literal_occurrence(texts, passages), "item_id", "passage_id") == [(1, 7), (1, 9), (2, 7), (2, 9), (4, 8)]
    odd = frame(spark, [(1, None), (2, ""), (3, "a"), (4, "日 x"), (5, "ab cd"), (6, "bc")], "id long, excerpt string")
    held = frame(spark, [(1, "ab cd"), (2, "so 日 xyz"), (3, ""), (4, None)], "item_id long, body string")
    assert values(quality.literal_occurrence(held, odd), "item_id", "passage_id") == [(1, 2), (1, 3), (1, 5), (2, 2), (2, 4), (3, 2)]
    broken = check_rows(frame(spark, [(1, "", 5), (2, "ok", None)], "id long, title string, bytes long"), {"title": F.length("title") > 0, "bytes": F.col("bytes").isNotNull()})
    assert values(broken.select("id", F.array_join("broken", ",")), "id") == [(1, "title"), (2, "bytes")]


def test_files(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"x")
    files = read_files(spark, str(tmp_path))
    assert {(r.extension, r.mime, r.bytes) for r in files.collect()} == {(".png", "image/png", 1), (".txt", None, 1)}
    assert [r.stage for r in ingest.accepted_uploads(files).collect()] == ["analyze"]


def test_no_task_collects_a_whole_item(spark):
    rows = [(1, k // 2, k, f"s{k}") for k in range(1200, 0, -1)] + [(2, 0, 1, None), (None, 3, 4, "x")]
    segments = frame(spark, rows, "item_id long, start_ms long, end_ms long, text string")
    head = detail.transcript_head(segments)
    assert values(head.where("item_id = 1").select("text"), "start_ms", "end_ms") == [(f"s{k}",) for k in range(1, 501)] and head.count() == 502
    items = frame(spark, [(1, "t", None)], "id long, title string, description string")
    others = satellites(spark)
    nested = detail.nested(items, *others[:2], segments, *others[3:])
    assert [s.text for s in nested.first().transcript] == [f"s{k}" for k in range(1, 501)]
    scored = frame(spark, [(1, 0.5, 4), (1, 0.5, 2), (1, 0.9, 7), (2, 0.7, 1)], "item_id long, score double, seq long")
    assert values(retrieval.roll_up(scored)) == [(1, 0.9, "7,2"), (2, 0.7, "1")]
    for df in (head, nested, retrieval.roll_up(scored)):
        assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_lists_are_whole(spark):
    items = frame(spark, [(1, "t", None), (2, "t", None)], "id long, title string, description string")
    nested = detail.nested(items, *satellites(spark, item_tags=[(1, f"t{k:02}") for k in range(12)], item_topics=[(1, f"p{k}") for k in range(5)], mentions=[(1, k, None, f"m{k}") for k in range(25)]))
    row = nested.where("id = 1").first()
    assert row.tags == [f"t{k:02}" for k in range(12)] and row.topics == [f"p{k}" for k in range(5)] and row.websites == [f"m{k}" for k in range(25)]
    captures = frame(spark, [(k, 1, "capture", k) for k in range(40)], "id long, item_id long, role string, timestamp_ms long")
    assert detail.item_captures(captures).count() == 40
    note = detail.as_markdown(nested, frame(spark, [(1, 2, "/b", "B"), (1, 1, "/a", "A")], "item_id long, place int, url string, alt string"))
    assert [r.markdown.endswith("![A](/a)\n![B](/b)") for r in note.orderBy("id").collect()] == [True, False]


def test_contract(spark):
    items = frame(spark, [(1, "t" * 161, "d", "ready", 5), (2, "ok", "d", "odd", -1), (3, "ok", "d", "ready", None), (4, "ok", "d", "ready", 1)], "id long, title string, description string, status string, bytes long")
    parts = dict(item_tags=[(2, "t" * 61), *((3, f"t{k}") for k in range(9))], segments=[(1, 0, 1, "x" * 1001), *((4, k, k, "x") for k in range(900)), (4, 901, 901, "x" * 1001)], notes=[(2, "n" * 12_001)])
    tags, topics, segments, revisions, *rest, notes = satellites(spark, **parts)
    lists = {"tags": tags.withColumn("text", F.col("tag")), "transcript": segments, "captures": topics.limit(0)}
    broken = quality.contract_breaches(items, revisions, notes, **lists)
    assert values(broken.select("id", F.array_join("broken", ",")), "id") == [(1, "title,transcript[].text"), (2, "note,tags[],status,bytes"), (3, "tags")]
    kept = detail.within_contract(items, broken, tags, topics, segments, revisions, *rest, notes)
    assert [(r.id, len(r.transcript)) for r in kept.collect()] == [(4, 500)]
    assert "collect_list" not in broken._jdf.queryExecution().executedPlan().toString()


def test_contract_joins_lengths_only(spark):
    """Long notes that are small on disk were sent to the driver for a join."""
    items = frame(spark, [(1, "t" * 161, "d", "ready")], "id long, title string, description string, status string")
    *_, revisions, _, _, _, _, _, notes = satellites(spark, notes=[(1, "n" * 12_001)])
    broken = quality.contract_breaches(items, revisions, notes)
    assert values(broken.select("id", F.array_join("broken", ","))) == [(1, "title,note")]
    joins = broken._jdf.queryExecution().optimizedPlan().toString()
    assert "AS length_note#" in joins and "AS note#" not in joins


def test_frames_are_dealt_by_item_in_many_tasks(spark):
    """Frames shrink in a shuffle, and by their bytes Spark joined the partitions until one task held all."""
    videos = spark.range(400).groupBy(F.col("id").alias("item_id")).agg(F.lit(50_000).cast("long").alias("duration_ms"))
    frames = media.sample_plan(videos).selectExpr("item_id", "at_ms", "(item_id + at_ms) * 7919 % 1048576 as hash")
    changing = media.distinct_frames(frames)
    chosen = media.select_frames(changing, frames.where("at_ms % 5000 = 0").selectExpr("item_id", "at_ms + 100 as at_ms"))
    for df in (changing, chosen, media.batches(chosen.select("item_id", "at_ms"))):
        assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert "Join" not in chosen._jdf.queryExecution().executedPlan().toString()


def test_children_of_posts(spark):
    posts = frame(spark, [(1, "x", "99", "u", 3), (2, "x", "98", "v", 1)], "id long, platform string, platform_id string, source_url string, media int")
    got = ingest.child_items(posts).orderBy("medium").collect()
    assert [(r.parent_id, r.platform_id, r.source_url) for r in got] == [(1, "99:1", "u"), (1, "99:2", "u"), (1, "99:3", "u")] and len({r.id for r in got}) == 3
