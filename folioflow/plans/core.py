"""The library's queries over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import pagetext, text, urls
from folioflow.functions.vectors import difference_hash, once
from folioflow.operators import chains, detail, graph, ingest, jobs, library, media, pages, quality, retrieval, state
from folioflow.plans.links import expected_sql, links
from folioflow.sources import demo
from folioflow.sources.adapters import NOW, entity, with_entities
from folioflow.sources.catalog import Catalog
from folioflow.sources.scratch import new_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEYWORD, WILDCARD, TOPIC, PLATFORM, TAG = "Apache License", "l_censed%apache", "fr", "src6", "toxic"
_UP, _LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _ntz() -> Column:
    return F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


def query(name: str, sql: str = "", *entities: str):
    """Register a query; with SQL, its oracle over the entities named."""

    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = with_entities(sql, *entities) if entities else sql
        return fn

    return put


def _fold(column: str) -> str:
    return f"translate({column}, {_UP}, {_LOW})"


def _has(column: str) -> str:
    return f"contains({_fold(column)}, '{KEYWORD.lower()}')"


_FOUND = f"({_has('title')} OR {_has('description')} OR EXISTS (SELECT 1 FROM chunks_ c WHERE c.item_id = i.id AND {_has('c.body')}))"

# ---- the list


@query("keyword_search", f"SELECT id, title, platform FROM items_ i WHERE {_FOUND}", "items", "chunks")
def keyword_search(spark, d):
    return library.keyword_search(entity(spark, d, "items"), entity(spark, d, "chunks"), KEYWORD).select("id", "title", "platform")


@query("wildcard_search", f"SELECT id, title FROM items_ i WHERE {_fold('title')} LIKE '%{WILDCARD}%' OR {_fold('description')} LIKE '%{WILDCARD}%' OR EXISTS (SELECT 1 FROM chunks_ c WHERE c.item_id = i.id AND {_fold('c.body')} LIKE '%{WILDCARD}%')", "items", "chunks")
def wildcard_search(spark, d):
    return library.keyword_search(entity(spark, d, "items"), entity(spark, d, "chunks"), WILDCARD).select("id", "title")


@query("filter_by_topic", f"SELECT id, title FROM items_ i WHERE EXISTS (SELECT 1 FROM item_topics_ t WHERE t.item_id = i.id AND t.topic = '{TOPIC}')", "items", "item_topics")
def filter_by_topic(spark, d):
    return library.with_topic(entity(spark, d, "items"), entity(spark, d, "item_topics"), TOPIC).select("id", "title")


@query("filter_by_platform", f"SELECT id, title FROM items_ WHERE platform = '{PLATFORM}'", "items")
def filter_by_platform(spark, d):
    return entity(spark, d, "items").where(F.col("platform") == PLATFORM).select("id", "title")


@query("filter_by_tag", f"SELECT id, title FROM items_ i WHERE EXISTS (SELECT 1 FROM item_tags_ t WHERE t.item_id = i.id AND t.tag = '{TAG}')", "items", "item_tags")
def filter_by_tag(spark, d):
    return library.with_tag(entity(spark, d, "items"), entity(spark, d, "item_tags"), TAG).select("id", "title")


def _combined(spark, d):
    names = ("items", "chunks", "item_topics", "item_tags")
    return library.search(*(entity(spark, d, n) for n in names), query="the", topic="en", platform=PLATFORM, tag="quality")


_COMBINED = (
    f"FROM items_ i WHERE platform = '{PLATFORM}' AND EXISTS (SELECT 1 FROM item_topics_ t WHERE t.item_id = i.id AND t.topic = 'en') "
    "AND EXISTS (SELECT 1 FROM item_tags_ t WHERE t.item_id = i.id AND t.tag = 'quality') "
    f"AND (contains({_fold('title')}, 'the') OR contains({_fold('description')}, 'the') OR EXISTS (SELECT 1 FROM chunks_ c WHERE c.item_id = i.id AND contains({_fold('c.body')}, 'the')))"
)
_FOUR = ("items", "chunks", "item_topics", "item_tags")


@query("combined_filters", f"SELECT id, title, status {_COMBINED}", *_FOUR)
def combined_filters(spark, d):
    return _combined(spark, d).select("id", "title", "status")


@query("filtered_total", f"SELECT count(*) AS total {_COMBINED}", *_FOUR)
def filtered_total(spark, d):
    return _combined(spark, d).agg(F.count("*").alias("total"))


@query("library_page", "SELECT id, title, platform FROM items_ ORDER BY created_order DESC, id DESC LIMIT 20 OFFSET 40", "items")
def library_page(spark, d):
    return library.page(entity(spark, d, "items"), 20, 40).select("id", "title", "platform")


@query("clamp_pagination", "SELECT event_id AS id, least(50, greatest(1, CASE WHEN coalesce(l, 0) = 0 THEN 20 ELSE l END))::BIGINT AS page_limit, greatest(0, coalesce(o, 0))::BIGINT AS page_offset FROM (SELECT event_id, CASE WHEN event_id % 11 > 0 THEN event_id % 71 - 5 END AS l, CASE WHEN event_id % 13 > 0 THEN event_id % 97 - 9 END AS o FROM events)")
def clamp_pagination(spark, d):
    e = F.col("event_id")
    rows = spark.read.parquet(f"{d}/events.parquet").select(e.alias("id"), F.when(e % 11 > 0, e % 71 - 5).alias("l"), F.when(e % 13 > 0, e % 97 - 9).alias("o"))
    limit, offset = library.clamp(F.col("l"), F.col("o"))
    return rows.select("id", limit.alias("page_limit"), offset.alias("page_offset"))


@query("page_has_more", f"SELECT count(*) AS total, count(*) > 60 AS has_more {_COMBINED}", *_FOUR)
def page_has_more(spark, d):
    return library.has_more(_combined(spark, d), 20, 40)


_FAMILY = (
    "CASE WHEN hi - lo < 32 THEN CASE WHEN hi < 64 THEN 'black' WHEN lo > 191 THEN 'white' ELSE 'grey' END ELSE list_extract(['blue', 'green', 'cyan', 'red', 'magenta', 'yellow'], "
    "(2 * (red - lo) > hi - lo)::INT * 4 + (2 * (green - lo) > hi - lo)::INT * 2 + (2 * (blue - lo) > hi - lo)::INT) END"
)


@query("color_families", f"SELECT id, {_FAMILY} AS color, CASE WHEN width > height THEN 'landscape' WHEN width < height THEN 'portrait' ELSE 'square' END AS aspect FROM (SELECT *, greatest(red, green, blue) AS hi, least(red, green, blue) AS lo FROM items_)", "items")
def color_families(spark, d):
    return _colored(spark, d).select("id", "color", text.aspect(F.col("width"), F.col("height")).alias("aspect"))


def _colored(spark, d):
    return entity(spark, d, "items").withColumn("color", text.color_family(F.col("red"), F.col("green"), F.col("blue")))


@query(
    "narrowed_search",
    f"SELECT id, title FROM (SELECT *, greatest(red, green, blue) AS hi, least(red, green, blue) AS lo FROM items_) i WHERE type = 'video' AND created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2030-01-01' AND width > height AND {_FAMILY} = 'blue' AND EXISTS (SELECT 1 FROM item_topics_ t WHERE t.item_id = i.id AND t.topic = 'en')",
    "items", "item_topics",
)
def narrowed_search(spark, d):
    names = ("chunks", "item_topics", "item_tags")
    kept = {"kind": "video", "since": datetime(2024, 1, 3), "until": datetime(2030, 1, 1), "shape": "landscape", "color": "blue"}
    return library.search(_colored(spark, d), *(entity(spark, d, n) for n in names), topic="en", **kept).select("id", "title")


@query("item_lookup", "SELECT id, title, platform FROM items_ WHERE id = 17", "items")
def item_lookup(spark, d):
    return detail.item_by_id(entity(spark, d, "items"), 17).select("id", "title", "platform")


@query("existing_items", "SELECT item_id AS id, max((item_id IN (SELECT doc_id FROM documents))::INT) = 1 AS there FROM jobs_ GROUP BY 1", "jobs")
def existing_items(spark, d):
    return detail.existing(entity(spark, d, "items"), entity(spark, d, "jobs").select(F.col("item_id").alias("id")))


@query("topic_colors", "SELECT doc_id AS id, CASE WHEN source IN ('src1', 'src2') THEN 'plum' ELSE 'muted' END AS color FROM documents")
def topic_colors(spark, d):
    stored = F.when(F.col("platform").isin("src1", "src2"), "plum").when(F.col("platform") != "src3", F.col("platform"))
    return entity(spark, d, "items").select("id", text.color_token(stored).alias("color"))


@query("topic_counts", "SELECT slug, label, display_order, count(i.topic)::BIGINT AS item_count FROM topics_ t LEFT JOIN item_topics_ i ON t.slug = i.topic GROUP BY ALL", "topics", "item_topics")
def topic_counts(spark, d):
    return library.topic_counts(entity(spark, d, "topics"), entity(spark, d, "item_topics"))


@query("tag_facets", "SELECT tag, count(*) AS item_count FROM item_tags_ GROUP BY tag ORDER BY 2 DESC, 1 LIMIT 50", "item_tags")
def tag_facets(spark, d):
    return library.tag_facets(entity(spark, d, "item_tags"))


@query("platform_counts", "SELECT p.platform, count(i.id)::BIGINT AS item_count FROM platforms_ p LEFT JOIN items_ i ON p.platform = i.platform GROUP BY 1", "platforms", "items")
def platform_counts(spark, d):
    return library.platform_counts(entity(spark, d, "platforms"), entity(spark, d, "items"))


@query("processing_count", "SELECT count(*) AS processing FROM items_ WHERE status NOT IN ('ready', 'failed', 'canceled')", "items")
def processing_count(spark, d):
    return library.processing_count(entity(spark, d, "items"))


@query("latest_revision", "SELECT item_id, max(revision) AS revision, arg_max(summary, revision) AS summary FROM revisions_ GROUP BY 1", "revisions")
def latest_revision(spark, d):
    return library.latest_revision(entity(spark, d, "revisions"))


@query("website_count", "SELECT item_id, count(*) AS website_count FROM mentions_ GROUP BY 1", "mentions")
def website_count(spark, d):
    return library.website_count(entity(spark, d, "mentions"))


@query("original_bytes", "SELECT item_id, (sum(bytes) FILTER (WHERE role = 'original'))::BIGINT AS original_bytes FROM assets_ GROUP BY 1", "assets")
def original_bytes(spark, d):
    return library.original_bytes(entity(spark, d, "assets"))


@query(
    "item_base_projection",
    "SELECT id, title, coalesce((SELECT arg_max(summary, revision) FROM revisions_ r WHERE r.item_id = i.id), description) AS summary, platform, status, "
    "coalesce(m.n, 0)::BIGINT AS website_count, a.b::BIGINT AS original_bytes FROM items_ i LEFT JOIN (SELECT item_id, count(*) AS n FROM mentions_ GROUP BY 1) m ON m.item_id = i.id "
    "LEFT JOIN (SELECT item_id, sum(bytes) FILTER (WHERE role = 'original') AS b FROM assets_ GROUP BY 1) a ON a.item_id = i.id",
    "items", "revisions", "mentions", "assets",
)
def item_base_projection(spark, d):
    return library.item_projection(*(entity(spark, d, n) for n in ("items", "revisions", "mentions", "assets")))


@query("first_match_snippet", f"SELECT item_id, arg_min(body, seq) AS body, min(seq)::BIGINT AS seq FROM chunks_ WHERE {_has('body')} GROUP BY 1", "chunks")
def first_match_snippet(spark, d):
    return library.first_match(entity(spark, d, "chunks"), KEYWORD)


@query("search_snippets", f"SELECT id, title, coalesce(left(m.body, 500), left(description, 240)) AS snippet, CASE WHEN m.item_id % 9 > 0 THEN 'description:' || m.item_id END AS evidence FROM items_ i LEFT JOIN (SELECT item_id, arg_min(body, seq) AS body FROM chunks_ c WHERE {_has('c.body')} GROUP BY 1) m ON m.item_id = i.id WHERE {_FOUND}", "items", "chunks")
def search_snippets(spark, d):
    return library.snippets(entity(spark, d, "items"), entity(spark, d, "chunks"), KEYWORD)


# ---- detail


@query("item_tags_agg", "SELECT item_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM item_tags_ GROUP BY 1", "item_tags")
def item_tags_agg(spark, d):
    return detail.item_tags(entity(spark, d, "item_tags"))


@query("item_websites", "SELECT m.item_id, m.seq, m.website_id, coalesce(w.name, m.unresolved_name) AS name FROM mentions_ m LEFT JOIN websites_ w ON w.id = m.website_id", "mentions", "websites")
def item_websites(spark, d):
    return detail.item_websites(entity(spark, d, "mentions"), entity(spark, d, "websites"))


@query("item_collections", "SELECT m.item_id, row_number() OVER (PARTITION BY m.item_id ORDER BY c.name, c.id) AS place, c.name FROM collection_items_ m JOIN collections_ c ON c.id = m.collection_id", "collections", "collection_items")
def item_collections(spark, d):
    return detail.item_collections(entity(spark, d, "collections"), entity(spark, d, "collection_items"))


@query("item_captures", "SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY timestamp_ms NULLS FIRST, id) AS place, id, timestamp_ms FROM assets_ WHERE role = 'capture'", "assets")
def item_captures(spark, d):
    return detail.item_captures(entity(spark, d, "assets"))


@query("chunk_evidence", "SELECT item_id, seq, CASE WHEN item_id % 9 > 0 THEN 'description:' || item_id END AS evidence_id FROM chunks_", "chunks")
def chunk_evidence(spark, d):
    return entity(spark, d, "chunks").select("item_id", "seq", detail.first_evidence(F.col("evidence_ids_json")).alias("evidence_id"))


@query("transcript_head", "SELECT item_id, start_ms, end_ms, text FROM segments_ QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY start_ms) <= 500", "segments")
def transcript_head(spark, d):
    return detail.transcript_head(entity(spark, d, "segments"))


@query("capture_labels", "SELECT page_id AS id, '/api/assets/' || page_id AS url, regexp_extract(path, '[^/]+$') AS label, CASE WHEN page_id % 7 = 0 THEN 'Capture from source' ELSE 'Capture from ' || floor(page_id * 250 / 1000.0 + 0.5)::BIGINT || ' seconds' END AS alt FROM (SELECT page_id, string_split(url, '?')[1] AS path FROM pages)")
def capture_labels(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    ms = F.when(F.col("page_id") % 7 != 0, F.col("page_id") * 250)
    return detail.capture_labels(pages.select(F.col("page_id").alias("id"), F.substring_index("url", "?", 1).alias("path"), ms.alias("timestamp_ms")))


@query("get_passages", "SELECT id, excerpt, true AS truncated FROM passages_ WHERE id IN (1, 3, 5, 999999)", "passages")
def get_passages(spark, d):
    return detail.passages(entity(spark, d, "passages"), [1, 3, 5, 999999])


_NESTED = ("items", "item_tags", "item_topics", "segments", "revisions", "mentions", "websites", "evidence", "collections", "collection_items", "notes")


def _nested(spark, d):
    return detail.nested(*(entity(spark, d, n) for n in _NESTED))


def _flat(rows: DataFrame) -> DataFrame:
    """A detail's lists as texts."""
    pair = lambda *parts: F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return rows.select(
        "id", "title", "summary", "note", F.array_join("tags", ",").alias("tags"), F.array_join("topics", ",").alias("topics"), F.array_join("websites", ",").alias("websites"),
        F.array_join("collections", ",").alias("collections"),
        F.array_join(F.transform("transcript", lambda t: pair(t["start_ms"], t["end_ms"], t["text"])), ";").alias("transcript"),
        F.array_join(F.transform("evidence", lambda e: pair(e["id"], e["kind"], e["excerpt"], e["start_ms"])), ";").alias("evidence"),
        F.array_join(F.transform("key_points", lambda p: pair(p["text"], F.array_join(p["evidenceIds"], ","))), ";").alias("key_points"),
    )


_FLAT_SQL = """,
    last AS (SELECT item_id, max(revision) AS revision, arg_max(title, revision) AS title, arg_max(summary, revision) AS summary FROM revisions_ GROUP BY 1),
    flat AS (SELECT i.id, coalesce(r.title, i.title) AS title, coalesce(r.summary, i.description) AS summary, coalesce(n.body, '') AS note,
        coalesce((SELECT string_agg(tag, ',' ORDER BY tag) FROM item_tags_ t WHERE t.item_id = i.id), '') AS tags,
        coalesce((SELECT string_agg(topic, ',' ORDER BY topic) FROM item_topics_ t WHERE t.item_id = i.id), '') AS topics,
        coalesce(s.names, '') AS websites,
        coalesce((SELECT string_agg(c.name, ',' ORDER BY c.name) FROM collection_items_ m JOIN collections_ c ON c.id = m.collection_id WHERE m.item_id = i.id), '') AS collections,
        coalesce((SELECT string_agg(start_ms || '|' || end_ms || '|' || coalesce(text, '-'), ';' ORDER BY start_ms) FROM segments_ g WHERE g.item_id = i.id), '') AS transcript,
        coalesce((SELECT string_agg(id || '|' || kind || '|' || excerpt || '|' || start_ms, ';' ORDER BY seq) FROM evidence_ e WHERE e.item_id = i.id), '') AS evidence,
        coalesce('point ' || r.revision || '|description:' || i.id, '') AS key_points
      FROM items_ i LEFT JOIN last r ON r.item_id = i.id LEFT JOIN notes_ n ON n.item_id = i.id
      LEFT JOIN (SELECT item_id, string_agg(name, ',' ORDER BY place) AS names FROM (SELECT m.item_id, coalesce(w.name, m.unresolved_name) AS name,
            row_number() OVER (PARTITION BY m.item_id ORDER BY m.seq, m.website_id NULLS FIRST) AS place FROM mentions_ m LEFT JOIN websites_ w ON w.id = m.website_id) GROUP BY 1) s ON s.item_id = i.id)
"""


def _then_flat(sql: str, *more: str) -> str:
    return with_entities("{{}}", *_NESTED, *more).replace(" {{}}", f"{_FLAT_SQL} {sql}")


@query("item_detail_nested", _then_flat("SELECT * FROM flat"))
def item_detail_nested(spark, d):
    return _flat(_nested(spark, d))


@query("export_item_json", _then_flat("SELECT * FROM flat"))
def export_item_json(spark, d):
    rows = _nested(spark, d)
    return _flat(detail.as_json(rows).select(F.from_json("json", rows.schema.simpleString()).alias("r")).select("r.*"))


@query(
    "export_item_markdown",
    _then_flat(
        "SELECT id, concat_ws(chr(10) || chr(10), '# ' || title, summary, 'Tags: ' || replace(tags, ',', ', '), CASE WHEN key_points <> '' THEN '- ' || replace(key_points, '|', ' [') || ']' END, nullif(note, ''), "
        "(SELECT string_agg('> ' || excerpt || ' (' || e.id || ')', chr(10) ORDER BY seq) FROM evidence_ e WHERE e.item_id = flat.id), "
        "shots.images) AS markdown FROM flat LEFT JOIN (SELECT item_id, string_agg('![' || CASE WHEN timestamp_ms IS NULL THEN 'Capture from source' ELSE 'Capture from ' || floor(timestamp_ms / 1000.0 + 0.5)::BIGINT || ' seconds' END || '](/api/assets/' || id || ')', chr(10) "
        "ORDER BY timestamp_ms NULLS FIRST, id) AS images FROM assets_ WHERE role = 'capture' GROUP BY 1) shots ON shots.item_id = flat.id",
        "assets",
    ),
)
def export_item_markdown(spark, d):
    assets = entity(spark, d, "assets").where("role = 'capture'").withColumn("path", F.col("id").cast("string"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("timestamp_ms").asc_nulls_first(), "id"))
    labels = detail.capture_labels(assets, "item_id", "timestamp_ms").withColumn("place", place)
    return detail.as_markdown(_nested(spark, d), labels)


@query("compact_projection", _then_flat("SELECT id, title, left(summary, 240) AS snippet, websites, tags FROM flat"))
def compact_projection(spark, d):
    return _flat(_nested(spark, d)).select("id", "title", F.left("summary", F.lit(240)).alias("snippet"), "websites", "tags")


# ---- ingest


def all_links(spark, d):
    """All pages' links after those of the list, which are numbered below zero."""
    pages = _pages(spark, d).select(F.col("page_id").alias("place"), "url")
    return spark.createDataFrame(links(), "place bigint, url string").unionByName(pages)


def _pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


@query(
    "import_url_lines",
    "SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY page_id) AS place, url FROM (SELECT page_id // 30 AS request_id, min(page_id) AS page_id, url FROM pages GROUP BY ALL) QUALIFY place <= 20",
)
def import_url_lines(spark, d):
    lines = _pages(spark, d).groupBy(F.floor(F.col("page_id") / 30).alias("request_id")).agg(F.sort_array(F.collect_list(F.struct("page_id", "url"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("  "), x["url"], F.lit(" "))), "\r\n\r\n")
    return ingest.import_lines(lines.select("request_id", body.alias("body")))


# The listed links' results are written by hand; the pages' addresses are plain enough for a few cuts.
_TRACKED = ", ".join(f"'{t}'" for t in urls.TRACKING)
_ADMIT = f"""WITH cut AS (SELECT page_id AS place, url, split_part(url, '#', 1) AS u FROM pages),
asked AS (SELECT *, regexp_replace(split_part(u, '?', 1), '/$', '') AS front, list_filter(string_split(split_part(u, '?', 2), '&'), lambda s: s <> '' AND split_part(s, '=', 1) NOT IN ({_TRACKED})) AS kept FROM cut),
admitted AS ({expected_sql()} UNION ALL SELECT place, url, split_part(url, '/', 3), 'web', NULL, front || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END, NULL FROM asked)
"""


def _admitted(spark, d):
    return ingest.admit(all_links(spark, d))


@query("url_validation", _ADMIT + "SELECT place, url, reject_reason FROM admitted")
def url_validation(spark, d):
    return _admitted(spark, d).select("place", "url", "reject_reason")


@query("url_canonicalize", _ADMIT + "SELECT place, canonical_url FROM admitted")
def url_canonicalize(spark, d):
    return _admitted(spark, d).select("place", "canonical_url")


@query("platform_classify", _ADMIT + "SELECT place, platform FROM admitted")
def platform_classify(spark, d):
    return _admitted(spark, d).select("place", "platform")


@query("platform_id_extract", _ADMIT + "SELECT place, platform, platform_id FROM admitted")
def platform_id_extract(spark, d):
    return _admitted(spark, d).select("place", "platform", "platform_id")


@query("private_host_filter", _ADMIT + f"SELECT place, host FROM admitted WHERE reject_reason = '{urls.PRIVATE}'")
def private_host_filter(spark, d):
    return urls.with_parts(all_links(spark, d)).where("parts.private").select("place", F.col("parts.host").alias("host"))


@query("page_urls", _ADMIT + "SELECT place AS page_id, canonical_url FROM admitted WHERE place >= 0")
def page_urls(spark, d):
    return ingest.admit(_pages(spark, d)).select("page_id", "canonical_url")


@query("host_counts", _ADMIT + "SELECT host, count(*) AS n FROM admitted GROUP BY 1")
def host_counts(spark, d):
    return ingest.host_counts(all_links(spark, d))


@query("website_merge", _ADMIT + "SELECT host, count(DISTINCT canonical_url) AS n_urls, count(*) AS mentions, min(canonical_url) AS first_url FROM admitted WHERE reject_reason IS NULL GROUP BY 1")
def website_merge(spark, d):
    return graph.merge_websites(_admitted(spark, d).where("reject_reason is null").select("host", F.col("canonical_url").alias("url")))


@query("website_paths", _ADMIT + "SELECT host, canonical_url AS url, count(*) AS mentions, count(*) OVER (PARTITION BY host) AS n_urls FROM admitted WHERE reject_reason IS NULL GROUP BY 1, 2")
def website_paths(spark, d):
    return graph.website_paths(_admitted(spark, d).where("reject_reason is null").select("host", F.col("canonical_url").alias("url")))


_KEYED = _ADMIT + """, keyed AS (SELECT *, CASE WHEN platform_id IS NOT NULL THEN platform || ':' || platform_id ELSE canonical_url END AS key FROM admitted),
old AS (SELECT DISTINCT key FROM keyed WHERE abs(place) % 9 = 1 AND key IS NOT NULL),
done AS (SELECT k.*, CASE WHEN reject_reason IS NOT NULL THEN 'rejected' WHEN o.key IS NOT NULL OR row_number() OVER (PARTITION BY k.key ORDER BY place) > 1 THEN 'existing' ELSE 'created' END AS outcome FROM keyed k LEFT JOIN old o ON k.key = o.key)
"""


def _outcomes(spark, d):
    links = _admitted(spark, d)
    old = links.where("abs(place) % 9 = 1 and canonical_url is not null").select(ingest.dedup_key(F.col("platform"), F.col("platform_id"), F.col("canonical_url")).alias("key"))
    return ingest.outcomes(links, old)


@query("dedup_against_existing", _KEYED + "SELECT place, key, outcome FROM done")
def dedup_against_existing(spark, d):
    return _outcomes(spark, d).select("place", "key", "outcome")


@query("ingest_items", _KEYED + f"SELECT sha256(key) AS id, CASE WHEN platform = 'web' THEN host ELSE 'Saved ' || platform || ' source' END AS title, platform, platform_id, trim(url) AS source_url, canonical_url, CASE WHEN platform = 'web' THEN 'page' ELSE 'video' END AS type, 'queued' AS status, {NOW} AS created_at FROM done WHERE outcome = 'created'")
def ingest_items(spark, d):
    return ingest.new_items(_outcomes(spark, d), _ntz())


@query("import_outcome_counts", _KEYED + "SELECT outcome, count(*) AS n FROM done GROUP BY 1")
def import_outcome_counts(spark, d):
    return ingest.outcome_counts(_outcomes(spark, d))


@query("child_items", "SELECT sha256('x:' || l_orderkey || ':' || k) AS id, l_orderkey AS parent_id, 'x' AS platform, l_orderkey || ':' || k AS platform_id, 'https://x.com/me/status/' || l_orderkey AS source_url, k AS medium, 'queued' AS status FROM (SELECT l_orderkey, unnest(range(1, count(*) + 1)) AS k FROM lineitem GROUP BY 1 HAVING count(*) > 1)")
def child_items(spark, d):
    posts = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("media"))
    posts = posts.select("id", F.lit("x").alias("platform"), F.col("id").alias("platform_id"), F.concat(F.lit("https://x.com/me/status/"), "id").alias("source_url"), "media")
    return ingest.child_items(posts)


@query("content_hash", "SELECT doc_id AS id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))


@query("content_hash_dedup", "SELECT sha256(text) AS content_hash, min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedup(spark, d):
    return ingest.by_content(spark.read.parquet(f"{d}/documents.parquet").withColumnRenamed("doc_id", "id"))


_LABELS = "(SELECT c_custkey AS item_id, chr(160) || '  ' || c_mktsegment || chr(9) || chr(8195) || left(c_name, 8) || CASE WHEN c_custkey % 2 = 0 THEN 'S ' ELSE '' END AS label FROM customer UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 's' ELSE ' ' || chr(8195) END FROM customer)"
_NORMAL = "regexp_replace(lower(trim(regexp_replace(label, '[\\s\\x{A0}\\x{2003}]+', ' ', 'g'))), 's$', '')"


def _labels(spark, d):
    blank, wide = F.lit("\u00a0"), F.lit("\u2003")
    customers = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("item_id"), "c_mktsegment", "c_name")
    one = F.concat(blank, F.lit("  "), "c_mktsegment", F.lit("\t"), wide, F.left("c_name", F.lit(8)), F.when(F.col("item_id") % 2 == 0, "S ").otherwise(""))
    two = F.when(F.col("item_id") % 3 == 0, "s").otherwise(F.concat(F.lit(" "), wide))
    return customers.select("item_id", F.explode(F.array(one, two)).alias("label"))


@query("normalize_tags", f"SELECT DISTINCT item_id, {_NORMAL} AS tag FROM {_LABELS} WHERE {_NORMAL} <> ''")
def normalize_tags(spark, d):
    return ingest.tag_links(_labels(spark, d))


@query("replace_item_tags", f"SELECT item_id, tag FROM item_tags_ WHERE item_id NOT IN (SELECT c_custkey FROM customer) UNION ALL (SELECT DISTINCT item_id, {_NORMAL} FROM {_LABELS} WHERE {_NORMAL} <> '')", "item_tags")
def replace_item_tags(spark, d):
    labels = _labels(spark, d)
    return ingest.replace_tags(entity(spark, d, "item_tags"), labels, labels)


@query("tag_merge", "SELECT DISTINCT item_id, CASE WHEN tag = 'toxic' THEN 'flagged' WHEN tag = 'quality' THEN 'flagged' ELSE tag END AS tag FROM item_tags_", "item_tags")
def tag_merge(spark, d):
    return ingest.merge_tags(entity(spark, d, "item_tags"), spark.createDataFrame([("toxic", "flagged"), ("quality", "flagged")], "tag string, into string"))


#: Parts' tags and renames that chain, some of them round in threes: 1 -> 2 -> 3 -> 1.
_RENAMES = "renames AS (SELECT p_partkey AS k, 't' || p_partkey AS tag, 't' || CASE WHEN p_partkey % 50 IN (1, 2) THEN p_partkey + 1 WHEN p_partkey % 50 = 3 THEN p_partkey - 2 ELSE p_partkey * 31 % 199 END AS into_tag FROM part WHERE p_partkey % 5 > 0)"
_ENDS = f"""WITH RECURSIVE {_RENAMES}, open AS (SELECT tag, into_tag FROM renames WHERE tag <> into_tag),
    walk AS (SELECT tag, into_tag AS here, [tag] AS path FROM open UNION ALL SELECT w.tag, o.into_tag, list_append(w.path, w.here) FROM walk w JOIN open o ON o.tag = w.here WHERE NOT list_contains(w.path, w.here)),
    ends AS (SELECT tag, CASE WHEN list_contains(path, here) THEN list_aggregate(path[list_position(path, here):], 'min') ELSE here END AS final, list_contains(path, here) AS is_cycle
        FROM walk WHERE list_contains(path, here) OR here NOT IN (SELECT tag FROM open))"""


def _renames(spark, d):
    k = F.col("p_partkey")
    into = F.when((k % 50).isin(1, 2), k + 1).when(k % 50 == 3, k - 2).otherwise(k * 31 % 199)
    named = lambda c: F.concat(F.lit("t"), c.cast("string"))
    return spark.read.parquet(f"{d}/part.parquet").where(k % 5 > 0).select(named(k).alias("tag"), named(into).alias("into"))


@query("tag_merge_chained", f"{_ENDS} SELECT DISTINCT l_orderkey AS item_id, coalesce(final, t) AS tag FROM (SELECT l_orderkey, 't' || l_partkey AS t FROM lineitem) LEFT JOIN ends ON ends.tag = t")
def tag_merge_chained(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    links = lines.select(F.col("l_orderkey").alias("item_id"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("tag"))
    return ingest.merge_tags(links, _renames(spark, d))


@query("rename_cycles", f"{_ENDS} SELECT tag, final AS cycle FROM ends WHERE is_cycle")
def rename_cycles(spark, d):
    """The tags whose renames lead round in a circle, and the circle's name."""
    return chains.resolve(_renames(spark, d)).where("cycle is not null").select("tag", "cycle")


@query("note_upsert", "SELECT item_id, arg_max(body, k) AS body, max(k)::BIGINT AS updated FROM (SELECT conv_id AS item_id, text AS body, turn AS k FROM conversations) GROUP BY 1")
def note_upsert(spark, d):
    notes = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("item_id"), F.col("text").alias("body"), F.col("turn").alias("updated"))
    return state.upsert(notes.where("updated % 2 = 0"), notes.where("updated % 2 = 1"), "item_id", "updated")


@query("replace_collections", "SELECT item_id, collection_id FROM collection_items_ WHERE item_id % 10 <> 0 UNION ALL SELECT item_id, 3 FROM collection_items_ WHERE item_id % 10 = 0", "collection_items")
def replace_collections(spark, d):
    members = entity(spark, d, "collection_items")
    edited = members.where("item_id % 10 = 0").select("item_id")
    new = edited.withColumn("collection_id", F.lit(3)).unionByName(edited.withColumn("collection_id", F.lit(4711)))
    return state.replace_links(members, new, entity(spark, d, "collections"), "item_id", "collection_id")


@query("bump_revisions", "SELECT id, (CASE WHEN id IN (SELECT item_id FROM item_tags_) THEN 1 ELSE 0 END)::BIGINT AS current_revision FROM items_", "items", "item_tags")
def bump_revisions(spark, d):
    items = entity(spark, d, "items").select("id", F.lit(0).cast("long").alias("current_revision"))
    return state.bump_revisions(items, entity(spark, d, "item_tags"))


_READY = "SELECT id FROM items_ WHERE status = 'ready'"


@query("delete_original_effect", f"SELECT item_id, count(*) AS removed_assets, sum(bytes)::BIGINT AS removed_bytes FROM assets_ WHERE role = 'original' AND item_id IN ({_READY}) GROUP BY 1", "assets", "items")
def delete_original_effect(spark, d):
    return state.delete_originals(entity(spark, d, "assets"), entity(spark, d, "items"))[1]


@query("delete_original_left", f"SELECT item_id, role, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM assets_ WHERE NOT (role = 'original' AND item_id IN ({_READY})) GROUP BY 1, 2", "assets", "items")
def delete_original_left(spark, d):
    left = state.delete_originals(entity(spark, d, "assets"), entity(spark, d, "items"))[0]
    return left.groupBy("item_id", "role").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("delete_original_stamp", f"SELECT id, CASE WHEN status = 'ready' AND id IN (SELECT item_id FROM item_tags_) THEN {NOW} END AS original_deleted_at FROM items_", "items", "item_tags")
def delete_original_stamp(spark, d):
    items = entity(spark, d, "items").select("id", "status", F.lit(None).cast("timestamp_ntz").alias("original_deleted_at"))
    return state.stamp_deleted(items, entity(spark, d, "item_tags"), _ntz()).select("id", "original_deleted_at")


_TRASH = "(SELECT user_id AS id, CASE WHEN max(event_id) % 3 > 0 THEN max(ts) - to_days((max(event_id) % 60)::INT) END AS deleted_at FROM events GROUP BY 1)"


def _trash(spark, d):
    last = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("e"), F.max("ts").alias("ts"))
    return last.select("id", F.when(F.col("e") % 3 > 0, F.col("ts") - F.make_interval(days=(F.col("e") % 60).cast("int"))).alias("deleted_at"))


@query("trash_state", f"SELECT id, CASE WHEN deleted_at IS NULL THEN 'kept' WHEN deleted_at > {NOW} - INTERVAL 30 DAY THEN 'trash' ELSE 'gone' END AS state FROM {_TRASH}")
def trash_state(spark, d):
    return state.trash_state(_trash(spark, d), _ntz())


@query("trash_restore", f"SELECT id, CASE WHEN id % 5 > 0 THEN deleted_at END AS deleted_at FROM {_TRASH} WHERE deleted_at IS NULL OR deleted_at > {NOW} - INTERVAL 30 DAY")
def trash_restore(spark, d):
    rows = _trash(spark, d)
    return state.restore(rows, rows.where("id % 5 = 0").select("id"), _ntz())


@query("rename_topics", "SELECT slug, CASE WHEN n % 2 = 1 THEN 'My ' || label ELSE label END AS label, display_order FROM topics_ LEFT JOIN (SELECT topic, count(*) AS n FROM item_topics_ GROUP BY 1) u ON u.topic = slug", "topics", "item_topics")
def rename_topics(spark, d):
    """Topics with an odd number of items get a name of the user's."""
    topics = entity(spark, d, "topics")
    odd = entity(spark, d, "item_topics").groupBy(F.col("topic").alias("slug")).agg(F.count("*").alias("n")).where("n % 2 = 1")
    return state.rename(topics, topics.join(odd, "slug").select("slug", F.concat(F.lit("My "), "label").alias("new_name")), "slug", "label")


@query("catalog_reopened", "SELECT id::VARCHAR AS id, CASE WHEN id % 2 = 0 THEN upper(platform) ELSE platform END AS platform, CASE WHEN id % 2 = 0 THEN 'ready' ELSE status END AS status FROM items_", "items")
def catalog_reopened(spark, d):
    """Items written to a catalog, changed through a second one on the same folder and read through a third."""
    path = new_dir(spark)
    items = entity(spark, d, "items").select(F.col("id").cast("string").alias("id"), "title", "platform", "status", _ntz().alias("created_at"))
    Catalog(spark, path).write("items", items)
    again = Catalog(spark, path)
    even = F.col("id").cast("long") % 2 == 0
    again.write("items", again.read("items").withColumns({"platform": F.when(even, F.upper("platform")).otherwise(F.col("platform")), "status": F.when(even, "ready").otherwise(F.col("status"))}))
    return Catalog(spark, path).read("items").select("id", "platform", "status")


_DEMO = "(VALUES ('demo-item-1', 'typography', 'screen,type', 'Letter Library', 0), ('demo-item-2', 'design', 'form', 'Form Notes', 1), ('demo-item-3', 'animation', 'easing,motion', 'Curve Garden', 2), ('demo-item-4', 'learning', 'notes', 'Reading Log', 3)) AS t(id, topic, tags, website, days)"


@query("demo_catalog", f"SELECT * FROM {_DEMO} UNION ALL SELECT id::VARCHAR, topic, NULL, NULL, 0 FROM items_ JOIN item_topics_ ON item_id = id", "items", "item_topics")
def demo_catalog(spark, d):
    """The demonstration, added twice to a catalog that holds the documents."""
    now, text_id = datetime(2024, 1, 15), F.col("id").cast("string")
    catalog = Catalog(spark, new_dir(spark))
    catalog.write("items", entity(spark, d, "items").select(text_id.alias("id"), "title", "platform", "status", F.lit(now).alias("created_at")))
    catalog.write("item_topics", entity(spark, d, "item_topics").select(F.col("item_id").cast("string").alias("item_id"), "topic"))
    demo.seed_demo(catalog, now)
    demo.seed_demo(catalog, now)
    sites = catalog.read("mentions").join(catalog.read("websites").select(F.col("id").alias("website_id"), F.col("name").alias("website")), "website_id").select("item_id", "website")
    joined = catalog.read("item_topics").join(detail.item_tags(catalog.read("item_tags")), "item_id", "left").join(sites, "item_id", "left").withColumnRenamed("item_id", "id")
    return catalog.read("items").join(joined, "id").select("id", "topic", "tags", "website", F.date_diff(F.lit(now), "created_at").alias("days"))


@query("cascade_delete", "SELECT item_id, tag FROM item_tags_ WHERE item_id NOT IN (SELECT id FROM items_ WHERE status = 'failed')", "item_tags", "items")
def cascade_delete(spark, d):
    return state.cascade(entity(spark, d, "item_tags"), entity(spark, d, "items").where("status = 'failed'"))


@query("set_null_reference", "SELECT item_id, seq, CASE WHEN website_id % 2 = 1 THEN website_id END AS website_id, unresolved_name FROM mentions_", "mentions")
def set_null_reference(spark, d):
    gone = entity(spark, d, "websites").where("id % 2 = 0")
    return state.forget_reference(entity(spark, d, "mentions"), gone, "website_id")


@query("unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, d):
    return ingest.unique_violations(spark.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey", "l_linenumber")


def _pattern(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _plain_sql(html: str) -> str:
    return f"trim(regexp_replace({'replace(' * 6}regexp_replace({html}, '(?s)<[^>]*(?:>|$)', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&'), '[\\s\\x0B\\x{{A0}}]+', ' ', 'g'))"


_TEXTS = f"""shown AS (SELECT page_id, regexp_replace(html, {_pattern(pagetext.HIDDEN_PATTERN)}, ' ', 'g') AS html FROM pages),
    cut AS (SELECT page_id, string_split(regexp_replace(html, {_pattern(pagetext.BLOCK_PATTERN)}, chr(1) || '\\1', 'g'), chr(1)) AS b FROM shown),
    block AS (SELECT page_id, unnest(b) AS b, unnest(range(len(b))) AS i FROM cut),
    plain AS (SELECT page_id, b, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k, text FROM (SELECT *, {_plain_sql("b")} AS text FROM block) WHERE text <> ''),
    scored AS (SELECT *, length(text) - {pagetext.LINK_COST} * length({_plain_sql(f"array_to_string(regexp_extract_all(b, {_pattern(pagetext.LINK_PATTERN)}, 1), ' ')")})
        - CASE WHEN beside THEN {pagetext.BESIDE_COST} WHEN regexp_matches(b, {_pattern(pagetext.HEADING_PATTERN)}) THEN 0 ELSE {pagetext.BLOCK_COST} END AS score FROM (SELECT *, regexp_matches(b, {_pattern(pagetext.BESIDE_PATTERN)}) AS beside FROM plain)),
    summed AS (SELECT page_id, k, text, beside, sum(score) OVER w AS upto, sum(score) OVER w - score AS before FROM scored WINDOW w AS (PARTITION BY page_id ORDER BY k)),
    runs AS (SELECT *, upto - min(before) OVER w AS total, arg_min(k, ROW(before, -k)) OVER w AS start FROM summed WINDOW w AS (PARTITION BY page_id ORDER BY k)),
    best AS (SELECT page_id, max(total) AS total, arg_min(start, ROW(-total, k)) AS low, arg_min(k, ROW(-total, k)) AS high FROM runs GROUP BY 1),
    texts AS (SELECT p.page_id, p.html, left(coalesce(t.text, ''), 60000) AS text FROM pages p LEFT JOIN (SELECT r.page_id, string_agg(text, ' ' ORDER BY k) AS text FROM runs r JOIN best b ON b.page_id = r.page_id
        WHERE CASE WHEN b.total < {pagetext.LEAST} THEN NOT beside ELSE k BETWEEN low AND high END GROUP BY 1) t ON t.page_id = p.page_id)"""


@query("extract_page_text", f"WITH {_TEXTS} SELECT page_id, text FROM texts")
def extract_page_text(spark, d):
    return _pages(spark, d).select("page_id", pagetext.page_text(F.col("html")).alias("text"))


def _page_writes(spark, d):
    read = pages.read_pages(_pages(spark, d).select(F.col("page_id").alias("item_id"), F.col("url").alias("title"), "html"))
    return pages.page_writes(read, entity(spark, d, "jobs"))


_HEADING = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
_READ = f"WITH {_TEXTS}, titled AS (SELECT page_id, text, {_plain_sql(_HEADING)} AS title FROM texts)"


@query("page_result_items", f"{_READ} SELECT page_id AS id, left(title, 160) AS title, left(text, 600) AS description, 'ready' AS status FROM titled")
def page_result_items(spark, d):
    return _page_writes(spark, d)["items"]


@query("page_result_evidence", f"{_READ} SELECT 'page:' || sha256(page_id || chr(10) || text) AS id, page_id AS item_id, 'page' AS kind, 'Readable page text' AS label, left(text, 600) AS excerpt FROM titled")
def page_result_evidence(spark, d):
    return _page_writes(spark, d)["evidence"]


@query("page_result_chunks", f"{_READ} SELECT page_id AS item_id, left(title, 160) || chr(10) || text AS body, 'page:' || sha256(page_id || chr(10) || text) AS evidence_id FROM titled")
def page_result_chunks(spark, d):
    return _page_writes(spark, d)["chunks"].select("item_id", "body", F.get("evidence_ids", 0).alias("evidence_id"))


@query("page_result_revisions", f"""{_READ}, r AS (SELECT conv_id AS item_id, turn AS revision, left(text, 40) AS title, text AS summary FROM conversations)
    SELECT item_id, revision, title, summary FROM r WHERE NOT (revision = 1 AND item_id IN (SELECT page_id FROM pages)) UNION ALL SELECT page_id, 1, left(title, 160), left(text, 600) FROM titled""")  # fmt: skip
def page_result_revisions(spark, d):
    columns = ("item_id", "revision", "title", "summary")
    return pages.with_revisions(entity(spark, d, "revisions").select(*columns), _page_writes(spark, d)["revisions"].select(*columns))


@query("page_result_jobs", "SELECT id, 'done' AS status FROM jobs_ WHERE item_id IN (SELECT page_id FROM pages)", "jobs")
def page_result_jobs(spark, d):
    return _page_writes(spark, d)["jobs"].where("lease_expires_at is null and message is null").select("id", "status")


@query("evidence_seq", "SELECT item_id, id, (SELECT count(*) FROM evidence_ o WHERE o.item_id = n.item_id) + row_number() OVER (PARTITION BY n.item_id ORDER BY n.id) - 1 AS seq FROM (SELECT user_id AS item_id, 'event:' || event_id AS id FROM events) n", "evidence")
def evidence_seq(spark, d):
    old = entity(spark, d, "evidence").select("item_id", (F.row_number().over(Window.partitionBy("item_id").orderBy("id")) - 1).alias("seq"))
    new = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("item_id"), F.concat(F.lit("event:"), "event_id").alias("id"))
    return pages.next_seq(old, new, "id")


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


@query(
    "page_title",
    "SELECT page_id, left(regexp_replace(regexp_replace(" + "replace(" * 6 + _TITLE + ", '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'), '^ | $', '', 'g'), 160) AS title FROM pages",
)
def page_title(spark, d):
    return _pages(spark, d).select("page_id", text.page_title(F.col("html")).alias("title"))


# ---- graph

_SHOWN = "shown AS (SELECT *, row_number() OVER (ORDER BY created_order, id) - 1 AS place FROM (SELECT * FROM items_ ORDER BY created_order, id LIMIT 50))"
_PRIMARY = "prime AS (SELECT i.id, coalesce(min(t.topic), 'other') AS topic FROM items_ i LEFT JOIN item_topics_ t ON t.item_id = i.id GROUP BY 1)"
_USED = "used AS (SELECT w.id, w.name, count(*) AS uses FROM websites_ w JOIN mentions_ m ON m.website_id = w.id GROUP BY 1, 2 ORDER BY 3 DESC, 2, 1 LIMIT 20)"
_GRAPH = ("items", "item_topics", "topics", "websites", "mentions")
_PLACED = (
    "nodes AS (SELECT 'topic:' || slug AS id, 'topic' AS kind, label, '' AS subtitle, 0 AS part, display_order AS place, 120::BIGINT AS x, (120 + 120 * (row_number() OVER (ORDER BY display_order) - 1))::BIGINT AS y FROM topics_ "
    "UNION ALL SELECT 'item:' || s.id, 'item', CASE WHEN coalesce(title, '') = '' THEN 'Untitled source' ELSE title END, platform, 1, place, (320 + (place % 5) * 190)::BIGINT, (120 + 120 * coalesce(t.display_order, 0))::BIGINT "
    "FROM shown s JOIN prime p ON p.id = s.id LEFT JOIN topics_ t ON t.slug = p.topic "
    "UNION ALL SELECT 'website:' || id, 'website', name, uses || CASE WHEN uses = 1 THEN ' mention' ELSE ' mentions' END, 2, row_number() OVER (ORDER BY uses DESC, name, id), 1120::BIGINT, (100 + 68 * (row_number() OVER (ORDER BY uses DESC, name, id) - 1))::BIGINT FROM used)"
)
_TOPIC_EDGES = "tedges AS (SELECT 'topic-edge:' || topic || ':' || s.id AS id, 'topic:' || topic AS source, 'item:' || s.id AS target, 'topic' AS kind, 0 AS part, place FROM shown s JOIN prime p ON p.id = s.id)"
_SITE_EDGES = (
    "wedges AS (SELECT 'website-edge:' || website_id || ':' || item_id AS id, 'website:' || website_id AS source, 'item:' || item_id AS target, 'website' AS kind, 1 AS part, 4 * (SELECT count(*) FROM used o WHERE (-o.uses, o.name, o.id) < (-u.uses, u.name, u.id)) + r AS place FROM "
    "(SELECT *, row_number() OVER (PARTITION BY website_id ORDER BY item_id) AS r FROM (SELECT DISTINCT website_id, item_id FROM mentions_ WHERE website_id IN (SELECT id FROM used))) m JOIN used u ON u.id = m.website_id WHERE r <= 4 AND item_id IN (SELECT s.id FROM shown s))"
)


def _graph(sql: str, *ctes: str) -> str:
    return with_entities("{{}}", *_GRAPH).replace(" {{}}", f", {', '.join(ctes)} {sql}")


def _shown(spark, d):
    return graph.graph_items(entity(spark, d, "items"))


def _shown_prime(spark, d):
    return graph.primary_topic(_shown(spark, d), entity(spark, d, "item_topics"), few=True)


def _prime(spark, d):
    return graph.primary_topic(entity(spark, d, "items"), entity(spark, d, "item_topics"))


def _used(spark, d):
    return graph.website_usage(entity(spark, d, "websites"), entity(spark, d, "mentions"))


@query("graph_items", _graph("SELECT id, title, place::BIGINT AS place FROM shown", _SHOWN))
def graph_items(spark, d):
    return _shown(spark, d).select("id", "title", "place")


@query("primary_topic", _graph("SELECT id, topic FROM prime", _PRIMARY))
def primary_topic(spark, d):
    return _prime(spark, d)


@query("website_usage", _graph("SELECT id, name, uses FROM used", _USED))
def website_usage(spark, d):
    return _used(spark, d)


@query("website_usage_by_topic", f"SELECT w.id, w.name, count(*) AS uses FROM websites_ w JOIN mentions_ m ON m.website_id = w.id WHERE m.item_id IN (SELECT item_id FROM item_topics_ WHERE topic = '{TOPIC}') GROUP BY 1, 2 ORDER BY 3 DESC, 2, 1 LIMIT 20", "websites", "mentions", "item_topics")
def website_usage_by_topic(spark, d):
    return graph.website_usage(entity(spark, d, "websites"), entity(spark, d, "mentions"), entity(spark, d, "item_topics"), TOPIC)


@query("website_edges", _graph("SELECT id, source, target FROM wedges", _SHOWN, _USED, _SITE_EDGES))
def website_edges(spark, d):
    return graph.website_edges(_shown(spark, d), _used(spark, d), entity(spark, d, "mentions")).drop("place")


@query("graph_edges", _graph("SELECT id, source, target, kind FROM (SELECT * FROM tedges UNION ALL SELECT * FROM wedges) ORDER BY part, place LIMIT 120", _SHOWN, _PRIMARY, _USED, _TOPIC_EDGES, _SITE_EDGES))
def graph_edges(spark, d):
    sites = graph.website_edges(_shown(spark, d), _used(spark, d), entity(spark, d, "mentions"))
    return graph.edges(graph.topic_edges(_shown(spark, d), _shown_prime(spark, d)), sites).select("id", "source", "target", "kind")


@query("graph_of_topic", f"SELECT id, title FROM items_ WHERE id IN (SELECT item_id FROM item_topics_ WHERE topic = '{TOPIC}') ORDER BY created_order, id LIMIT 50", "items", "item_topics")
def graph_of_topic(spark, d):
    return graph.graph_items(entity(spark, d, "items"), entity(spark, d, "item_topics"), TOPIC).select("id", "title")


@query("graph_summary", "SELECT least(50, count(*)) AS visible_count, count(*) >= 50 AS has_more FROM items_", "items")
def graph_summary(spark, d):
    return graph.summary(_shown(spark, d))


def _nodes(spark, d):
    return graph.nodes(entity(spark, d, "topics"), _shown(spark, d), _shown_prime(spark, d), _used(spark, d))


@query("graph_nodes", _graph("SELECT id, kind, label, subtitle FROM nodes ORDER BY part, place LIMIT 80", _SHOWN, _PRIMARY, _USED, _PLACED))
def graph_nodes(spark, d):
    return graph.capped_nodes(_nodes(spark, d)).select("id", "kind", "label", "subtitle")


@query("graph_positions", _graph("SELECT id, x, y FROM nodes", _SHOWN, _PRIMARY, _USED, _PLACED))
def graph_positions(spark, d):
    return _nodes(spark, d).select("id", "x", "y")


# ---- jobs

_RUN = f"j.status = 'queued' AND (next_attempt_at IS NULL OR next_attempt_at <= {NOW}) AND item_id IN (SELECT id FROM items_ WHERE status NOT IN ('paused', 'canceled'))"


def _jobs(spark, d):
    return entity(spark, d, "jobs")


@query("runnable_jobs", f"SELECT id, item_id, created_at FROM jobs_ j WHERE {_RUN}", "jobs", "items")
def runnable_jobs(spark, d):
    return jobs.runnable(_jobs(spark, d), entity(spark, d, "items"), _ntz()).select("id", "item_id", "created_at")


@query("next_job", f"SELECT id, item_id, stage FROM jobs_ j WHERE {_RUN} ORDER BY created_at, id LIMIT 1", "jobs", "items")
def next_job(spark, d):
    return jobs.next_jobs(_jobs(spark, d), entity(spark, d, "items"), _ntz()).select("id", "item_id", "stage")


@query("claim_transition", f"SELECT id, 'running' AS status, attempt + 1 AS attempt, {NOW} + INTERVAL 60 SECOND AS lease_expires_at, CASE WHEN stage = 'acquire' THEN 'downloading' ELSE 'analyzing' END AS item_status FROM jobs_ j WHERE {_RUN} ORDER BY created_at, id LIMIT 10", "jobs", "items")
def claim_transition(spark, d):
    claimed = jobs.claim(jobs.next_jobs(_jobs(spark, d), entity(spark, d, "items"), _ntz(), 10), _ntz())
    return claimed.select("id", "status", "attempt", "lease_expires_at", "item_status")


@query(
    "stage_outcome",
    f"SELECT j.id, CASE WHEN p.page_id IS NULL THEN 'failed' ELSE 'done' END AS status, CASE WHEN p.page_id IS NULL THEN NULL WHEN stage <> 'acquire' THEN 'waiting_for_key' WHEN j.item_id % 10 = 0 OR length(html) < 3000 AND j.item_id % 10 <> 1 THEN 'ready' ELSE 'needs_review' END AS item_status, "
    f"CASE WHEN p.page_id IS NULL THEN '{jobs.GONE}' WHEN stage <> 'acquire' THEN '{jobs.NO_KEY}' WHEN j.item_id % 10 = 0 THEN NULL WHEN j.item_id % 10 = 1 THEN '{jobs.TOO_LARGE}' WHEN length(html) >= 3000 THEN '{jobs.FALLBACK}' END AS message FROM jobs_ j LEFT JOIN pages p ON p.page_id = j.item_id",
    "jobs",
)
def stage_outcome(spark, d):
    page = F.col("page_id")
    size = F.when(page % 10 == 1, 6 << 20).otherwise(F.length("html"))
    sources = _pages(spark, d).select(page.alias("id"), F.when(page % 10 > 0, F.col("url")).alias("source_url"), (F.length("html") < 3000).alias("readable"), size.alias("bytes"))
    return jobs.stage_outcome(_jobs(spark, d), sources)


@query(
    "pause_and_cancel",
    "SELECT id, CASE WHEN r = 2 AND status IN ('queued', 'running') THEN 'canceled' ELSE status END AS status, CASE WHEN r = 2 AND status IN ('queued', 'running') THEN 'canceled' WHEN r = 1 AND status = 'queued' THEN 'paused' END AS item_status "
    "FROM jobs_ LEFT JOIN (SELECT o_custkey AS item_id, max(o_orderkey) % 3 AS r FROM orders GROUP BY 1) USING (item_id)",
    "jobs",
)
def pause_and_cancel(spark, d):
    order = F.col("o_orderkey")
    asked = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("item_id"), F.element_at(F.array(F.lit("resume"), F.lit("pause"), F.lit("cancel")), (order % 3 + 1).cast("int")).alias("request"), order.alias("at"))
    return jobs.between_stages(jobs.flagged(_jobs(spark, d), asked))


@query("expired_leases", f"SELECT id, item_id, 'queued' AS status FROM jobs_ WHERE status = 'running' AND lease_expires_at < {NOW}", "jobs")
def expired_leases(spark, d):
    return jobs.expired(_jobs(spark, d), _ntz()).select("id", "item_id", "status")


@query("retry_backoff", "SELECT id, (CASE WHEN error = '429' AND id % 8 = 0 THEN least(id * 10, 86400) WHEN error = '429' AND a = 0 THEN 900 WHEN error = '429' AND a = 1 THEN 3600 WHEN error = '5xx' AND a = 0 THEN 30 WHEN error = '5xx' AND a = 1 THEN 120 WHEN error = '5xx' AND a = 2 THEN 600 END)::BIGINT AS wait_s FROM (SELECT *, id // 4 % 4 AS a FROM jobs_ WHERE status = 'failed')", "jobs")
def retry_backoff(spark, d):
    failed = _jobs(spark, d).where("status = 'failed'")
    after = F.when(F.col("id") % 8 == 0, F.col("id") * 10)
    return failed.select("id", jobs.retry_seconds(F.col("error"), F.floor(F.col("id") / 4) % 4, after).alias("wait_s"))


@query("daily_cap_usage", "SELECT created_at::DATE AS day, count(*) AS calls, count(*) >= 30 AS capped FROM jobs_ GROUP BY 1", "jobs")
def daily_cap_usage(spark, d):
    return jobs.daily_calls(_jobs(spark, d), 30)


@query("call_spacing", "SELECT id, round(gap, 6) AS gap_s FROM (SELECT id, epoch_us(created_at - lag(created_at) OVER (PARTITION BY created_at::DATE ORDER BY created_at, id)) / 1000000 AS gap FROM jobs_) WHERE gap < 15", "jobs")
def call_spacing(spark, d):
    return jobs.too_close(_jobs(spark, d))


#: Requests of calls, and their starts one after another.
CALLS_SQL = f"""
    WITH RECURSIVE r AS (SELECT event_id AS id, user_id % 40 AS provider, ts AS asked, event_id % 40 AS took, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS k FROM events),
    s AS (SELECT id, provider, asked, took, k, asked AS starts, 1 AS n FROM r WHERE k = 1
        UNION ALL SELECT id, provider, asked, took, k, starts, CASE WHEN starts::DATE = was::DATE THEN n + 1 ELSE 1 END FROM (
            SELECT *, CASE WHEN free::DATE = was::DATE AND n >= {jobs.DAILY} THEN (was::DATE + 1)::TIMESTAMP ELSE free END AS starts FROM (
                SELECT r.*, s.starts AS was, s.n, greatest(r.asked, s.starts + INTERVAL {jobs.SPACING} SECOND, s.starts + to_seconds(s.took)) AS free FROM s JOIN r ON r.provider = s.provider AND r.k = s.k + 1)))
    SELECT id, provider, asked AS "at", starts FROM s
"""


@query("call_schedule", CALLS_SQL)
def call_schedule(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return jobs.schedule(events.select(F.col("event_id").alias("id"), (F.col("user_id") % 40).alias("provider"), F.col("ts").alias("at"), (F.col("event_id") % 40).alias("took_s")))


@query("worker_liveness", "SELECT user_id % 7 AS worker, max(ts) AS last_seen, max(ts) > TIMESTAMP '2024-01-29 12:00:00' - INTERVAL 5 SECOND AS online FROM events GROUP BY 1")
def worker_liveness(spark, d):
    beats = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 7).alias("worker"), "ts")
    return jobs.liveness(beats, F.expr("TIMESTAMP_NTZ '2024-01-29 12:00:00'"))


_STAGE = "SELECT doc_id AS item_id, 'analyze' AS stage, md5(text) AS input_hash, 'm' || doc_id % 2 AS model, 'v1' AS prompt_version FROM documents"


@query("uncached_stages", f"WITH w AS ({_STAGE}) SELECT * FROM w WHERE NOT (item_id % 3 = 0 AND model = 'm0')")
def uncached_stages(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    wanted = docs.select(F.col("doc_id").alias("item_id"), F.lit("analyze").alias("stage"), F.md5("text").alias("input_hash"), F.concat(F.lit("m"), F.col("doc_id") % 2).alias("model"), F.lit("v1").alias("prompt_version"))
    return jobs.uncached(wanted, wanted.where("item_id % 3 = 0 and model = 'm0'"))


# ---- retrieval

_W = "list_filter(string_split_regex(coalesce(body, ''), '\\s+'), lambda w: w <> '')"


@query("chunk_documents", f"SELECT item_id, seq, len(p)::BIGINT AS n_words, array_to_string(p, ' ') AS body FROM (SELECT item_id, seq, w[seq * 180 + 1:seq * 180 + 220] AS p FROM (SELECT item_id, w, unnest(range(greatest(0, ceil((len(w) - 220) / 180.0))::BIGINT + 1)) AS seq FROM (SELECT item_id, {_W} AS w FROM chunks_) WHERE len(w) > 0))", "chunks")
def chunk_documents(spark, d):
    return retrieval.chunk(entity(spark, d, "chunks"))


BM_WORDS = ["the", "license", "apache"]
_TERMS = f"list_filter(string_split_regex({_fold('body')}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def _chunks_by_id(spark, d):
    return entity(spark, d, "chunks").withColumnRenamed("item_id", "id")


@query("bm25_stats", f"SELECT count(*) AS n_chunks, sum(len(w))::BIGINT AS n_words, round(avg(len(w)), 6) AS avg_words FROM (SELECT {_TERMS} AS w FROM chunks_)", "chunks")
def bm25_stats(spark, d):
    return retrieval.corpus_stats(_chunks_by_id(spark, d))


@query("term_index", f"SELECT item_id AS id, term, count(*) AS tf FROM (SELECT item_id, unnest({_TERMS}) AS term FROM chunks_) GROUP BY 1, 2", "chunks")
def term_index(spark, d):
    return retrieval.term_counts(_chunks_by_id(spark, d))


_BM = f"""listed AS (SELECT item_id AS id, {_TERMS} AS w FROM chunks_), stat AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM listed),
terms AS (SELECT unnest({sorted(BM_WORDS)}) AS q), df AS (SELECT q, count(*) AS df FROM terms JOIN listed ON list_contains(w, q) GROUP BY 1),
tf AS (SELECT id, q, len(w) AS size, len(list_filter(w, lambda x: x = q)) AS tf FROM listed, terms),
scored AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM tf JOIN df USING (q), stat GROUP BY 1),
bm AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0 ORDER BY score DESC, id LIMIT 50)"""


def _then(first: str, ctes: str, sql: str, *names: str) -> str:
    return with_entities("{{}}", *names).replace(" {{}}", f", {ctes} {sql}")


def _bm25(spark, d):
    return retrieval.bm25(_chunks_by_id(spark, d), BM_WORDS)


@query("bm25_topk", _then("", _BM, "SELECT id, score, rank FROM bm", "chunks"))
def bm25_topk(spark, d):
    return _bm25(spark, d)


_VEC = "vec AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, round(list_cosine_similarity(vector::DOUBLE[], (SELECT vector::DOUBLE[] FROM vectors_ WHERE id = 0)), 6) AS score FROM vectors_{}) ORDER BY score DESC, id LIMIT 50)"


def _query_vector(spark, d):
    return entity(spark, d, "vectors").where("id = 0").first()["vector"]


@query("cosine_topk", _then("", _VEC.format(""), "SELECT id, score, rank FROM vec", "vectors"))
def cosine_topk(spark, d):
    return retrieval.nearest(entity(spark, d, "vectors"), _query_vector(spark, d))


@query("similar_items", _then("", _VEC.format(" WHERE id <> 0"), "SELECT id, score, rank FROM vec", "vectors"))
def similar_items(spark, d):
    return retrieval.nearest(entity(spark, d, "vectors"), _query_vector(spark, d), exclude=0)


@query("bm25_indexed", _then("", _BM, "SELECT id, score, rank FROM bm", "chunks"))
def bm25_indexed(spark, d):
    """An index of all chunks is stored, and the query reads its words' rows of it."""
    path = new_dir(spark)
    retrieval.store_index(_chunks_by_id(spark, d), path)
    return retrieval.bm25_of(spark, path, BM_WORDS)


@query("rrf_fusion", _then("", _BM + ", " + _VEC.format(""), "SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT id, rank FROM bm UNION ALL SELECT id, rank FROM vec) GROUP BY 1", "chunks", "vectors"))
def rrf_fusion(spark, d):
    return retrieval.fuse(_bm25(spark, d), cosine_topk(spark, d))


@query("retrieval_mode", "SELECT CASE WHEN count(*) > 0 THEN 'hybrid' ELSE 'keyword' END AS mode FROM vectors_", "vectors")
def retrieval_mode(spark, d):
    return retrieval.mode(entity(spark, d, "vectors"))


@query("item_score_rollup", "SELECT item_id, score, seqs FROM (SELECT conv_id AS item_id, max(length(text)) AS score, array_to_string(list(turn ORDER BY length(text) DESC, turn)[1:2], ',') AS seqs FROM conversations GROUP BY 1) ORDER BY score DESC, item_id LIMIT 20")
def item_score_rollup(spark, d):
    scored = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("seq"), F.length("text").cast("long").alias("score"))
    return retrieval.roll_up(scored)


_SITE = "supplier-000000003.example"


@query("filtered_rollup", f"""SELECT item_id, score, seqs FROM (SELECT item_id, max(tf) AS score, '0' AS seqs, bool_or(item_id IN (SELECT m.item_id FROM mentions_ m JOIN websites_ w ON w.id = m.website_id WHERE w.hostname = '{_SITE}')) AS lead
    FROM (SELECT item_id, len(regexp_extract_all(lower(body), '\\bthe\\b')) AS tf FROM chunks_ WHERE item_id IN (SELECT item_id FROM item_topics_ WHERE topic = 'en')) WHERE tf > 0 GROUP BY 1) ORDER BY score DESC, lead DESC, item_id LIMIT 20""", "chunks", "item_topics", "mentions", "websites")  # fmt: skip
def filtered_rollup(spark, d):
    """Items of a topic by a word's count; those that mention the site asked for lead among equals."""
    kept = entity(spark, d, "item_topics").where("topic = 'en'").select("item_id")
    chunks = entity(spark, d, "chunks").join(kept, "item_id", "left_semi")
    scored = chunks.select("item_id", "seq", F.regexp_count(F.lower("body"), F.lit(r"\bthe\b")).cast("long").alias("score")).where("score > 0")
    return retrieval.roll_up(scored, exact=retrieval.exact_sites(entity(spark, d, "mentions"), entity(spark, d, "websites"), f" {_SITE.upper()} "))


# ---- media


def _videos(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").groupBy(F.col("conv_id").alias("item_id")).agg((F.sum(F.length("text")) * 100).alias("duration_ms"))


_VIDEOS = "videos AS (SELECT conv_id AS item_id, (sum(length(text)) * 100)::BIGINT AS duration_ms FROM conversations GROUP BY 1)"
_FRAMES = "frames AS (SELECT item_id, unnest(range(0, duration_ms, CASE WHEN duration_ms <= 180000 THEN 500 ELSE 2000 END)) AS at_ms FROM videos)"
_HASHED = "hashed AS (SELECT item_id, at_ms, ((item_id * 31 + at_ms // 1500) * 7919) % 1048576 AS hash FROM frames)"


def _hashed(spark, d):
    hash_ = ((F.col("item_id") * 31 + F.floor(F.col("at_ms") / 1500)) * 7919) % 1048576
    return media.sample_plan(_videos(spark, d)).withColumn("hash", hash_)


@query("frame_sample_plan", f"WITH {_VIDEOS}, {_FRAMES} SELECT item_id, at_ms FROM frames")
def frame_sample_plan(spark, d):
    return media.sample_plan(_videos(spark, d))


_CHANGED = "changed AS (SELECT *, coalesce(bit_count(xor(hash, lag(hash) OVER (PARTITION BY item_id ORDER BY at_ms))), 64)::BIGINT AS change FROM hashed), kept AS (SELECT * FROM changed WHERE change > 4)"


@query("frame_dedup", f"WITH {_VIDEOS}, {_FRAMES}, {_HASHED}, {_CHANGED} SELECT item_id, at_ms, change FROM kept")
def frame_dedup(spark, d):
    return media.distinct_frames(_hashed(spark, d)).select("item_id", "at_ms", "change")


def _chosen(spark, d):
    moments = spark.read.parquet(f"{d}/conversations.parquet").where("role = 'assistant'").select(F.col("conv_id").alias("item_id"), (F.col("turn") * 4000).alias("at_ms"))
    return media.select_frames(media.distinct_frames(_hashed(spark, d)), moments)


_CHOSEN = """timed AS (SELECT *, at_ms - min(at_ms) OVER (PARTITION BY item_id) AS since, max(at_ms) OVER (PARTITION BY item_id) - min(at_ms) OVER (PARTITION BY item_id) + 1 AS span FROM kept),
even AS (SELECT item_id, min(at_ms) AS at_ms FROM timed GROUP BY item_id, since * 8 // span),
asked AS (SELECT conv_id AS item_id, turn * 4000 AS m FROM conversations WHERE role = 'assistant'),
close AS (SELECT DISTINCT item_id, arg_min(at_ms, (abs(at_ms - m), at_ms)) AS at_ms FROM asked JOIN kept USING (item_id) GROUP BY item_id, m),
near AS (SELECT item_id, at_ms FROM close WHERE (item_id, at_ms) NOT IN (SELECT item_id, at_ms FROM even) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY at_ms) <= 12),
taken AS (SELECT item_id, at_ms, 0 AS pick FROM even UNION ALL SELECT item_id, at_ms, 1 FROM near),
open AS (SELECT t.*, greatest(1, 32 - n) AS places FROM timed t JOIN (SELECT item_id, count(*) AS n FROM taken GROUP BY 1) USING (item_id) WHERE (item_id, at_ms) NOT IN (SELECT item_id, at_ms FROM taken)),
led AS (SELECT *, row_number() OVER (PARTITION BY item_id, since * places // span ORDER BY change DESC, at_ms) = 1 AS leads FROM open),
rest AS (SELECT item_id, at_ms FROM led JOIN (SELECT item_id, count(*) AS n FROM taken GROUP BY 1) USING (item_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY leads DESC, change DESC, at_ms) <= 32 - n),
chosen AS (SELECT * FROM taken UNION ALL SELECT item_id, at_ms, 2 FROM rest)"""


@query("frame_selection", f"WITH {_VIDEOS}, {_FRAMES}, {_HASHED}, {_CHANGED}, {_CHOSEN} SELECT item_id, at_ms, pick::BIGINT AS pick FROM chosen")
def frame_selection(spark, d):
    return _chosen(spark, d)


@query("frame_batches", f"WITH {_VIDEOS}, {_FRAMES}, {_HASHED}, {_CHANGED}, {_CHOSEN} SELECT item_id, at_ms, ((row_number() OVER (PARTITION BY item_id ORDER BY at_ms) - 1) // 8)::BIGINT AS batch FROM chosen QUALIFY batch < 4")
def frame_batches(spark, d):
    return media.batches(_chosen(spark, d).select("item_id", "at_ms"))


@query("nearby_segments", "SELECT m.item_id, m.start_ms + 500 AS at_ms, s.start_ms, s.text FROM segments_ m JOIN segments_ s ON m.item_id = s.item_id AND s.start_ms <= m.start_ms + 8500 AND s.end_ms >= m.start_ms - 7500", "segments")
def nearby_segments(spark, d):
    segments = entity(spark, d, "segments")
    return media.nearby(segments.select("item_id", (F.col("start_ms") + 500).alias("at_ms")), segments).select("item_id", "at_ms", "start_ms", "text")


_GREY = "list_transform(embedding[1:64], lambda x: floor((x + 1) * 127)) AS p"


@query("image_hash", f"SELECT vec_id, (list_sum(list_transform(range(64), lambda i: CASE WHEN g[(i // 8 * 9 + i % 8 + 1)::INT] > g[(i // 8 * 9 + i % 8 + 2)::INT] THEN (2::HUGEINT ** (63 - i))::HUGEINT ELSE 0 END)) - CASE WHEN g[1] > g[2] THEN 18446744073709551616::HUGEINT ELSE 0 END)::BIGINT AS hash FROM (SELECT vec_id, p || p[1:8] AS g FROM (SELECT vec_id, {_GREY} FROM embeddings))")
def image_hash(spark, d):
    """Brightness is reckoned in the table's single precision, whatever numbers the session would widen to: at a whole number, double precision falls on its other side."""
    light = F.transform(F.slice("embedding", 1, 64), lambda x: (x + F.lit(1).cast("float")) * F.lit(127).cast("float"))
    # beyond 2**24 single precision holds whole numbers only, and NaN and infinity have no floor that is one
    pixels = F.transform(light, lambda y: F.when(F.abs(y) < 1 << 24, F.floor(y).cast("float")).otherwise(y))
    row = F.concat(pixels, F.slice(pixels, 1, 8))
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", difference_hash(row).alias("hash"))


def _image_hash(spark, d):
    return image_hash(spark, d).select(F.col("vec_id").alias("id"), "hash")


@query(
    "alike_frames",
    "WITH RECURSIVE h AS (" + ORACLE_SQL["image_hash"] + """), own AS (SELECT DISTINCT hash FROM h),
    pairs AS (SELECT a.hash, b.hash AS other FROM own a JOIN own b ON a.hash <> b.hash AND bit_count(xor(a.hash, b.hash)) <= 4),
    reach AS (SELECT hash, hash AS other FROM own UNION SELECT reach.hash, pairs.other FROM reach JOIN pairs ON reach.other = pairs.hash),
    found AS (SELECT hash, min(other) AS class FROM reach GROUP BY 1)
    SELECT vec_id AS id, h.hash, class, (SELECT count(*) FROM pairs WHERE pairs.hash = h.hash) AS n_alike FROM h JOIN found ON found.hash = h.hash""",
)
def alike_frames(spark, d):
    return media.alike_classes(_image_hash(spark, d))


@query(
    "alike_coarse",
    """WITH RECURSIVE g AS (SELECT vec_id, p || p[1:8] AS g FROM (SELECT vec_id, list_transform(embedding[1:64], lambda x: CASE WHEN x > 0.15 THEN 1 ELSE 0 END) AS p FROM embeddings)),
    h AS (SELECT vec_id AS id, list_sum(list_transform(range(56), lambda i: CASE WHEN g[i + 1] > g[i + 2] THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS hash FROM g), own AS (SELECT DISTINCT hash FROM h)
    SELECT a.hash, b.hash AS other, bit_count(xor(a.hash, b.hash))::BIGINT AS bits FROM own a JOIN own b ON a.hash < b.hash AND bit_count(xor(a.hash, b.hash)) <= 4""",
)
def alike_coarse(spark, d):
    """Pairs of alike hashes of coarse pictures, of which many share a band."""
    bright = F.transform(F.slice("embedding", 1, 64), lambda x: F.when(x > F.lit(0.15).cast("float"), 1).otherwise(0))
    falls = lambda g: F.transform(F.sequence(F.lit(1), F.lit(56)), lambda i: F.when(F.try_element_at(g, i) > F.try_element_at(g, i + 1), F.call_function("shiftleft", F.lit(1).cast("long"), (i - 1).cast("int"))).otherwise(F.lit(0).cast("long")))
    hash_ = once(F.concat(bright, F.slice(bright, 1, 8)), lambda g: F.aggregate(falls(g), F.lit(0).cast("long"), lambda a, x: a + x))
    return media.alike_pairs(spark.read.parquet(f"{d}/embeddings.parquet").select(hash_.alias("hash")))


# ---- checks


@query("literal_occurrence", "SELECT c.item_id, p.id AS passage_id FROM chunks_ c JOIN passages_ p ON contains(c.body, p.excerpt)", "chunks", "passages")
def literal_occurrence(spark, d):
    return quality.literal_occurrence(entity(spark, d, "chunks"), entity(spark, d, "passages"))


@query("dangling_citations", "SELECT doc_id AS item_id, doc_id % 50 AS evidence_id FROM labels WHERE NOT (doc_id % 50 IN (SELECT item_id FROM benchmark) AND doc_id % 2 = 0)")
def dangling_citations(spark, d):
    cited = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("item_id"), (F.col("doc_id") % 50).alias("evidence_id"))
    ids = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("evidence_id"))
    owned = cited.where("item_id % 2 = 0").join(ids, "evidence_id", "left_semi").select("item_id", F.col("evidence_id").alias("id"))
    return quality.dangling(cited, owned)


@query(
    "contract_violations",
    _then_flat(
        "SELECT f.id, concat_ws(',', CASE WHEN length(f.summary) > 600 THEN 'summary' END, CASE WHEN longest > 1000 THEN 'transcript[].text' END) AS broken FROM flat f JOIN items_ i ON i.id = f.id "
        "LEFT JOIN (SELECT item_id, max(length(text)) AS longest FROM segments_ GROUP BY 1) g ON g.item_id = f.id WHERE broken <> ''"
    ),
)
def contract_violations(spark, d):
    e = {n: entity(spark, d, n) for n in _NESTED}
    sites = detail.item_websites(e["mentions"].select("item_id", "seq", "website_id", "unresolved_name"), e["websites"]).withColumnRenamed("name", "text")
    lists = {"topics": e["item_topics"].withColumn("text", F.col("topic")), "tags": e["item_tags"].withColumn("text", F.col("tag")), "websites": sites, "evidence": e["evidence"], "transcript": e["segments"]}
    lists["collections"] = detail.item_collections(e["collections"], e["collection_items"]).withColumnRenamed("name", "text")
    broken = quality.contract_breaches(e["items"], e["revisions"], e["notes"], **lists)
    return broken.select("id", F.array_join("broken", ",").alias("broken"))


#: Parts as items, with as many entries of each list as their order lines give, so that every rule has items that break it.
_LINES = "lines AS (SELECT l_partkey AS item_id, l_orderkey % 63 AS short, l_quantity::BIGINT AS much, l_orderkey AS k FROM lineitem)"
_LIST_OF = {"topics": "much > 42", "tags": "much > 15", "websites": "much > 5", "evidence": "much > 7", "transcript": "true", "captures": "true", "collections": "true"}
_COPIES = {"evidence": 3}
_LONG = {"topics": (2, 80), "tags": (1, 60), "websites": (2, 120), "collections": (2, 120), "transcript": (17, 1000), "evidence": (10, 600)}


@query(
    "contract_breaches",
    f"""WITH {_LINES}, sizes AS (SELECT item_id, max(k % 12) AS points, max(short) * 9 AS point, {", ".join(f"count(*) FILTER ({c}) * {_COPIES.get(n, 1)} AS n_{n}, coalesce(max(short) FILTER ({c}), 0) AS short_{n}" for n, c in _LIST_OF.items())} FROM lines GROUP BY 1),
    items AS (SELECT p_partkey AS id, p_size * 4 AS title, p_size * 13 AS summary, p_size * 260 AS note, CASE WHEN p_partkey % 17 = 0 THEN 'odd' ELSE 'ready' END AS status, CASE WHEN p_partkey % 19 = 0 THEN -1 ELSE 1 END AS bytes FROM part),
    ruled AS (SELECT id, concat_ws(',', CASE WHEN n_topics > 3 THEN 'topics' END, CASE WHEN n_tags > 8 THEN 'tags' END, CASE WHEN points > 8 THEN 'key_points' END, CASE WHEN n_websites > 20 THEN 'websites' END, CASE WHEN n_evidence > 80 THEN 'evidence' END,
        CASE WHEN n_captures > 32 THEN 'captures' END, CASE WHEN n_collections > 30 THEN 'collections' END, CASE WHEN title > 160 THEN 'title' END, CASE WHEN summary > 600 THEN 'summary' END, CASE WHEN note > 12000 THEN 'note' END,
        CASE WHEN short_tags > 60 THEN 'tags[]' END, CASE WHEN short_topics * 2 > 80 THEN 'topics[]' END, CASE WHEN short_transcript * 17 > 1000 THEN 'transcript[].text' END, CASE WHEN points > 0 AND point > 500 THEN 'key_points[].text' END,
        CASE WHEN short_evidence * 10 > 600 THEN 'evidence[].excerpt' END, CASE WHEN short_collections * 2 > 120 THEN 'collections[]' END, CASE WHEN short_websites * 2 > 120 THEN 'websites[]' END,
        CASE WHEN status = 'odd' THEN 'status' END, CASE WHEN bytes < 0 THEN 'bytes' END) AS broken FROM items LEFT JOIN sizes ON item_id = id)
    SELECT id, broken FROM ruled WHERE broken <> ''""",
)
def contract_breaches(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("item_id"), (F.col("l_orderkey") % 63).cast("int").alias("short"), F.col("l_quantity").cast("long").alias("much"), F.col("l_orderkey").alias("k"))
    lists = {}
    for name, kept in _LIST_OF.items():
        said = F.repeat(F.lit("x"), F.col("short") * _LONG[name][0]).alias("excerpt" if name == "evidence" else "text") if name in _LONG else F.lit(None).alias("none")
        copies = F.explode(F.sequence(F.lit(1), F.lit(_COPIES.get(name, 1)))).alias("copy")
        lists[name] = lines.where(kept).select("item_id", F.col("k").alias("start_ms"), F.col("k").alias("end_ms"), said, copies)
    part = spark.read.parquet(f"{d}/part.parquet")
    of_size = lambda n: F.repeat(F.lit("x"), F.col("p_size") * n)
    status, size = F.when(F.col("p_partkey") % 17 == 0, "odd").otherwise("ready"), F.when(F.col("p_partkey") % 19 == 0, -1).otherwise(1).cast("long")
    items = part.select(F.col("p_partkey").alias("id"), of_size(4).alias("title"), of_size(13).alias("description"), status.alias("status"), size.alias("bytes"))
    notes = part.select(F.col("p_partkey").alias("item_id"), of_size(260).alias("body"))
    each = lines.groupBy("item_id").agg(F.max(F.col("k") % 12).cast("int").alias("n"), F.max("short").alias("short"))
    points = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(F.repeat(F.lit("x"), F.col("short") * 9).alias("text"), F.array(F.lit("e")).alias("evidenceIds")))
    revisions = each.select("item_id", F.lit(1).alias("revision"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("summary"), F.when(F.col("n") > 0, F.to_json(points)).alias("key_points_json"))
    return quality.contract_breaches(items, revisions, notes, **lists).select("id", F.array_join("broken", ",").alias("broken"))


@query("storage_by_role", "SELECT role, count(*) AS assets, sum(bytes)::BIGINT AS bytes FROM assets_ GROUP BY 1", "assets")
def storage_by_role(spark, d):
    return quality.storage_by_role(entity(spark, d, "assets"))


@query("status_labels", "SELECT id, CASE status WHEN 'transcribing' THEN 'Transcribing on device' WHEN 'analyzing' THEN 'Finding useful details' WHEN 'needs_browser_session' THEN 'Browser session required' ELSE upper(left(status, 1)) || replace(substr(status, 2), '_', ' ') END AS label FROM items_", "items")
def status_labels(spark, d):
    return entity(spark, d, "items").select("id", text.status_label(F.col("status")).alias("label"))


@query("format_duration", "SELECT event_id, (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS shown FROM (SELECT event_id, floor(event_id * 137 / 1000.0 + 0.5)::BIGINT AS s FROM events)")
def format_duration(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", text.format_duration(F.col("event_id") * 137).alias("shown"))


@query("format_bytes", "SELECT event_id, CASE WHEN b = 0 THEN '—' WHEN b > 1073741824 THEN printf('%.1f', b / 1073741824.0) || ' GB' ELSE greatest(1, floor(b / 1048576.0 + 0.5)::BIGINT) || ' MB' END AS shown FROM (SELECT event_id, event_id * 1000003 AS b FROM events)")
def format_bytes(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", text.format_bytes(F.col("event_id") * 1000003).alias("shown"))

