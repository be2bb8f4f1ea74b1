"""Entities of the library catalog: schemas, domains and limits."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

# The domains that stored rows must keep to.
ITEM_STATUSES = (
    "queued", "downloading", "transcribing", "analyzing", "indexing", "ready",
    "waiting_for_key", "waiting_for_quota", "needs_browser_session", "needs_review",
    "failed", "paused", "canceled",
)
SETTLED_STATUSES = ("ready", "failed", "canceled")
ITEM_TYPES = ("video", "image", "page")
PLATFORMS = ("youtube", "instagram", "tiktok", "x", "web", "local")
EVIDENCE_KINDS = ("description", "transcript", "capture", "page")
TOPICS = (
    ("design", "Design", "sage"), ("typography", "Typography", "lilac"), ("animation", "Animation", "ochre"),
    ("development", "Development", "sage"), ("ai-tools", "AI tools", "plum"), ("photography", "Photography", "coral"),
    ("learning", "Learning", "blue"), ("other", "Other", "muted"),
)
STATUS_LABELS = {
    "queued": "Queued", "downloading": "Downloading", "transcribing": "Transcribing on device", "analyzing": "Finding useful details",
    "indexing": "Indexing", "ready": "Ready", "waiting_for_key": "Waiting for key", "waiting_for_quota": "Waiting for quota",
    "needs_browser_session": "Browser session required", "needs_review": "Needs review", "failed": "Failed", "paused": "Paused", "canceled": "Canceled",
}
COLORS = ("sage", "ochre", "lilac", "coral", "blue", "moss", "plum", "muted")
#: Families of colours by the parts that are strong in them.
FAMILIES = {"r": "red", "rg": "yellow", "g": "green", "gb": "cyan", "b": "blue", "rb": "magenta"}
UPLOAD_TYPES = ("image/jpeg", "image/png", "image/webp", "video/mp4", "video/quicktime", "video/webm")
UPLOAD_EXTENSIONS = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".mp4": "video/mp4", ".mov": "video/quicktime", ".webm": "video/webm",
}
# Limits.
PAGE_DEFAULT, PAGE_MAX, TAG_FACETS, GRAPH_ITEMS, GRAPH_WEBSITES, GRAPH_NODES, GRAPH_EDGES = 20, 50, 50, 50, 20, 80, 120
IMPORT_LINES, IMPORT_CHARS, TITLE_CHARS, TEXT_CHARS, PAGE_CHARS, MATCH_CHARS, SNIPPET_CHARS = 20, 40_000, 160, 600, 60_000, 500, 240
HTML_BYTES, UPLOAD_BYTES, LEASE_SECONDS, LIVE_SECONDS, TRASH_DAYS = 5 << 20, 500 << 20, 60, 5, 30
#: The most entries of an item's lists, and code points of its texts.
LIST_LIMITS = {"topics": 3, "tags": 8, "key_points": 8, "websites": 20, "evidence": 80, "transcript": 500, "captures": 32, "collections": 30}
TEXT_LIMITS = {"title": 160, "author": 160, "summary": 600, "note": 12_000}
ENTRY_LIMITS = {"tags[]": 60, "topics[]": 80, "transcript[].text": 1000, "key_points[].text": 500, "evidence[].excerpt": 600, "collections[]": 120, "websites[]": 120}

_s, _l, _t, _strings = StringType(), LongType(), TimestampType(), ArrayType(StringType())


def _table(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, not required) for name, kind, *required in fields])


ITEMS = _table(
    ("id", _s, 1), ("title", _s, 1), ("description", _s), ("platform", _s, 1), ("platform_id", _s), ("source_url", _s), ("canonical_url", _s), ("content_hash", _s),
    ("type", _s), ("status", _s, 1), ("duration_ms", _l), ("current_revision", _l), ("created_at", _t, 1), ("original_deleted_at", _t), ("deleted_at", _t), ("message", _s),
)
ASSETS = _table(("id", _s, 1), ("item_id", _s, 1), ("role", _s, 1), ("path", _s), ("mime", _s), ("bytes", _l), ("sha256", _s), ("timestamp_ms", _l))
SEGMENTS = _table(("id", _s, 1), ("item_id", _s, 1), ("start_ms", _l, 1), ("end_ms", _l, 1), ("text", _s, 1))
KEY_POINTS = ArrayType(_table(("text", _s), ("evidenceIds", _strings)))
REVISIONS = _table(("item_id", _s, 1), ("revision", _l, 1), ("title", _s), ("summary", _s), ("key_points", KEY_POINTS), ("topics", _strings))
EVIDENCE = _table(("id", _s, 1), ("item_id", _s, 1), ("seq", _l), ("kind", _s, 1), ("label", _s), ("excerpt", _s), ("start_ms", _l), ("end_ms", _l))
WEBSITES = _table(("id", _s, 1), ("name", _s, 1), ("hostname", _s), ("canonical_url", _s))
MENTIONS = _table(("id", _s, 1), ("item_id", _s, 1), ("website_id", _s), ("unresolved_name", _s), ("seq", _l), ("evidence_id", _s), ("certainty", _s), ("confirmation", _s))
ITEM_TOPICS, ITEM_TAGS = _table(("item_id", _s, 1), ("topic", _s, 1)), _table(("item_id", _s, 1), ("tag", _s, 1))
COLLECTIONS, COLLECTION_ITEMS = _table(("id", _s, 1), ("name", _s, 1)), _table(("collection_id", _s, 1), ("item_id", _s, 1))
NOTES = _table(("item_id", _s, 1), ("body", _s), ("updated_at", _t))
CHUNKS = _table(("item_id", _s, 1), ("seq", _l, 1), ("body", _s), ("evidence_ids", _strings))
JOBS = _table(
    ("id", _s, 1), ("item_id", _s, 1), ("stage", _s, 1), ("status", _s, 1), ("attempt", _l), ("lease_expires_at", _t), ("next_attempt_at", _t), ("created_at", _t, 1),
    ("pause_requested", BooleanType()), ("cancel_requested", BooleanType()), ("message", _s),
)
STAGE_RESULTS = _table(("item_id", _s, 1), ("stage", _s, 1), ("input_hash", _s, 1), ("model", _s), ("prompt_version", _s), ("output", _s))
POSITIONS = _table(("node_id", _s, 1), ("x", DoubleType()), ("y", DoubleType()))
SETTINGS = _table(("key", _s, 1), ("value", _s), ("updated_at", _t))
TABLES = {
    "items": ITEMS, "assets": ASSETS, "segments": SEGMENTS, "revisions": REVISIONS, "evidence": EVIDENCE, "websites": WEBSITES, "mentions": MENTIONS,
    "item_topics": ITEM_TOPICS, "item_tags": ITEM_TAGS, "collections": COLLECTIONS, "collection_items": COLLECTION_ITEMS, "notes": NOTES, "chunks": CHUNKS,
    "jobs": JOBS, "migrations": _table(("version", _l, 1), ("applied_at", _t)), "stage_results": STAGE_RESULTS, "positions": POSITIONS, "settings": SETTINGS,
    "topics": _table(("slug", _s, 1), ("label", _s, 1), ("color", _s), ("display_order", _l, 1)),
}
SCHEMA_VERSION = 1
