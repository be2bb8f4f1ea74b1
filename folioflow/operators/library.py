"""The library's list: search, filters, pages, facets and the item projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import aspect, like_anywhere
from folioflow.schemas import MATCH_CHARS, PAGE_DEFAULT, PAGE_MAX, SETTLED_STATUSES, SNIPPET_CHARS, TAG_FACETS


def keyword_search(items: DataFrame, chunks: DataFrame, query: str) -> DataFrame:
    """Items with the query in title, description or any chunk; an empty query takes all.

    The chunks that match are reduced to their items before they meet the list.
    """
    if not query.strip():
        return items
    return _found(items, chunks.where(like_anywhere(F.col("body"), query)).select("item_id"), query)


def _found(items: DataFrame, hits: DataFrame, query: str) -> DataFrame:
    """Items with the query in title or description, or among the hits (item_id)."""
    hits = hits.select(F.col("item_id").alias("id")).distinct().withColumn("in_chunk", F.lit(True))
    own = like_anywhere(F.col("title"), query) | like_anywhere(F.coalesce("description", F.lit("")), query)
    return items.join(hits, "id", "left").where(F.col("in_chunk").isNotNull() | own).drop("in_chunk")


def with_topic(items: DataFrame, item_topics: DataFrame, topic: str) -> DataFrame:
    return items.join(item_topics.where(F.col("topic") == topic).select(F.col("item_id").alias("id")), "id", "left_semi")


def with_tag(items: DataFrame, item_tags: DataFrame, tag: str) -> DataFrame:
    return items.join(item_tags.where(F.col("tag") == tag).select(F.col("item_id").alias("id")), "id", "left_semi")


def narrow(items: DataFrame, kind: str = "", since=None, until=None, shape: str = "", color: str = "") -> DataFrame:
    """Items of a type, created from `since` to before `until`, of an aspect (columns width, height) and a colour family (column color); an empty one isn't a filter."""
    if kind:
        items = items.where(F.col("type") == kind)
    if since is not None:
        items = items.where(F.col("created_at") >= F.lit(since))
    if until is not None:
        items = items.where(F.col("created_at") < F.lit(until))
    if shape:
        items = items.where(aspect(F.col("width"), F.col("height")) == shape)
    if color:
        items = items.where(F.col("color") == color)
    return items


def search(items: DataFrame, chunks: DataFrame, item_topics: DataFrame, item_tags: DataFrame, query: str = "", topic: str = "", platform: str = "", tag: str = "", **narrower) -> DataFrame:
    """Items that pass every filter given, those of narrow() too; an empty one isn't a filter."""
    items = narrow(items, **narrower)
    if platform:
        items = items.where(F.col("platform") == platform)
    if topic:
        items = with_topic(items, item_topics, topic)
    if tag:
        items = with_tag(items, item_tags, tag)
    return keyword_search(items, chunks, query)


def clamp(limit: Column, offset: Column) -> tuple[Column, Column]:
    """Limit from 1 to PAGE_MAX (missing or zero: PAGE_DEFAULT), offset from 0."""
    wanted = F.when(F.coalesce(limit, F.lit(0)) == 0, PAGE_DEFAULT).otherwise(limit)
    return F.least(F.lit(PAGE_MAX), F.greatest(F.lit(1), wanted)), F.greatest(F.lit(0), F.coalesce(offset, F.lit(0)))


def page(items: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A page of the list, newest first, larger id first among equals."""
    limit, offset = min(PAGE_MAX, max(1, limit or PAGE_DEFAULT)), max(0, offset or 0)
    return items.orderBy(F.desc("created_order"), F.desc("id")).offset(offset).limit(limit)


def has_more(items: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """total, has_more: how many items there are and whether some follow the page."""
    limit, offset = min(PAGE_MAX, max(1, limit or PAGE_DEFAULT)), max(0, offset or 0)
    return items.agg(F.count("*").alias("total")).select("total", (F.col("total") > offset + limit).alias("has_more"))


def topic_counts(topics: DataFrame, item_topics: DataFrame) -> DataFrame:
    counts = item_topics.groupBy("topic").agg(F.count("*").alias("n"))
    return topics.join(counts, topics.slug == counts.topic, "left").select("slug", "label", "display_order", F.coalesce("n", F.lit(0)).cast("long").alias("item_count"))


def tag_facets(item_tags: DataFrame) -> DataFrame:
    """The most used tags, ties by label; a report of TAG_FACETS rows at most."""
    return item_tags.groupBy("tag").agg(F.count("*").alias("item_count")).orderBy(F.desc("item_count"), "tag").limit(TAG_FACETS)


def platform_counts(domain: DataFrame, items: DataFrame) -> DataFrame:
    counts = items.groupBy("platform").agg(F.count("*").alias("n"))
    return domain.join(counts, "platform", "left").select("platform", F.coalesce("n", F.lit(0)).cast("long").alias("item_count"))


def processing_count(items: DataFrame) -> DataFrame:
    return items.where(~F.col("status").isin(*SETTLED_STATUSES)).agg(F.count("*").alias("processing"))


def latest_revision(revisions: DataFrame, *fields: str) -> DataFrame:
    """Of each item's last revision its number and the fields, the summary if none are named."""
    fields = ("revision", *(fields or ("summary",)))
    latest = revisions.groupBy("item_id").agg(F.max_by(F.struct(*fields), "revision").alias("r"))
    return latest.select("item_id", *[F.col(f"r.{f}").alias(f) for f in fields])


def website_count(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("item_id").agg(F.count("*").alias("website_count"))


def original_bytes(assets: DataFrame) -> DataFrame:
    """Bytes of originals by item; items without an original have null."""
    return assets.groupBy("item_id").agg(F.sum(F.when(F.col("role") == "original", F.col("bytes"))).alias("original_bytes"))


def item_projection(items: DataFrame, revisions: DataFrame, mentions: DataFrame, assets: DataFrame) -> DataFrame:
    """Items with the latest summary (else the description), mention count and original bytes.

    Each satellite is aggregated by item once, instead of looked up for every row.
    """
    joined = items
    for part in (latest_revision(revisions).select("item_id", F.col("summary").alias("latest")), website_count(mentions), original_bytes(assets)):
        joined = joined.join(part.withColumnRenamed("item_id", "id"), "id", "left")
    return joined.select(
        "id", "title", F.coalesce("latest", "description").alias("summary"), "platform", "status", F.coalesce("website_count", F.lit(0)).cast("long").alias("website_count"), "original_bytes"
    )


def first_match(chunks: DataFrame, query: str, *more: str) -> DataFrame:
    """Each item's first chunk that matches, with more of its columns if named."""
    hits = chunks.where(like_anywhere(F.col("body"), query))
    return hits.groupBy("item_id").agg(F.min_by("body", "seq").alias("body"), F.min("seq").cast("long").alias("seq"), *[F.min_by(c, "seq").alias(c) for c in more])


def snippets(items: DataFrame, chunks: DataFrame, query: str) -> DataFrame:
    """id, title, snippet, evidence of items found: the start of the first matching chunk and the first evidence id it cites, else the start of the description and null."""
    has = "evidence_ids_json" in chunks.columns
    match = first_match(chunks, query, *(["evidence_ids_json"] if has else []))
    cited = F.get(F.from_json("evidence_ids_json", "array<string>"), 0) if has else F.lit(None).cast("string")
    found = _found(items, match.select("item_id"), query).join(match.select(F.col("item_id").alias("id"), "body", cited.alias("evidence")), "id", "left")
    return found.select("id", "title", F.when(F.col("body").isNotNull(), F.left("body", F.lit(MATCH_CHARS))).otherwise(F.left("description", F.lit(SNIPPET_CHARS))).alias("snippet"), "evidence")
