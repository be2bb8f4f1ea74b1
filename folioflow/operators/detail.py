"""One item's detail: satellites as arrays, passages and exports.

Lists are whole, but for the transcript, of which a detail shows the first segments. What
is too long for the contract is refused, not cut: quality.contract_breaches() counts and
measures without collecting a list, and within_contract() makes the details of the others,
so an item with a list of any length is in no task as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import round_half_up
from folioflow.operators.library import latest_revision
from folioflow.schemas import KEY_POINTS, LIST_LIMITS


def _placed(rows: DataFrame, *order: Column | str, key: str = "item_id") -> DataFrame:
    """Each item's rows with their place from 1."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def _listed(rows: DataFrame, name: str, *fields: str) -> DataFrame:
    """item_id and an array of the fields (one: its values) by place."""
    by_place = F.sort_array(F.collect_list(F.struct("place", *fields)))
    return rows.groupBy("item_id").agg(F.transform(by_place, lambda r: F.struct(*[r[f].alias(f) for f in fields]) if len(fields) > 1 else r[fields[0]]).alias(name))


def item_tags(tags: DataFrame) -> DataFrame:
    return tags.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))


def item_websites(mentions: DataFrame, websites: DataFrame) -> DataFrame:
    """Mentions with their website's name, else the name they were given."""
    named = websites.select(F.col("id").alias("website_id"), "name")
    return mentions.join(named, "website_id", "left").withColumn("name", F.coalesce("name", "unresolved_name")).drop("unresolved_name")


def item_collections(collections: DataFrame, members: DataFrame) -> DataFrame:
    """All collections' names by item, in their order: item_id, place, name."""
    named = members.join(collections.withColumnRenamed("id", "collection_id"), "collection_id").select("item_id", "name", "collection_id")
    return _placed(named, "name", "collection_id").select("item_id", F.col("place").cast("long").alias("place"), "name")


def transcript_head(segments: DataFrame, rows: int = LIST_LIMITS["transcript"]) -> DataFrame:
    """Each item's first segments, the number that a detail shows."""
    return _placed(segments.select("item_id", "start_ms", "end_ms", "text"), "start_ms", "end_ms", "text").where(F.col("place") <= rows).drop("place")


def capture_labels(captures: DataFrame, *keep: str) -> DataFrame:
    """What a capture is called: url, file name, and the second it was taken at, or its source; and the columns to keep."""
    alt = F.when(F.col("timestamp_ms").isNull(), "Capture from source").otherwise(
        F.concat(F.lit("Capture from "), round_half_up(F.col("timestamp_ms") / 1000).cast("string"), F.lit(" seconds"))
    )
    return captures.select(
        "id", F.concat(F.lit("/api/assets/"), F.col("id").cast("string")).alias("url"), F.regexp_extract("path", "[^/]+$", 0).alias("label"), alt.alias("alt"), *keep
    )


def item_captures(assets: DataFrame) -> DataFrame:
    """item_id, place, id, timestamp_ms of all captures: those without a time first, then by time."""
    captures = assets.where("role = 'capture'").select("item_id", "id", "timestamp_ms")
    return _placed(captures, F.col("timestamp_ms").asc_nulls_first(), "id").withColumn("place", F.col("place").cast("long"))


def passages(evidence: DataFrame, ids: list) -> DataFrame:
    """The passages asked for by id, a few, and whether some weren't found."""
    wanted = sorted(set(ids))
    found = evidence.where(F.col("id").isin(*wanted))
    return found.select("id", "excerpt", (F.count("*").over(Window.partitionBy()) < len(wanted)).alias("truncated"))


def item_by_id(items: DataFrame, item) -> DataFrame:
    """The item of this id, if there is one."""
    return items.where(F.col("id") == F.lit(item)).limit(1)


def existing(items: DataFrame, ids: DataFrame) -> DataFrame:
    """id, there: which of the ids are items'."""
    known = items.select("id").distinct().withColumn("there", F.lit(True))
    return ids.select("id").distinct().join(known, "id", "left").select("id", F.coalesce("there", F.lit(False)).alias("there"))


def decoded_points(json: Column) -> Column:
    """Key points (text, evidenceIds) from their JSON; none for null or what isn't such."""
    return F.coalesce(F.from_json(json, KEY_POINTS.simpleString()), F.array().cast(KEY_POINTS))


def first_evidence(json: Column) -> Column:
    """The first evidence id in a JSON list; null if there is none."""
    return F.get(F.from_json(json, "array<string>"), 0)


def nested(items: DataFrame, tags: DataFrame, topics: DataFrame, segments: DataFrame, revisions: DataFrame, mentions: DataFrame, websites: DataFrame, evidence: DataFrame, collections: DataFrame, members: DataFrame, notes: DataFrame) -> DataFrame:
    """An item's row with its satellites as sorted arrays, whole but for the transcript; title,
    summary and key points are the latest revision's where there is one."""
    latest = latest_revision(revisions, "title", "summary", "key_points_json")
    latest = latest.select("item_id", F.col("title").alias("new_title"), F.col("summary").alias("new_summary"), decoded_points(F.col("key_points_json")).alias("key_points"))
    sites = item_websites(mentions.select("item_id", "seq", "website_id", "unresolved_name"), websites)
    parts = (
        _listed(_placed(tags.select("item_id", "tag"), "tag"), "tags", "tag"),
        _listed(_placed(topics.select("item_id", "topic"), "topic"), "topics", "topic"),
        _listed(_placed(transcript_head(segments), "start_ms", "end_ms", "text"), "transcript", "start_ms", "end_ms", "text"),
        _listed(_placed(sites, "seq", "website_id"), "websites", "name"),
        _listed(_placed(evidence, "seq", "id"), "evidence", "id", "kind", "excerpt", "start_ms"),
        _listed(item_collections(collections, members), "collections", "name"),
        notes.select("item_id", F.col("body").alias("note")),
        latest,
    )
    for part in parts:
        items = items.join(part.withColumnRenamed("item_id", "id"), "id", "left")
    lists = ("tags", "topics", "transcript", "websites", "evidence", "collections", "key_points")
    full = {c: F.coalesce(F.col(c), F.array().cast(items.schema[c].dataType)) for c in lists}
    full |= {"title": F.coalesce("new_title", "title"), "summary": F.coalesce("new_summary", "description"), "note": F.coalesce("note", F.lit(""))}
    return items.withColumns(full).drop("new_title", "new_summary")


def within_contract(items: DataFrame, breaches: DataFrame, *satellites: DataFrame) -> DataFrame:
    """nested() of the items that keep to the contract; breaches: their ids as quality.contract_breaches() gives them."""
    return nested(items.join(breaches.select("id"), "id", "left_anti"), *satellites)


def as_json(detail: DataFrame) -> DataFrame:
    """id and the row as a JSON text without nulls."""
    return detail.select("id", F.to_json(F.struct("*")).alias("json"))


def as_markdown(detail: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """id and the item as a Markdown note: title, summary, tags, key points with their evidence, the user's note, citations and captures (rows of item_captures with url, label, alt) as images."""
    points = F.array_join(F.transform("key_points", lambda p: F.concat(F.lit("- "), p["text"], F.lit(" ["), F.array_join(p["evidenceIds"], ", "), F.lit("]"))), "\n")
    cited = F.array_join(F.transform("evidence", lambda e: F.concat(F.lit("> "), e["excerpt"], F.lit(" ("), e["id"], F.lit(")"))), "\n")
    some = lambda text: F.nullif(text, F.lit(""))
    shots = F.lit(None).cast("string")
    if captures is not None:
        image = F.concat(F.lit("!["), "alt", F.lit("]("), "url", F.lit(")"))
        detail = detail.join(_listed(captures.select(F.col("item_id"), "place", image.alias("image")), "captures", "image").withColumnRenamed("item_id", "id"), "id", "left")
        shots = F.array_join("captures", "\n")
    parts = (F.concat(F.lit("# "), F.col("title")), F.col("summary"), F.concat(F.lit("Tags: "), F.array_join("tags", ", ")), some(points), some(F.col("note")), some(cited), some(shots))
    return detail.select("id", F.concat_ws("\n\n", *parts).alias("markdown"))
