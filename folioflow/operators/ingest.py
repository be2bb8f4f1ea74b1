"""Imports: link lists, admission, duplicates, new rows, files and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import urls
from folioflow.functions.text import normalize_tag
from folioflow.operators.chains import resolve
from folioflow.schemas import IMPORT_CHARS, IMPORT_LINES, UPLOAD_BYTES, UPLOAD_TYPES


def import_lines(requests: DataFrame) -> DataFrame:
    """request_id, place, url: the distinct trimmed lines of each request's text, first ones first, IMPORT_LINES at most.

    Texts over IMPORT_CHARS are refused whole.
    """
    lines = requests.where(F.length("body") <= IMPORT_CHARS).select("request_id", F.posexplode(F.split("body", "\r?\n")).alias("place", "line"))
    lines = lines.withColumn("url", urls.trimmed(F.col("line"))).where("url <> ''")
    first = lines.groupBy("request_id", "url").agg(F.min("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("place"))
    return first.withColumn("place", rank.cast("long")).where(F.col("place") <= IMPORT_LINES).select("request_id", "place", "url")


def admit(links: DataFrame, url: str = "url") -> DataFrame:
    """Links with host, platform, platform_id, canonical_url (all but the host null unless admitted) and reject_reason (null: admitted)."""
    ok = F.col("parts.reason").isNull()
    new = {
        "reject_reason": F.col("parts.reason"),
        "host": F.col("parts.host"),
        "platform": F.when(ok, F.col("parts.platform")),
        "platform_id": F.when(ok, F.col("parts.post")),
        "canonical_url": F.when(ok, F.col("parts.canonical")),
    }
    return urls.with_parts(links, url).select(*[c for c in links.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def dedup_key(platform: Column, platform_id: Column, canonical: Column) -> Column:
    """One key by which items are the same: the post on its platform, else the canonical URL."""
    return F.when(platform_id.isNotNull(), F.concat_ws(":", platform, platform_id)).otherwise(canonical)


def outcomes(links: DataFrame, existing: DataFrame) -> DataFrame:
    """Admitted links (place, url, ...) with key and outcome: created, existing or rejected.

    The first of new links with one key is created, the others exist by then. existing
    has a column key. One equi-join by key, as an OR of two conditions would be a
    nested loop. The first place of a key is an aggregate that meets the links by key and
    place, so links of one key are no task of their own; rejected links have no key and
    stay apart.
    """
    key = dedup_key(F.col("platform"), F.col("platform_id"), F.col("canonical_url"))
    keyed = links.withColumn("key", F.when(F.col("reject_reason").isNull(), key))
    taken = keyed.where("key is not null")
    known = existing.select("key").distinct().withColumn("known", F.lit(True))
    first = taken.groupBy("key").agg(F.min("place").alias("place")).join(known, "key", "left").where("known is null").select("key", "place", F.lit("created").alias("outcome"))
    taken = taken.join(first, ["key", "place"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("existing")))
    return taken.select(*keyed.columns, "outcome").unionByName(keyed.where("key is null").withColumn("outcome", F.lit("rejected")))


def new_items(created: DataFrame, now: Column) -> DataFrame:
    """Item rows of created links; ids are hashes of the key, so that a repeated import makes the same rows."""
    web = F.col("platform") == "web"
    title = F.when(web, F.col("host")).otherwise(F.concat(F.lit("Saved "), F.col("platform"), F.lit(" source")))
    return created.where("outcome = 'created'").select(
        F.sha2("key", 256).alias("id"), title.alias("title"), "platform", "platform_id", urls.trimmed(F.col("url")).alias("source_url"), "canonical_url",
        F.when(web, "page").otherwise("video").alias("type"), F.lit("queued").alias("status"), now.alias("created_at"),
    )


def child_items(posts: DataFrame) -> DataFrame:
    """A row for each medium of posts (id, platform, platform_id, source_url, media) with several: an item of its own, that of the post its parent.

    Children share the source and carry the post's id with the medium's number, from 1.
    """
    each = posts.where("media > 1").withColumn("medium", F.explode(F.sequence(F.lit(1), F.col("media").cast("int"))))
    own = F.concat_ws(":", F.col("platform_id").cast("string"), F.col("medium").cast("string"))
    return each.select(
        F.sha2(F.concat_ws(":", F.col("platform"), own), 256).alias("id"), F.col("id").alias("parent_id"), "platform", own.alias("platform_id"), "source_url", F.col("medium").cast("long").alias("medium"),
        F.lit("queued").alias("status"),
    )


def first_jobs(items: DataFrame, now: Column) -> DataFrame:
    return items.select(F.sha2(F.concat(F.lit("job:"), "id"), 256).alias("id"), F.col("id").alias("item_id"), F.lit("acquire").alias("stage"), F.lit("queued").alias("status"), F.lit(0).cast("long").alias("attempt"), now.alias("created_at"))


def first_chunks(items: DataFrame) -> DataFrame:
    return items.select(F.col("id").alias("item_id"), F.lit(0).cast("long").alias("seq"), F.col("title").alias("body"), F.array(F.concat(F.lit("description:"), "id")).alias("evidence_ids"))


def outcome_counts(done: DataFrame) -> DataFrame:
    return done.groupBy("outcome").agg(F.count("*").alias("n"))


def host_counts(links: DataFrame, url: str = "url") -> DataFrame:
    return urls.with_parts(links, url).groupBy(F.col("parts.host").alias("host")).agg(F.count("*").alias("n"))


def by_content(files: DataFrame, content: str = "text") -> DataFrame:
    """Of files of equal content the one of smallest id, with how many there are."""
    return files.groupBy(F.sha2(content, 256).alias("content_hash")).agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def accepted_uploads(files: DataFrame) -> DataFrame:
    """Uploads of an accepted type and size, with the stage they start at."""
    ok = F.col("mime").isin(*UPLOAD_TYPES) & (F.col("bytes") <= UPLOAD_BYTES)
    return files.where(ok).withColumn("stage", F.when(F.startswith("mime", F.lit("image/")), "analyze").otherwise("transcribe"))


def tag_links(labels: DataFrame) -> DataFrame:
    """item_id, tag: normalised, no empty ones, each once."""
    return labels.select("item_id", normalize_tag(F.col("label")).alias("tag")).where("tag <> ''").distinct()


def replace_tags(old: DataFrame, edited: DataFrame, labels: DataFrame) -> DataFrame:
    """All tag links when the edited items' are replaced by the labels given."""
    return old.join(edited.select("item_id").distinct(), "item_id", "left_anti").select("item_id", "tag").unionByName(tag_links(labels))


def merge_tags(links: DataFrame, renames: DataFrame) -> DataFrame:
    """Links with tags renamed (renames: tag, into) to where their renames end, doubles joined; see chains.resolve for chains, cycles and tags that are renamed twice."""
    ends = resolve(renames).select("tag", "final")
    return links.join(ends.hint("merge"), "tag", "left").select("item_id", F.coalesce("final", "tag").alias("tag")).distinct()


def unique_violations(rows: DataFrame, *keys: str) -> DataFrame:
    """Key values that several rows have; a null key is never the same as another."""
    full = rows.where(F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull())
    return full.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
