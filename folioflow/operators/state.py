"""Changes of stored state as new tables: last writes, replacements, deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.schemas import TRASH_DAYS


def upsert(old: DataFrame, new: DataFrame, key: str, by: str) -> DataFrame:
    """One row for each key, the last written by the column `by`; of equals, the new one."""
    both = old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    columns = [c for c in old.columns if c != key]
    last = both.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(by, "is_new")).alias("r"))
    return last.select(key, *[F.col(f"r.{c}").alias(c) for c in columns]).select(old.columns)


def bump_revisions(items: DataFrame, edited: DataFrame) -> DataFrame:
    hit = edited.select(F.col("item_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    return items.join(hit, "id", "left").withColumn("current_revision", F.coalesce("current_revision", F.lit(0)) + F.coalesce("hit", F.lit(0))).drop("hit")


def replace_links(old: DataFrame, new: DataFrame, targets: DataFrame, key: str, target: str) -> DataFrame:
    """Links (key, target) of the keys in new replaced; targets that don't exist are left out."""
    kept = old.join(new.select(key).distinct(), key, "left_anti").select(key, target)
    return kept.unionByName(new.join(targets.select(F.col("id").alias(target)), target, "left_semi").select(key, target).distinct())


def delete_originals(assets: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets left when the ready items' originals are deleted; and by item what was removed. Others' originals stay."""
    ready = items.where("status = 'ready'").select(F.col("id").alias("item_id"))
    original = F.col("role") == "original"
    left = assets.where(~original).unionByName(assets.where(original).join(ready, "item_id", "left_anti").select(assets.columns))
    removed = assets.where(original).join(ready, "item_id", "left_semi").groupBy("item_id")
    return left, removed.agg(F.count("*").alias("removed_assets"), F.sum("bytes").alias("removed_bytes"))


def stamp_deleted(items: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """Items with original_deleted_at set where the original was asked to be deleted (item_id) and may be: those that are ready."""
    hit = asked.select(F.col("item_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    stamped = F.when(F.col("hit") & (F.col("status") == "ready"), now).otherwise(F.col("original_deleted_at"))
    return items.join(hit, "id", "left").withColumn("original_deleted_at", stamped).select(items.columns)


def cascade(satellite: DataFrame, deleted: DataFrame, key: str = "item_id") -> DataFrame:
    """A satellite's rows whose owner isn't deleted."""
    return satellite.join(deleted.select(F.col("id").alias(key)), key, "left_anti").select(satellite.columns)


def forget_reference(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows whose reference to a deleted row is null."""
    gone = deleted.select(F.col("id").alias(key)).distinct().withColumn("gone", F.lit(True))
    return rows.join(gone, key, "left").withColumn(key, F.when(F.col("gone").isNull(), F.col(key))).select(rows.columns)


def restorable(trash: DataFrame, now: Column, days: int = TRASH_DAYS) -> DataFrame:
    """Deleted rows that are still kept."""
    return trash.where(F.col("deleted_at") > now - F.make_interval(days=F.lit(days)))


def trash_state(items: DataFrame, now: Column, days: int = TRASH_DAYS) -> DataFrame:
    """Items (id, deleted_at) with what they are: kept, in the trash, or gone for good."""
    over = F.col("deleted_at") <= now - F.make_interval(days=F.lit(days))
    return items.select("id", F.when(F.col("deleted_at").isNull(), "kept").when(over, "gone").otherwise("trash").alias("state"))


def restore(items: DataFrame, asked: DataFrame, now: Column, days: int = TRASH_DAYS) -> DataFrame:
    """Items without those gone for good; the ones asked back (id) out of the trash."""
    hit = asked.select("id").distinct().withColumn("hit", F.lit(True))
    left = items.where("deleted_at is null").unionByName(restorable(items, now, days))
    return left.join(hit, "id", "left").withColumn("deleted_at", F.when(F.col("hit").isNull(), F.col("deleted_at"))).select(items.columns)


def rename(rows: DataFrame, names: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose column is what names (key, new_name) say, where they say something: topics and collections renamed."""
    said = names.groupBy(key).agg(F.max("new_name").alias("new_name"))
    return rows.join(said, key, "left").withColumn(column, F.coalesce("new_name", column)).select(rows.columns)
