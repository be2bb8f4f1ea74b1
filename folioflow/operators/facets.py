"""Facet counts kept by difference: a stored table that batches of changes add to."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.schemas import SETTLED_STATUSES, TAG_FACETS


def counted(items: DataFrame, item_topics: DataFrame, item_tags: DataFrame, sign: int = 1) -> DataFrame:
    """facet, value, n: what these rows add to the counts (or take, with sign -1) of topics, tags, platforms and processing items."""
    each = [
        item_topics.select(F.lit("topic").alias("facet"), F.col("topic").alias("value")),
        item_tags.select(F.lit("tag").alias("facet"), F.col("tag").alias("value")),
        items.select(F.lit("platform").alias("facet"), F.col("platform").alias("value")),
        items.where(~F.col("status").isin(*SETTLED_STATUSES)).select(F.lit("processing").alias("facet"), F.lit("").alias("value")),
    ]
    rows = each[0]
    for more in each[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("facet", "value").agg((F.count("*") * sign).alias("n"))


@dataclass(frozen=True)
class Facets:
    """Counts in a folder, a segment for each change; change() makes new ones and leaves these as they are.

    A count is the sum over segments, so a batch costs what it holds, not what the library
    holds. Once there are MOST segments they are summed into one.
    """

    spark: SparkSession
    path: str
    segments: tuple[int, ...] = ()
    next: int = 0

    MOST = 16

    def change(self, old: tuple[DataFrame, DataFrame, DataFrame] | None, new: tuple[DataFrame, DataFrame, DataFrame] | None) -> Facets:
        """The counts after rows (items, item_topics, item_tags) were taken away and others added; an edit gives an item's old rows and its new ones."""
        parts = [counted(*rows, sign=sign) for rows, sign in ((old, -1), (new, 1)) if rows is not None]
        delta = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return self._with(delta.groupBy("facet", "value").agg(F.sum("n").alias("n")).where("n <> 0"), self.segments)

    def _with(self, rows: DataFrame, kept: tuple[int, ...]) -> Facets:
        rows.write.parquet(f"{self.path}/segment={self.next}")
        after = replace(self, segments=(*kept, self.next), next=self.next + 1)
        return after._with(after.counts(), ()) if len(after.segments) > self.MOST else after

    def counts(self) -> DataFrame:
        """facet, value, n of all values that are there."""
        if not self.segments:
            return self.spark.createDataFrame([], "facet string, value string, n long")
        rows = self.spark.read.schema("facet string, value string, n long").parquet(*[f"{self.path}/segment={k}" for k in self.segments])
        return rows.groupBy("facet", "value").agg(F.sum("n").alias("n")).where("n <> 0")

    def _of(self, facet: str, name: str) -> DataFrame:
        return self.counts().where(F.col("facet") == facet).select(F.col("value").alias(name), "n")

    def topics(self, topics: DataFrame) -> DataFrame:
        """As library.topic_counts."""
        n: Column = F.coalesce("n", F.lit(0)).alias("item_count")
        return topics.join(self._of("topic", "slug"), "slug", "left").select("slug", "label", "display_order", n)

    def tags(self) -> DataFrame:
        """As library.tag_facets."""
        return self._of("tag", "tag").withColumnRenamed("n", "item_count").orderBy(F.desc("item_count"), "tag").limit(TAG_FACETS)

    def platforms(self, domain: DataFrame) -> DataFrame:
        """As library.platform_counts."""
        return domain.join(self._of("platform", "platform"), "platform", "left").select("platform", F.coalesce("n", F.lit(0)).alias("item_count"))

    def processing(self) -> DataFrame:
        """As library.processing_count."""
        return self.counts().where("facet = 'processing'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("processing"))
