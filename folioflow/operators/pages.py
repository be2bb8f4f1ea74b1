"""What a page that was read writes: its item, evidence, revision, chunk, topic and job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.pagetext import page_text
from folioflow.functions.text import page_title
from folioflow.operators.state import upsert
from folioflow.schemas import TEXT_CHARS

EVIDENCE_LABEL, PAGE_TOPIC = "Readable page text", "other"


def read_pages(pages: DataFrame) -> DataFrame:
    """item_id, title, text, description, evidence_id of pages (item_id, title, html): the page's own title if it has one, else the item's."""
    text = page_text(F.col("html"))
    read = pages.select("item_id", F.coalesce(F.nullif(page_title(F.col("html")), F.lit("")), F.col("title")).alias("title"), text.alias("text"))
    return read.withColumns({"description": F.left("text", F.lit(TEXT_CHARS)), "evidence_id": F.concat(F.lit("page:"), F.sha2(F.concat_ws("\n", "item_id", "text"), 256))})


def page_writes(read: DataFrame, jobs: DataFrame) -> dict[str, DataFrame]:
    """The rows that each table gets; revisions are number 1 and take the place of what is there."""
    ids = F.array("evidence_id")
    points = F.array(F.struct(F.col("description").alias("text"), ids.alias("evidenceIds")))
    return {
        "items": read.select(F.col("item_id").alias("id"), "title", "description", F.lit("ready").alias("status")),
        "evidence": read.select(F.col("evidence_id").alias("id"), "item_id", F.lit("page").alias("kind"), F.lit(EVIDENCE_LABEL).alias("label"), F.col("description").alias("excerpt")),
        "revisions": read.select("item_id", F.lit(1).cast("long").alias("revision"), "title", F.col("description").alias("summary"), points.alias("key_points"), F.array(F.lit(PAGE_TOPIC)).alias("topics")),
        "chunks": read.select("item_id", F.concat_ws("\n", "title", "text").alias("body"), ids.alias("evidence_ids")),
        "item_topics": read.select("item_id", F.lit(PAGE_TOPIC).alias("topic")),
        "jobs": jobs.join(read.select("item_id"), "item_id", "left_semi").select("id", F.lit("done").alias("status"), F.lit(None).cast("timestamp").alias("lease_expires_at"), F.lit(None).cast("string").alias("message")),
    }


def with_revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Revisions with the new ones in the place of those of the same item and number."""
    key = F.concat_ws(":", F.col("item_id").cast("string"), F.col("revision").cast("string"))
    marked = [df.withColumns({"key": key, "turn": F.lit(turn)}) for turn, df in enumerate((old, new))]
    return upsert(*marked, "key", "turn").select(old.columns)


def next_seq(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """New rows of items with seq counting on from the items' old rows."""
    last = old.groupBy("item_id").agg((F.max("seq") + 1).alias("start"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(order)) - 1
    return new.withColumn("place", place).join(last, "item_id", "left").select(*new.columns, (F.coalesce("start", F.lit(0)) + F.col("place")).cast("long").alias("seq"))
