"""The graph of topics, items and websites, as two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import counted
from folioflow.operators.library import with_topic
from folioflow.schemas import GRAPH_EDGES, GRAPH_ITEMS, GRAPH_NODES, GRAPH_WEBSITES

WEBSITE_LINKS = 4


def graph_items(items: DataFrame, item_topics: DataFrame | None = None, topic: str = "") -> DataFrame:
    """The oldest items, with a topic only its own, GRAPH_ITEMS of them, with their place from 0."""
    if topic:
        items = with_topic(items, item_topics, topic)
    shown = items.orderBy("created_order", "id").limit(GRAPH_ITEMS)
    return shown.withColumn("place", (F.row_number().over(Window.orderBy("created_order", "id")) - 1).cast("long"))


def primary_topic(items: DataFrame, item_topics: DataFrame, few: bool = False) -> DataFrame:
    """Each item's alphabetically first topic, `other` without one. few: items are a graph's, GRAPH_ITEMS at most, whose topics alone are gathered."""
    if few:
        item_topics = item_topics.join(F.broadcast(items.select(F.col("id").alias("item_id"))), "item_id", "left_semi")
    first = item_topics.groupBy(F.col("item_id").alias("id")).agg(F.min("topic").alias("topic"))
    return items.select("id").join(first, "id", "left").select("id", F.coalesce("topic", F.lit("other")).alias("topic"))


def website_usage(websites: DataFrame, mentions: DataFrame, item_topics: DataFrame | None = None, topic: str = "") -> DataFrame:
    """The most mentioned websites, with a topic only by its items; ties by name and id; a report of GRAPH_WEBSITES rows."""
    if topic:
        mentions = mentions.join(item_topics.where(F.col("topic") == topic).select("item_id").distinct(), "item_id", "left_semi")
    uses = mentions.groupBy(F.col("website_id").alias("id")).agg(F.count("*").alias("uses"))
    return websites.join(uses, "id").select("id", "name", "uses").orderBy(F.desc("uses"), "name", "id").limit(GRAPH_WEBSITES)


def _ranked(websites: DataFrame) -> DataFrame:
    """The websites listed with their rank from 0."""
    return websites.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("uses"), "name", "id")) - 1)


def website_edges(shown: DataFrame, websites: DataFrame, mentions: DataFrame) -> DataFrame:
    """Edges of the websites listed to items shown: of each website the first WEBSITE_LINKS linked items by id. place: their order."""
    ranked = _ranked(websites).select(F.col("id").alias("website_id"), "rank")
    linked = mentions.join(F.broadcast(ranked), "website_id").select("website_id", "rank", "item_id").distinct()
    linked = linked.withColumn("turn", F.row_number().over(Window.partitionBy("website_id").orderBy("item_id"))).where(F.col("turn") <= WEBSITE_LINKS)
    linked = linked.join(shown.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    return linked.select(
        F.concat_ws(":", F.lit("website-edge"), "website_id", "item_id").alias("id"), F.concat_ws(":", F.lit("website"), "website_id").alias("source"),
        F.concat_ws(":", F.lit("item"), "item_id").alias("target"), (F.col("rank") * WEBSITE_LINKS + F.col("turn") - 1).cast("long").alias("place"),
    )


def topic_edges(shown: DataFrame, primary: DataFrame) -> DataFrame:
    """An edge from each item shown to its topic; place: the item's."""
    edges = shown.select("id", "place").join(primary, "id")
    return edges.select(F.concat_ws(":", F.lit("topic-edge"), "topic", "id").alias("id"), F.concat_ws(":", F.lit("topic"), "topic").alias("source"), F.concat_ws(":", F.lit("item"), "id").alias("target"), "place")


def nodes(topics: DataFrame, shown: DataFrame, primary: DataFrame, websites: DataFrame) -> DataFrame:
    """Nodes with kind, label, subtitle, x, y, part and place: topics left, items in lanes by topic, websites right."""
    lanes = topics.withColumn("lane", F.row_number().over(Window.orderBy("display_order")) - 1)
    y = lambda n: (F.lit(120) + 120 * n).cast("long")
    text = lambda c: F.col(c).cast("string")
    place = lambda part, of: (F.lit(part).alias("part"), F.col(of).cast("long").alias("place"))
    left = lanes.select(F.concat_ws(":", F.lit("topic"), "slug").alias("id"), F.lit("topic").alias("kind"), F.col("label"), F.lit("").alias("subtitle"), F.lit(120).cast("long").alias("x"), y(F.col("lane")).alias("y"), *place(0, "lane"))
    placed = shown.join(primary, "id").join(F.broadcast(lanes.select(F.col("slug").alias("topic"), "lane")), "topic", "left")
    label = F.when(F.coalesce("title", F.lit("")) == "", "Untitled source").otherwise(F.col("title"))
    middle = placed.select(
        F.concat_ws(":", F.lit("item"), text("id")).alias("id"), F.lit("item").alias("kind"), label.alias("label"), F.col("platform").alias("subtitle"),
        (F.lit(320) + (F.col("place") % 5) * 190).cast("long").alias("x"), y(F.coalesce("lane", F.lit(0))).alias("y"), *place(1, "place"),
    )
    right = _ranked(websites).select(
        F.concat_ws(":", F.lit("website"), text("id")).alias("id"), F.lit("website").alias("kind"), F.col("name").alias("label"), counted(F.col("uses"), "mention").alias("subtitle"),
        F.lit(1120).cast("long").alias("x"), (F.lit(100) + 68 * F.col("rank")).cast("long").alias("y"), *place(2, "rank"),
    )
    return left.unionByName(middle).unionByName(right)


def edges(topic: DataFrame, website: DataFrame) -> DataFrame:
    """The edges in the order in which the graph is put together, topics' first; a report of GRAPH_EDGES at most."""
    parts = [rows.withColumns({"kind": F.lit(kind), "part": F.lit(k)}) for k, (kind, rows) in enumerate((("topic", topic), ("website", website)))]
    return parts[0].unionByName(parts[1]).orderBy("part", "place").limit(GRAPH_EDGES)


def capped_nodes(rows: DataFrame) -> DataFrame:
    """The nodes in the order in which the graph is put together: topics, items, websites; a report of GRAPH_NODES at most."""
    return rows.orderBy("part", "place").limit(GRAPH_NODES)


def summary(shown: DataFrame) -> DataFrame:
    """visible_count, has_more: how many items are shown and whether there may be more."""
    return shown.agg(F.count("*").alias("visible_count")).select("visible_count", (F.col("visible_count") == GRAPH_ITEMS).alias("has_more"))


def merge_websites(urls_by_item: DataFrame) -> DataFrame:
    """Websites by host, with their distinct page URLs counted, and the least of them; website_paths() has them all."""
    per_url = urls_by_item.groupBy("host", "url").agg(F.count("*").alias("n"))
    return per_url.groupBy("host").agg(F.count("*").alias("n_urls"), F.sum("n").alias("mentions"), F.min("url").alias("first_url"))


def website_paths(urls_by_item: DataFrame) -> DataFrame:
    """host, url, mentions, n_urls: every URL of a merged website, with its mentions and the number of the website's URLs.

    A row for each URL, not a list for each host, so a host with very many is in no task as a whole."""
    per_url = urls_by_item.groupBy("host", "url").agg(F.count("*").alias("mentions"))
    return per_url.join(per_url.groupBy("host").agg(F.count("*").alias("n_urls")), "host")
