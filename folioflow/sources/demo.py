"""A demonstration catalog: four items with their satellites, by fixed ids."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from folioflow.schemas import TABLES

#: title, platform, link, topic, tags, summary, website.
ITEMS = (
    ("Setting type for small screens", "youtube", "https://www.youtube.com/watch?v=demo-type", "typography", ("type", "screen"), "How sizes and leading carry over to small screens.", "Letter Library"),
    ("Forms that forgive", "instagram", "https://www.instagram.com/reel/demo-forms", "design", ("form",), "Inputs that help people to correct what they typed.", "Form Notes"),
    ("Easing, explained by balls", "tiktok", "https://www.tiktok.com/@demo/video/1000000001", "animation", ("motion", "easing"), "Three curves and what they are good for.", "Curve Garden"),
    ("Keeping a reading log", "web", "https://log.example/reading", "learning", ("notes",), "Why a line for each book is enough.", "Reading Log"),
)


def demo_tables(spark: SparkSession, now: datetime) -> dict[str, DataFrame]:
    """items, item_topics, item_tags, revisions, evidence, chunks, websites and mentions; each item a day older than the one before."""
    rows: dict[str, list[dict]] = {t: [] for t in ("items", "item_topics", "item_tags", "revisions", "evidence", "chunks", "websites", "mentions")}
    for k, (title, platform, link, topic, tags, summary, site) in enumerate(ITEMS):
        item, website, source = f"demo-item-{k + 1}", f"demo-site-{k + 1}", f"description:demo-item-{k + 1}"
        kind = "page" if platform == "web" else "video"
        rows["items"].append(dict(id=item, title=title, description=summary, platform=platform, platform_id=f"demo-{k}", source_url=link, canonical_url=link, type=kind, status="ready", current_revision=1, created_at=now - timedelta(days=k)))
        rows["item_topics"].append(dict(item_id=item, topic=topic))
        rows["item_tags"] += [dict(item_id=item, tag=t) for t in tags]
        rows["revisions"].append(dict(item_id=item, revision=1, title=title, summary=summary, key_points=[(summary, [source])], topics=[topic]))
        rows["evidence"].append(dict(id=source, item_id=item, seq=0, kind="description", label="Source description", excerpt=summary))
        rows["chunks"].append(dict(item_id=item, seq=0, body=" ".join((title, summary, *tags)), evidence_ids=[source]))
        rows["websites"].append(dict(id=website, name=site, hostname=link.split("/")[2], canonical_url=link))
        rows["mentions"].append(dict(id=f"demo-mention-{k + 1}", item_id=item, website_id=website, seq=0, evidence_id=source, certainty="explicit", confirmation="confirmed"))
    return {t: spark.createDataFrame([tuple(r.get(f.name) for f in TABLES[t]) for r in found], TABLES[t]) for t, found in rows.items()}


def seed_demo(catalog, now: datetime) -> None:
    """Add the demonstration to a catalog, but for items that it has."""
    new = demo_tables(catalog.spark, now)
    known = catalog.read("items").select("id")
    fresh = new["items"].join(known, "id", "left_anti").select("id")
    added = {t: rows.join(fresh.withColumnRenamed("id", "item_id"), "item_id", "left_semi") for t, rows in new.items() if "item_id" in rows.columns}
    added["websites"] = new["websites"].join(added["mentions"].select("website_id").withColumnRenamed("website_id", "id"), "id", "left_semi")
    for table, rows in added.items():
        catalog.write(table, catalog.read(table).unionByName(rows.select(catalog.read(table).columns)))
    # the items last: they say what is there
    catalog.write("items", catalog.read("items").unionByName(new["items"].join(fresh, "id", "left_semi").select(new["items"].columns)))
