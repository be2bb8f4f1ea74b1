"""Checks of citations, contracts and storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators import detail
from folioflow.operators.library import latest_revision
from folioflow.schemas import ENTRY_LIMITS, ITEM_STATUSES, LIST_LIMITS, TEXT_LIMITS
from folioflow.sources.scratch import written

#: White space that parts words, characters that a passage without inner words is looked for by at most, anchors of a passage, places of the filter of candidates.
BLANKS, SHORT, ANCHORS, PLACES = r"[ \t-\r]+", 3, 3, 1 << 18


def literal_occurrence(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """item_id, passage_id: which texts hold which passages literally. Null texts and passages are in none; an empty passage is in all others.

    White space parts a passage's inner words from their neighbours, so a text that holds the
    passage has these as words of its own, in their order. The rarest ones, by the number of
    texts that have them, are the passage's anchors; a text is a candidate where all of a
    passage's anchors stand at their distances. Passages without an inner word are found by
    their first characters, SHORT at most, in the same way. Only then texts are read for the
    comparison, those of candidates: a filter of fixed size (PLACES) leaves most others out
    before anything is shuffled, so texts move for candidates only.
    """
    texts, passages = texts.where("body is not null").select("item_id", "body"), passages.where("excerpt is not null").select(F.col("id").alias("passage_id"), "excerpt")
    words = F.split("excerpt", BLANKS)
    inner = F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 2))
    long = passages.withColumn("inner", inner).where("size(inner) > 0")
    wanted = written(long.select("passage_id", F.posexplode("inner").alias("offset", "key")), "wanted")
    said = texts.select("item_id", F.posexplode(F.split("body", BLANKS)).alias("place", "key"))
    candidates = _anchored(said, wanted)
    short = passages.where(F.size(inner) == 0).select("passage_id", F.left("excerpt", F.lit(SHORT)).alias("key"))
    # texts are cut into characters only if there are such passages: at most a row is broadcast
    some = short.limit(1).select(F.lit(1).alias("one"))
    cut = texts.withColumn("one", F.lit(1)).join(F.broadcast(some), "one", "left_semi").select("item_id", F.split("body", "").alias("c"))
    grams = F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("c"))), lambda i: F.transform(F.sequence(F.lit(1), F.lit(SHORT)), lambda n: F.array_join(F.slice("c", i, n), ""))))))
    candidates = candidates.unionByName(cut.select("item_id", F.explode(grams).alias("key")).join(short, "key").select("item_id", "passage_id"))
    candidates = written(candidates.distinct(), "candidates")
    place = F.pmod(F.xxhash64("item_id"), F.lit(PLACES)).cast("int")
    near = candidates.select(place.alias("at")).distinct()  # PLACES rows at most
    read = texts.withColumn("at", place).join(F.broadcast(near), "at", "left_semi").drop("at")
    pairs = candidates.join(passages, "passage_id").join(read, "item_id")
    return pairs.where(F.contains("body", "excerpt")).select("item_id", "passage_id").distinct()


def _anchored(said: DataFrame, wanted: DataFrame) -> DataFrame:
    """item_id, passage_id where a text's words (item_id, place, key) have a passage's rarest words (passage_id, offset, key) at their distances."""
    heard = said.join(wanted.select("key").distinct(), "key", "left_semi")
    frequency = heard.select("item_id", "key").distinct().groupBy("key").agg(F.count("*").alias("n"))
    # a word that no text has: the passage is in none
    rare = wanted.join(frequency, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("passage_id").orderBy("n", F.desc(F.length("key")), "offset")
    anchors = rare.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= ANCHORS).withColumn("least", F.min("n").over(Window.partitionBy("passage_id"))).where("least > 0")
    anchors = anchors.withColumn("n_anchors", F.count("*").over(Window.partitionBy("passage_id"))).select("passage_id", "offset", "key", "n_anchors")
    hits = said.join(anchors, "key").groupBy("passage_id", "n_anchors", "item_id", (F.col("place") - F.col("offset")).alias("start")).agg(F.count("*").alias("found"))
    return hits.where("found = n_anchors").select("item_id", "passage_id").distinct()


def dangling(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations (item_id, evidence_id) of evidence that the item doesn't have."""
    return citations.join(evidence.select("item_id", F.col("id").alias("evidence_id")), ["item_id", "evidence_id"], "left_anti")


def _measured(rows: DataFrame, name: str, text: str | None = None) -> DataFrame:
    """Of each item's rows how many there are and how long the longest text is; nothing is collected."""
    longest = F.max(F.length(text)) if text else F.lit(0)
    return rows.groupBy(F.col("item_id").alias("id")).agg(F.count("*").alias(f"n_{name}"), longest.cast("long").alias(f"longest_{name}"))


def contract_breaches(items: DataFrame, revisions: DataFrame, notes: DataFrame, **lists: DataFrame) -> DataFrame:
    """id, broken: the items whose detail breaks the contract and the names of the rules, in their order.

    lists: rows with item_id by the names of LIST_LIMITS (whole lists, not what a detail
    shows), and the text that ENTRY_LIMITS limits in a column named as there, or `text`.
    A list is refused for its length or an entry's; of the transcript the first entries count.
    """
    latest = latest_revision(revisions, "title", "summary", "key_points_json")
    points = detail.decoded_points(F.col("key_points_json"))
    longest_point = F.array_max(F.transform(points, lambda p: F.length(p["text"]))).cast("long")
    size = lambda column: F.length(column).alias(f"length_{column}")
    # texts are measured where they are read: only lengths are joined, and neither side of a join is ever sent to the driver with its texts
    latest = latest.select(F.col("item_id").alias("id"), F.length("title").alias("new_title"), F.length("summary").alias("new_summary"), F.size(points).cast("long").alias("n_key_points"), longest_point.alias("longest_key_points"))
    size_of = [size(c) for c in ("title", "author") if c in items.columns]
    own = items.select("id", "status", (F.col("bytes") if "bytes" in items.columns else F.lit(None).cast("long")).alias("bytes"), F.length("description").alias("length_summary"), *size_of)
    noted = notes.select(F.col("item_id").alias("id"), F.length("body").alias("length_note"))
    rows = own.join(latest, "id", "left").join(noted.hint("merge"), "id", "left")
    rows = rows.withColumns({"length_title": F.coalesce("new_title", "length_title"), "length_summary": F.coalesce("new_summary", "length_summary")})
    texts = {place.partition("[]")[0]: place.partition("[]")[2].removeprefix(".") or "text" for place in ENTRY_LIMITS}
    for name, of_list in lists.items():
        if name == "transcript":
            of_list = detail.transcript_head(of_list)
        rows = rows.join(_measured(of_list, name, texts.get(name) if texts.get(name) in of_list.columns else None), "id", "left")
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in contract_rules({*lists, "key_points"}, rows.columns).items()]
    return rows.select("id", F.array_compact(F.array(*broken)).alias("broken")).where(F.size("broken") > 0)


def contract_rules(lists: set[str], columns: list[str]) -> dict[str, Column]:
    """Rules of measured items, by what they are about: lengths of lists, of texts, of lists' entries, and the domains of columns."""
    zero = F.lit(0)
    rules = {name: F.coalesce(f"n_{name}", zero) <= most for name, most in LIST_LIMITS.items() if name in lists}
    rules |= {name: F.coalesce(f"length_{name}", zero) <= most for name, most in TEXT_LIMITS.items() if f"length_{name}" in columns}
    rules |= {place: F.coalesce(f"longest_{place.partition('[]')[0]}", zero) <= most for place, most in ENTRY_LIMITS.items() if place.partition("[]")[0] in lists}
    return rules | {"status": F.col("status").isin(*ITEM_STATUSES), "bytes": F.coalesce(F.col("bytes") >= 0, F.lit(True))}


def storage_by_role(assets: DataFrame) -> DataFrame:
    return assets.groupBy("role").agg(F.count("*").alias("assets"), F.sum("bytes").alias("bytes"))
