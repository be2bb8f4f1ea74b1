"""Queries over stored indexes and counts that change by difference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import retrieval
from folioflow.operators.facets import Facets
from folioflow.operators.rankindex import RankIndex
from folioflow.operators.textindex import TextIndex, library_texts
from folioflow.operators.vectorindex import VectorIndex
from folioflow.plans import core
from folioflow.plans.core import KEYWORD, ORACLE_SQL, WILDCARD, query
from folioflow.sources.adapters import entity, with_entities
from folioflow.sources.scratch import new_dir

NEIGHBOURS = 10


def text_index(spark, d) -> TextIndex:
    """All texts of the library, a third of them added later, and another third removed and added again."""
    texts = library_texts(entity(spark, d, "items"), entity(spark, d, "chunks"))
    third = lambda k: texts.where(F.col("item_id") % 3 == k)
    index = TextIndex(spark, new_dir(spark)).add(texts.where(F.col("item_id") % 3 < 2)).add(third(2))
    return index.remove(third(1)).add(third(1))


@query("keyword_search_indexed", ORACLE_SQL["keyword_search"])
def keyword_search_indexed(spark, d):
    return text_index(spark, d).search(entity(spark, d, "items"), KEYWORD).select("id", "title", "platform")


@query("wildcard_search_indexed", ORACLE_SQL["wildcard_search"])
def wildcard_search_indexed(spark, d):
    return text_index(spark, d).search(entity(spark, d, "items"), WILDCARD).select("id", "title")


def vector_index(spark, d) -> VectorIndex:
    return VectorIndex.build(spark, new_dir(spark), entity(spark, d, "vectors"))


def _asking(spark, d) -> DataFrame:
    return entity(spark, d, "vectors").where("id % 50 = 0")


@query(
    "similar_items_indexed",
    f"""SELECT query_id, rank, id, score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
        SELECT q.id AS query_id, v.id, round(list_cosine_similarity(q.vector::DOUBLE[], v.vector::DOUBLE[]), 6) AS score FROM vectors_ q JOIN vectors_ v ON q.id <> v.id WHERE q.id % 50 = 0)) WHERE rank <= {NEIGHBOURS}""",
    "vectors",
)
def similar_items_indexed(spark, d):
    """The exact nearest, by cells and then by what other cells could hold."""
    return vector_index(spark, d).nearest(_asking(spark, d), NEIGHBOURS, share=0.25, exact=True)


@query("nearest_by_cells")
def nearest_by_cells(spark, d):
    """What the nearest cells hold: most of the nearest (recall in the README)."""
    return vector_index(spark, d).nearest(_asking(spark, d), NEIGHBOURS)


@query("item_neighbours")
def item_neighbours(spark, d):
    """The neighbours of every item at once, from the nearest cells."""
    return vector_index(spark, d).neighbours(NEIGHBOURS)


def rank_index(spark, d) -> RankIndex:
    """All chunks: most put in three segments, some first with other texts, some removed and put again."""
    chunks = entity(spark, d, "chunks").select(F.col("item_id").alias("id"), "body")
    other = chunks.where("id % 5 = 1").select("id", F.concat_ws(" ", F.lit("the apache the license the"), F.left("body", F.lit(200))).alias("body"))
    index = RankIndex(spark, new_dir(spark)).put(chunks.where("id % 5 in (0, 2)").unionByName(other))
    index = index.put(chunks.where("id % 5 in (1, 3)")).remove(chunks.where("id % 10 = 2"))
    return index.put(chunks.where("id % 5 = 4 or id % 10 = 2"))


@query("bm25_blocks", ORACLE_SQL["bm25_topk"])
def bm25_blocks(spark, d):
    return rank_index(spark, d).search(core.BM_WORDS)


_FACETS = """SELECT 'topic' AS facet, topic AS value, count(*) AS n FROM item_topics_ GROUP BY ALL UNION ALL SELECT 'tag', tag, count(*) FROM item_tags_ GROUP BY ALL
    UNION ALL SELECT 'platform', platform, count(*) FROM items_ GROUP BY ALL UNION ALL SELECT 'processing', '', count(*) FROM items_ WHERE status NOT IN ('ready', 'failed', 'canceled')"""


def facets(spark, d) -> Facets:
    """The library's facets, kept through an insert of all but some items, an insert with other values, an edit and a deletion."""
    items, topics, tags = (entity(spark, d, n) for n in ("items", "item_topics", "item_tags"))
    own = {"items": "id", "topics": "item_id", "tags": "item_id"}
    part = lambda sql: tuple(rows.where(sql.format(key)) for rows, key in zip((items, topics, tags), own.values(), strict=True))
    wrong = part("{} % 7 = 3")
    wrong = (wrong[0].withColumns({"platform": F.lit("local"), "status": F.lit("queued")}), wrong[1].withColumn("topic", F.lit("zz")), wrong[2].withColumn("tag", F.lit("unsure")))
    kept = Facets(spark, new_dir(spark)).change(None, part("{} % 7 < 3")).change(None, wrong)
    kept = kept.change(wrong, part("{} % 7 = 3")).change(None, part("{} % 7 > 2 and {} % 7 <> 3".replace("{}", "{0}")))
    return kept.change(part("{} % 7 = 5"), None).change(None, part("{} % 7 = 5"))


@query("facets_kept", _FACETS, "items", "item_topics", "item_tags")
def facets_kept(spark, d):
    return facets(spark, d).counts()


@query("topic_counts_kept", ORACLE_SQL["topic_counts"])
def topic_counts_kept(spark, d):
    return facets(spark, d).topics(entity(spark, d, "topics"))


_PACKED = r"""WITH RECURSIVE tok AS (SELECT item_id, unnest(w) AS t, unnest(range(len(w))) AS k FROM (SELECT item_id, regexp_extract_all(body, '[\t-\r ]*[^\t-\r ]+') AS w FROM chunks_)),
    placed AS (SELECT item_id, k, regexp_extract(t, '[^\t-\r ]+') AS word, sum(length(t)) OVER (PARTITION BY item_id ORDER BY k) AS upto FROM tok),
    d AS (SELECT item_id, count(*) AS n, list(upto - length(word) ORDER BY k) AS starts, list(upto ORDER BY k) AS ends, coalesce(list(k + 1 ORDER BY k) FILTER (WHERE word[-1] IN ('.', '!', '?')), []) AS after FROM placed GROUP BY 1),
    c AS (SELECT item_id, 0::BIGINT AS seq, 0::BIGINT AS first, CASE WHEN 220 >= n THEN n ELSE coalesce(list_max(list_filter(after, lambda x: x > 0 AND x <= 220)), 220) END AS last FROM d
        UNION ALL SELECT item_id, seq, nf, CASE WHEN nf + 220 >= n THEN n ELSE coalesce(list_max(list_filter(after, lambda x: x > nf AND x <= nf + 220)), nf + 220) END FROM (
            SELECT c.item_id, c.seq + 1 AS seq, d.n, d.after, coalesce(list_min(list_filter(d.after, lambda x: x >= greatest(c.first + 1, c.last - 40) AND x < c.last)), c.last) AS nf FROM c JOIN d ON d.item_id = c.item_id WHERE c.last < d.n)),
    spans AS (SELECT c.item_id, c.seq, starts[first + 1]::BIGINT AS start, ends[last]::BIGINT AS "end", last - first AS n_words FROM c JOIN d ON d.item_id = c.item_id),
    held AS (SELECT item_id, 'e' || k AS id, k * 700 AS low, k * 700 + 150 AS high FROM (SELECT item_id, unnest(range(length(body) // 700 + 1)) AS k FROM chunks_))
    SELECT s.item_id, s.seq, s.start, s."end", s.n_words, coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM held h WHERE h.item_id = s.item_id AND h.low < s."end" AND h.high > s.start), '') AS evidence FROM spans s"""


@query("chunks_with_evidence", with_entities("{{}}", "chunks").replace("WITH chunks_", "WITH RECURSIVE chunks_").replace(" {{}}", ", " + _PACKED.removeprefix("WITH RECURSIVE ")))
def chunks_with_evidence(spark, d):
    """Chunks packed at sentence ends, with the evidence that their characters overlap: 150 characters of every 700 of each text."""
    texts = entity(spark, d, "chunks").select("item_id", "body").where("body is not null")
    low = F.col("k") * 700
    held = texts.select("item_id", F.explode(F.sequence(F.lit(0), F.floor(F.length("body") / 700))).alias("k"))
    held = held.select("item_id", F.concat(F.lit("e"), F.col("k").cast("string")).alias("id"), low.alias("start"), (low + 150).alias("end"))
    found = retrieval.with_evidence(retrieval.packed_chunks(texts), held)
    return found.select("item_id", "seq", "start", "end", "n_words", F.array_join("evidence_ids", ",").alias("evidence"))
