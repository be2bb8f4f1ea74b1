"""The catalog's entities as they stand in the test tables, in Spark and in DuckDB's SQL.

Every entity has the same columns in both, so that a query and its SQL start from one
mapping. `now` is fixed, so that results are too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.schemas import ITEM_STATUSES

NOW = "TIMESTAMP '2024-01-15 00:00:00'"
PLATFORM_DOMAIN = (*(f"src{k}" for k in range(20)), "local")
TOPIC_DOMAIN = (("en", "English"), ("de", "German"), ("fr", "French"), ("es", "Spanish"), ("zz", "Unknown"))

_statuses = ", ".join(f"'{s}'" for s in ITEM_STATUSES)
_topics = ", ".join(f"('{s}', '{t}', {k})" for k, (s, t) in enumerate(TOPIC_DOMAIN))
_platforms = ", ".join(f"('{p}')" for p in PLATFORM_DOMAIN)

#: Written once for both engines; {array}, {element} and braces differ.
ENTITIES = {
    "items": "SELECT doc_id AS id, left(text, 160) AS title, left(text, 600) AS description, source AS platform, n_chars AS bytes, doc_id AS created_order, "
    "CASE doc_id % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'image' ELSE 'page' END AS type, TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' HOUR AS created_at, "
    "n_chars % 50 + 40 AS width, n_chars % 7 * 10 + 30 AS height, doc_id * 37 % 256 AS red, doc_id * 91 % 256 AS green, doc_id * 53 % 256 AS blue, "
    f"{{element}}({{array}}({_statuses}), CAST(doc_id % 13 AS INT) + 1) AS status FROM documents",
    "chunks": "SELECT doc_id AS item_id, 0 AS seq, text AS body, CASE WHEN doc_id % 9 = 0 THEN '[]' ELSE concat('[\"description:', CAST(doc_id AS STRING), '\",\"page:1\"]') END AS evidence_ids_json FROM documents",
    "topics": f"SELECT * FROM (VALUES {_topics}) AS t(slug, label, display_order)",
    "platforms": f"SELECT * FROM (VALUES {_platforms}) AS t(platform)",
    "item_topics": "SELECT doc_id AS item_id, lang AS topic FROM documents",
    "item_tags": "SELECT doc_id AS item_id, 'quality' AS tag FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1",
    "revisions": "SELECT conv_id AS item_id, turn AS revision, left(text, 40) AS title, text AS summary, "
    "concat('[{open}\"text\":\"point ', CAST(turn AS STRING), '\",\"evidenceIds\":[\"description:', CAST(conv_id AS STRING), '\"]{close}]') AS key_points_json FROM conversations",
    "segments": "SELECT conv_id AS item_id, turn * 1000 AS start_ms, turn * 1000 + 1000 AS end_ms, text FROM conversations",
    "mentions": "SELECT l_orderkey AS item_id, l_linenumber AS seq, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_suppkey END AS website_id, concat('site ', CAST(l_linenumber AS STRING)) AS unresolved_name FROM lineitem",
    "websites": "SELECT s_suppkey AS id, s_name AS name, concat(lower(replace(s_name, '#', '-')), '.example') AS hostname FROM supplier",
    "assets": "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS item_id, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_partkey * 10 END AS timestamp_ms, CASE WHEN l_linestatus = 'O' THEN 'original' ELSE 'capture' END AS role, CAST(l_quantity AS BIGINT) AS bytes FROM lineitem",
    "evidence": "SELECT concat('page:', CAST(item_id AS STRING)) AS id, item_id % 9 AS item_id, item_id AS seq, 'page' AS kind, left(text, 60) AS excerpt, item_id * 100 AS start_ms FROM benchmark",
    "notes": "SELECT c_custkey AS item_id, concat(c_name, ' noted') AS body FROM customer WHERE c_custkey % 3 = 0",
    "passages": "SELECT item_id AS id, text AS excerpt FROM benchmark",
    "collections": "SELECT n_nationkey AS id, n_name AS name FROM nation",
    "collection_items": "SELECT c_nationkey AS collection_id, c_custkey AS item_id FROM customer",
    "jobs": "SELECT event_id AS id, user_id AS item_id, ts AS created_at, "
    "CASE event_type WHEN 'view' THEN 'queued' WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'done' END AS status, "
    "CASE event_id % 3 WHEN 0 THEN 'acquire' WHEN 1 THEN 'analyze' ELSE 'transcribe' END AS stage, event_id % 4 AS attempt, "
    "CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL '1' DAY END AS next_attempt_at, ts + INTERVAL '60' SECOND AS lease_expires_at, "
    "CASE event_id % 4 WHEN 0 THEN '429' WHEN 1 THEN '5xx' WHEN 2 THEN '401' ELSE '403' END AS error FROM events",
    "vectors": "SELECT vec_id AS id, embedding AS vector FROM embeddings",
}
TABLES = ("documents", "labels", "conversations", "lineitem", "supplier", "benchmark", "nation", "customer", "events", "embeddings", "pages")


def _spark(sql: str) -> str:
    return sql.replace("{element}", "element_at").replace("{array}", "array").replace("{open}", "{{").replace("{close}", "}}")


def _duck(sql: str) -> str:
    return sql.replace("{element}", "list_extract").replace("{array}", "list_value").replace("{open}", "{").replace("{close}", "}")


def entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An entity as a DataFrame."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in ENTITIES[name]}
    sql = _spark(ENTITIES[name])
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **tables)


def with_entities(sql: str, *names: str) -> str:
    """DuckDB SQL that starts from entities."""
    ctes = ", ".join(f"{n}_ AS ({_duck(ENTITIES[n]).replace(' AS STRING', ' AS VARCHAR')})" for n in names)
    return f"WITH {ctes} {sql}"
