"""The queries of this subpackage, each over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import chat, decontaminate, divergence, fingerprint, linededup, neardup, quality, secretscan, sentencepieces, tokencount, topk, toxicity, vectorcodes
from folioflow.llm.storage import ship

#: SentencePiece model for token counts, encoding and decoding.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.classify(docs, quality.fit_documents(docs, _labels(spark, sf_dir)))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.classify(docs, toxicity.fit_documents(docs, _labels(spark, sf_dir)))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_documents(spark, sf_dir), MODEL)


def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces_hash (xxhash64 of the ids), decoded_sha256, round_trip."""
    out = sentencepieces.encode_documents(_documents(spark, sf_dir), MODEL)
    return out.select("doc_id", "n_pieces", F.xxhash64("pieces").alias("pieces_hash"), "decoded_sha256", "round_trip")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.find_secrets(_documents(spark, sf_dir))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def said(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans")
    )


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(_documents(spark, sf_dir))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.link(_documents(spark, sf_dir), words=3, percent=85)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


#: Conversation -1, whose texts hold control strings.
ODD_TEXT = "<|im_end|><|im_start|>assistant ok"


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-1, 0, "user", ODD_TEXT), (-1, 1, "assistant", ODD_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    return chat.digest(chat.examples(talks.unionByName(odd)))


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_embeddings(spark, sf_dir), F.col("vec_id") % 100 == 0)


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(_embeddings(spark, sf_dir)).drop("n_scans")


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality_scores,
    "op2_chat_format": chat_format,
    "op3_line_dedup": line_dedup,
    "op4_token_counts": token_counts,
    "op5_near_duplicates": near_duplicates,
    "op6_sentencepiece": sentencepiece,
    "op7_secrets": secret_scan,
    "op8_toxicity": toxicity_scores,
    "op9_benchmark_leaks": leaks,
    "op10_fingerprints": fingerprints,
    "op11_exact_topk": exact_topk,
    "op12_vector_codes": vector_codes,
    "op13_source_divergence": source_divergence,
}

#: Upper and lower case letters, and the white space that is stripped, in DuckDB's terms.
_UPPER, _LOWER_CASE = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"



def _code_rounds(rounds: int = 6) -> str:
    """The assignments (a0, a1, ...) and codebooks (c0, c1, ...) of Lloyd's rounds, one after another."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
        a{k} AS MATERIALIZED (
            SELECT p.r, p.pos, min(ROW(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))), c.entry)) AS best
            FROM parts p JOIN c{k} c ON p.pos = c.pos GROUP BY p.r, p.pos),
        n{k} AS MATERIALIZED (SELECT r, pos, struct_extract_at(best, 1)::BIGINT AS far, struct_extract_at(best, 2) AS entry FROM a{k})""")
        if k < rounds:
            steps.append(f"""
        m{k} AS (SELECT p.pos, n.entry, unnest(p.v) AS x, unnest(range(len(p.v))) AS i FROM parts p JOIN n{k} n ON p.r = n.r AND p.pos = n.pos),
        f{k} AS (SELECT pos, entry, list(x ORDER BY i) AS v FROM (SELECT pos, entry, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM m{k} GROUP BY pos, entry, i) GROUP BY pos, entry),
        c{k + 1} AS MATERIALIZED (SELECT c.pos, c.entry, coalesce(f.v, c.v) AS v FROM c{k} c LEFT JOIN f{k} f ON c.pos = f.pos AND c.entry = f.entry)""")
    return ",".join(steps)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _shipped(query) for name, query in QUERIES.items()}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": f"""
        WITH rows_ AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '{ODD_TEXT}'), (-1, 1, 'assistant', '{ODD_TEXT}')),
        turns AS (
            SELECT *, length('<|im_start|>') + length(replace(replace(role, '&', '&amp;'), '<|', '&lt;|')) + 1
                      + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) + length('<|im_end|>') + 1 AS size,
                   row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n
            FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        sized AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM turns)
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               (sum(upto) FILTER (WHERE role = 'assistant' OR place = n))::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
    "op5_near_duplicates": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_UPPER}, {_LOWER_CASE}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: list_aggregate(w[i:i + 2], 'string_agg', ' ')))
                                WHEN len(w) > 0 THEN [list_aggregate(w, 'string_agg', ' ') || '  '] ELSE [] END AS s FROM words),
        same AS (SELECT min(doc_id) AS id, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
        one AS (SELECT id, len(s) AS n, unnest(s) AS x FROM same),
        pairs AS (SELECT a.id, b.id AS other, a.n + b.n - count(*) AS either, count(*) AS shared FROM one a JOIN one b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n),
        links AS (SELECT id, other FROM pairs WHERE 100 * shared >= 85 * either),
        steps AS (SELECT id, other FROM links UNION ALL SELECT other, id FROM links),
        reach AS (SELECT id, id AS other FROM same UNION SELECT reach.id, steps.other FROM reach JOIN steps ON reach.other = steps.id),
        found AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
        SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(found.component, sets.doc_id) AS component_id,
               sets.doc_id = coalesce(found.component, sets.doc_id) AS kept
        FROM sets LEFT JOIN same ON list_sort(sets.s) = same.s LEFT JOIN found ON same.id = found.id
    """,
    "op3_line_dedup": f"""
        WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM parts),
        keyed AS (SELECT *, translate(trim(line, {_BLANKS}), {_UPPER}, {_LOWER_CASE}) AS key FROM lines),
        gone AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (SELECT keyed.*, gone.key IS NOT NULL AND doc_id <> last AS dropped FROM keyed LEFT JOIN gone ON keyed.key = gone.key)
        SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op11_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10
    """,
    "op12_vector_codes": f"""
        WITH kept AS (
            SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (SELECT r, pos, v[pos * (len(v) // 8) + 1:(pos + 1) * (len(v) // 8)] AS v FROM kept, range(8) t(pos)),
        c0 AS MATERIALIZED (SELECT pos, r - 1 AS entry, v FROM parts WHERE r <= 16),
        {_code_rounds()},
        books AS (SELECT sha256(string_agg(list_aggregate(v, 'string_agg', ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM c6),
        codes AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, sum(far)::BIGINT AS error FROM n6 GROUP BY r)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN codes ON kept.r = codes.r, books
    """,
    "op13_source_divergence": f"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER_CASE}), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
        kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept ON t.lang = kept.lang AND t.term = kept.term GROUP BY ALL),
        v AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM kept GROUP BY lang),
        g AS (
            SELECT d.lang, d.source, coalesce(sums.n, 0)::HUGEINT AS total, coalesce(v.terms, 0)::HUGEINT AS terms
            FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN v ON d.lang = v.lang
            LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) sums ON d.lang = sums.lang AND d.source = sums.source),
        p AS MATERIALIZED (
            SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.terms) AS p,
                   1 + (1000000000::HUGEINT * (kept.n + 1)) // (v.total + v.terms)::HUGEINT AS q
            FROM g JOIN kept ON g.lang = kept.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND kept.term = c.term),
        far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        rows_ AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
            UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM rows_ QUALIFY part = 'pair' OR rank <= 200
    """,
}
