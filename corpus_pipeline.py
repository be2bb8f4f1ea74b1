"""The corpus pipeline: documents through five of the operators of folioflow.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet in the shared folder and reads again as the next stage's docs. All stages but
the last return the columns of documents, whatever other columns these have. Rows with a
null doc_id pass every stage; null texts count as empty; texts of any length are read
whole; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, linededup, neardup, queries, sentencepieces, toxicity
from folioflow.llm.skew import parted
from folioflow.llm.storage import ship, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is below the cut, by a model of this corpus's labelled rows.

    Each row goes by its own text, so equal texts go together and empty ones stay. A
    column named score is lost on the way and comes back as it was.
    """
    model = toxicity.fit_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    given = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    return toxicity.score(given, model, keep=True).where(F.col("score") < toxicity.CUT).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without the lines that at least three documents share (but for the last of these), n_chars that of the new text.

    Rows that repeat a doc_id count as one document; a row with a null doc_id keeps its
    lines. Null texts become empty.
    """
    return linededup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates (five words, likeness of 0.8 or more) the document of smallest id.

    Of rows with equal doc_id and text one stays. Where rows of one doc_id have different
    texts, they go only if each of them has a near duplicate of smaller id. Texts without
    words are near to nothing and stay.
    """
    rows = written(neardup.link(docs, words=5, percent=80).where("doc_id is not null"), "classes")
    ids = rows.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("goes"), F.count("*").alias("n"))
    kept = parted(docs, written(ids.where("goes").select("doc_id"), "goes"), "doc_id")[0]
    several = written(ids.where("n > 1 and not goes").select("doc_id"), "several")
    if several.isEmpty():
        return kept
    once, again = parted(kept, several, "doc_id")
    again = again.select(F.struct(*docs.columns).alias("row"))
    place = F.row_number().over(Window.partitionBy("row.doc_id", F.xxhash64("row.text")).orderBy(F.xxhash64("row")))
    return once.unionByName(again.withColumn("place", place).where("place = 1").select("row.*"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of the benchmark, as it is or asked again with other names, numbers or units.

    Rows that repeat a doc_id go or stay together.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces, decoded_sha256, round_trip of every document left, a row for each row; empty texts have no pieces."""
    return sentencepieces.encode_documents(docs, queries.MODEL)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode),
]

#: SQL can't express a trained network or the tokeniser's search; tests/llm compares each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
