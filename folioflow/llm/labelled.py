"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit(""))) % folds).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: tuple[int, int], max_chars: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, tie, label (0/1) of at most per_class[c] labelled documents of class c, none longer than max_chars.

    Documents of the held-out fold are never taken, nor are ids with a null label or
    with both labels. The pick goes by a hash of the id, so it is the same on each run.
    Null texts are empty. The picked ids, at most the sum of per_class, are broadcast;
    ids that repeat in docs give repeated rows, which `one_each` reduces to the one of
    smallest tie, a hash of the text.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (fold("id", folds) != held_out))
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where("label = most")
        .drop("most")
    )
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if max_chars is not None:
        texts = texts.where(F.length("text") <= max_chars)
        known = known.join(texts.select("id"), "id", "left_semi")
    order = [F.xxhash64(F.lit("sample"), "id"), F.col("id")]
    picked = [known.where(F.col("label") == c).orderBy(*order).limit(per_class[c]) for c in (0, 1)]
    return texts.withColumn("tie", F.xxhash64("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "id")


def one_each(rows: pd.DataFrame) -> pd.DataFrame:
    """Sampled rows by id, one of each: the same rows in the same order on every run."""
    return rows.sort_values(["id", "tie"], kind="stable").drop_duplicates("id").reset_index(drop=True)
