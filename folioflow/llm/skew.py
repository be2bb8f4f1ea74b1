"""Joins and summaries by keys of which one may have a third of all rows.

Rows are dealt by key and by a number from 0 to SALTS - 1 that another column gives, so
a key's rows are in up to SALTS tasks; what all of them need is first brought to each
(key, number) that occurs, of which a key has SALTS at most. All of it is shuffled and
merged at every size; nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64
#: Words of 64 bits in the filter of `parted`: 1 MB, however many its ids are.
WORDS = 1 << 17


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def look_up(rows: DataFrame, table: DataFrame, *keys: str, by: str, how: str = "inner", among: DataFrame | None = None) -> DataFrame:
    """rows joined with table by keys. among, if given, has at least the values of keys and `by` that rows has, and is cheaper to read."""
    dealt = _dealt(rows, by)
    wanted = (dealt if among is None else _dealt(among, by)).select(*keys, "salt").distinct().join(table.hint("merge"), list(keys))
    return dealt.join(wanted.hint("merge"), [*keys, "salt"], how).drop("salt")


def summed_up(rows: DataFrame, key: str, by: str, sums: dict[str, tuple[Column, Callable]], keep: Column) -> DataFrame:
    """The rows with summaries of their key, of the keys that keep is true of.

    sums: for each new column an aggregate over rows, and a function that makes an
    aggregate over such results (sum of counts, least of the least).
    """
    dealt = _dealt(rows, by).repartition(key, "salt")
    parts = dealt.groupBy(key, "salt").agg(*[first.alias(name) for name, (first, _) in sums.items()])
    over = Window.partitionBy(key)
    whole = parts.select(key, "salt", *[then(F.col(name)).over(over).alias(name) for name, (_, then) in sums.items()]).where(keep)
    return dealt.join(whole.hint("merge"), [key, "salt"]).drop("salt")


def parted(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is none of ids (the key alone, no nulls), and those whose key is one.

    A filter of fixed size says of most of the former that they can't be: a bit for each hash.
    They stay where they are, and only the rest, which then meets the ids, is shuffled. ids is
    read three times and should be written.
    """
    hashed = F.xxhash64(key)
    word, bit = F.pmod(hashed, F.lit(WORDS)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 58).cast("int"))
    bits = ids.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    given = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(key), word.alias("word"), bit.alias("bit"))
    met = given.join(F.broadcast(bits), "word", "left")
    maybe = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    near = met.where(maybe).select("row", key)
    out = met.where(~maybe).select("row").unionByName(near.join(ids, key, "left_anti").select("row"))
    return out.select("row.*"), near.join(ids, key, "left_semi").select("row.*")
