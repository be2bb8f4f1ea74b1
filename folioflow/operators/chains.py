"""Names that stand for other names: renames that chain, and groups of what is linked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.sources.scratch import written


def resolve(renames: DataFrame) -> DataFrame:
    """tag, final, cycle of renames (tag, into): where each tag ends, however long the chain.

    By pointer jumping: each round a tag points to where its pointer's pointer points, so a
    chain of n renames takes log2(n) rounds, each a join. A tag that is renamed several
    times goes to the smallest of its new names; a rename to itself or to null is none. Tags
    on a cycle, and those that lead to it, end at the cycle's smallest tag, which is in the
    column cycle (else null).
    """
    kept = renames.where("tag is not null and into is not null and tag <> into").groupBy("tag").agg(F.min("into").alias("at"))
    # low: the smallest of the tags that were passed, `at` not among them
    steps = written(kept.withColumn("low", F.col("tag")), "renames")
    n_open, reach = None, 1
    while True:
        following = steps.select(F.col("tag").alias("at"), F.col("at").alias("after"), F.col("low").alias("low_after"))
        # files of such names are far smaller than their rows, so Spark would take them for small enough to send to the driver, each round
        joined = steps.join(following.hint("merge"), "at", "left")
        is_open = F.col("after").isNotNull()
        further = written(joined.select("tag", F.coalesce("after", "at").alias("at"), F.least("low", "low_after").alias("low"), is_open.alias("open")), "renames")
        still = further.where("open").count()
        reach *= 2
        # none is open: all have ended. As many as before: these lead to cycles; go on until each pointer has gone all round
        if not still or (still == n_open and reach >= 2 * still):
            break
        n_open, steps = still, further.drop("open")
    ended = further.where("not open").select("tag", F.col("at").alias("final"), F.lit(None).cast(dict(further.dtypes)["tag"]).alias("cycle"))
    if not still:
        return ended
    circling = further.where("open")
    low = circling.select(F.col("tag").alias("at"), F.col("low").alias("cycle"))
    return ended.unionByName(circling.join(low.hint("merge"), "at").select("tag", F.col("cycle").alias("final"), "cycle"))


def groups(links: DataFrame) -> DataFrame:
    """id, group of links (id, other): the smallest id that each is linked with, over any number of links.

    Each round takes the smallest group of the neighbours and then that group's own group,
    so that long chains halve; it ends when nothing changes.
    """
    both = links.select("id", "other").unionByName(links.select(F.col("other").alias("id"), F.col("id").alias("other")))
    both = written(both.where("id <> other").distinct(), "links")
    of = written(both.groupBy("id").agg(F.min("other").alias("low")).select("id", F.least("id", "low").alias("group")), "groups")
    while True:
        near = both.join(of.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("group").alias("low"))
        lower = of.join(near, "id").select("id", F.col("group").alias("was"), F.least("group", "low").alias("group"))
        up = of.select(F.col("id").alias("group"), F.col("group").alias("above"))
        moved = written(lower.join(up, "group", "left").select("id", "was", F.least("group", F.coalesce("above", "group")).alias("group")), "groups")
        of = moved.drop("was")
        if not moved.where(F.col("group") != F.col("was")).limit(1).count():
            return of
