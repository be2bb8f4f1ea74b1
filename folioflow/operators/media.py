"""Planning of video frames: samples, near-equal frames, selection, transcript around a moment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.vectors import hamming
from folioflow.operators.chains import groups
from folioflow.sources.scratch import ship, written

# Frames a second up to and beyond this length, bits by which frames are alike, frames kept, batch size, batches, time around a moment.
SHORT_MS, FAST_MS, SLOW_MS, ALIKE, FRAMES, EVEN, NEAR, BATCH, CALLS, AROUND_MS = 180_000, 500, 2_000, 4, 32, 8, 12, 8, 4, 8_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys in a set number of tasks. Frames and hashes shrink to few bytes where they are
    shuffled, so by these bytes Spark would join partitions until a few tasks hold all rows. As many
    tasks as other shuffles have would be none of its own where rows come from one by the same keys."""
    session = rows.sparkSession
    return rows.repartition(max(2 * int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism), *keys)


def sample_plan(videos: DataFrame) -> DataFrame:
    """item_id, at_ms: two frames a second up to three minutes, else one in two seconds."""
    step = F.when(F.col("duration_ms") <= SHORT_MS, FAST_MS).otherwise(SLOW_MS).cast("long")
    return dealt(videos.where("duration_ms > 0"), "item_id").select("item_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration_ms") - 1, step)).alias("at_ms"))


def distinct_frames(frames: DataFrame) -> DataFrame:
    """Frames (item_id, at_ms, hash) less those that hardly differ from the frame before; change: differing bits (first: 64)."""
    before = F.lag("hash").over(Window.partitionBy("item_id").orderBy("at_ms"))
    change = F.coalesce(hamming(F.col("hash"), before), F.lit(64)).cast("long")
    return dealt(frames, "item_id").withColumn("change", change).where(F.col("change") > ALIKE)


#: Bits of a hash, hashes of a block, comparisons at a time.
BITS, CROWD, AT_ONCE = 64, 1 << 14, 1 << 19


def _bands(n: int, count: int) -> list[tuple[int, int]]:
    """The first bit and the number of bits of `count` bands of n bits."""
    cuts = [n * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _cut(hash_: Column, first: int, size: int) -> Column:
    return F.shiftrightunsigned(hash_, first).bitwiseAND(F.lit((1 << size) - 1))


def alike_pairs(hashes: DataFrame, most: int = ALIKE) -> DataFrame:
    """hash, other, bits: all pairs of distinct hashes (hash) that differ in at most so many bits, the smaller first.

    Of most + 1 bands two such hashes have one in common, so only hashes that share a band
    are compared. Hashes that share one are dealt to blocks of about CROWD, and every two
    blocks meet in a group of their own, so neither a task's memory nor its time grows with
    a crowded band. A pair counts in the first band that it shares, so none is made twice.
    """
    ship(hashes.sparkSession)
    own = hashes.select("hash").where("hash is not null").distinct()
    bands = _bands(BITS, most + 1)
    keyed = own.select("hash", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), _cut(F.col("hash"), *at).alias("value")) for k, at in enumerate(bands)])).alias("b")).select("hash", "b.*")
    keyed = written(keyed, "bands")
    crowded = keyed.groupBy("band", "value").agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
    blocks = crowded.select("band", "value", F.ceil(F.col("n") / CROWD).cast("int").alias("blocks"))
    spread = keyed.join(blocks, ["band", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = spread.withColumn("side", F.pmod(F.xxhash64("hash"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = spread.select("hash", "band", "value", F.least("side", "with").alias("low"), F.greatest("side", "with").alias("high"), "side")
    key = ["band", "value", "low", "high"]
    masks = np.array([((1 << n) - 1) << at for at, n in bands], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in key]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if a == b:
                    continue
                at = tuple(int(c[a]) for c in columns)
                if at != last and last is not None:
                    yield from _near(last, held, masks, most)
                    held = []
                last = at
                held.append((batch.column("hash").to_numpy()[a:b], batch.column("side").to_numpy()[a:b]))
        if last is not None:
            yield from _near(last, held, masks, most)

    return dealt(met, *key).sortWithinPartitions(*key).mapInArrow(run, "hash long, other long, bits long")


def _near(at: tuple[int, int, int, int], held: list[tuple[np.ndarray, np.ndarray]], masks: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """The alike pairs of a band's two blocks, or of one, that share no earlier band; at: band, value, and the blocks' numbers."""
    band, _, low, high = at
    hashes, side = (np.concatenate(c) for c in zip(*held, strict=True))
    left, right = (hashes, hashes) if low == high else (hashes[side == low], hashes[side == high])
    rows = max(1, AT_ONCE // max(1, len(right)))
    found, n_found = [], 0
    for k in range(0, len(left), rows):
        # in one block a hash meets those after it only
        mine, theirs = left[k : k + rows], right[k:] if low == high else right
        differ = mine.view(np.uint64)[:, None] ^ theirs.view(np.uint64)[None, :]
        bits = np.bitwise_count(differ)
        i, j = np.nonzero(bits <= most)
        if low == high:
            i, j = i[j > i], j[j > i]
        kept = np.all((differ[i, j][:, None] & masks[:band]) != 0, axis=1)
        i, j = i[kept], j[kept]
        found.append((np.minimum(mine[i], theirs[j]), np.maximum(mine[i], theirs[j]), bits[i, j].astype(np.int64)))
        n_found += len(i)
        if n_found and (n_found >= AT_ONCE or k + rows >= len(left)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["hash", "other", "bits"])
            found, n_found = [], 0


def alike_classes(hashes: DataFrame, most: int = ALIKE) -> DataFrame:
    """id, hash, class, n_alike of hashes (id, hash): class is the smallest hash that alike hashes lead to, n_alike the number of other hashes that are alike. A null hash is alike to nothing."""
    hashes = written(hashes.select("id", "hash"), "hashes")  # else they are made again for the result
    pairs = written(alike_pairs(hashes, most), "alike")
    of = groups(pairs.select(F.col("hash").alias("id"), "other")).withColumnsRenamed({"id": "hash", "group": "class"})
    ends = pairs.select("hash").unionByName(pairs.select(F.col("other").alias("hash"))).groupBy("hash").agg(F.count("*").alias("n_alike"))
    found = hashes.join(of, "hash", "left").join(ends, "hash", "left")
    return found.select("id", "hash", F.coalesce("class", "hash").alias("class"), F.coalesce("n_alike", F.lit(0)).cast("long").alias("n_alike"))


def select_frames(frames: DataFrame, moments: DataFrame, most: int = FRAMES) -> DataFrame:
    """item_id, at_ms, pick: up to `most` frames of each item, of frames (item_id, at_ms, change).

    pick 0: the first frame of each of EVEN equal parts of the item's time; 1: the frames
    nearest to the moments (item_id, at_ms), the first NEAR of them in time that aren't
    picked yet; 2: the rest, of most change in each of as many equal parts of the time as
    places are left, then of most change at all. The earlier goes first among equals.
    """
    item = Window.partitionBy("item_id")
    low, span = F.min("at_ms").over(item), F.max("at_ms").over(item) - F.min("at_ms").over(item) + 1
    near = _near_marked(frames, moments)
    timed = near.withColumns({"from": F.col("at_ms") - low, "span": span})
    slot = F.floor(F.col("from") * EVEN / F.col("span"))
    timed = timed.withColumn("slot", slot).withColumn("is_even", F.row_number().over(Window.partitionBy("item_id", "slot").orderBy("at_ms")) == 1)
    is_near = F.col("near") & ~F.col("is_even")
    marked = timed.withColumn("turn", F.sum(is_near.cast("int")).over(item.orderBy("at_ms"))).withColumn("is_near", is_near & (F.col("turn") <= NEAR))
    picked = marked.withColumn("pick", F.when(F.col("is_even"), 0).when(F.col("is_near"), 1).otherwise(2))
    left = F.greatest(F.lit(1), most - F.sum((F.col("pick") < 2).cast("int")).over(item))
    picked = picked.withColumn("bin", F.when(F.col("pick") == 2, F.floor(F.col("from") * left / F.col("span"))))
    first = F.row_number().over(Window.partitionBy("item_id", "pick", "bin").orderBy(F.desc("change"), "at_ms")) == 1
    picked = picked.withColumn("leads", (F.col("pick") == 2) & first)
    rank = F.row_number().over(item.orderBy("pick", F.desc("leads"), F.when(F.col("pick") == 2, F.col("change")).desc_nulls_last(), "at_ms"))
    return picked.withColumn("rank", rank).where(F.col("rank") <= most).select("item_id", "at_ms", F.col("pick").cast("long").alias("pick"))


def _near_marked(frames: DataFrame, moments: DataFrame) -> DataFrame:
    """item_id, at_ms, change, near: frames and whether one is the nearest to a moment of its item, the earlier of equals.

    No pair of both is made, and both are dealt by item once: a moment's row goes on as a mark at
    its nearest frame's time, which the frames of that time see.
    """
    both = frames.select("item_id", "at_ms", "change", F.col("at_ms").alias("frame")).unionByName(moments.select("item_id", "at_ms", F.lit(None).cast("long").alias("change"), F.lit(None).cast("long").alias("frame")))
    order = Window.partitionBy("item_id").orderBy("at_ms", F.col("frame").asc_nulls_last())
    before = F.last("frame", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("frame", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    met = dealt(both, "item_id").withColumns({"before": before, "after": after})
    earlier = F.col("after").isNull() | (F.col("at_ms") - F.col("before") <= F.col("after") - F.col("at_ms"))
    nearest = F.when(F.col("before").isNotNull() & earlier, F.col("before")).otherwise(F.col("after"))
    met = met.select("item_id", F.when(F.col("frame").isNull(), nearest).otherwise(F.col("at_ms")).alias("at_ms"), "change", "frame")
    marked = met.withColumn("near", F.max(F.col("frame").isNull()).over(Window.partitionBy("item_id", "at_ms")))
    return marked.where("frame is not null").select("item_id", "at_ms", "change", "near")


def batches(frames: DataFrame, size: int = BATCH, most: int = CALLS) -> DataFrame:
    """The frames that are looked at, with the number of their batch in time order: `most` batches at most."""
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("at_ms")) - 1
    return frames.withColumn("batch", F.floor(place / size).cast("long")).where(F.col("batch") < most)


def nearby(moments: DataFrame, segments: DataFrame, around_ms: int = AROUND_MS) -> DataFrame:
    """Segments that overlap the time around each moment (item_id, at_ms).

    Both are dealt to the pieces of time that they touch, so a moment meets the segments
    near it only; a pair counts in the first piece that both touch.
    """
    piece = lambda ms: F.floor(ms / (2 * around_ms)).cast("long")
    low, high = F.col("at_ms") - around_ms, F.col("at_ms") + around_ms
    asked = moments.withColumn("first", piece(low)).withColumn("piece", F.explode(F.sequence(F.col("first"), piece(high))))
    held = segments.withColumn("begins", piece(F.col("start_ms"))).withColumn("piece", F.explode(F.sequence(F.col("begins"), piece(F.greatest("start_ms", "end_ms")))))
    near = (F.col("start_ms") <= high) & (F.col("end_ms") >= low) & (F.col("piece") == F.greatest("first", "begins"))
    return asked.join(held, ["item_id", "piece"]).where(near).drop("piece", "first", "begins")
