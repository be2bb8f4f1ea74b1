"""Near-duplicate detection with SetSketch registers.

A document's distinct word shingles set its registers: every shingle sends points of
a Poisson process to random registers, a register keeps its least point, and the
minima are rounded down on an exponential scale and truncated (SetSketch, Ertl 2021).
Registers of a union are the registers' maxima, so sketches merge; registers of
similar sets agree often, so bands of them find candidates. A candidate pair's
likeness is estimated from all registers and both set sizes by maximum likelihood;
pairs within a margin of the threshold are then verified on the full sets.

Links are found without all pairs of a group. Equal sets are one class, so copies
never meet each other. In each bucket of a band every member first meets the one of
smallest id only. Where a large bucket's members still fall into several components, it
elects further leaders, round by round, that meet the members outside their component.
What is then still apart is mostly shown by its shingles alone to have no link: those
that one member alone has, or in large buckets members of one component alone, can't be
shared across, and a set with more than the allowed share of them is set aside. The rest meets across components in blocks
of bounded size, so that no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import textbytes as tb
from folioflow.llm.components import components
from folioflow.llm.skew import look_up, parted, summed_up
from folioflow.llm.storage import freeing, written

U = np.uint64
#: Registers, their scale's base, rate and largest value; bands and registers in each.
REGISTERS, BASE, RATE, TOP = 256, 1.02, 20.0, 65534
BANDS, BAND = 32, 4
#: How far below the threshold an estimate may fall for its pair to be verified (four standard errors).
MARGIN = 0.1
#: Members of a bucket that meet in one task at most; members from which on a bucket is large; rounds of further leaders in large ones.
BLOCK, WIDE, ROUNDS = 512, 4096, 8
CHUNK = 1 << 21


def sketch(hashes: np.ndarray, first: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The registers of each document's set of 64-bit hashes; zeros for an empty set."""
    n = len(first) - 1
    lowest = np.full(n * registers, np.inf)
    owner, place, step = tb.owners(first), np.zeros(len(hashes)), 0
    limit = np.full(n, np.inf)
    while len(hashes):
        step += 1
        with np.errstate(over="ignore"):
            draw = tb.mix(hashes + U(step) * U(tb._STEP))
        place = place - np.log(((draw >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)
        at = owner * registers + ((tb.mix(draw) >> U(32)) * U(registers) >> U(32)).astype(np.int64)
        np.minimum.at(lowest, at, place)
        if step < 8 or step % 8 == 0:
            limit = lowest.reshape(n, registers).max(1)
            on = place <= limit[owner]
            hashes, owner, place = hashes[on], owner[on], place[on]
    with np.errstate(divide="ignore"):
        value = np.floor(1 - np.log(lowest / registers / RATE) / np.log(BASE))
    return np.clip(np.where(np.isinf(lowest), 0, value), 0, TOP).astype(np.uint16).reshape(n, registers)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of the sets of a and b."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard likeness of each pair of sets, from registers and set sizes."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    share = size_a / np.maximum(size_a + size_b, 1)
    grid = np.linspace(0, 1, 101)
    with np.errstate(divide="ignore", invalid="ignore"):
        most = np.minimum(size_a, size_b) / np.maximum(np.maximum(size_a, size_b), 1)
        likeness = grid[None, :] * most[:, None]

        def chance(x: np.ndarray) -> np.ndarray:
            return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

        up = np.clip(chance(share[:, None] - (1 - share[:, None]) * likeness), 1e-12, 1)
        down = np.clip(chance(1 - share[:, None] - share[:, None] * likeness), 1e-12, 1)
        same = np.clip(1 - up - down, 1e-12, 1)
    equal = a.shape[1] - above - below
    log = above[:, None] * np.log(up) + below[:, None] * np.log(down) + equal[:, None] * np.log(same)
    return likeness[np.arange(len(likeness)), log.argmax(1)]


def _bands(registers: np.ndarray) -> np.ndarray:
    out = np.zeros((len(registers), BANDS), U)
    with np.errstate(over="ignore"):
        for k in range(BAND):
            out = tb.mix(out * U(3) + registers[:, k * BANDS : (k + 1) * BANDS].astype(U) + U(1))
        return tb.mix(out + np.arange(1, BANDS + 1, dtype=U) * U(tb._STEP)).view(np.int64)


def _shingles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for low, high, data, offsets in tb.chunks(batch.column("text"), CHUNK):
            yield batch.slice(low, high - low), *tb.shingle_sets(*tb.word_hashes(data, offsets), k)


def sketches(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (distinct shingles), set_a and set_b (128 bits that stand for the set), registers."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hashes, first in _shingles(batches, words):
            registers = sketch(hashes, first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(first)), *_set_hashes(hashes, first), pa.array([r.tobytes() for r in registers], pa.binary())],
                ["id", "n", "set_a", "set_b", "registers"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(freeing(run), f"id {kind}, n bigint, set_a bigint, set_b bigint, registers binary")


def _set_hashes(hashes: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """128 bits that stand for each set."""
    return [pa.array(tb.sums(tb.mix(hashes ^ U(c)), first).view(np.int64)) for c in (tb._STEP, tb._BASE)]


def shingle_arrays(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, set_a, set_b, shingles: the full set of each document as sorted hashes."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hashes, first in _shingles(batches, words):
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *_set_hashes(hashes, first), lists], ["id", "set_a", "set_b", "shingles"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(freeing(run), f"id {kind}, set_a bigint, set_b bigint, shingles array<bigint>")


def _buckets(classes: DataFrame) -> DataFrame:
    """id, bucket: a row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = _bands(_registers(batch.column("registers").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.repeat(np.arange(len(bands)), bands.shape[1]))), pa.array(bands.ravel())], ["id", "bucket"])

    return classes.select("id", "registers").mapInArrow(freeing(run), f"id {dict(classes.dtypes)['id']}, bucket bigint")


def _registers(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint16).reshape(-1, REGISTERS)


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (id, other) whose set sizes allow a link and whose estimate comes near it; other may have any number of pairs."""
    # sizes first, registers for what they leave
    sizes = [classes.select(F.col("id").alias(c), F.col("n").alias(n)) for c, n in (("id", "n_a"), ("other", "n_b"))]
    fit = look_up(pairs, sizes[1], "other", by="id").join(sizes[0].hint("merge"), "id").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    fit = written(fit.select("id", "other", "n_a", "n_b"), "fit")
    a, b = (classes.select(F.col("id").alias(c), F.col("registers").alias(r)) for c, r in (("id", "reg_a"), ("other", "reg_b")))
    near = look_up(fit.join(a.hint("merge"), "id"), b, "other", by="id", among=fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 2000):
                part = batch.slice(low, 2000)
                n = [part.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b")]
                guess = estimate(*(_registers(part.column(c).to_pylist()) for c in ("reg_a", "reg_b")), *n)
                yield part.select(["id", "other"]).filter(pa.array(guess >= percent / 100 - MARGIN))

    kind = dict(classes.dtypes)["id"]
    return near.select("id", "other", "n_a", "n_b", "reg_a", "reg_b").mapInArrow(freeing(run), f"id {kind}, other {kind}")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (id, other) of likeness at least percent / 100, on their full sets; other may have any number of pairs."""
    a = sets.select("id", F.col("shingles").alias("a"))
    b = sets.select(F.col("id").alias("other"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return look_up(pairs.join(a.hint("merge"), "id"), b, "other", by="id", among=pairs).where(100 * both >= percent * (F.size("a") + F.size("b") - both)).select("id", "other")


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (id, other) between members of a bucket in different components.

    A bucket's members are dealt to blocks, and each pair of blocks meets in a task of
    its own, so no task has more than two blocks. There the sizes, the shingles that
    other components have too (common) and the registers leave few pairs; the sets of
    just their members are fetched, once a meeting, and compared. A pair that shares
    several buckets is met in one of them, the first by band.
    """
    dealt = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).drop("low", "size")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("with", meets).withColumns({"low": F.least("own", "with"), "high": F.greatest("own", "with")})
    kind, meeting = dict(members.dtypes)["id"], ["bucket", "low", "high"]

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        registers, n, common = _registers(rows["registers"].tolist()), rows["n"].to_numpy(np.int64), rows["common"].to_numpy(np.int64)
        bands, component, own = _bands(registers), rows["component"].to_numpy(), rows["own"].to_numpy()
        ids, bucket, found, needed = rows["id"].to_numpy(), rows["bucket"].iloc[0], {}, set()
        same_block = rows["low"].iloc[0] == rows["high"].iloc[0]
        for i in range(len(ids)):
            most = np.minimum(common, common[i])  # members of two components share no shingle that only one of them has
            ok = (component != component[i]) & (ids > ids[i]) & (100 * most >= percent * (n + n[i] - most))
            if not same_block:
                ok &= own != own[i]
            at = np.flatnonzero(ok)
            if len(at):
                shared = bands[at] == bands[i]
                at = at[bands[i][shared.argmax(1)] == bucket]
            if len(at):
                # the share of equal registers is an estimate of its own, coarser but cheap
                at = at[(registers[at] == registers[i]).mean(1) >= percent / 100 - MARGIN - 0.05]
            if len(at):
                guess = estimate(registers[at], np.repeat(registers[i : i + 1], len(at), 0), n[at], np.full(len(at), n[i]))
                at = at[guess >= percent / 100 - MARGIN]
            if len(at):
                found[i] = ids[at].tolist()
                needed |= {i, *at.tolist()}
        low, high = rows["low"].iloc[0], rows["high"].iloc[0]
        return pd.DataFrame([(bucket, low, high, ids[i], found.get(i, [])) for i in sorted(needed)], columns=[*meeting, "id", "others"])

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        held = dict(zip(rows["id"], rows["shingles"], strict=True))
        links = []
        for i, others in zip(rows["id"], rows["others"], strict=True):
            for j in others:
                both = len(np.intersect1d(held[i], held[j], assume_unique=True))
                if 100 * both >= percent * (len(held[i]) + len(held[j]) - both):
                    links.append((i, j))
        return pd.DataFrame(links, columns=["id", "other"])

    given = dealt.select(*meeting, "id", "component", "n", "common", "registers", "own")
    # little data but much work in each group: more tasks than its bytes alone would give
    parts = 4 * int(given.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = given.repartition(parts, *meeting).groupBy(*meeting).applyInPandas(meet, f"bucket bigint, low int, high int, id {kind}, others array<{kind}>")
    near = written(near, "near").join(sets, "id").select(*meeting, "id", "others", "shingles")
    return near.repartition(parts, *meeting).groupBy(*meeting).applyInPandas(compare, f"id {kind}, other {kind}")


def link(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id it is linked with, itself included).

    Documents are linked if the Jaccard likeness of their sets of distinct shingles of
    so many words (A-Z lower-cased; a text of fewer words is one shingle) is at least
    percent / 100, and through others. Texts without words, null or empty, are linked
    with nothing, nor are rows with a null id, whose component is null. Rows that
    repeat an id count once and each get the component of their own text; where their
    texts differ, the one whose set has the smallest hash stands for the id, and one that
    no other id has is linked with nothing. A text of any length is read whole; columns
    beside id and text, of whatever name, don't matter; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(docs.dtypes)["id"]
    rows = written(sketches(docs, words, "id"), "sketches")
    full = _one_set_each(rows.where("n > 0 and id is not null"))
    classes = written(
        full.groupBy("set_a", "set_b").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("registers").alias("registers")), "classes"
    )
    shared = written(summed_up(_buckets(classes), "bucket", "id", {"other": (F.min("id"), F.min), "size": (F.count("*"), F.sum)}, F.col("size") > 1).drop("size"), "shared")
    links = _linked(shared.select("id", "other"), classes, docs, words, percent)
    found = components(links)
    known = shared.select("id", "bucket").join(classes.select("id", "n"), "id")
    apart = _apart(known, found)
    for turn in range(ROUNDS):
        large = apart.where(F.col("size") > WIDE)
        if large.isEmpty():
            break
        # a member outside the first component leads, another in each round
        candidate = F.when(F.col("component") != F.col("low"), F.struct(F.xxhash64(F.lit(turn), "id").alias("h"), F.col("id"), F.col("component")))
        led = summed_up(large, "bucket", "id", {"leader": (F.min(candidate), F.min)}, F.col("leader").isNotNull())
        new = _linked(led.where(F.col("component") != F.col("leader.component")).select("id", F.col("leader.id").alias("other")), classes, docs, words, percent)
        if new.isEmpty():
            break
        links = links.unionByName(new)
        found = components(links)
        apart = _apart(apart.select("id", "bucket", "n"), found)
    if not apart.isEmpty():
        sets = written(_sets_of(docs, apart.select("id").distinct(), words), "sets")
        # shingles that one member alone has, in all buckets
        alone = sets.select("id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("id").alias("id"), F.count("*").alias("holders")).where("holders = 1")
        able = _able(apart, alone.groupBy("id").agg(F.count("*").alias("own")), found, percent)
        # in large ones, those that one component alone has
        wide = able.where(F.col("size") > WIDE)
        if not wide.isEmpty():
            shingles = sets.join(wide.select("id", "component").distinct(), "id").select("id", "component", F.explode("shingles").alias("shingle"))
            within = shingles.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low = high").select("shingle")
            own = shingles.join(within, "shingle").groupBy("id").agg(F.count("*").alias("own"))
            able = able.where(F.col("size") <= WIDE).unionByName(_able(wide, own, found, percent))
        able = able.join(classes.select("id", "registers"), "id")
        found = components(links.unionByName(written(_across(able, sets, percent), "links")))
    named = classes.select("set_a", "set_b", F.col("id").alias("class")).join(found.withColumnRenamed("id", "class"), "class", "left")
    named = named.select("set_a", "set_b", F.coalesce("component", "class").alias("component"))
    out = look_up(rows.select("id", "n", "set_a", "set_b"), named, "set_a", "set_b", by="id", how="left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"))


def _one_set_each(full: DataFrame) -> DataFrame:
    """The rows without those of ids that have several sets, but for each such id's set of smallest hash."""
    of_id = full.groupBy("id").agg(F.min(F.struct("set_a", "set_b")).alias("least"), F.max(F.struct("set_a", "set_b")).alias("most"))
    several = written(of_id.where("least <> most").select("id", "least"), "several")
    if several.isEmpty():
        return full
    return look_up(full, several, "id", by="set_a", how="left").where("least is null or (least.set_a = set_a and least.set_b = set_b)").drop("least")


def _linked(met: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The links among pairs (id, other) of members and leaders that met."""
    pairs = written(_likely(met.where("id <> other").distinct(), classes, percent), "pairs")
    wanted = pairs.select("id").union(pairs.select("other")).distinct()
    return written(_verified(pairs, written(_sets_of(docs, wanted, words), "pair_sets"), percent), "links")


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id, shingles: the full sets of the documents wanted; of an id's several sets that of smallest hash."""
    # texts that aren't wanted aren't shuffled
    arrays = shingle_arrays(parted(docs, written(wanted, "wanted"), "id")[1], words, "id").where(F.size("shingles") > 0)
    return arrays.groupBy("id").agg(F.min_by("shingles", F.struct("set_a", "set_b")).alias("shingles"))


def _able(members: DataFrame, own: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The members, as of _apart, that can be linked across components of their bucket, with common: shingles less those counted in own (id, own), which no other component has."""
    counted = members.join(own, "id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    # two sets of n and m share n - own shingles at most, and the other's own ones come on top
    counted = summed_up(counted, "bucket", "id", {"fewest": (F.min("own"), F.min)}, F.lit(True)).withColumn("common", F.col("n") - F.col("own"))
    left = counted.where(100 * F.col("common") >= percent * (F.col("n") + F.col("fewest")))
    # members set aside can leave a bucket with one component; written, as the summaries there read it twice
    return _apart(written(left.select("id", "bucket", "n", "common"), "left"), found)


def _apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members (id, bucket, ...) of the buckets that have several components, with component, low and size."""
    known = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    ends = {"low": (F.min("component"), F.min), "high": (F.max("component"), F.max), "size": (F.count("*"), F.sum)}
    return written(summed_up(known, "bucket", "id", ends, F.col("low") != F.col("high")).drop("high"), "apart")
