"""The work queue as streams: metrics by window, leases with timers, state upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators.jobs import DAILY, SPACING, Turn
from folioflow.operators.state import upsert
from folioflow.schemas import LEASE_SECONDS
from folioflow.sources.catalog import Catalog
from folioflow.sources.scratch import ship


#: Versions that upsert_into keeps.
KEPT = 3


def hourly_status(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Job events by hour and type. An hour is given once the watermark has passed its end; events that come later than that are left out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counts = timed.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return counts.select(F.col("window.start").alias("hour"), "event_type", "n", "value")


def leases(events: DataFrame, seconds: int = LEASE_SECONDS, late: str = "0 seconds") -> DataFrame:
    """id, outcome of every lease: done, or expired when it ran out before the job was done.

    events: id, at (timestamp), kind ('claim', 'renew' or 'done'). A claim opens a lease
    or, where one is open, renews it; what comes after a lease's end finds none. One
    state for each job, with a timer at its lease's end; runs as long as jobs are open.
    A task sorts what a micro-batch has of one job: a source with maxFilesPerTrigger or the
    like bounds that.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "outcome": ["expired"]})
            return
        end = state.get[0] if state.exists else None
        for at, kind in sorted((r.at.value // 1_000_000, r.kind) for b in batches for r in b.itertuples()):
            if end is not None and at > end:
                yield pd.DataFrame({"id": [key[0]], "outcome": ["expired"]})
                end = None
            if kind == "done":
                if end is not None:
                    yield pd.DataFrame({"id": [key[0]], "outcome": ["done"]})
                end = None
            elif kind == "claim" or end is not None:
                end = at + seconds * 1000
        if end is None:
            if state.exists:
                state.remove()
        else:
            state.update((end,))
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    timed = events.withWatermark("at", late)
    return timed.groupBy("id").applyInPandasWithState(step, "id long, outcome string", "lease_end long", "append", "EventTimeTimeout")


def call_starts(requests: DataFrame, spacing: int = SPACING, cap: int = DAILY) -> DataFrame:
    """id, provider, at, starts (microseconds): jobs.schedule() of a stream of requests (id, provider, at, took_s).

    One state for each provider: its last start and end, and that day's calls. Requests of a
    micro-batch are taken in order of time; those of later ones wait behind them.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        turn = Turn(*state.get) if state.exists else Turn()
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        starts = [turn.next(at, took, spacing * 1_000_000, cap) for at, took in zip(rows["at"].tolist(), rows["took"].tolist(), strict=True)]
        state.update((turn.start, turn.end, turn.n))
        yield pd.DataFrame({"id": rows["id"], "provider": rows["provider"], "at": rows["at"], "starts": starts})

    ship(requests.sparkSession)
    kinds = dict(requests.dtypes)
    given = requests.where("at is not null and provider is not null").select("id", "provider", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), (F.coalesce("took_s", F.lit(0)) * 1_000_000).cast("long").alias("took"))
    out = f"id {kinds['id']}, provider {kinds['provider']}, at long, starts long"
    return given.groupBy("provider").applyInPandasWithState(step, out, "start long, end long, n long", "append", "NoTimeout")


def upsert_into(catalog: Catalog, table: str, key: str, by: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a table's last row of each key; a batch that runs twice changes nothing more.

    For tables of state as small as their keys, such as settings and heartbeats: each batch
    writes the table anew and forgets all versions but the last few.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        catalog.write(table, upsert(catalog.read(table), batch, key, by)).forget(table, KEPT)

    return write


def poll(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "1 second") -> StreamingQuery:
    """Hand each micro-batch to `handle`, one at a time, every so often; without `every`, all there is and then stop."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """All rows that a stream gives until its source is used up, from files in `path`, which executors share.

    Appended rows go to a Parquet sink, each once, though a run may be cut off and started
    again on the same path; complete results are written anew with each micro-batch, of which
    the last counts. Nothing passes through the driver.
    """
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    spark, rows = stream.sparkSession, f"{path}/rows"
    if mode == "append":
        writer.format("parquet").outputMode("append").start(rows).awaitTermination()
        return spark.read.schema(stream.schema).parquet(rows)
    last = [0]

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/epoch={epoch}")
        last[0] = epoch

    writer.outputMode(mode).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{rows}/epoch={last[0]}")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
