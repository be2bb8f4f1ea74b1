"""The work queue: what may run, claims, outcomes, leases, retries and caps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.schemas import HTML_BYTES, LEASE_SECONDS, LIVE_SECONDS
from folioflow.sources.scratch import ship


def runnable(jobs: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """Queued jobs that are due and whose item isn't paused or canceled."""
    due = (F.col("status") == "queued") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    active = items.where(~F.col("status").isin("paused", "canceled")).select(F.col("id").alias("item_id"))
    return jobs.where(due).join(active, "item_id", "left_semi")


def next_jobs(jobs: DataFrame, items: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The n oldest runnable jobs."""
    return runnable(jobs, items, now).orderBy("created_at", "id").limit(n)


def claim(job: DataFrame, now: Column) -> DataFrame:
    """The job as claimed: running, leased, one attempt more; and its item's new status."""
    return job.withColumns(
        {
            "status": F.lit("running"),
            "attempt": F.col("attempt") + 1,
            "lease_expires_at": now + F.make_dt_interval(secs=F.lit(LEASE_SECONDS)),
            "item_status": F.when(F.col("stage") == "acquire", "downloading").otherwise("analyzing"),
        }
    )


# What an item is told after a job.
NO_KEY = "Cloud analysis is waiting for the selected provider key in Settings."
FALLBACK = "The source needs local-file fallback or a browser session before it can be downloaded."
TOO_LARGE = "This page is larger than the 5 MiB HTML limit."
GONE = "Source item no longer exists."


def stage_outcome(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """id, status, item_status and message after a job; sources: id, source_url, readable, bytes.

    Later stages wait for a key, items without a source are ready, pages that can't be
    read or are larger than HTML_BYTES need review. The job is done, whatever came out;
    where the item is gone, it failed.
    """
    later, none = F.col("stage") != "acquire", F.col("source_url").isNull()
    large = F.col("bytes") > HTML_BYTES
    status = F.when(later, "waiting_for_key").when(none, "ready").when(large, "needs_review").when(F.col("readable"), "ready").otherwise("needs_review")
    message = F.when(later, NO_KEY).when(none, None).when(large, TOO_LARGE).when(~F.coalesce("readable", F.lit(False)), FALLBACK)
    known = sources.withColumnRenamed("id", "item_id").withColumn("there", F.lit(True))
    joined = jobs.join(known, "item_id", "left")
    return joined.select(
        "id", F.when(F.col("there"), "done").otherwise("failed").alias("status"), F.when(F.col("there"), status).alias("item_status"), F.when(F.col("there"), message).otherwise(GONE).alias("message")
    )


def flagged(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Jobs with what was asked for their items (item_id, request: pause, resume or cancel, at), the last request of each."""
    last = requests.groupBy("item_id").agg(F.max_by("request", "at").alias("request"))
    joined = jobs.join(last, "item_id", "left")
    return joined.withColumns({"pause_requested": F.coalesce(F.col("request") == "pause", F.lit(False)), "cancel_requested": F.coalesce(F.col("request") == "cancel", F.lit(False))}).drop("request")


def between_stages(jobs: DataFrame) -> DataFrame:
    """Flagged jobs as they go on: id, status, item_status (null: as it was).

    A pause lets the running stage finish and then holds the item; a cancel ends queued
    and running jobs. Jobs that are over stay as they are.
    """
    open_ = F.col("status").isin("queued", "running")
    cancel, pause = open_ & F.col("cancel_requested"), (F.col("status") == "queued") & F.col("pause_requested")
    return jobs.select("id", F.when(cancel, "canceled").otherwise(F.col("status")).alias("status"), F.when(cancel, "canceled").when(pause, "paused").alias("item_status"))


def expired(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease is over, as queued again."""
    return jobs.where((F.col("status") == "running") & (F.col("lease_expires_at") < now)).withColumns({"status": F.lit("queued"), "lease_expires_at": F.lit(None).cast("timestamp_ntz")})


def retry_seconds(error: Column, attempt: Column, retry_after: Column) -> Column:
    """Seconds until a failed call is tried again; null: not by itself.

    429: what the server asks, a day at most, else 15 and then 60 minutes; 5xx: 30, 120,
    600 s; refused keys wait for the user.
    """
    return (
        F.when((error == "429") & retry_after.isNotNull(), F.least(retry_after, F.lit(86_400)))
        .when((error == "429") & (attempt == 0), 900)
        .when((error == "429") & (attempt == 1), 3600)
        .when((error == "5xx") & (attempt == 0), 30)
        .when((error == "5xx") & (attempt == 1), 120)
        .when((error == "5xx") & (attempt == 2), 600)
    ).cast("long")


def daily_calls(calls: DataFrame, cap: int) -> DataFrame:
    """Calls by UTC day and whether the cap is reached."""
    return calls.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("calls")).withColumn("capped", F.col("calls") >= cap)


def too_close(calls: DataFrame, seconds: int = 15) -> DataFrame:
    """Calls that start sooner than allowed after the one before on the same day."""
    before = F.lag("created_at").over(Window.partitionBy(F.to_date("created_at")).orderBy("created_at", "id"))
    gap = (F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1_000_000
    return calls.withColumn("gap_s", gap).where(F.col("gap_s") < seconds).select("id", F.round("gap_s", 6).alias("gap_s"))


def liveness(beats: DataFrame, now: Column) -> DataFrame:
    """Workers (key worker) and whether their last heartbeat is young enough."""
    last = beats.groupBy("worker").agg(F.max("ts").alias("last_seen"))
    return last.withColumn("online", F.col("last_seen") > now - F.make_dt_interval(secs=F.lit(LIVE_SECONDS)))


def uncached(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """Stage inputs without a stored result of the same input hash, model and prompt version."""
    keys = ["item_id", "stage", "input_hash", "model", "prompt_version"]
    return wanted.join(results.select(keys).distinct(), keys, "left_anti")


# Seconds between the starts of calls, calls of a provider in a UTC day.
SPACING, DAILY = 15, 30


class Turn:
    """Where a provider's schedule stands: its last start and end (microseconds), and the calls started on that UTC day."""

    DAY = 86_400_000_000

    def __init__(self, start: int = 0, end: int = 0, n: int = 0):
        self.start, self.end, self.n = start, end, n

    def next(self, at: int, took: int, spacing: int, cap: int) -> int:
        """The start of a call that was asked for at this time and takes so long: one at a time, spaced, the rest of a full day on the next."""
        if self.n:
            at = max(at, self.start + spacing, self.end)
            if at // self.DAY == self.start // self.DAY and self.n >= cap:
                at = (at // self.DAY + 1) * self.DAY
        self.n = self.n + 1 if self.n and at // self.DAY == self.start // self.DAY else 1
        self.start, self.end = at, at + took
        return at


def schedule(requests: DataFrame, spacing: int = SPACING, cap: int = DAILY) -> DataFrame:
    """id, provider, at, starts of requests (id, provider, at, took_s): when each call may start.

    A provider makes one call at a time, starts are `spacing` seconds apart, and at most `cap`
    are on one UTC day; what doesn't fit waits, first come first served (ties by id). A null
    took_s is none. Each start depends on the one before, so a provider's requests are one
    after another in one task; they stream by in sorted order with a state of three numbers,
    and are never held. Requests without a time or a provider are left out.
    """
    ship(requests.sparkSession)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    given = requests.where("at is not null and provider is not null").select("id", "provider", micros("at").alias("at"), (F.coalesce("took_s", F.lit(0)) * 1_000_000).cast("long").alias("took"))
    ordered = given.repartition("provider").sortWithinPartitions("provider", "at", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider, turn = None, Turn()
        for rows in batches:
            starts = []
            for of, at, took in zip(rows["provider"].tolist(), rows["at"].tolist(), rows["took"].tolist(), strict=True):
                if of != provider:
                    provider, turn = of, Turn()
                starts.append(turn.next(at, took, spacing * 1_000_000, cap))
            yield pd.DataFrame({"id": rows["id"], "provider": rows["provider"], "at": rows["at"], "starts": starts})

    kinds = dict(ordered.dtypes)
    out = ordered.mapInPandas(run, f"id {kinds['id']}, provider {kinds['provider']}, at long, starts long")
    return out.withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("at", "starts")})
