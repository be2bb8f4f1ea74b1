"""Streaming queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import ingest
from folioflow.plans import core
from folioflow.sources.catalog import Catalog
from folioflow.sources.scratch import new_dir
from folioflow.streaming import imports, queue


def stream_hourly_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured Streaming over the events, hour by hour; complete mode, so all rows count."""
    hourly = queue.hourly_status(queue.event_stream(spark, sf_dir))
    return queue.drained(hourly, new_dir(spark), "complete").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def stream_closed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hours that the watermark has closed: all that end ten minutes before the last event or sooner."""
    hourly = queue.hourly_status(queue.event_stream(spark, sf_dir))
    return queue.drained(hourly, new_dir(spark)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def stream_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as claims of their user's job and sign-ups and purchases as its end, a lease of an hour."""
    events = queue.event_stream(spark, sf_dir)
    kind = F.when(F.col("event_type") == "click", "claim").when(F.col("event_type").isin("signup", "purchase"), "done")
    timed = events.select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind")).where("kind is not null")
    return queue.drained(queue.leases(timed, 3600), new_dir(spark)).groupBy("id", "outcome").agg(F.count("*").alias("n"))


def stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event type of every user, kept in a catalog's settings by a polled stream, read from the catalog opened again."""
    path = new_dir(spark)
    last = queue.event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.struct("ts", "event_id", "event_type").alias("e"))

    def last_of(batch: DataFrame, epoch: int) -> None:
        newest = batch.groupBy("key").agg(F.max("e").alias("e")).select("key", F.col("e.event_type").alias("value"), F.col("e.ts").cast("timestamp").alias("updated_at"))
        queue.upsert_into(Catalog(spark, f"{path}/catalog"), "settings", "key", "updated_at")(newest, epoch)

    queue.poll(last, last_of, f"{path}/checkpoint", every=None).awaitTermination()
    return Catalog(spark, f"{path}/catalog").read("settings").select("key", "value")


def stream_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links in three batches, the stream ended and started again between them; what the library had is its first state."""
    session = spark.newSession()  # its own setting of the state store
    session.conf.set(*imports.PROVIDER)
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    path, links = new_dir(spark), core.all_links(session, sf_dir)
    last = links.agg(F.max("place")).first()[0] or 0
    known = ingest.admit(links).where("abs(place) % 9 = 1 and canonical_url is not null")
    known = known.select(ingest.dedup_key(F.col("platform"), F.col("platform_id"), F.col("canonical_url")).alias("key"))
    for k, part in enumerate(("place < 0", f"place >= 0 and place < {last // 2}", f"place >= {last // 2}")):
        links.where(part).write.parquet(f"{path}/in/batch{k}")
        stream = session.readStream.schema(links.schema).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        done = queue.drained(imports.outcomes(ingest.admit(stream), known), f"{path}/out")
    return done


def stream_call_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the calls that the events ask for may start, from per-provider state."""
    events = queue.event_stream(spark, sf_dir).select(F.col("event_id").alias("id"), (F.col("user_id") % 40).alias("provider"), F.col("ts").alias("at"), (F.col("event_id") % 40).alias("took_s"))
    return queue.drained(queue.call_starts(events), new_dir(spark)).withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("at", "starts")})


QUERIES = {"stream_closed_hours": stream_closed_hours, "stream_imports": stream_imports, "stream_call_starts": stream_call_starts, "stream_hourly_status": stream_hourly_status, "stream_leases": stream_leases, "stream_upserts": stream_upserts}
ORACLE_SQL = {
    "stream_imports": core.ORACLE_SQL["dedup_against_existing"],
    "stream_call_starts": core.CALLS_SQL,
    "stream_closed_hours": """SELECT hour, event_type, n, value FROM (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2)
        WHERE hour + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE""",
    "stream_hourly_status": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "stream_leases": """
        WITH e AS (SELECT user_id AS id, ts, CASE WHEN event_type = 'click' THEN 'claim' ELSE 'done' END AS kind FROM events WHERE event_type IN ('click', 'signup', 'purchase')),
        n AS (SELECT *, lead(ts) OVER w AS next_ts, lead(kind) OVER w AS next_kind FROM e WINDOW w AS (PARTITION BY id ORDER BY ts, kind)),
        -- a claim ends by what comes next within the hour, or by the clock if the stream goes on that long
        ended AS (SELECT id, CASE WHEN next_ts <= ts + INTERVAL 1 HOUR THEN next_kind ELSE 'expired' END AS outcome FROM n
                  WHERE kind = 'claim' AND (next_ts IS NOT NULL OR ts + INTERVAL 1 HOUR < (SELECT max(ts) FROM e)))
        SELECT id, outcome, count(*) AS n FROM ended WHERE outcome <> 'claim' GROUP BY 1, 2
    """,
    "stream_upserts": "SELECT user_id::VARCHAR AS key, arg_max(event_type, (ts, event_id)) AS value FROM events GROUP BY 1",
}
