from datetime import datetime, timedelta

from folioflow.operators import ingest
from folioflow.sources.catalog import Catalog
from folioflow.streaming import imports, queue


def test_leases_end_by_done_or_by_timer(spark, tmp_path):
    start, schema = datetime(2024, 1, 1), "id long, at timestamp, kind string"
    at = lambda s: start + timedelta(seconds=s)
    for k, rows in enumerate([[(1, at(0), "claim"), (2, at(0), "claim"), (3, at(0), "claim")], [(1, at(30), "done"), (3, at(50), "renew")], [(9, at(100), "claim")], [(3, at(105), "done"), (9, at(400), "done")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = {(r.id, r.outcome) for r in queue.drained(queue.leases(stream), str(tmp_path / "out")).collect()}
    assert {(1, "done"), (2, "expired"), (3, "done"), (9, "expired")} == got


def test_upserts_survive_a_restart(spark, tmp_path):
    schema = "key string, value string, updated_at timestamp"
    spark.createDataFrame([("beat", "1", datetime(2024, 1, 1)), ("mode", "x", datetime(2024, 1, 1))], schema).write.parquet(f"{tmp_path}/in")

    def run():
        write = queue.upsert_into(Catalog(spark, f"{tmp_path}/db"), "settings", "key", "updated_at")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        queue.poll(stream, write, f"{tmp_path}/check", every=None).awaitTermination()
        return sorted((r.key, r.value) for r in Catalog(spark, f"{tmp_path}/db").read("settings").collect())

    assert run() == [("beat", "1"), ("mode", "x")]
    spark.createDataFrame([("beat", "2", datetime(2024, 1, 2))], schema).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == run() == [("beat", "2"), ("mode", "x")]


def test_a_lease_that_ran_out_is_not_done_later(spark, tmp_path):
    start, schema = datetime(2024, 1, 1), "id long, at timestamp, kind string"
    rows = [(1, 0, "claim"), (1, 100, "done"), (1, 200, "claim"), (1, 210, "renew"), (1, 265, "done"), (2, 0, "done"), (3, 900, "claim")]
    spark.createDataFrame([(i, start + timedelta(seconds=s), k) for i, s, k in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = queue.drained(queue.leases(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), str(tmp_path / "out")).collect()
    assert sorted((r.id, r.outcome) for r in got) == [(1, "done"), (1, "expired")]


def test_late_events_are_left_out_and_hours_close(spark, tmp_path):
    schema, start = "ts timestamp, event_type string, value double", datetime(2024, 1, 1)
    batches = [[(0, "a"), (50, "a")], [(130, "b")], [(125, "a")], [(30, "a")], [(400, "a")]]  # minutes; the fourth is late
    for k, rows in enumerate(batches):
        spark.createDataFrame([(start + timedelta(minutes=m), e, 1.0) for m, e in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = {(r.hour.hour, r.event_type): r.n for r in queue.drained(queue.hourly_status(stream), str(tmp_path / "out")).collect()}
    assert got == {(0, "a"): 2, (2, "b"): 1, (2, "a"): 1}


def test_imports_across_batches_and_restarts(spark, tmp_path):
    session = spark.newSession()
    session.conf.set(*imports.PROVIDER)
    known = session.createDataFrame([("https://example.com/known",)], "key string")
    url = "https://example.com/{}".format
    batches = [[(0, url("a")), (1, url("a?utm_source=x")), (2, url("known"))], [(3, url("b")), (4, url("a")), (5, "http://localhost/")], [(6, url("b")), (7, url("c")), (8, url("c")), (9, None)]]
    for k, rows in enumerate(batches):
        session.createDataFrame(rows, "place long, url string").write.parquet(f"{tmp_path}/in/part{k}")
        stream = session.readStream.schema("place long, url string").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        done = queue.drained(imports.outcomes(ingest.admit(stream), known), str(tmp_path / "out"))
    got = {r.place: r.outcome for r in done.collect()}
    assert [got[k] for k in range(10)] == ["created", "existing", "existing", "created", "existing", "rejected", "existing", "created", "existing", "rejected"]


def test_call_starts_wait_across_batches(spark, tmp_path):
    schema, start = "id long, provider string, at timestamp, took_s long", datetime(2024, 1, 1)
    for k, rows in enumerate([[(1, "p", 0), (2, "q", 0)], [(3, "p", 3), (4, "p", 1)], [(5, "q", 100)]]):
        spark.createDataFrame([(i, p, start + timedelta(seconds=s), 20 if i == 4 else None) for i, p, s in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = {r.id: r.starts / 1e6 - start.timestamp() for r in queue.drained(queue.call_starts(stream), str(tmp_path / "out")).collect()}
    assert got == {1: 0, 2: 0, 4: 15, 3: 35, 5: 100}
