"""Streaming results equal their batch twins."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarrymark.operators import transcripts as tr
from quarrymark.plans.state_queries import chunk_stream, utterance_ends
from quarrymark.streaming import chunks as st
from quarrymark.streaming import sinks


def run(query, spark, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name)


def feed_of(batch, ends):
    start = F.lit("2026-01-01 00:00:00").cast("timestamp")
    at = lambda c: F.timestamp_millis(F.unix_millis(start) + c)
    rows = batch.select(
        "session", "utterance", F.lit("chunk").alias("kind"), "seq", F.col("idx").cast("int").alias("idx"), "text", at(F.lit(0)).alias("ts")
    )
    stops = ends.select(
        "session", "utterance", F.lit("end").alias("kind"), F.col("end_seq").alias("seq"), F.lit(None).cast("int").alias("idx"),
        F.lit(None).cast("string").alias("text"), at(F.lit(0)).alias("ts"),
    )
    return rows.unionByName(stops)


def test_chunk_fold_equals_batch(spark, tables, tmp_path):
    batch, ends = chunk_stream(tables), utterance_ends(tables)
    feed_of(batch, ends).write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(st.FEED).parquet(str(tmp_path / "feed"))
    got = run(st.fold(stream), spark, "folded").where("status NOT LIKE 'finalized%'").select("session", "utterance", "seq", "idx", "status")
    want = tr.statuses(batch, ends).select("session", "utterance", "seq", "idx", "status")
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


T0 = datetime(2026, 1, 1)


def test_silence_ends_an_utterance_and_late_rows_are_visible(spark, tmp_path):
    def rows(*xs):
        return spark.createDataFrame([(1, 1, k, s, i, x, T0 + timedelta(seconds=t)) for k, s, i, x, t in xs], st.FEED)

    folder = str(tmp_path / "feed")
    rows(("chunk", 0, 0, "a", 0), ("chunk", 1, 1, "b", 1)).coalesce(1).write.mode("append").parquet(folder)
    other = spark.createDataFrame([(9, 9, "chunk", 0, 0, "z", T0 + timedelta(seconds=60))], st.FEED)
    stream = spark.readStream.schema(st.FEED).option("maxFilesPerTrigger", 1).parquet(folder)
    q = st.fold(stream).writeStream.format("memory").queryName("silence").outputMode("append").start()
    try:
        q.processAllAvailable()
        other.coalesce(1).write.mode("append").parquet(folder)
        q.processAllAvailable()
        rows(("chunk", 2, 2, "c", 61)).coalesce(1).write.mode("append").parquet(folder)
        q.processAllAvailable()
        got = {(r.session, r.seq, r.status) for r in spark.table("silence").collect()}
    finally:
        q.stop()
    assert (1, None, "finalized_by_silence") in got
    assert (1, 2, "rejected_finalized") in got
    assert (1, 0, "accepted") in got and (1, 1, "accepted") in got


def test_ordered_release(spark, tmp_path):
    schema = "stream long, seq long, item string, ts timestamp"
    data = [(1, 0, "a", 0), (1, 2, "c", 100), (1, 1, "b", 200), (1, 1, "b", 300), (1, 5, "f", 400), (1, 6, "g", 5000)]
    spark.createDataFrame([(s, q, i, T0 + timedelta(milliseconds=t)) for s, q, i, t in data], schema).write.parquet(str(tmp_path / "in"))
    got = run(st.ordered_release(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), spark, "released").collect()
    assert [(r.seq, r.status) for r in got if r.status == "released"] == [(0, "released"), (1, "released"), (2, "released"), (5, "released"), (6, "released")]
    assert [(r.seq, r.last) for r in got if r.status == "skipped"] == [(3, 4)]
    assert [r.seq for r in got if r.status == "duplicate"] == [1]


def test_sessions_equal_batch_for_closed_windows(spark, tables, tmp_path):
    events = tables.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "ev"))
    got = run(st.sessions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))), spark, "sess")
    batch = events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    want = batch.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")
    closed = got.count()
    assert 0 < closed <= want.count()
    assert got.exceptAll(want).count() == 0
    limit = events.agg(F.max("ts") - F.expr("INTERVAL 10 MINUTES")).first()[0]
    assert closed == want.where(F.col("end") <= F.lit(limit)).count()


def test_results_of_old_versions_are_discarded(spark, tmp_path):
    results = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("c", 1, "w")], "key string, version int, value string")
    expected = spark.createDataFrame([("a", 2), ("b", 1)], "key string, current int")
    verdicts = {(r.key, r.version): r.verdict for r in sinks.judge_results(results, expected).collect()}
    assert verdicts == {("a", 1): "discarded", ("a", 2): "applied", ("b", 1): "applied", ("c", 1): "discarded"}
    for _ in range(2):  # a replayed epoch replaces itself
        sinks.write_epoch(results, 0, str(tmp_path / "state"))
    sinks.write_epoch(results.where("key = 'a' AND version = 2").withColumn("version", F.lit(3)), 1, str(tmp_path / "state"))
    state = {r.key: (r.version, r.value) for r in sinks.current_state(spark, str(tmp_path / "state")).collect()}
    assert state == {"a": (3, "y"), "b": (1, "z"), "c": (1, "w")}
    assert spark.read.parquet(str(tmp_path / "state")).count() == 5
