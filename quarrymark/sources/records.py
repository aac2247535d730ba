"""JSON inputs: stream events, evaluation items and nested benchmark cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = (
    "type string, session_id string, utterance_id string, payload struct<chunk_index: int, timestamp_s: double, text: string, "
    "stability: string, replaces_chunk_index: int, utterance_offset_s: double>"
)
ITEM = (
    "item_id string, query string, gold array<string>, gold_level string, case_id string, intent_id string, category string, "
    "split string, is_fixture boolean"
)
CASE = (
    "case_id string, category string, split string, is_fixture boolean, session struct<session_id: string, turns: array<struct<"
    "utterance_id: string, utterance_text: string, utterance_end_s: double, chunks: array<struct<chunk_index: int, timestamp_s: double, "
    "text: string>>, expected: struct<turn_type: string, retrieval_required: boolean, intents: array<struct<gold_intent_id: string, "
    "description: string, answerable: boolean, gold_evidence: array<string>, min_evidence: int>>>>>>"
)
TRACE = (
    "event_id string, type string, session_id string, utterance_id string, seq long, t_session_ms double, t_wall_ms double, "
    "component string, payload string, parent_event_id string, state_version int"
)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One validated record per line; a malformed line is an error, not a NULL row."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def events(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, EVENT)


def items(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, ITEM)


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """Nested cases, one file each."""
    return spark.read.schema(CASE).option("multiLine", True).option("mode", "FAILFAST").json(folder)


def case_items(case_rows: DataFrame) -> DataFrame:
    """One retrieval item per answerable gold intent."""
    turns = case_rows.select("case_id", "category", "split", "is_fixture", F.explode("session.turns").alias("t"))
    intents = turns.select("case_id", "category", "split", "is_fixture", "t.utterance_id", F.explode("t.expected.intents").alias("i"))
    return intents.where("i.answerable").select(
        F.concat_ws(":", "case_id", "utterance_id", "i.gold_intent_id").alias("item_id"),
        F.col("i.description").alias("query"),
        F.col("i.gold_evidence").alias("gold"),
        "case_id",
        F.col("i.gold_intent_id").alias("intent_id"),
        "category",
        "split",
        "is_fixture",
    )


def case_feed(case_rows: DataFrame) -> DataFrame:
    """The chunk feed of nested cases in event time."""
    turns = case_rows.select("session.session_id", F.explode("session.turns").alias("t"))
    return turns.select("session_id", "t.utterance_id", F.explode("t.chunks").alias("c")).select(
        "session_id", "utterance_id", "c.chunk_index", "c.timestamp_s", "c.text"
    )


def trace(spark: SparkSession, path: str) -> DataFrame:
    """A saved event trace."""
    return read_lines(spark, path, TRACE)


def replay_inputs(trace_rows: DataFrame) -> DataFrame:
    """The inputs a trace was produced from, in arrival order."""
    payload = F.from_json("payload", "chunk_index int, text string, timestamp_s double")
    return (
        trace_rows.where(F.col("type").isin("transcript_chunk", "utterance_end"))
        .select("session_id", "seq", "type", "utterance_id", payload.alias("p"))
        .select("session_id", "seq", "type", "utterance_id", "p.chunk_index", "p.text", "p.timestamp_s")
    )


def canonical(trace_rows: DataFrame) -> DataFrame:
    """What two replays must agree on: everything but wall-clock time."""
    return trace_rows.drop("t_wall_ms")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either trace that the other one lacks."""
    left, right = canonical(a), canonical(b)
    return left.exceptAll(right).withColumn("side", F.lit("a")).unionByName(right.exceptAll(left).withColumn("side", F.lit("b")))
