"""Queries that run streams to their end and read what they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.plans import ORACLES, query
from foliant.sources.corpus import scratch, table
from foliant.streaming.keyed import keep_latest, read_keyed, run_to_end
from foliant.streaming.sessions import session_stream

BATCHES = 3


def in_batches(spark: SparkSession, rows: DataFrame, by: str) -> DataFrame:
    """The rows as a stream of BATCHES files, each with rows of all times."""
    path = scratch(spark, "batches")
    rows.repartition(BATCHES, by).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(ORACLES["progress_upsert"], books=False)
def progress_stream(s, d):
    """The last row of each reader and event, kept by a stream of several batches that are out of order."""
    rows = in_batches(s, table(s, d, "events").select("user_id", "event_type", "ts", "value", "event_id"), "event_id").drop("event_id")
    path = scratch(s, "progress")
    run_to_end(lambda: keep_latest(rows, path, scratch(s, "progress-checkpoint"), ["user_id", "event_type"], ["ts", "value"], 8))
    return read_keyed(s, path)


@query(ORACLES["session_states"], books=False)
def session_states_stream(s, d):
    """Where each reader is after a stream of moves in batches that are out of order."""
    moves = table(s, d, "events").select("user_id", "ts", F.col("event_id").alias("tie"), F.when(F.col("event_type") != "error", (F.col("event_id") % 400 + 1).cast("int")).alias("section"))
    states = session_stream(in_batches(s, moves, "tie"), late="400 days")
    path = scratch(s, "sessions")
    run_to_end(lambda: keep_latest(states, path, scratch(s, "sessions-checkpoint"), ["user_id"], ["last", "moves"], 8, mode="update"))
    return read_keyed(s, path).select("user_id", "current", F.array_join(F.transform("history", lambda x: x.cast("string")), ",").alias("history"), "moves")
