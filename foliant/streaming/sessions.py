"""The state of each reader's game, kept by a stream of moves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

STATE = "user_id long, current int, history array<int>, moves long, last long"
#: The store that keeps states of several kinds.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

HEAD = StructType([StructField("since", LongType()), StructField("tie", LongType()), StructField("moves", LongType()), StructField("last", LongType()), StructField("reset", IntegerType())])
MOVE = StructType([StructField("at", LongType()), StructField("tie", LongType()), StructField("section", IntegerType())])


class Session(StatefulProcessor):
    """A value (the last reset, how many moves there were, the latest of them) and a list of the moves since that reset.

    A move that comes late is put where it belongs by its time; one from before the last reset is counted alone. A timer at
    ``idle_ms`` after the latest move drops the session.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.moves = handle.getListState("moves", MOVE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(at), int(tie), None if pd.isna(section) else int(section)) for f in rows for at, tie, section in zip(f["at"], f["tie"], f["section"], strict=True)]
        since, tie, n, last, reset = self.head.get() if self.head.exists() else (None, None, 0, None, 0)
        own = [tuple(m) for m in self.moves.get()] if self.moves.exists() else []
        resets = [m[:2] for m in new if m[2] is None]
        start = max([*resets, *([(since, tie)] if reset else [])], default=None)
        own = sorted(m for m in [*own, *(m for m in new if m[2] is not None)] if start is None or m[:2] > start)
        latest = max([m[0] for m in new] + ([last] if last is not None else []))
        self.head.update((start[0] if start else None, start[1] if start else None, n + len(new), latest, int(start is not None)))
        self.moves.put(own) if own else self.moves.clear()
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(latest // 1000 + self.idle_ms)
        history = ([1] if start else []) + [m[2] for m in own]
        yield pd.DataFrame({"user_id": [key[0]], "current": [history[-1]], "history": [history], "moves": [n + len(new)], "last": [latest]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.head.clear()
        self.moves.clear()
        return iter(())

    def close(self) -> None:
        pass


def session_stream(moves: DataFrame, idle: str = "400 days", late: str = "1 day") -> DataFrame:
    """user_id, current, history, moves, last: after each batch where its readers are; moves: user_id, ts, tie, section (null: a reset).

    As players.session_states: a reset goes back to section 1 and clears the history. Batches may be out of order by up to
    ``late``; a session without moves for ``idle`` is dropped when the watermark passes, and a later move begins a new one.
    last: the time of the latest move in microseconds. The session's stream needs the store of PROVIDER.
    """
    session = moves.sparkSession
    session.conf.set(*PROVIDER)
    idle_ms = session.sql(f"SELECT CAST(unix_millis(timestamp_seconds(0) + INTERVAL {idle}) AS LONG)").collect()[0][0]
    rows = moves.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("user_id", "ts", F.unix_micros("ts").alias("at"), F.col("tie").cast("long").alias("tie"), F.col("section").cast("int").alias("section"))
    return rows.groupBy("user_id").transformWithStateInPandas(Session(idle_ms), STATE, "update", "EventTime")
