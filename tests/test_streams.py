"""Streams in several batches, repeated and out of order, against the batch queries."""

import os

from pyspark.sql import functions as F

from foliant.operators import players
from foliant.streaming.keyed import bucket_of, keep_latest, merge_batch, read_keyed, run_to_end
from foliant.streaming.sessions import session_stream

ROW = "k long, kind string, ts long, v string"
KEYS, ORDER = ["k", "kind"], ["ts"]


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def data_files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_batches_merge(spark, tmp_path):
    """Late and repeated rows, ties, null keys; then each batch again, as after a failure."""
    batches = [
        [(k, "a", 10, "first") for k in range(40)] + [(None, "a", 1, "null"), (1, None, 1, "null")],
        [(k, "a", 5, "late") for k in range(0, 40, 3)] + [(k, "a", 20, "new") for k in range(1, 40, 7)] + [(None, "a", 2, "null again")],
        [(2, "a", 10, "tie"), (2, "a", 10, "tie"), (99, "b", 1, None)],
        [],
    ]
    path = str(tmp_path / "t")
    frames = [spark.createDataFrame(b, ROW) for b in batches]
    seen = frames[0]
    for k, f in enumerate(frames):
        merge_batch(f, k, path, KEYS, ORDER, 8)
        seen = seen.unionByName(f) if k else seen
        assert rows(read_keyed(spark, path).select("k", "kind", "ts", "v")) == rows(players.latest(seen, KEYS, ["ts", "v"]).select("k", "kind", "ts", "v"))
    before = data_files(path)
    for k, f in enumerate(frames):
        merge_batch(f, k, path, KEYS, ORDER, 8)
    assert {f: t for f, t in data_files(path).items() if f in before} == before and len(data_files(path)) == len(before)


def test_batch_of_one_bucket_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    merge_batch(spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("kind"), F.lit(1).cast("long").alias("ts"), F.lit("x").alias("v")), 0, path, KEYS, ORDER, 8)
    before = data_files(path)
    one = spark.createDataFrame([(7, "a", 9, "y")], ROW)
    bucket = one.select(bucket_of(KEYS, 8)).collect()[0][0]
    merge_batch(one, 1, path, KEYS, ORDER, 8)
    changed = {f for f in set(before) ^ set(data_files(path))}
    assert changed and all(f"bucket={bucket}{os.sep}" in f for f in changed)


def test_part_of_a_batch_that_was_written(spark, tmp_path):
    """A batch stopped after some of its buckets: when it comes again, those stay and the rest is done."""
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(k, "a", 1, "old") for k in range(50)], ROW)
    new = spark.createDataFrame([(k, "a", 2, "new") for k in range(50)], ROW)
    merge_batch(old, 0, path, KEYS, ORDER, 4)
    merge_batch(new.where(bucket_of(KEYS, 4) < 2), 1, path, KEYS, ORDER, 4)
    before = data_files(path)
    merge_batch(new, 1, path, KEYS, ORDER, 4)
    assert {r.v for r in read_keyed(spark, path).collect()} == {"new"} and read_keyed(spark, path).count() == 50
    done = {f for f in before if "bucket=0" in f or "bucket=1" in f}
    assert done <= set(data_files(path))


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_type", "ts", "value", "event_id")
    source, path, mark = (str(tmp_path / x) for x in ("in", "kept", "mark"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
    for part in range(3):  # two files each time; the stream stops in between
        events.where(F.col("event_id") % 3 == part).repartition(2).write.mode("append").parquet(source)
        run_to_end(lambda: keep_latest(stream.parquet(source).drop("event_id"), path, mark, ["user_id", "event_type"], ["ts", "value"], 4))
        so_far = players.latest(events.where(F.col("event_id") % 3 <= part).drop("event_id"), ["user_id", "event_type"], ["ts", "value"])
        assert rows(read_keyed(spark, path).select(so_far.columns)) == rows(so_far)


def played(spark, tmp_path, batches, **kw):
    """The last state of each reader, and all that were told, after moves in the given batches."""
    schema = "user_id long, ts timestamp, tie long, section int"
    source, path = str(tmp_path / "in"), str(tmp_path / "states")
    for k, b in enumerate(batches):
        spark.createDataFrame(b, "user_id long, ts string, tie long, section int").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{source}/b={k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(source)
        run_to_end(lambda stream=stream: keep_latest(session_stream(stream, **kw), path, str(tmp_path / "mark"), ["user_id"], ["last", "moves"], 4, mode="update"))
    return {r.user_id: (r.current, r.history, r.moves) for r in read_keyed(spark, path).collect()}


def test_sessions_out_of_order(spark, tmp_path):
    """Three batches, the stream started anew for each; moves from before and after a reset come late."""
    day = "2024-03-01 10:{:02d}:00".format
    batches = [
        [(1, day(5), 1, 50), (1, day(9), 2, None), (1, day(20), 3, 60), (2, day(1), 4, 7)],
        [(1, day(7), 5, 51), (1, day(15), 6, 55), (2, day(1), 3, 6), (3, day(30), 9, None)],
        [(1, day(10), 7, 52), (3, day(29), 8, 400), (3, day(31), 10, 2), (2, day(1), 4, 7)],
    ]
    flat = spark.createDataFrame([m for b in batches for m in b], "user_id long, ts string, tie long, section int")
    want = {r.user_id: (r.current, r.history, r.moves) for r in players.session_states(flat).collect()}
    assert played(spark, tmp_path, batches) == want == {1: (60, [1, 52, 55, 60], 6), 2: (7, [6, 7, 7], 3), 3: (2, [1, 2], 3)}


def test_idle_session_is_dropped(spark, tmp_path):
    batches = [
        [(1, "2024-03-01 10:00:00", 1, 50), (2, "2024-03-01 10:00:00", 2, 9)],
        [(2, "2024-03-05 10:00:00", 3, 10)],  # moves the watermark
        [(2, "2024-03-05 11:00:00", 4, 11)],  # drops the session of 1
        [(1, "2024-03-05 12:00:00", 5, 3), (2, "2024-03-05 12:00:00", 6, 12)],
    ]
    states = played(spark, tmp_path, batches, idle="1 day", late="1 hour")
    assert states[1] == (3, [3], 1)
