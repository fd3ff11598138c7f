"""The folder that driver and executors share, and cutting lineage in it."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, in tests on one machine, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if root is None:
        if sc.getCheckpointDir() is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="foliant-"))
        root = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint: later steps survive the loss of executors.

    A checkpoint keeps Spark's estimate of its size, and estimates of joins are products: in a loop that joins its own results their
    digits grow by a power in each pass, until they fill the driver. Loops take ``stored``, whose size is that of its files.
    """
    shared_root(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """The same rows, written as Parquet to the shared folder (below ``root``, if given) and read again."""
    path = f"{root}/{name}" if root else scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one whose rows no later step reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps whose results are cut off; it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tasks(spark: SparkSession) -> int:
    """How many tasks a shuffle is dealt to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key with more rows than this is looked up by broadcast; there are at most rows / HOT_ROWS of them.
HOT_ROWS = 1_000
#: Keys that are broadcast at most (a few numbers each); of more hot keys the hottest are, so that the others have rows / HOT_KEYS each at most.
HOT_KEYS = 500_000


def small(keys: DataFrame) -> DataFrame:
    """keys with a broadcast hint if they are at most HOT_KEYS (a few numbers each), else as they are."""
    return F.broadcast(keys) if keys.limit(HOT_KEYS + 1).count() <= HOT_KEYS else keys


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows joined with table (inner; one row per key), which has in column ``count`` how many rows a key has.

    Keys with many rows are looked up by broadcast, so no task gets all rows of one. Their number is checked first; of more than
    HOT_KEYS the hottest are, down to a number of rows that is looked for by halving.
    """
    least = HOT_ROWS
    while (many := table.where(F.col(count) > least).limit(HOT_KEYS + 1).count()) > HOT_KEYS:
        least *= 2
    if not many:
        return rows.join(table, keys)
    hot = table.where(F.col(count) > least)
    found = [c for c in table.columns if c not in keys]
    near = rows.join(F.broadcast(hot), keys, "left")
    first, others = near.where(F.col(count).isNotNull()), near.where(F.col(count).isNull()).drop(*found)
    return first.unionByName(others.join(table.where(F.col(count) <= least), keys))
