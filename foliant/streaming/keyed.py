"""A table of the last row of each key, kept up to date by the batches of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.players import latest
from foliant.sources.corpus import folder_exists

#: Folders of a table; a batch reads and writes those alone that its keys fall into.
BUCKETS = 64


def bucket_of(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merge_batch(batch: DataFrame, number: int, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> None:
    """Puts batch ``number`` into the table at ``path``: of each key the last row by ``order`` stays, whichever batch has it.

    Buckets without a key of the batch are neither read nor written; the others are replaced by dynamic partition overwrite. A
    bucket's rows carry the number of the batch that wrote it last, and a bucket that has this number or a later one is left as
    it is. So a batch that is repeated, after it was written whole or in part, changes nothing that is done. Null keys are keys; of rows
    that tie in ``order`` the larger in the other columns stays. An empty batch changes nothing but makes the table.
    """
    spark = batch.sparkSession
    rest = [c for c in batch.columns if c not in keys + order]
    new = latest(batch, keys, order + rest).withColumn("bucket", bucket_of(keys, buckets)).persist()
    try:
        old = None
        if folder_exists(spark, path):
            schema = new.withColumn("batch", F.lit(0).cast("long")).select(*batch.columns, "batch", "bucket").schema
            touched = [r[0] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
            old = spark.read.schema(schema).parquet(path).where(F.col("bucket").isin(touched))
            done = [r["bucket"] for r in old.groupBy("bucket").agg(F.max("batch").alias("batch")).where(F.col("batch") >= number).collect()]
            new = new.where(~F.col("bucket").isin(done))
            old = old.where(~F.col("bucket").isin(done)).drop("batch")
            if len(done) == len(touched):
                return
        every = new if old is None else new.unionByName(old)
        merged = latest(every, ["bucket", *keys], order + rest).withColumn("batch", F.lit(number).cast("long"))
        # a large bucket may be several files: Spark cuts them to its advised size
        merged.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    finally:
        new.unpersist()


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows as they came, without its own columns."""
    return spark.read.parquet(path).drop("bucket", "batch")


def keep_latest(rows: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = BUCKETS, mode: str = "append") -> StreamingQuery:
    """Starts a query over what the stream has by now that keeps the table at ``path``; started again, it goes on where it stopped."""

    def write(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, path, keys, order, buckets)

    return rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(start: Callable[[], StreamingQuery]) -> None:
    """Runs a query over all that its source has, and raises what it failed with."""
    started = start()
    started.awaitTermination()
    if started.exception() is not None:
        raise started.exception()
