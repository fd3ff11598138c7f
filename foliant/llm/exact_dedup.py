"""Exact dedup by an extendible-hash index on shared files, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from foliant.llm.shared import lookup, remove, scratch, small, stored, tasks

#: The white space that equality ignores, [\x20\x09-\x0D].
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: Distinct texts that a bucket file holds before it is split, and bits of the directory at first.
BUCKET_KEYS, DEPTH = 500_000, 2
#: Bits of the directory at most; a bucket that is still too full then stays, as one long chain.
DEEPEST = 24


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


class Directory:
    """Which bucket owns a key: 2^depth slots, addressed by a key's low bits; several slots share a bucket that is shallower.

    buckets: (bits, local depth) -> path of the bucket's file. Its size follows the number of buckets, not of rows.
    """

    def __init__(self, depth: int, root: str) -> None:
        self.depth, self.root = depth, root
        self.buckets = {(i, depth): f"{root}/depth={depth}/slot={i}" for i in range(1 << depth)}

    def split(self, bits: int, local: int, more: int) -> list[tuple[int, int]]:
        """A full bucket becomes 2^more, told apart by so many more bits; the directory doubles until it is as deep as they."""
        del self.buckets[bits, local]
        self.depth = max(self.depth, local + more)
        made = [(bits | high << local, local + more) for high in range(1 << more)]
        self.buckets |= {(i, depth): f"{self.root}/depth={depth}/slot={i}" for i, depth in made}
        return made

    def owners(self, spark: SparkSession) -> DataFrame:
        """at (a slot of the directory), depth, slot (the bucket that it shares): what a key is looked up in."""
        own = spark.createDataFrame([(b, d) for b, d in self.buckets], "slot long, depth int")
        step = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth"))
        return own.select("slot", "depth", F.explode(F.sequence(F.col("slot"), F.lit((1 << self.depth) - 1).cast("long"), step)).alias("at"))

    def located(self, rows: DataFrame) -> DataFrame:
        """rows (with a column key) and the bucket of each: depth, slot."""
        at = rows.withColumn("at", F.col("key").bitwiseAND(F.lit((1 << self.depth) - 1)))
        return at.join(small(self.owners(rows.sparkSession)), "at").drop("at")


def build_index(records: DataFrame, root: str, bucket_keys: int = BUCKET_KEYS) -> tuple[Directory, DataFrame]:
    """Writes records (column key: 64-bit hash) into bucket files under root and splits those that hold too many.

    Returns the directory and the records of its buckets, with columns depth and slot. It begins with DEPTH bits. Owner tasks
    hold key ranges: a bucket's records are dealt by its low key bits, and one task writes each bucket's file. A full
    bucket is told apart by as many more bits as its size calls for, again and again; what agrees in DEEPEST bits stays together.
    """
    spark = records.sparkSession
    directory = Directory(DEPTH, root)
    schema = StructType([*records.schema.fields, StructField("depth", IntegerType()), StructField("slot", LongType())])

    def write(df: DataFrame, depth: int) -> None:
        slot = F.col("key").bitwiseAND(F.lit((1 << depth) - 1))
        n = max(1, min(1 << depth, tasks(spark)))
        df.withColumn("depth", F.lit(depth)).withColumn("slot", slot).repartition(n, "depth", "slot").write.mode("append").partitionBy("depth", "slot").parquet(root)

    def held(buckets: list[tuple[int, int]] | None = None) -> DataFrame:
        every = spark.read.schema(schema).parquet(root)
        return every if buckets is None else every.join(small(spark.createDataFrame(buckets, "slot long, depth int")), ["slot", "depth"], "left_semi")

    write(records, DEPTH)
    fresh = list(directory.buckets)
    while fresh:
        counts = held(fresh).groupBy("depth", "slot").count().where(F.col("count") > bucket_keys).collect()  # bucket totals only
        full = [(r["slot"], r["depth"], min((r["count"] // bucket_keys).bit_length(), DEEPEST - r["depth"])) for r in counts if r["depth"] < DEEPEST]
        for local, more in sorted({(d, m) for _, d, m in full}):
            paths = [directory.buckets[b, d] for b, d, m in full if (d, m) == (local, more)]
            write(spark.read.schema(records.schema).parquet(*paths), local + more)
            for path in paths:
                remove(spark, path)
        fresh = [b for one in full for b in directory.split(*one)]
    return directory, held()


def exact_dedup(docs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after all white space went; a null text is an empty one. Of equal texts the row with
    the most code points stays, then the smallest doc_id (null last), then one of the rows that repeat it. Other columns are
    ignored, so they may have any name. An empty table gives no rows.

    The index has a record per distinct text. Texts with one 64-bit key are a chain; the owner of a key compares their whole
    bytes, so that each text of a chain has its record. Partial aggregation comes before: a text that a third of the rows
    share reaches its owner once per task. A row finds its record by the directory, the key and, in the chain, its SHA-256.
    """
    spark = docs.sparkSession
    root = scratch(spark, "exact-dedup")
    norm = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("points"), normalised(F.col("text")).alias("norm"))
    norm = norm.withColumn("key", F.xxhash64("norm"))
    digest = F.unhex(F.sha2("norm", 256)).alias("digest")
    rows = norm.select("doc_id", "points", "key", digest, F.monotonically_increasing_id().alias("row"))
    rows.write.parquet(f"{root}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{root}/rows")
    # the complement of a number orders the other way round, without overflow
    best = F.max(F.struct("points", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("doc"))).alias("best")
    chains = norm.groupBy("key", "norm").agg(best, F.count(F.lit(1)).alias("group_size"))
    records = chains.select("key", digest, F.col("best.points").alias("most"), F.bitwise_not("best.doc").alias("keep_id"), "group_size")
    directory, index = build_index(records, f"{root}/index", bucket_keys)

    found = stored(lookup(directory.located(rows), index, ["depth", "slot", "key", "digest"], "group_size"), "found", root)
    # rows that repeat the one that stays: the first of them does
    first = (F.col("points") == F.col("most")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    several = found.where((F.col("group_size") > 1) & first).groupBy("key", "digest").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("stays"))
    joined = found.join(several, "row", "left")
    kept = (F.col("group_size") == 1) | F.coalesce("stays", F.lit(False))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
