"""Books that are written again: versions with a switch, rewrites behind a list of protected titles, and a layout for lookups."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.players import rewritten
from foliant.sources.corpus import _place, folder_exists

CURRENT = "CURRENT.json"
#: Folders of a store of books, and of one of sections.
SHELVES, BUCKETS = 64, 64


def publish(rows: DataFrame, path: str) -> str:
    """Writes rows as a new version below path and makes it the current one; readers have the old version until all is written, then the new one.

    The switch is one rename of a small file over another, so a run that fails leaves the version before. Returns the version's name.
    """
    spark, name = rows.sparkSession, f"v-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    jvm = spark.sparkContext._jvm
    new, store = _place(spark, f"{path}/.{name}.json")
    out = store.create(new)
    out.write(json.dumps({"version": name, "before": current(spark, path)}).encode())
    out.close()
    whole = lambda p: p.makeQualified(store.getUri(), store.getWorkingDirectory())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(whole(new), whole(_place(spark, f"{path}/{CURRENT}")[0]), over)
    return name


def _pointer(spark: SparkSession, path: str) -> dict:
    place, store = _place(spark, f"{path}/{CURRENT}")
    if not store.exists(place):
        return {}
    given = store.open(place)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(given)))
    finally:
        given.close()


def current(spark: SparkSession, path: str) -> str | None:
    """The name of the current version, if there is one."""
    return _pointer(spark, path).get("version")


def read_current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{current(spark, path)}")


def prune_versions(spark: SparkSession, path: str) -> None:
    """Deletes all versions but the current one and the one before, which readers may still have."""
    keep = set(_pointer(spark, path).values())
    place, store = _place(spark, path)
    for f in store.listStatus(place):
        if f.getPath().getName().startswith("v-") and f.getPath().getName() not in keep:
            store.delete(f.getPath(), True)


def front_of(name: Column) -> Column:
    """What "title" and "title (*" have in common: the lower-case name up to the first " ("."""
    return F.substring_index(F.lower(name), " (", 1)


def unique_names(titles: DataFrame, stored: DataFrame) -> DataFrame:
    """titles with name: the title, or "title (i)" with the least i >= 1 that no stored name (name) has; compared as they are written. Give titles once."""
    number = F.regexp_extract("name", r"^(?s:.*) \(([1-9]\d{0,8})\)$", 1)
    forms = F.array(F.struct(F.col("name").alias("title"), F.lit(0).alias("i")), F.struct(F.left("name", F.length("name") - F.length(number) - 3).alias("title"), number.try_cast("int").alias("i")))
    held = stored.select(F.inline(F.slice(forms, 1, F.when(number == "", 1).otherwise(2)))).groupBy("title").agg(F.collect_set("i").alias("held"))
    free = F.filter(F.sequence(F.lit(0), F.size("held")), lambda i: ~F.array_contains("held", i))[0]
    name = F.when(F.col("held").isNull() | (free == 0), F.col("title")).otherwise(F.concat("title", F.lit(" ("), free.cast("string"), F.lit(")")))
    return titles.join(held, "title", "left").withColumn("name", name).drop("held")


def write_cleaned(books: DataFrame, path: str, protected: list[str] | DataFrame, shelves: int = SHELVES) -> None:
    """Puts cleaned books (title and any columns) into the store at path, which has a name for each.

    Names "title" and "title (*" of a title that is written again go first, whatever their case; those of protected titles stay, and
    the new book stands beside them as "title (i)". Only the shelves that the titles are on are read and replaced, by dynamic
    partition overwrite; so a rerun of some books leaves the files of others as they are, and a rerun of all gives the same names.
    Of rows of one title one is written, that with the largest other columns.
    """
    spark = books.sparkSession
    rest = [c for c in books.columns if c != "title"]
    once = books.where("title IS NOT NULL").groupBy("title").agg(F.max(F.struct(*rest)).alias("row")).select("title", "row.*")
    shelf = lambda name: F.pmod(F.xxhash64(front_of(name)), F.lit(shelves)).cast("int")
    if folder_exists(spark, path):
        touched = [r[0] for r in once.select(shelf(F.col("title")).alias("s")).distinct().collect()]  # SHELVES at most
        schema = once.withColumns({"name": F.lit(""), "shelf": F.lit(0)}).schema
        old = spark.read.schema(schema).parquet(path).where(F.col("shelf").isin(touched)).drop("shelf")
    else:
        old = once.withColumn("name", F.col("title")).limit(0)
    kept = old.join(rewritten(old.select("name"), once.select("title"), protected), "name", "left_semi")
    new = unique_names(once, kept)
    every = kept.unionByName(new).withColumn("shelf", shelf(F.col("name")))
    every.hint("rebalance", "shelf").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shelf").parquet(path)


def read_cleaned(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("shelf")


def bucket(book_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(book_id.cast("long")), F.lit(buckets)).cast("int")


def write_sections(sections: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Sections (book_id, section_number, ...) in folders by a hash of the book, sorted within files, so that a lookup reads one folder and few row groups."""
    rows = sections.withColumn("bucket", bucket(F.col("book_id"), buckets))
    rows.repartition("bucket").sortWithinPartitions("bucket", "book_id", "section_number").write.mode("overwrite").partitionBy("bucket").parquet(path)


def lookup_section(spark: SparkSession, path: str, book_id: int, number: int, buckets: int = BUCKETS) -> DataFrame:
    """The section of that book and number: at most one row; the scan lists and reads one bucket."""
    where = (F.col("bucket") == bucket(F.lit(book_id), buckets)) & (F.col("book_id") == book_id) & (F.col("section_number") == number)
    return spark.read.parquet(path).where(where).drop("bucket").limit(1)


def lookup_sections(spark: SparkSession, path: str, keys: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The sections of many keys (book_id, section_number): joined by bucket too, so that only the keys' buckets are read if there are few."""
    wanted = keys.select("book_id", "section_number").distinct().withColumn("bucket", bucket(F.col("book_id"), buckets))
    return spark.read.parquet(path).join(wanted, ["bucket", "book_id", "section_number"]).drop("bucket")


def page_index(lines: DataFrame) -> DataFrame:
    """book_id, page, n_lines, first, last: a row for each page of lines (book_id, page, n, text), with its first and last text."""
    return lines.groupBy("book_id", "page").agg(F.count(F.lit(1)).alias("n_lines"), F.min_by("text", "n").alias("first"), F.max_by("text", "n").alias("last"))

