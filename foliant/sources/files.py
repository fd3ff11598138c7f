"""Books as JSON files, with explicit schemas; files that can't be parsed are kept apart, not fatal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOOK = "title string, introduction string, sections array<struct<number: int, content: string, image_path: string>>"


def read_books(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """title, introduction, sections, file, broken (the text of a file that is no book): a book per file, or ``per_line`` as write_books has them."""
    rows = spark.read.schema(f"{BOOK}, broken string").option("columnNameOfCorruptRecord", "broken").json(path, multiLine=not per_line, pathGlobFilter="*.json")
    rows = rows.withColumn("file", F.input_file_name())
    return rows.where(~F.lower("file").rlike(r"\.cleaned\.json$|\.bak$"))


def exploded(books: DataFrame) -> DataFrame:
    return books.where(F.col("broken").isNull()).select("title", F.inline("sections"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """n, page, side, line, end: the entries of a manifest file."""
    return read_manifests(spark, path).drop("name")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """name, n, page, side, line, end: the entries of all manifests below path, by the names of their files."""
    entry = "entries array<struct<n: int, page: int, side: string, line: int, `end`: int>>"
    rows = spark.read.schema(entry).json(path, multiLine=True, pathGlobFilter="*.json", recursiveFileLookup=True)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("name"), F.inline("entries"))


def write_books(books: DataFrame, path: str, run: str) -> None:
    """A new version below path, a book per line; an earlier one is never overwritten."""
    books.write.mode("errorifexists").json(f"{path}/run={run}")
