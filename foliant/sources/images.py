"""Images of books: their sizes from the heads of files, what kind they are, and which is a book's map."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides below which an image is no illustration, and below which one that isn't a scan is noise.
LEAST_SIDE, LEAST_ART = 50, 100
#: A map is wider than this and stands before this page.
MAP_WIDTH, MAP_PAGE = 400, 20
#: An image over this share of its page is a scan of it.
SCAN = 0.85
#: Bytes of a file that are looked at first; most have their size in them.
HEAD = 1 << 16


def size_of(head: bytes) -> tuple[str, int, int] | None:
    """Format, width and height of a PNG or JPEG from its first bytes; None if they don't have it."""
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        return ("png", *struct.unpack(">II", head[16:24])) if head[12:16] == b"IHDR" and len(head) >= 24 else None
    if head[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(head):
        if head[at] != 0xFF:
            return None
        kind = head[at + 1]
        if kind == 0xFF:  # a filling byte
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            if at + 9 > len(head):
                return None
            height, width = struct.unpack(">HH", head[at + 5 : at + 9])
            return "jpeg", width, height
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 2
        else:
            at += 2 + struct.unpack(">H", head[at + 2 : at + 4])[0]
    return None


def image_sizes(files: DataFrame) -> DataFrame:
    """path, length, format, width, height: files (path, length, content) that are PNG or JPEG images; of others the last three are null.

    Python gets the first HEAD bytes of each; only a file whose size isn't there (a JPEG behind long notes) is looked at whole.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [size_of(c.as_py() or b"") or (None, None, None) for c in batch.column("head")]
            parts = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), *parts], names=["path", "length", "format", "width", "height"])

    ddl = "path string, length long, format string, width int, height int"
    part = lambda rows, head: rows.select("path", F.col("length").cast("long").alias("length"), head.alias("head")).mapInArrow(work, ddl)
    head = F.substring("content", 1, HEAD)
    first = part(files, head)
    long = files.where((F.octet_length("content") > HEAD) & (F.substring("content", 1, 2) == F.unhex(F.lit("FFD8"))))
    whole = part(long, F.col("content")).select("path", *(F.col(c).alias(f"whole_{c}") for c in ("format", "width", "height")))
    return first.join(whole, "path", "left").select("path", "length", *(F.coalesce(c, f"whole_{c}").alias(c) for c in ("format", "width", "height")))


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """book, page, i, path, width, height: images named <book>/p<page>_i<i>.<ext> below path, both sides at least LEAST_SIDE."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")
    name = r"([^/]+)/p(\d+)_i(\d+)\.\w+$"
    named = image_sizes(files).withColumns({"book": F.regexp_extract("path", name, 1), "page": F.regexp_extract("path", name, 2), "i": F.regexp_extract("path", name, 3)})
    usable = named.where((F.col("page") != "") & (F.col("width") >= LEAST_SIDE) & (F.col("height") >= LEAST_SIDE))
    return usable.select("book", F.col("page").try_cast("int").alias("page"), F.col("i").try_cast("int").alias("i"), "path", "width", "height")


def book_maps(images: DataFrame, keys: tuple[str, ...] = ("book",)) -> DataFrame:
    """The keys and map: the first large image early in a book (page, i, path, width, height)."""
    early = (F.col("page") < MAP_PAGE) & (F.col("width") > MAP_WIDTH) & (F.col("height") >= LEAST_SIDE)
    return images.where(early).groupBy(*keys).agg(F.min_by("path", F.struct("page", "i", "path")).alias("map"))


def image_kind(width: Column, height: Column, bounds_width: Column, bounds_height: Column, page_width: Column, page_height: Column) -> Column:
    """scan, if its bounds cover the page; else embedded, or null for noise. width and height are of the image itself."""
    covered = bounds_width * bounds_height / (page_width * page_height)
    return F.when(covered >= SCAN, "scan").when((width >= LEAST_ART) & (height >= LEAST_ART), "embedded")


def page_totals(images: DataFrame) -> DataFrame:
    """book_id, files, pages, art_pages, scan_pages: totals over the pages of images (book_id, page, kind, regions): a scan gives a file for each region, an embedded image one.

    Pages without files don't count. A page with an embedded image is an art page, the others are pages of scans.
    """
    files = F.when(F.col("kind") == "scan", F.col("regions")).when(F.col("kind") == "embedded", 1).otherwise(0)
    pages = images.groupBy("book_id", "page").agg(F.sum(files).alias("files"), F.max(F.coalesce(F.col("kind") == "embedded", F.lit(False))).alias("art")).where("files > 0")
    totals = pages.groupBy("book_id").agg(F.sum("files").cast("long").alias("files"), F.count(F.lit(1)).alias("pages"), F.count_if("art").alias("art_pages"))
    return totals.withColumn("scan_pages", F.col("pages") - F.col("art_pages"))
