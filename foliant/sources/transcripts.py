"""Transcripts of scanned pages as a data source: a file of JSON for each page, one of plain text beside it, and an index per book.

``spark.dataSource.register(Transcripts)``, then ``spark.read.format("transcripts").load(path)`` and
``lines.write.format("transcripts").mode("append").save(path)``. Paths are those pyarrow knows: local and shared folders, hdfs://, s3://, gs://.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: broken: the text of a file that is no transcript; such a file has one row, without lines.
LINES = "book_id long, page int, n int, side string, top double, text string, file string, broken string"
PAGE = re.compile(r"(?:^|/)(\d+)/pages/Page(\d+)\.json$")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else re.sub(r"^file:/*", "/", path))


@dataclass
class Files(InputPartition):
    names: list[str]


class TranscriptReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.many = options["path"], int(options.get("filesPerPartition", 1))

    def partitions(self) -> list[Files]:
        """A partition per file, or per so many; in order of the numbers in their names, not of the names."""
        store, root = opened(self.path)
        found = [(int(m[1]), int(m[2]), f.path) for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and (m := PAGE.search(f.path))]
        names = [name for _, _, name in sorted(found)]
        return [Files(names[k : k + self.many]) for k in range(0, len(names), self.many)]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = opened(self.path)
        for name in partition.names:
            book = int(PAGE.search(name)[1])
            with store.open_input_stream(name) as f:
                raw = f.read().decode("utf-8", "replace")
            try:
                held = json.loads(raw)
                lines = [(book, int(held["page"]), int(x["n"]), x["side"], float(x.get("top") or 0), x["text"]) for x in held["lines"]]
            except (ValueError, KeyError, TypeError, AttributeError):
                yield book, int(PAGE.search(name)[2]), None, None, None, None, name, raw
                continue
            for line in sorted(lines, key=lambda x: x[2]):
                yield *line, name, None


class TranscriptWriter(DataSourceWriter):
    """Writes each page's files where they stay; a task that runs again writes the same. dump writes the indexes, which say what belongs to it."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        """Rows of a task in order of book, page and n (see dump): one page is in memory at a time."""
        store, root = opened(self.path)
        held: list[Row] = []

        def page() -> None:
            book, number = held[0].book_id, held[0].page
            folder = f"{root}/{book}/pages"
            store.create_dir(folder, recursive=True)
            lines = [{"n": r.n, "side": r.side, "top": r.top, "text": r.text} for r in held]
            plain = [f"PAGE {number}  ({len(held)} lines)", *(f"{r.n:>3} {r.side} {r.top or 0:>6.3f}  {r.text}" for r in held)]
            for kind, text in (("json", json.dumps({"page": number, "lineCount": len(lines), "lines": lines}, ensure_ascii=False, indent=1)), ("txt", "\n".join(plain) + "\n")):
                with store.open_output_stream(f"{folder}/Page{number:03d}.{kind}") as f:
                    f.write(text.encode())
            held.clear()

        for r in rows:
            if held and (held[0].book_id, held[0].page) != (r.book_id, r.page):
                page()
            held.append(r)
        if held:
            page()
        return WriterCommitMessage()


def write_indexes(pages: DataFrame, path: str, overwrite: bool) -> None:
    """pages: book_id, page, lines. Writes index.json of each book: its pages, how many lines they have, and their files.

    Pages of an earlier index stay in it, or with ``overwrite`` their files and those of other pages go. A book's index is written by one
    task, from a row for each of its pages; the driver gets nothing.
    """

    def write(store: fs.FileSystem, folder: str, pages: dict[int, int]) -> None:
        if not overwrite:
            pages = {**{x["page"]: x["lines"] for x in index_of(store, folder)}, **pages}
        rows = [{"page": p, "lines": n, "file": f"pages/Page{p:03d}.json"} for p, n in sorted(pages.items())]
        with store.open_output_stream(f"{folder}/index.json") as f:
            f.write(json.dumps(rows, indent=1).encode())
        for x in store.get_file_info(fs.FileSelector(f"{folder}/pages")) if overwrite else ():
            m = re.search(r"Page(\d+)\.(?:json|txt)$", x.path)
            if m and int(m[1]) not in pages:
                store.delete_file(x.path)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path)
        book, held = None, {}
        for batch in batches:
            for b, p, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != book and held:
                    write(store, f"{root}/{book}", held)
                    held = {}
                book, held[p] = b, n
        if held:
            write(store, f"{root}/{book}", held)
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["book_id"])

    dealt = pages.select("book_id", "page", "lines").repartition("book_id").sortWithinPartitions("book_id", "page")
    dealt.mapInArrow(each, "book_id long").write.format("noop").mode("overwrite").save()


def index_of(store: fs.FileSystem, folder: str) -> list[dict]:
    if store.get_file_info(f"{folder}/index.json").type == fs.FileType.NotFound:
        return []
    with store.open_input_stream(f"{folder}/index.json") as f:
        return json.loads(f.read())


class Transcripts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> TranscriptReader:
        return TranscriptReader(self.options)

    def writer(self, schema, overwrite: bool) -> TranscriptWriter:
        return TranscriptWriter(self.options)


def read_transcripts(spark: SparkSession, path: str, per_task: int = 1) -> DataFrame:
    """book_id, page, n, side, top, text, file, broken: the lines of all books' pages below path, ``per_task`` files to a task."""
    spark.dataSource.register(Transcripts)
    return spark.read.format("transcripts").option("filesPerPartition", per_task).load(path)


def dump(lines: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes lines (book_id, page, n, side, top, text): for each book a folder with a JSON and a text file per page and index.json.

    Pages are dealt to tasks whole. Pages written again are replaced; with ``overwrite`` a book's other pages go, else they stay.
    Rows without book or page are left out; lines of one n are kept in order of their text.
    """
    rows = lines.where("book_id IS NOT NULL AND page IS NOT NULL").select(F.col("book_id").cast("long"), F.col("page").cast("int"), F.col("n").cast("int"), "side", F.col("top").cast("double"), "text")
    rows.sparkSession.dataSource.register(Transcripts)
    dealt = rows.repartition("book_id", "page").sortWithinPartitions("book_id", "page", "n", "side", "text")
    dealt.write.format("transcripts").mode("append").save(path)
    write_indexes(rows.groupBy("book_id", "page").agg(F.count(F.lit(1)).alias("lines")), path, overwrite)
