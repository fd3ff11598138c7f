"""Token ids in files of length-delimited records with masked checksums, and an offset index beside each file.

File format (all numbers little-endian). A data file ``part-P-K.rec`` is a sequence of frames:

    length    u64  bytes of the payload
    check     u32  masked CRC-32 of the 8 length bytes
    payload        has_id u8 (0: the id is null), doc_id i64, width u8 (bytes of an id: 2 or 4), count u32, ids
    check     u32  masked CRC-32 of the payload

A check is masked by a rotation right by 15 bits plus 0xA282EAD8, so that checksums of data that hold checksums stay sound.
The index ``part-P-K.idx`` has 16 bytes for each frame, its offset u64 and its length u64: a reader draws frames in any
order by seeking. Files are in ascending doc_id order by name, null last; rows of one id by a hash of their text.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.kernels import column_bytes
from foliant.llm.shared import scratch, stored, tasks
from foliant.llm.subwords import encoder

#: Bytes after which a task begins its next file.
FILE_BYTES = 64 << 20
#: The id after each document.
END = 1

HEAD, FOOT, PAYLOAD, ENTRY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<BqBI"), struct.Struct("<QQ")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + FOOT.pack(masked_crc(length)) + payload + FOOT.pack(masked_crc(payload))


def pack_ids(doc_id: int | None, ids: np.ndarray) -> bytes:
    return PAYLOAD.pack(doc_id is not None, doc_id or 0, ids.dtype.itemsize, len(ids)) + ids.tobytes()


def unpack_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    has_id, doc_id, width, count = PAYLOAD.unpack_from(payload)
    return doc_id if has_id else None, np.frombuffer(payload, dtype=f"<u{width}", count=count, offset=PAYLOAD.size)


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the frame at an offset, and the offset after it; ValueError if it is cut short or a check fails."""
    if at + HEAD.size > len(data):
        raise ValueError(f"the frame at {at} is cut short")
    length, check = HEAD.unpack_from(data, at)
    if masked_crc(data[at : at + 8]) != check:
        raise ValueError(f"the length at {at} is damaged")
    body = at + HEAD.size
    if body + length + FOOT.size > len(data):
        raise ValueError(f"the frame at {at} is cut short")
    payload = data[body : body + length]
    if masked_crc(payload) != FOOT.unpack_from(data, body + length)[0]:
        raise ValueError(f"the record at {at} is damaged")
    return payload, body + length + FOOT.size


def frames(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        payload, at = unframe(data, at)
        yield payload


def file_system(uri: str):
    """The store of a folder and its path there; any store that pyarrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri if ":" in uri else f"file://{uri}"))


def read_record(uri: str, i: int) -> tuple[int | None, np.ndarray]:
    """Record i of a data file, by its index: two seeks, whatever the file's size."""
    store, path = file_system(uri)
    with store.open_input_file(path.removesuffix(".rec") + ".idx") as index:
        index.seek(i * ENTRY.size)
        offset, length = ENTRY.unpack(index.read(ENTRY.size))
    with store.open_input_file(path) as data:
        data.seek(offset)
        return unpack_ids(unframe(data.read(length))[0])


class _Files:
    """The files of one task; a finished pair is moved to its final name, so a task that runs again replaces it."""

    def __init__(self, root: str, part: int, attempt: int, file_bytes: int) -> None:
        (self.store, self.path), self.root, self.part, self.attempt, self.most = file_system(root), root, part, attempt, file_bytes
        self.k, self.out = 0, None

    def add(self, payload: bytes, n: int) -> tuple | None:
        if self.out is None:
            self.name = f"part-{self.part:06d}-{self.k:04d}"
            self.own = f"{self.path}/_{self.name}-{self.attempt}"
            self.out, self.at, self.index, self.records, self.ids = self.store.open_output_stream(f"{self.own}.rec"), 0, [], 0, 0
        data = frame(payload)
        self.out.write(data)
        self.index.append(ENTRY.pack(self.at, len(data)))
        self.at, self.records, self.ids = self.at + len(data), self.records + 1, self.ids + n
        return self.close() if self.at >= self.most else None

    def close(self) -> tuple | None:
        if self.out is None:
            return None
        self.out.close()
        with self.store.open_output_stream(f"{self.own}.idx") as f:
            f.write(b"".join(self.index))
        for kind in ("idx", "rec"):
            self.store.move(f"{self.own}.{kind}", f"{self.path}/{self.name}.{kind}")
        self.out, self.k = None, self.k + 1
        return f"{self.root}/{self.name}.rec", self.part, self.k - 1, self.records, self.ids


FILES = "file string, part int, k int, records long, ids long"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def write_records(docs: DataFrame, root: str, tokenizer: str, end: int = END, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the ids of docs (doc_id, text) below root; returns a row per data file: file, part, k, records, ids.

    tokenizer: path of a tokenizers file, readable by the executors. A null or empty text gives the end id alone; an empty
    table gives no files. Rows are dealt by ranges of doc_id, so each task's files hold one range.
    """
    arrow = pa.schema([("file", pa.string()), ("part", pa.int32()), ("k", pa.int32()), ("records", pa.int64()), ("ids", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        files, done = _Files(root, context.partitionId(), context.taskAttemptId(), file_bytes), []
        files.store.create_dir(files.path, recursive=True)
        for batch in batches:
            ids, at = encoder(tokenizer).encode(*column_bytes(batch.column("text")), end=end)
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                done.append(files.add(pack_ids(doc, ids[a:b]), b - a))
        done = [x for x in [*done, files.close()] if x]
        yield _table(done, arrow)

    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(tasks(docs.sparkSession), *order).sortWithinPartitions(*order)
    return stored(rows.mapInArrow(write, FILES), "token-files")


def placed(files: DataFrame) -> DataFrame:
    """files with start: the ids in all files before. Files are summed by part first, so that a part's files are numbered apart."""
    parts = files.groupBy("part").agg(F.sum("ids").alias("in_part"))  # a row per task that wrote
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("in_part").over(earlier), F.lit(0))).drop("in_part")
    within = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("within", F.coalesce(F.sum("ids").over(within), F.lit(0))).join(parts, "part").withColumn("start", F.col("before") + F.col("within")).drop("before", "within")


def _indexed(name: str) -> tuple[bytes, np.ndarray]:
    """A data file's bytes, and the offset and length of each frame by its index; ValueError where the index doesn't cover the file."""
    store, path = file_system(name)
    with store.open_input_file(path) as f:
        data = f.read()
    with store.open_input_file(path.removesuffix(".rec") + ".idx") as f:
        index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
    ends = index.sum(axis=1)
    if not np.array_equal(index[1:, 0], ends[:-1]) or (len(index) and (index[0, 0] != 0 or ends[-1] != len(data))) or (not len(index) and data):
        raise ValueError(f"the index of {name} doesn't fit")
    return data, index


def read_records(files: DataFrame) -> DataFrame:
    """Reads the data files back by their indexes, with all checks: doc_id, start, n_tokens, ids_crc32. A damaged file fails the query."""
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                data, index = _indexed(name)
                rows = []
                for at in index[:, 0].tolist():
                    doc, ids = unpack_ids(unframe(data, at)[0])
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield _table(rows, arrow)

    dealt = placed(files).select("file", "start").repartition(max(1, tasks(files.sparkSession)), "file")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shuffled_records(files: DataFrame, seed: int) -> DataFrame:
    """doc_id, ids of all records in an order by seed: files are dealt at random, and the records of each are drawn by its index in a permuted order. Reruns agree."""
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, part, k in zip(*(batch.column(c).to_pylist() for c in ("file", "part", "k")), strict=True):
                data, index = _indexed(name)
                order = np.random.default_rng([seed, part, k]).permutation(len(index))
                rows = [unpack_ids(unframe(data, at)[0]) for at in index[order, 0].tolist()]
                yield _table([(doc, ids.tolist()) for doc, ids in rows], arrow)

    place = F.xxhash64(F.lit(seed), "part", "k")
    dealt = files.select("file", "part", "k").repartition(max(1, tasks(files.sparkSession)), place).sortWithinPartitions(place)
    return dealt.mapInArrow(read, "doc_id long, ids array<long>")


def token_records(docs: DataFrame, tokenizer: str, root: str | None = None, end: int = END) -> DataFrame:
    """Writes docs to record files and reads them back: one row per row of docs, doc_id, start, n_tokens, ids_crc32."""
    return read_records(write_records(docs, root or scratch(docs.sparkSession, "tokens"), tokenizer, end))
