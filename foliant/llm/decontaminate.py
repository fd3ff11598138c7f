"""Benchmark items inside documents: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.kernels import BLANK, column_bytes, pieces, shingles, word_hashes
from foliant.llm.shared import stored

#: Words of a shingle, and the share of an item's shingles that a document must hold.
WIDTH, SIMILARITY = 5, 0.75
#: Characters of a benchmark whose sketches go to all tasks; those of a larger one are a table that is joined.
BLOCK_CHARS = 2_000_000
#: Bits of the filter that tells most shingles that are in no sketch, and candidates of a document that are verified at once.
FILTER_BITS, AT_ONCE = 1 << 26, 256

#: Words end at white space and ASCII punctuation.
APART = BLANK.copy()
APART[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class Sketches:
    """Sketches of items whose shingles have the same width.

    Items are partitioned by size (powers of two). An item that is held to ``similarity`` lacks at most
    (1 - similarity) x its size of its shingles; so of the smallest (1 - similarity) x the partition's upper size + 1
    hashes (a bottom-k MinHash) at least one is in the document: the sketch misses nothing. How many of an item's sketch
    hashes a document must hold follows from its own size.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], similarity: float) -> None:
        self.sets, self.need, keys, owners = [], [], [], []
        for item, found in items:
            upper = (1 << len(found).bit_length()) - 1
            sketch = found[: int((1 - similarity) * upper + 1e-9) + 1]
            self.need.append(max(1, len(sketch) - int((1 - similarity) * len(found) + 1e-9)))
            keys.append(sketch)
            owners.append(np.full(len(sketch), len(self.sets)))
            self.sets.append((item, found))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners, self.need = keys[order], owners[order], np.array(self.need)
        self.distinct, self.first = np.unique(self.keys, return_index=True)
        self.ends = np.append(self.first[1:], len(self.keys))
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.keys & np.uint64((1 << 20) - 1)] = True

    def find(self, hashes: np.ndarray, rows: np.ndarray, least: float) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, size of the item, shingles shared) of all rows that hold at least that share of an item."""
        at = np.flatnonzero(self.maybe[hashes & np.uint64((1 << 20) - 1)])
        where = np.minimum(np.searchsorted(self.distinct, hashes[at]), len(self.distinct) - 1)
        same = self.distinct[where] == hashes[at]
        at, where = at[same], where[same]
        row = np.searchsorted(rows, at, side="right") - 1
        hits = np.unique(np.stack([row, where]), axis=1)
        counts: dict[tuple[int, int], int] = defaultdict(int)
        for r, w in hits.T.tolist():
            for i in self.owners[self.first[w] : self.ends[w]].tolist():
                counts[r, i] += 1
        for (r, i), n in counts.items():
            if n >= self.need[i]:
                item, found = self.sets[i]
                shared = int(np.isin(found, hashes[rows[r] : rows[r + 1]]).sum())
                if shared >= least * len(found) - 1e-9:
                    yield r, item, len(found), shared


def _sketches(items: list[tuple[int, str]], similarity: float, width: int) -> dict[int, Sketches]:
    """By shingle width: an item of fewer than ``width`` words is one shingle of all its words. Items without words are left out."""
    data, offsets = column_bytes(pa.array([t or "" for _, t in items], pa.string()))
    words, rows = word_hashes(data, offsets, APART)
    by: dict[int, list] = defaultdict(list)
    for k, (item, _) in enumerate(items):
        own = words[rows[k] : rows[k + 1]]
        if len(own):
            w = min(width, len(own))
            by[w].append((item, np.unique(shingles(own, np.array([0, len(own)]), w)[0])))
    return {w: Sketches(x, similarity) for w, x in by.items()}


def _found(column: pa.Array, sketches: dict[int, Sketches], similarity: float) -> Iterator[tuple[int, int, int, int]]:
    data, offsets = column_bytes(column)
    for a, _, part, at in pieces(data, offsets):
        words, rows = word_hashes(part, at, APART)
        for width, s in sketches.items():
            hashes, begins = shingles(words, rows, width)
            for r, *rest in s.find(hashes, begins, similarity):
                yield a + r, *rest


def _in_memory(items: DataFrame, similarity: float, width: int, block_chars: int) -> dict[int, Sketches] | None:
    """The sketches of a benchmark of at most ``block_chars`` characters; None for a larger one, of which the driver gets nothing."""
    if (items.agg(F.sum(F.length("text"))).collect()[0][0] or 0) > block_chars:
        return None
    return _sketches([(r[0], r[1]) for r in items.select("item_id", "text").distinct().collect()], similarity, width)


def _over(docs: DataFrame, sketches: dict[int, Sketches], work: Callable, schema) -> DataFrame:
    return docs.mapInArrow(lambda batches: (work(b, sketches) for b in batches), schema)


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (doc_id, item_id, n_item, n_shared, containment): each document with each item of which it holds enough shingles.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Words are compared with A-Z as a-z and end at white
    space and ASCII punctuation. A null text holds nothing and an item without words is in nothing; repeated rows give
    repeated results, repeated items count once; an empty table on either side gives none. Sketches of a benchmark of at most ``block_chars`` characters go to all
    tasks, and nothing is shuffled; those of a larger one are a table, and the driver holds none of them (see _joined).
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64()), ("containment", pa.float64())])

    def work(batch: pa.RecordBatch, sketches: dict[int, Sketches]) -> pa.RecordBatch:
        found = list(_found(batch.column("text"), sketches, similarity))
        ids = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
        rest = [pa.array([f[k] for f in found], pa.int64()) for k in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([ids, *rest, pa.array([f[3] / f[2] for f in found], pa.float64())], schema=arrow)

    schema = "doc_id long, item_id long, n_item long, n_shared long, containment double"
    sketches = _in_memory(items, similarity, width, block_chars)
    if sketches is None:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        found = _joined(rows, items, similarity, width)
        held = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
        return held.join(found, ["row", "digest"]).select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return _over(rows, sketches, work, schema) if sketches else docs.sparkSession.createDataFrame([], schema)


SKETCH = "item long, item_id long, width int, n_item long, need int, keys binary, hashes binary"


def _sketch_table(items: DataFrame, similarity: float, width: int) -> DataFrame:
    """A row for each item with words: item (a hash of id and text), its shingles and its sketch, sorted hashes of 64 bits, and how many of the sketch a document must hold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, item_id, text in zip(*(batch.column(c).to_pylist() for c in ("item", "item_id", "text")), strict=True):
                for w, s in _sketches([(item_id, text)], similarity, width).items():
                    rows.append((item, item_id, w, len(s.sets[0][1]), int(s.need[0]), s.keys.tobytes(), s.sets[0][1].tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in SKETCH.split(", ")])

    once = items.select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return once.mapInArrow(work, SKETCH)


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A bit for each key modulo FILTER_BITS; the driver gets FILTER_BITS / 64 numbers at most, whatever the benchmark."""
    bit = F.pmod("key", F.lit(FILTER_BITS))
    words = keys.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(key, {FILTER_BITS}) % 64 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _joined(rows: DataFrame, items: DataFrame, similarity: float, width: int) -> DataFrame:
    """row, digest (of doc_id and text), item_id, n_item, n_shared: the same search by joins, for a benchmark of any size.

    Shingles of documents that pass a filter of fixed size meet the sketches by hash; documents with enough hashes of an item's
    sketch are verified against the item's whole set, so many items at once. Documents are read twice, however large the benchmark.
    """
    spark = rows.sparkSession
    table = stored(_sketch_table(items, similarity, width), "sketches")

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [np.frombuffer(k, np.int64) for k in batch.column("keys").to_pylist()]
            at = np.repeat(np.arange(len(flat)), [len(k) for k in flat])
            parts = [batch.column(c).take(pa.array(at)) for c in ("item", "width", "need")]
            yield pa.RecordBatch.from_arrays([*parts, pa.array(np.concatenate([np.zeros(0, np.int64), *flat]))], names=["item", "width", "need", "key"])

    keys = stored(table.select("item", "width", "need", "keys").mapInArrow(exploded, "item long, width int, need int, key long"), "keys")
    widths = sorted(r[0] for r in keys.select("width").distinct().collect())  # ``width`` at most
    maybe = spark.sparkContext.broadcast(np.packbits(_filter_of(keys)))
    named = rows.select(F.xxhash64("doc_id", "text").alias("row"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "text").where("digest IS NOT NULL")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(maybe.value).astype(bool)
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, _, part, at in pieces(data, offsets):
                words, begins = word_hashes(part, at, APART)
                for w in widths:
                    hashes, of = shingles(words, begins, w)
                    hit = np.flatnonzero(held[hashes % np.uint64(FILTER_BITS)])
                    own = np.unique(np.stack([np.searchsorted(of, hit, side="right") - 1, hashes[hit].view(np.int64)]), axis=1)
                    where = pa.array(own[0] + a)
                    yield pa.RecordBatch.from_arrays([batch.column("row").take(where), batch.column("digest").take(where), pa.array(np.full(own.shape[1], w, np.int32)), pa.array(own[1])], names=["row", "digest", "width", "key"])

    # a shingle of a hot passage meets its sketches in parts: Spark splits the large side of a skewed join
    seen = named.mapInArrow(hashed, "row long, digest string, width int, key long")
    met = seen.join(keys, ["width", "key"]).groupBy("row", "digest", "item").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).where("n >= need")
    near = stored(met.select("row", "digest", "item"), "candidates")
    order = Window.partitionBy("row", "digest").orderBy("item")
    slots = near.withColumn("slot", F.floor((F.row_number().over(order) - 1) / AT_ONCE)).join(table.select("item", "item_id", "width", "n_item", "hashes"), "item")
    asked = slots.groupBy("row", "digest", "slot").agg(F.collect_list(F.struct("item_id", "width", "n_item", "hashes")).alias("asked"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            words, begins = word_hashes(data, offsets, APART)
            out = []
            for k, asked in enumerate(batch.column("asked").to_pylist()):
                own = words[begins[k] : begins[k + 1]]
                sets = {w: np.unique(shingles(own, np.array([0, len(own)]), w)[0]) for w in {x["width"] for x in asked}}
                for x in asked:
                    shared = int(np.isin(np.frombuffer(x["hashes"], np.uint64), sets[x["width"]], assume_unique=True).sum())
                    if shared >= similarity * x["n_item"] - 1e-9:
                        out.append((k, x["item_id"], x["n_item"], shared))
            at = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(at), batch.column("digest").take(at), *(pa.array([x[k] for x in out], pa.int64()) for k in (1, 2, 3))], names=["row", "digest", "item_id", "n_item", "n_shared"])

    return named.join(asked, ["row", "digest"]).mapInArrow(verified, "row long, digest string, item_id long, n_item long, n_shared long").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item (see find_leaks)."""

    def work(batch: pa.RecordBatch, sketches: dict[int, Sketches]) -> pa.RecordBatch:
        stay = np.ones(batch.num_rows, dtype=bool)
        stay[[f[0] for f in _found(batch.column("text"), sketches, similarity)]] = False
        return batch.filter(pa.array(stay))

    sketches = _in_memory(items, similarity, width, block_chars)
    if sketches is not None:
        return _over(docs, sketches, work, docs.schema) if sketches else docs
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_")
    held = docs.select(row).select("row_", F.col("row_.doc_id").cast("long").alias("doc_id"), F.col("row_.text").alias("text"))
    found = _joined(held.select("doc_id", "text"), items, similarity, width).select("row", "digest").distinct()
    named = held.withColumns({"row": F.xxhash64("doc_id", "text"), "digest": F.sha2(F.col("text").cast("binary"), 256)})
    return named.join(found, ["row", "digest"], "left_anti").select("row_.*")
