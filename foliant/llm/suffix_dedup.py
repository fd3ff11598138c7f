"""Removal of repeated passages by sorting suffixes, with a difference cover for long ties.

A passage is a string of ``length`` bytes; each byte of one that also starts earlier goes. Sorting every suffix of a corpus
would move each byte many times over, so only suffixes whose passage may occur twice are sorted:

1. Each passage has an anchor, its gram of GRAM bytes with the least hash: equal passages have equal anchors. Passages in
   a row with one anchor are a cell; a cell is named by hashes of its anchor and of all its bytes. Cells are dealt by anchor
   (some 3 % of positions; of equal cells in a task only the first). A cell equal to an earlier one is repeated as a whole. A
   cell alone with its anchor repeats nothing. The first ones of several different cells with the same anchor remain.
2. The bytes of those cells are fetched and dealt by anchor. A task builds the sparse suffix array of its cells'
   passages, one bucket of suffixes at a time: it sorts a bucket by the first PERIOD bytes, and resolves ties by the
   ranks of a difference-cover sample, which are computed once. Neighbours that agree in ``length`` bytes are the same
   passage; all but the first occurrence are repeated.
3. An anchor of more cells than HOT_CELLS, as around the ends of a passage that many texts have, would keep one task busy. The
   passages of its cells are named by 128-bit hashes (as cells are) and counted by Spark instead, pre-aggregated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.kernels import LOW_BYTES, M1, M2, PIECE, column_bytes, eights, mixed, pieces, powers, ragged
from foliant.llm.shared import HOT_KEYS, lookup, release, remove, scratch, small, stored, tasks

#: Bytes of a passage, of a gram, and of a period of the difference cover.
LENGTH, GRAM, PERIOD = 100, 24, 32
#: Text bytes whose equal cells are told apart in one go, and suffixes sorted as one bucket at most (more if they tie).
CHUNK_BYTES, BUCKET = 2 << 20, 1 << 17
#: Bytes of cells whose passages are sorted together (more if they share an anchor).
BLOCK = 1 << 20
#: An anchor with more different cells than this is dealt by passages, those of so many cells in a batch.
HOT_CELLS, CELLS_AT_ONCE = 1000, 4096
#: One in so many texts is looked at to see which cells are common.
SEEN = 16
#: Bits of a position in a piece; a longer text is cut into overlapping segments of SEGMENT passages.
POSITION, SEGMENT = 20, 1 << 18


def difference_cover(period: int) -> tuple[np.ndarray, np.ndarray]:
    """Residues of which any two offsets have a pair at the same distance, and for each two residues that distance."""
    cover, seen = [0, 1], {0, 1, period - 1}
    while len(seen) < period:
        gain = lambda c: len({(c - d) % period for d in cover} | {(d - c) % period for d in cover} | seen)
        best = max(range(period), key=gain)
        seen |= {(best - d) % period for d in cover} | {(d - best) % period for d in cover}
        cover.append(best)
    inside = np.zeros(period, dtype=bool)
    inside[cover] = True
    k = np.arange(period)
    shift = np.array([[int(np.flatnonzero(inside[(i + k) % period] & inside[(j + k) % period])[0]) for j in range(period)] for i in range(period)])
    return inside, shift


INSIDE, SHIFT = difference_cover(PERIOD)


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The PERIOD bytes at each position, as rows of numbers in the order of the bytes."""
    view = eights(text)
    return np.stack([view[at + k].byteswap() for k in range(0, PERIOD, 8)], axis=1)


def _order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows, and which rows in that order differ from the one before."""
    order = np.lexsort(words.T[::-1])
    ranked = words[order]
    return order, np.r_[True, (ranked[1:] != ranked[:-1]).any(axis=1)] if len(order) else np.zeros(0, bool)


def sample_ranks(text: np.ndarray, n: int, length: int) -> np.ndarray:
    """For each position in the cover its rank by the next ``length`` bytes or more (-1 elsewhere); text has 4 x length bytes more than n."""
    at = np.flatnonzero(INSIDE[np.arange(n) % PERIOD])
    rank = np.full(n + PERIOD, -1, dtype=np.int64)
    order, new = _order(_words(text, at))
    rank[at[order]] = np.cumsum(new)
    depth = PERIOD
    while depth < length:
        after = np.zeros(len(at), dtype=np.int64)
        inner = at + depth < n
        after[inner] = rank[at[inner] + depth]  # a multiple of the period further: in the cover too
        _, which = np.unique(rank[at] * (len(at) + 2) + after, return_inverse=True)
        rank[at] = which + 1
        depth *= 2
    return rank


def sort_suffixes(text: np.ndarray, n: int, at: np.ndarray, length: int, bucket: int = BUCKET) -> Iterator[np.ndarray]:
    """The suffixes that start at the positions ``at``, in order by their first ``length`` bytes, one bucket after the other.

    Equal suffixes (in that many bytes) are neighbours and in one bucket. text has 4 x length bytes more than n.
    """
    rank = sample_ranks(text, n, length)
    lead = eights(text)[at].byteswap()
    by_lead = np.argsort(lead, kind="stable")
    at, lead = at[by_lead], lead[by_lead]
    a = 0
    while a < len(at):
        b = min(a + bucket, len(at))
        b = int(np.searchsorted(lead, lead[b - 1], side="right"))
        own = at[a:b]
        a = b
        order, new = _order(_words(text, own))
        own, group = own[order], np.cumsum(new) - 1
        size = np.bincount(group)
        open_at = np.flatnonzero(size[group] > 1)
        while len(open_at):
            g = group[open_at]
            first = np.r_[True, g[1:] != g[:-1]]
            starts = np.flatnonzero(first)
            counts = np.diff(np.append(starts, len(g)))
            here, pivot = own[open_at], np.repeat(own[open_at][starts + counts // 2], counts)
            k = SHIFT[here % PERIOD, pivot % PERIOD]
            side = np.sign(rank[here + k] - rank[pivot + k])
            order = np.lexsort((side, np.repeat(np.arange(len(starts)), counts)))
            own[open_at], side = here[order], side[order]
            key = np.repeat(np.arange(len(starts)), counts) * 3 + side + 1
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            many = np.diff(np.append(cut, len(key)))
            more = np.repeat((many > 1) & (side[cut] != 0), many)
            group[open_at] = np.repeat(np.arange(len(cut)), many)
            open_at = open_at[more]
        yield own


def repeated(text: np.ndarray, at: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Which of the passages at the positions ``at`` equal one of smaller rank; rank orders them by where they occur."""
    n = len(text)
    text = np.concatenate([text, np.zeros(4 * length + PERIOD, np.uint8)])
    place = np.zeros(n, dtype=np.int64)
    place[at] = np.arange(len(at))
    out = np.zeros(len(at), dtype=bool)
    for own in sort_suffixes(text, n, at, length):
        same = np.zeros(len(own), dtype=bool)
        for a in range(1, len(own), 1 << 15):
            b = min(len(own), a + (1 << 15))
            rows = text[own[a - 1 : b, None] + np.arange(length)]
            same[a:b] = (rows[1:] == rows[:-1]).all(axis=1)
        kind, which = np.cumsum(~same), place[own]
        order = np.lexsort((rank[which], kind))
        first = np.r_[True, kind[order][1:] != kind[order][:-1]]
        out[which[order][~first]] = True
    return out


def cells(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of whole rows: anchor hash, hash of all bytes, row, first passage (its start in the row) and last minus first."""
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    n = len(data)
    if not counts.sum():
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    view = eights(data)
    gram = mixed(mixed(mixed(view[: n - GRAM + 1]) ^ view[8 : n - GRAM + 9]) ^ view[16 : n - GRAM + 17])
    # a span's hash is made of those of its grams, which aren't linear in its bytes
    total = np.zeros(len(gram) + 1, dtype=np.uint64)
    np.cumsum(gram * powers(len(gram)), out=total[1:])
    inverse = powers(len(gram) + 1, inverse=True)
    least = (gram & ~np.uint64((1 << POSITION) - 1)) | np.arange(len(gram), dtype=np.uint64)
    width, wide = 1, length - GRAM + 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wide:
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    at = ragged(offsets[:-1], counts)
    anchor = (least[at] & np.uint64((1 << POSITION) - 1)).astype(np.int64)
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    begin, end = at[first], at[last]
    row = np.searchsorted(offsets, begin, side="right") - 1
    shape = (end - begin).astype(np.uint64) * M1 + (anchor[first] - begin).astype(np.uint64) * M2
    span = mixed(((total[end + length - GRAM + 1] - total[begin]) * inverse[begin]) ^ shape)
    return gram[anchor[first]], span, row, begin - offsets[row], end - begin


def _segments(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    for a, _, part, own in pieces(data, offsets):
        if len(part) <= PIECE:
            anchor, span, row, start, more = cells(part, own, length)
            yield anchor, span, row + a, start, more
        else:  # one long text
            for x in range(0, len(part) - length + 1, SEGMENT):
                seg = part[x : x + SEGMENT + length - 1]
                anchor, span, row, start, more = cells(seg, np.array([0, len(seg)]), length)
                yield anchor, span, row + a, start + x, more


CELLS = pa.schema([("anchor", pa.int64()), ("span", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("more", pa.int16()), ("again", pa.bool_())])
CELLS_DDL = "anchor long, span long, key long, start int, more short, again boolean"
FOUND = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("start", pa.int64()), ("more", pa.int64()), ("anchor", pa.int64())])
FOUND_DDL = "key long, kind int, start long, more long, anchor long"
REPEAT, ASK, SPREAD = range(3)


def _found(key: np.ndarray, kind: int, start: np.ndarray, more: np.ndarray, anchor: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(np.full(len(key), kind, np.int32)), pa.array(start.astype(np.int64)), pa.array(more.astype(np.int64)), pa.array(anchor.view(np.int64))], schema=FOUND)


def _cells_of(length: int):
    """The cells of all texts; again: one of the same chunk that equals it comes earlier."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            keys = batch.column("key").to_numpy()
            for a, _, part, own in pieces(data, offsets, CHUNK_BYTES):
                found = [np.concatenate(x) for x in zip(*_segments(part, own, length), strict=True)]
                if not found or not len(found[0]):
                    continue
                anchor, span, row, start, more = found
                key = keys[row + a]
                order = np.lexsort((start, key, span, anchor))
                anchor, span, key, start, more = (x[order] for x in (anchor, span, key, start, more))
                again = np.r_[False, (span[1:] == span[:-1]) & (anchor[1:] == anchor[:-1])]
                made = anchor.view(np.int64), span.view(np.int64), key, start.astype(np.int32), more.astype(np.int16), again
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, CELLS, strict=True)], schema=CELLS)

    return work


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells in order of anchor, span, key and start: those that repeat an earlier one, and the first ones of several with an anchor.

    Cells of hot anchors are dealt by their spans too, so each first one is asked for, as others may be elsewhere.
    A batch at a time: from the one before stay the last anchor and span, how many first ones the anchor has (two stand for
    more), and the only first one, which is asked for once a second one comes.
    """
    last, count, alone = None, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, span, key, start, more = (batch.column(c).to_numpy() for c in ("anchor", "span", "key", "start", "more"))
        goes_on = last is not None and anchor[0] == last[0]
        same_anchor = np.r_[goes_on, anchor[1:] == anchor[:-1]]
        again = same_anchor & np.r_[goes_on and span[0] == last[1], span[1:] == span[:-1]]
        group = np.cumsum(~same_anchor) - (0 if goes_on else 1)
        many = np.bincount(group[~again], minlength=group[-1] + 1)
        if goes_on:
            if count == 1 and many[0]:
                first, *rest = (np.array([x], dtype=np.int64) for x in alone)
                yield _found(first, ASK, *rest)
            many[0] += count
        yield _found(key[again], REPEAT, start[again], more[again], np.zeros(int(again.sum()), np.int64))
        hot = batch.column("hot").to_numpy(zero_copy_only=False)
        several = ~again & ((many[group] > 1) | hot)
        yield _found(key[several], ASK, start[several], more[several], anchor[several])
        last, count = (anchor[-1], span[-1]), 2 if hot[-1] else min(int(many[-1]), 2)
        own = np.flatnonzero(~again & (group == group[-1]))
        if count == 1 and len(own):
            alone = key[own[0]], start[own[0]], more[own[0]], anchor[own[0]]


def passage_hashes(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the ``length`` bytes at each position."""
    view, one, two = eights(data), np.full(len(at), M1), np.full(len(at), M2)
    for k in range(0, length, 8):
        part = view[at + k] & LOW_BYTES[min(8, length - k)]
        one, two = mixed(one ^ part), mixed(two + part * M1)
    return one, two


FETCHED = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("start", pa.int64()), ("more", pa.int64()), ("anchor", pa.int64()), ("bytes", pa.binary()), ("one", pa.int64()), ("two", pa.int64())])
FETCHED_DDL = "kind int, key long, start long, more long, anchor long, bytes binary, one long, two long"


def _rows(kind: int, key: np.ndarray, start: np.ndarray, more: np.ndarray, **others: pa.Array) -> pa.RecordBatch:
    made = {"kind": np.full(len(key), kind), "key": key, "start": start, "more": more} | others
    return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else pa.nulls(len(key), f.type) for f in FETCHED], schema=FETCHED)


def _fetch(length: int):
    """The bytes of the cells asked for (ASK); of those with a hot anchor the passages with their hashes (SPREAD), without those that equal an earlier one of the same batch (REPEAT, in runs)."""

    def spread(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, key: np.ndarray, start: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
        many = more + 1
        begin, key = ragged(start, many), np.repeat(key, many)
        one, two = passage_hashes(data, begin + np.repeat(offsets[row], many), length)
        order = np.lexsort((begin, key, two, one))
        key, begin, one, two = (x[order] for x in (key, begin, one, two))
        again = np.r_[False, (one[1:] == one[:-1]) & (two[1:] == two[:-1])]
        yield _rows(SPREAD, key[~again], begin[~again], np.zeros(int((~again).sum()), np.int64), one=one[~again].view(np.int64), two=two[~again].view(np.int64))
        if again.any():
            order = np.lexsort((begin[again], key[again]))
            key, begin = key[again][order], begin[again][order]
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (begin[1:] != begin[:-1] + 1)])
            yield _rows(REPEAT, key[first], begin[first], begin[np.append(first[1:], len(begin)) - 1] - begin[first])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            asked = batch.column("asked")
            row = np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy())
            key, (start, more, anchor) = batch.column("key").to_numpy()[row], (asked.flatten().field(c).to_numpy() for c in ("start", "more", "anchor"))
            hot = asked.flatten().field("hot").to_numpy(zero_copy_only=False)
            raw, at = data.tobytes(), (offsets[row] + start)[~hot]
            cells = [raw[a : a + n + length] for a, n in zip(at.tolist(), more[~hot].tolist(), strict=True)]
            yield _rows(ASK, key[~hot], start[~hot], more[~hot], anchor=anchor[~hot], bytes=pa.array(cells, pa.binary()))
            own = np.flatnonzero(hot)
            for a in range(0, len(own), CELLS_AT_ONCE):
                some = own[a : a + CELLS_AT_ONCE]
                yield from spread(data, offsets, *(x[some] for x in (row, key, start, more)))

    return work


def _sorted_cells(length: int):
    """Rows come in order of their anchors; whole anchors of about BLOCK bytes are sorted at a time."""

    def passages(block: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(block)
        key, start, more = (whole.column(c).to_numpy() for c in ("key", "start", "more"))
        text, offsets = column_bytes(whole.column("bytes"))
        many = more + 1
        at = ragged(offsets[:-1], many)
        key, begin = np.repeat(key, many), ragged(start, many)
        order = np.lexsort((begin, key))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        again = repeated(text, at, rank, length)
        none = np.zeros(int(again.sum()), np.int64)
        return _found(key[again], REPEAT, begin[again], none, none.astype(np.uint64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, last = [], 0, None
        for batch in batches:
            anchor = batch.column("anchor").to_numpy()
            cuts = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(anchor)] if len(anchor) else []
            a = 0
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if size >= BLOCK and anchor[x] != last:
                    if x > a:
                        block.append(batch.slice(a, x - a))
                    yield passages(block)
                    block, size, a = [], 0, x
                size += int(batch.column("more").slice(x, y - x).to_numpy().sum()) + (y - x) * length
                last = anchor[x]
            if a < batch.num_rows:
                block.append(batch.slice(a))
        if block:
            yield passages(block)

    return work


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("kept", pa.binary())])


def _kept(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            raw, spans, kept = data.tobytes(), [], []
            for i, found in enumerate(batch.column("found").to_pylist()):
                text = raw[offsets[i] : offsets[i + 1]]
                runs: list[list[int]] = []
                for a, b in sorted((x["start"], x["start"] + x["more"] + length) for x in found or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                ends = [0, *(x for r in runs for x in r), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
                spans.append([{"first": a, "last": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(spans, KEPT.field("spans").type), pa.array(kept, pa.binary())], schema=KEPT)

    return work


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and key: numbers that order the rows as doc_id does, each once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if rows.where(F.col("doc_id").isNull()).isEmpty() and rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows.withColumn("key", F.col("doc_id"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    return stored(rows.repartitionByRange(tasks(docs.sparkSession), *order).sortWithinPartitions(*order).withColumn("key", F.monotonically_increasing_id()), "keyed")


def _hot_apart(cells: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """cells with hot (whether their anchor is common), without the repeats of the most common ones; and those repeats.

    Which cells and anchors are common is seen in the share of texts whose key's hash is 0 modulo SEEN. Of common cells all rows are
    judged, where they lie, against the first of all, which is found by a combined minimum. So no task gets all cells of a
    popular passage; a cell that the share doesn't show as common is judged like all others.
    """
    name = ["anchor", "span"]
    share = cells.where(F.pmod(F.xxhash64("key"), F.lit(SEEN)) == 0).select(*name)
    common = lambda keys: share.groupBy(*keys).count().where(F.col("count") > HOT_CELLS // SEEN).orderBy(F.col("count").desc(), *keys).limit(HOT_KEYS).select(*keys)
    anchors = stored(common(["anchor"]), "hot-anchors", root)
    if anchors.isEmpty():
        return cells.withColumn("hot", F.lit(False)), cells.limit(0)
    cells = cells.join(F.broadcast(anchors.withColumn("hot", F.lit(True))), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    hot = stored(common(name), "hot", root)
    firsts = stored(cells.join(F.broadcast(hot), name).groupBy(*name).agg(F.min(F.struct("key", "start")).alias("first")), "hot-firsts", root)
    found = cells.join(F.broadcast(firsts), name, "left")
    later = F.coalesce(F.struct("key", "start") != F.col("first"), F.lit(False))
    return found.where(~later).drop("first"), found.where(later).drop("first")


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans (first, last: removed bytes first..last-1, maximal runs) and kept (the other bytes).

    docs: doc_id, text; other columns are ignored. Texts are UTF-8 bytes, a null one is empty; passages don't cross texts.
    All are judged on the input. Rows without doc_id come last; rows that share one, by a hash of their text (of equal
    rows, one is the later). Texts of fewer than ``length`` bytes stay whole. An empty table gives no rows.
    """
    ranges = tasks(docs.sparkSession)
    rows = _keyed(docs)
    root = scratch(docs.sparkSession, "suffixes")
    cells = stored(rows.select("key", "text").mapInArrow(_cells_of(length), CELLS_DDL), "cells", root)
    once, repeated_hot = _hot_apart(cells.where("not again").drop("again"), root)
    place = F.when(F.col("hot"), F.xxhash64("anchor", "span")).otherwise(F.col("anchor"))
    dealt = once.repartition(ranges, place).sortWithinPartitions("anchor", "span", "key", "start")
    judged = stored(dealt.mapInArrow(_judge, FOUND_DDL), "judged", root)
    release(docs.sparkSession)
    asks = judged.where(F.col("kind") == ASK).select("key", "start", "more", "anchor")
    hot = small(asks.groupBy("anchor").count().where(F.col("count") > HOT_CELLS).select("anchor", F.lit(True).alias("hot")))
    told = F.struct("start", "more", "anchor", F.col("hot").isNotNull().alias("hot"))
    asked = asks.join(hot, "anchor", "left").groupBy("key").agg(F.collect_list(told).alias("asked"))
    fetched = stored(rows.select("key", "text").join(asked, "key").mapInArrow(_fetch(length), FETCHED_DDL), "fetched", root)
    release(docs.sparkSession)
    of_kind = lambda df, kind: df.where(F.col("kind") == kind)
    alone = of_kind(fetched, ASK).select("key", "start", "more", "anchor", "bytes").repartition(ranges, "anchor").sortWithinPartitions("anchor")
    sorted_ = stored(alone.mapInArrow(_sorted_cells(length), FOUND_DDL), "sorted", root)
    spread = of_kind(fetched, SPREAD).select("key", "start", "more", "one", "two")
    firsts = spread.groupBy("one", "two").agg(F.min(F.struct("key", "start")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    later = lookup(spread, stored(firsts, "firsts", root), ["one", "two"], "times").where(F.struct("key", "start") != F.col("first"))
    repeats = cells.where("again").unionByName(repeated_hot, True).unionByName(of_kind(judged, REPEAT), True).unionByName(of_kind(fetched, REPEAT), True).unionByName(sorted_, True).unionByName(later, True).select("key", "start", "more")
    found = stored(repeats.groupBy("key").agg(F.collect_list(F.struct("start", "more")).alias("found")), "found", root)
    for name in ("cells", "judged", "fetched", "sorted", "firsts", "hot", "hot-anchors", "hot-firsts"):
        remove(docs.sparkSession, f"{root}/{name}")
    release(docs.sparkSession)
    joined = rows.join(found, "key", "left").select("doc_id", "text", "found")
    return joined.mapInArrow(_kept(length), "doc_id long, n_bytes long, spans array<struct<first: long, last: long>>, kept binary")
