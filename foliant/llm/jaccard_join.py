"""N-gram Jaccard join with adaptive multi-match prefixes, as components of linked documents.

1. Each task makes the distinct shingles of its texts and deals them by hash range. The task of a range knows how many texts
   have each shingle; it answers with those that several have. So no text is moved, and of a shingle that many texts of a
   task share only one count is.
2. All shingles are ordered by that frequency, rarest first. A text of n shingles must share 0.75 n with any partner, so
   a text with fewer shingles that another has is done. Texts with the same set are one node from here on.
3. Of two linked nodes, the first n - ceil(0.75 n) + l shingles share l at least, for any l. A node takes the l that makes
   lookups and expected verifications cheapest (adaptive prefixes). Some shared shingle is among both prefixes for l = 1, so
   nodes meet in the lists of those; two that met must share min(l, l') shingles of their own, longer prefixes. Only
   prefixes are moved to count these; the other shingles only follow for pairs that have enough.
4. Nodes that share a prefix shingle are compared with a few pivots of its list at a time; links join components, and pairs
   within a component need no comparison. Pivots leave the list once compared with all of it, until no list
   spans components. So copies of one text cost a comparison each, and no pair is left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.components import roots
from foliant.llm.kernels import M1, M2, column_bytes, mixed, pieces, ragged, shingles, word_hashes
from foliant.llm.shared import lookup, release, remove, scratch, stored, tasks

#: Words of a shingle; two texts are linked when the share of common shingles is PERCENT / 100 at least.
WIDTH, PERCENT = 5, 75
#: Text bytes whose shingles are dealt together, and rows at most.
CHUNK_BYTES, CHUNK_ROWS = 8 << 20, 60_000
#: A shingle that so many texts of a chunk have is dealt as a count.
SHARED = 32
#: Cost of a verification, in lookups.
VERIFY = 16.0
#: By so much the number of pivots grows in each round, and how many a list has at most in one: up to that number Spark ranks a list where its parts lie, and a round's pairs stay within so many of its rows.
PIVOTS, MOST_PIVOTS = 32, 1000
LENGTHS = np.array([1, 2, 3, 4, 6, 8, 12, 16])
LOW48 = np.uint64((1 << 48) - 1)
#: Stands for a step between sorted hashes that 32 bits can't hold.
WIDE = np.uint64((1 << 32) - 1)
NO_ROW = 0xFFFF


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], dtype="<i8").tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data, "<i8", len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


def _steps(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes as steps of 32 bits, and the steps that are too wide for these."""
    step = np.diff(h, prepend=np.uint64(0))
    wide = step >= WIDE
    return np.where(wide, WIDE, step).astype("<u4"), step[wide]


def _walked(step: np.ndarray, wide: np.ndarray) -> np.ndarray:
    out = step.astype(np.uint64)
    out[out == WIDE] = wide
    return np.cumsum(out, dtype=np.uint64)


DEALT = pa.schema([("to", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
SETS = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("node2", pa.int64()), ("tokens", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _chunk_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all rows, the row of each, and the number of each row."""
    sets = []
    for _, _, part, at in pieces(data, offsets):
        found, begins = shingles(*word_hashes(part, at), width)
        sets += [np.unique(found[a:b]) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), sizes), sizes


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _deal(ranges: int, width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b, part, at in pieces(data, offsets, CHUNK_BYTES):
                for x in range(a, b, CHUNK_ROWS):
                    y = min(b, x + CHUNK_ROWS)
                    own = at[x - a : y - a + 1]
                    hashes, row, sizes = _chunk_sets(part[own[0] : own[-1]], own - own[0], width)
                    ids, ties = batch.column("doc_id").slice(x, y - x), batch.column("tie").slice(x, y - x)
                    yield _batch(_chunk(chunk, hashes, row, sizes, ids, ties, ranges), DEALT)
                    chunk += 1

    return work


def _chunk(chunk: int, hashes: np.ndarray, row: np.ndarray, sizes: np.ndarray, ids: pa.Array, ties: pa.Array, ranges: int) -> list[tuple]:
    node, node2 = mixed(_sums(mixed(hashes ^ M1), sizes) + sizes.astype(np.uint64)), _sums(mixed(hashes * M2), sizes)
    order = np.argsort(hashes)
    h, row = hashes[order], row[order].astype("<u2")
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(h)))
    many = counts >= SHARED
    shared = np.repeat(many, counts)
    hot = h[starts[many]] >> np.uint64(16)
    present = np.array([x is not None for x in ids.to_pylist()], dtype=np.uint8)
    meta = _pack(ids.fill_null(0).to_numpy(), present, ties.to_numpy(), sizes, node, node2, h[shared] >> np.uint64(16), row[shared])
    out = [(chunk % ranges, chunk, 1, meta)]
    h, row = h[~shared], row[~shared]
    bounds = (np.arange(ranges + 1, dtype=object) * (1 << 64) // ranges)[:-1].astype(np.uint64)
    at, hot_at = np.append(np.searchsorted(h, bounds), len(h)), np.append(np.searchsorted(hot, bounds >> np.uint64(16)), len(hot))
    for r in range(ranges):
        a, b, c, d = at[r], at[r + 1], hot_at[r], hot_at[r + 1]
        if a < b or c < d:
            out.append((r, chunk, 0, _pack(*_steps(h[a:b] >> np.uint64(16)), row[a:b], *_steps(hot[c:d]), counts[many][c:d].astype("<u4"))))
    return out


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In the task of a range: which of its shingles several texts have, and how many do, for each chunk that asked."""
    asked: dict[int, list] = defaultdict(list)
    for batch in batches:
        to, chunk, kind, payload = (c.to_pylist() for c in batch.columns)
        passed = [(t, c, k, p) for t, c, k, p in zip(to, chunk, kind, payload, strict=True) if k == 1]
        if passed:
            yield _batch(passed, DEALT)
        for t, c, k, p in zip(to, chunk, kind, payload, strict=True):
            if k == 0:
                asked[t].append((c, p))
    for t in list(asked):
        chunks, payloads = zip(*asked.pop(t), strict=True)
        parts = [_unpack(p, "<u4", "<u8", "<u2", "<u4", "<u8", "<u4") for p in payloads]
        h = np.concatenate([x for p in parts for x in (_walked(p[0], p[1]), _walked(p[3], p[4]))])
        row = np.concatenate([x for p in parts for x in (p[2], np.full(len(p[3]), NO_ROW, "<u2"))])
        n = np.concatenate([x for p in parts for x in (np.ones(len(p[0]), "<u4"), p[5])])
        at = np.cumsum([0] + [len(p[0]) + len(p[3]) for p in parts])
        _, which = np.unique(h, return_inverse=True)
        texts = np.bincount(which, weights=n)[which]
        several = texts >= 2
        rank = np.minimum(np.floor(8 * np.log2(np.maximum(texts, 1))), 254).astype(np.uint8)
        for i, c in enumerate(chunks):
            own = slice(at[i], at[i + 1])
            some = several[own]
            if some.any():
                shared = h[own][some]
                order = np.argsort(shared, kind="stable")
                yield _batch([(t, c, 2, _pack(*_steps(shared[order]), row[own][some][order], rank[own][some][order]))], DEALT)


def _gather(percent: int):
    """For each chunk: its texts with their shared shingles in order, or none if they can't have a partner."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        metas: dict[int, bytes] = {}
        answers: dict[int, list[bytes]] = defaultdict(list)
        for batch in batches:
            _, chunk, kind, payload = (c.to_pylist() for c in batch.columns)
            for c, k, p in zip(chunk, kind, payload, strict=True):
                if k == 1:
                    metas[c] = p
                else:
                    answers[c].append(p)
        if answers.keys() - metas.keys():
            raise RuntimeError("a chunk of texts changed while it was asked for; run the query again")
        for c in list(metas):
            ids, present, ties, sizes, node, node2, hot, hot_row = _unpack(metas.pop(c), "<i8", "u1", "<i8", "<i8", "<u8", "<u8", "<u8", "<u2")
            parts = [_unpack(p, "<u4", "<u8", "<u2", "u1") for p in answers.pop(c, [])]
            token = np.concatenate([np.zeros(0, np.uint64), *((p[3].astype(np.uint64) << np.uint64(48)) | _walked(p[0], p[1]) for p in parts)])
            row = np.concatenate([np.zeros(0, "<u2"), *(p[2] for p in parts)])
            whole = row == NO_ROW
            if len(hot):
                known = token[whole]
                known = known[np.argsort(known & LOW48)]
                hot_token = known[np.searchsorted(known & LOW48, hot)]
                token, row = np.concatenate([token[~whole], hot_token]), np.concatenate([row[~whole], hot_row])
            order = np.argsort(token, kind="stable")
            order = order[np.argsort(row[order], kind="stable")]
            token, shared = token[order], np.bincount(row, minlength=len(ids))
            ends = np.cumsum(shared)
            alive = (shared > 0) & (100 * shared >= percent * sizes)
            tokens = [token[e - s : e].tobytes() if x else None for e, s, x in zip(ends.tolist(), shared.tolist(), alive.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=present == 0), pa.array(ties), pa.array(sizes), pa.array(node.view(np.int64)), pa.array(node2.view(np.int64)), pa.array(tokens, pa.binary())], schema=SETS)

    return work


def prefix(tokens: np.ndarray, n: int, percent: int = PERCENT) -> tuple[int, int]:
    """How many of a node's shared shingles are in its prefix for l = 1, and the l that is cheapest.

    A lookup meets each text of a shingle's list; a pair is expected to be verified for each l met.
    """
    least = -(-percent * n // 100)
    first = n - least + 1 - (n - len(tokens))
    lengths = LENGTHS[LENGTHS <= max(1, len(tokens) - first + 1)]
    met = np.cumsum(np.exp2((tokens >> np.uint64(48)).astype(float) / 8))
    cost = met[first + lengths - 2] * (1 + VERIFY / lengths)
    return first, int(lengths[np.argmin(cost)])


def linked(a: np.ndarray, na: int, b: np.ndarray, nb: int, percent: int = PERCENT) -> bool:
    """Whether two nodes, given by their shared shingles and their numbers of all shingles, are linked."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (na + nb - both)


NODES_DDL = "node long, n long, l int, first long, prefix binary, rest binary"


def _prefixes(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, n, t in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "tokens")), strict=True):
                first, length = prefix(np.frombuffer(t, "<u8"), n, percent)
                rows.append((k, n, length, first, t[: 8 * (first + length - 1)], t[8 * (first + length - 1) :]))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["node", "n", "l", "first", "prefix", "rest"])

    return work


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of the prefixes for l = 1: token, node, n, alone (shingles of no other text) and rest (shared ones from there on)."""
    for batch in batches:
        token, offsets = column_bytes(batch.column("prefix"))
        node, n, first, shared = (batch.column(c).to_numpy() for c in ("node", "n", "first", "shared"))
        at = ragged(offsets[:-1] // 8, first)
        k = ragged(np.zeros(len(first), np.int64), first)
        made = token.view("<i8")[at], np.repeat(node, first), np.repeat(n, first), np.repeat(n - shared, first), np.repeat(shared, first) - k
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=["token", "node", "n", "alone", "rest"])


def _pairs(keep):
    """The pairs a, b of the rows for which keep(row) holds; columns of bytes are arrays of shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[np.frombuffer(x, "<u8") for x in c.to_pylist()] if pa.types.is_binary(c.type) else c.to_pylist() for c in batch.columns]
            stay = [keep(**dict(zip(batch.schema.names, r, strict=True))) for r in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    return work


def enough(a: int, b: int, la: int, lb: int, pa: np.ndarray, pb: np.ndarray) -> bool:
    """Whether two prefixes share as many shingles as linked nodes must, by the shorter of their lengthenings."""
    return len(np.intersect1d(pa, pb, assume_unique=True)) >= min(la, lb)


def shingle_sets(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, tie (a hash of the text), n (shingles), node and node2 (128 bits that name the set), tokens (null: no partner)."""
    ranges = tasks(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    dealt = rows.mapInArrow(_deal(ranges, width), "to int, chunk long, kind int, payload binary").repartitionById(ranges, F.col("to"))
    answers = dealt.mapInArrow(_answer, "to int, chunk long, kind int, payload binary").repartition(ranges, "chunk")
    return answers.mapInArrow(_gather(percent), "doc_id long, tie long, n long, node long, node2 long, tokens binary")


def _components(nodes: DataFrame, percent: int, root: str) -> DataFrame:
    """node, comp for the nodes that have links. Each round's tables go below root and are deleted once the next has its own."""
    spark = nodes.sparkSession

    def verify(a: int, b: int, na: int, nb: int, pa: np.ndarray, pb: np.ndarray, ra: np.ndarray, rb: np.ndarray) -> bool:
        return linked(np.concatenate([pa, ra]), na, np.concatenate([pb, rb]), nb, percent)

    def side(c: str, **columns: str) -> DataFrame:
        return nodes.select(F.col("node").alias(c), *(F.col(v).alias(f"{k}{c}") for k, v in columns.items()))

    whole = nodes.select("node", "n", "first", "prefix", ((F.octet_length("prefix") + F.octet_length("rest")) / 8).cast("long").alias("shared"))
    live = stored(whole.mapInArrow(_postings, "token long, node long, n long, alone long, rest long"), "postings", root)
    comp, pivots, turn, folder = None, 1, 0, f"{root}/postings"
    while not live.isEmpty():
        mine = f"{root}/round-{turn}"
        now = live.withColumn("comp", F.col("node")) if comp is None else live.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        open_lists = now.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token")
        now = stored(now.join(open_lists, "token").select("token", "node", "n", "alone", "rest", "comp"), "open", mine)
        remove(spark, folder)
        # what the copies of a text were made from has few shingles of its own, and is linked with most of them
        order = Window.partitionBy("token").orderBy(F.col("alone") / F.col("n"), F.xxhash64("node"), "node")
        chosen = stored(now.withColumn("k", F.row_number().over(order)).where(F.col("k") <= pivots).select("token", F.col("node").alias("pivot"), F.col("n").alias("pn"), F.col("rest").alias("prest"), F.col("comp").alias("pcomp")), "pivots", mine)
        # where two linked nodes meet first, what both have from there on holds all they share; other meetings may be dropped
        met = now.join(chosen, "token").where(f"comp <> pcomp and 100 * n >= {percent} * pn and 100 * pn >= {percent} * n and {100 + percent} * least(rest, prest) >= {percent} * (n + pn)")
        pairs = stored(met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "pairs", mine)
        likely = pairs.join(side("a", l="l", p="prefix"), "a").join(side("b", l="l", p="prefix"), "b").select("a", "b", "la", "lb", "pa", "pb").mapInArrow(_pairs(enough), "a long, b long")
        likely = stored(likely, "likely", mine)
        sides = likely.join(side("a", n="n", p="prefix", r="rest"), "a").join(side("b", n="n", p="prefix", r="rest"), "b")
        links = stored(sides.select("a", "b", "na", "nb", "pa", "pb", "ra", "rb").mapInArrow(_pairs(verify), "a long, b long"), "links", mine)
        if comp is not None:
            of = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
            joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
            links = joined.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
        found = roots(links, f"{mine}/roots")
        if comp is None:
            comp = stored(found.withColumnRenamed("root", "comp"), f"comp-{turn}", root)
        else:
            grown = comp.join(found.select(F.col("node").alias("comp"), "root"), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
            fresh = found.select("node", F.col("root").alias("comp")).join(comp.select("node"), "node", "left_anti")
            comp = stored(grown.unionByName(fresh), f"comp-{turn}", root)
            remove(spark, f"{root}/comp-{turn - 1}")
        live = now.join(chosen.select("token", F.col("pivot").alias("node")), ["token", "node"], "left_anti").select("token", "node", "n", "alone", "rest")
        pivots, turn, folder = min(pivots * PIVOTS, MOST_PIVOTS), turn + 1, mine
        release(spark)
    return comp if comp is not None else nodes.select("node", F.col("node").alias("comp")).limit(0)


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, tie (xxhash64 of the text), n_shingles, component_id.

    docs: doc_id, text; other columns are ignored. Words are runs of other bytes than ASCII white space, A-Z as a-z. A text's set
    holds its distinct runs of ``width`` words, or all its words as one if they are fewer. Null and blank texts have no
    shingles and no links. component_id is the smallest doc_id that links reach, that of the row itself included; null ids
    count as the largest. Repeated rows and texts are linked. An empty table gives no rows.
    """
    spark = docs.sparkSession
    root = scratch(spark, "jaccard")
    sets = stored(shingle_sets(docs, width, percent), "sets", root)
    release(spark)
    whole = sets.where(F.col("tokens").isNotNull()).select("node", "n", "tokens").dropDuplicates(["node"])
    nodes = stored(whole.mapInArrow(_prefixes(percent), NODES_DDL), "nodes", root)
    sets = stored(sets.drop("tokens"), "rows", root)
    remove(spark, f"{root}/sets")
    release(spark)
    full = sets.where("n > 0")
    classes = stored(full.groupBy("node", "node2", "n").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "classes", root)
    comp = _components(nodes, percent, root)
    own = classes.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    own = stored(own, "own", root)
    lowest = own.groupBy("comp").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    placed = stored(lookup(own, lowest, ["comp"], "nodes").select("node", "node2", "n", "copies", "component_id"), "placed", root)
    found = lookup(full, placed, ["node", "node2", "n"], "copies")
    blank = sets.where("n = 0").select("doc_id", "tie", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.select("doc_id", "tie", F.col("n").alias("n_shingles"), "component_id").unionByName(blank)


def near_dedup(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with their columns: one of each component stays, that with the smallest doc_id (then the smallest tie).

    Blank texts are linked with nothing and stay; repeated rows with the same id and text count once.
    """
    rows = jaccard_components(docs, width, percent)
    best = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "tie")
    linked_rows = rows.where("n_shingles > 0").groupBy(F.coalesce("component_id", F.lit(-1)).alias("of"), F.when(F.col("component_id").isNull(), F.col("tie")).alias("alone")).agg(F.min(best).alias("best"))
    keep = linked_rows.select("best.doc_id", "best.tie").unionByName(rows.where("n_shingles = 0").select("doc_id", "tie").distinct())
    keep = keep.select(F.col("doc_id").alias("keep_id"), F.col("tie").alias("keep_tie"))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_tie"))
    kept = row.join(keep, F.col("own_id").eqNullSafe(F.col("keep_id")) & (F.col("own_tie") == F.col("keep_tie")), "left_semi")
    return kept.dropDuplicates(["own_id", "own_tie"]).select("row.*")
