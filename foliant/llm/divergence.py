"""How far the sources of each language differ in their terms.

Pairs of sources are summed over terms in two parts. Each pair starts with what it would differ by if no term occurred in
either; terms add the difference to that. Terms present in many sources are rows of dense numpy tiles; those in few are postings, of
which only sources that have the term are touched: one-sided differences by sorted shares, two-sided ones by pairs of a posting.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.shared import lookup, stored

#: A share in units of 1 / SCALE, of counts with PRIOR added to each.
SCALE, PRIOR = 1_000_000_000, 5
#: A term is kept in a language if so many of its documents have it; how many terms of a group are listed.
LEAST, TOP = 30, 50
#: A term in this share of a language's sources or more is summed in tiles.
HEAVY = 0.25
#: Sources of a block (a task holds a matrix of two blocks), and occurrences of terms that a task is dealt at least.
BLOCK, SLICE = 512, 50_000
#: Different terms that a task counts before it hands them on, bytes of a text that are split at once, and cells of a tile.
HELD, PIECE, CELLS = 200_000, 1 << 20, 1 << 20

#: For bytes.translate: A-Z in lower case, other letters and all bytes of other alphabets as they are, the rest blank.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time; a long text is cut at blanks."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + PIECE)
        while end < n and TERMS[text[end]] != 32:  # a term is whole
            step = text[end : end + PIECE].translate(TERMS).find(b" ")
            end = min(n, end + PIECE) if step < 0 else end + step
        yield text[at:end].translate(TERMS).split()
        at = end


COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: how often a term occurs in a group and in how many documents; each group has a row without term (null, 0, 0)."""

    def handed(counts: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        groups = list(counts)
        of = pa.array(np.repeat(np.arange(len(groups)), [1 + len(n) for n, _ in counts.values()]))
        terms, times, docs = [], [], []
        for n, d in counts.values():  # both have their terms in the order in which they came
            terms += [None, *n]
            times += [0, *n.values()]
            docs += [0, *d.values()]
        counts.clear()
        names = [pa.array([g[k] for g in groups], pa.string()).take(of) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*names, pa.array(terms, pa.binary()), pa.array(times, pa.int64()), pa.array(docs, pa.int64())], schema=COUNTED)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for text, lang, source in zip(*(batch.column(c) for c in ("text", "lang", "source")), strict=True):
                n, docs = counts.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                held -= len(n)
                own: dict[bytes, None] = {}
                for some in terms_of(text.as_py()):
                    n.update(some)
                    own.update(dict.fromkeys(some))
                docs.update(own.keys())
                held += len(n)
                if held > HELD:
                    yield handed(counts)
                    held = 0
        yield handed(counts)

    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))
    counted = rows.mapInArrow(work, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * n / total) for 0 <= n <= total, in steps of three digits, as the product would leave 64 bits."""
    out, rest = F.lit(1).cast("long"), n
    for weight in (SCALE // 1000, SCALE // 1_000_000, 1):
        out = out + F.call_function("div", rest * 1000, total) * weight
        rest = (rest * 1000) % total
    return out


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same in numpy."""
    out, rest = np.ones(np.broadcast(n, total).shape, dtype=np.int64), n
    for weight in (SCALE // 1000, SCALE // 1_000_000, 1):
        q, rest = np.divmod(rest * 1000, total)
        out += weight * q
    return out


def pair_sums(term: np.ndarray, source: np.ndarray, n: np.ndarray, present: np.ndarray, totals: np.ndarray, sources: int, split: int | None = None, heavy: float = HEAVY) -> np.ndarray:
    """For pairs of sources the sum over terms of |p - q| less |base - base|, as if a term were in neither.

    term, source, n: occurrences, ordered by term; present: in how many of the language's ``sources`` a term is. totals: what a
    source's counts and priors add up to. The first ``split`` sources are rows, the others columns; without it, all are both.
    """
    base = shares(np.full(len(totals), PRIOR, dtype=np.int64), totals)
    rows = np.arange(len(totals) if split is None else split)
    columns = rows if split is None else np.arange(split, len(totals))
    apart = np.abs(base[rows][:, None] - base[columns])
    out = np.zeros((len(rows), len(columns)), dtype=np.int64)
    p = shares(n + PRIOR, totals[source])
    dense = present >= heavy * sources
    # tiles of whole terms
    at, own, q = term[dense], source[dense], p[dense]
    names, at = np.unique(at, return_inverse=True)
    tile = max(1, CELLS // max(len(totals), 1))
    for a in range(0, len(names), tile):
        some = slice(*np.searchsorted(at, [a, a + tile]))
        block = np.tile(base, (min(tile, len(names) - a), 1))
        block[at[some] - a, own[some]] = q[some]
        for i in rows.tolist():
            out[i] += np.abs(block[:, columns] - block[:, i : i + 1]).sum(axis=0)
        out -= len(block) * apart
    # postings: first as if the other source had none of the term, by where its base is among the sorted shares
    at, own, q = term[~dense], source[~dense], p[~dense]
    order = np.lexsort((q, own))
    bounds = np.searchsorted(own[order], np.arange(len(totals) + 1))
    for i in np.flatnonzero(np.diff(bounds)).tolist():
        mine = q[order[bounds[i] : bounds[i + 1]]]
        upto = np.concatenate([[0], np.cumsum(mine)])
        here, there = (i, columns) if split is None or i < split else (i - split, rows)
        k = np.searchsorted(mine, base[there])
        b = base[there]
        one = b * k - upto[k] + upto[-1] - upto[k] - b * (len(mine) - k) - len(mine) * np.abs(base[i] - b)
        if split is None:
            out[here] += one
            out[:, here] += one
        elif i < split:
            out[here] += one
        else:
            out[:, here] += one
    # then what is different where both have it
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(at)])
    for shift in range(1, int(sizes.max(initial=0))):
        left = np.flatnonzero(np.repeat(sizes, sizes) - (np.arange(len(at)) - np.repeat(starts, sizes)) > shift)
        i, j, x, y = own[left], own[left + shift], q[left], q[left + shift]
        both = np.abs(x - y) - np.abs(x - base[j]) - np.abs(base[i] - y) + np.abs(base[i] - base[j])
        if split is None:
            np.add.at(out, (i, j), both)
            np.add.at(out, (j, i), both)
        else:
            across = (i < split) != (j < split)
            i, j, both = np.minimum(i, j)[across], np.maximum(i, j)[across] - split, both[across]
            np.add.at(out, (i, j), both)
    return out


SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _tile(heavy: float, key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Of a slice of terms and two blocks of sources (perhaps one and the same) the partial sum of each pair, both ways round."""
    lang, part, a, b = (k.as_py() for k in key)
    right = right.sort_by("place")
    blocks, names, totals = right.column("block").to_numpy(), right.column("source").to_pylist(), right.column("total").to_numpy()
    n_sources, vocabulary = right.column("n_sources")[0].as_py(), right.column("vocabulary")[0].as_py()
    split = int((blocks == a).sum()) if a != b else None
    rows = np.arange(len(names) if split is None else split)
    columns = rows if split is None else np.arange(split, len(names))
    out = np.zeros((len(rows), len(columns)), dtype=np.int64)
    if vocabulary:
        if left.num_rows:
            left = left.sort_by([("term", "ascending"), ("place", "ascending")])
            term = left.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
            source = np.searchsorted(right.column("place").to_numpy(), left.column("place").to_numpy())
            out += pair_sums(term, source, left.column("n").to_numpy(), left.column("present").to_numpy(), totals, n_sources, split, heavy)
        if part == 0:  # once for each pair
            base = shares(np.full(len(totals), PRIOR, dtype=np.int64), totals)
            out += vocabulary * np.abs(base[rows][:, None] - base[columns])
    some = np.flatnonzero(((rows[:, None] != columns) & ((out != 0) | (part == 0))).ravel())
    i, j = rows[some // max(len(columns), 1)], columns[some % max(len(columns), 1)]
    of, names = out.ravel()[some], np.array(names, dtype=object)
    ways = [(i, j)] if split is None else [(i, j), (j, i)]
    first, second = (np.concatenate([w[k] for w in ways]) for k in (0, 1))
    return pa.table([pa.array([lang] * len(first), pa.string()), pa.array(names[first], pa.string()), pa.array(names[second], pa.string()), pa.array(np.tile(of, len(ways)))], schema=SUMS)


def audit_sources(docs: DataFrame, least: int = LEAST, top: int = TOP, heavy: float = HEAVY, block: int = BLOCK, slice_rows: int = SLICE) -> DataFrame:
    """lang, source, part, item, value, rank: for each group (lang, source) how far it is from others, and the terms it has above its language.

    docs: text, lang, source (null is empty). Terms are runs of letters A-Z, a-z and of all characters beyond ASCII, A-Z in
    lower case; a language keeps those in at least ``least`` of its documents. A group gives each kept term the share
    1 + floor(10^9 (count + 5) / (N + 5 V)), as does the whole language. Part pair: each other source of the language with
    the sum of the shares' differences (0 without kept terms); part term: the ``top`` terms present in the group
    by how far its share is above the language's. rank: by value, the largest first, then item. A group without terms is a group;
    repeated rows count as often as they occur; an empty table gives no rows; other columns are ignored.

    The driver gets three numbers. Counts are combined before they are shuffled, terms are dealt to tasks by slices, and a
    language of more than ``block`` sources by pairs of blocks, so neither a hot source nor a common term is one task's.
    """
    counted = stored(term_counts(docs), "term-counts")
    by_term = Window.partitionBy("lang", "term")
    wide = counted.where("n > 0").withColumns({"df": F.sum("docs").over(by_term), "present": F.count(F.lit(1)).over(by_term), "lang_n": F.sum("n").over(by_term), "least": F.min("source").over(by_term)})
    kept = stored(wide.where(F.col("df") >= least).select("lang", "source", "term", "n", "present", "lang_n", (F.col("source") == F.col("least")).alias("first")), "kept-terms")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count(F.lit(1)).alias("rows"), F.count_if("first").alias("firsts"))
    groups = counted.where(F.col("term").isNull()).select("lang", "source").join(own, ["lang", "source"], "left").na.fill(0, ["own", "rows", "firsts"])
    by_lang = Window.partitionBy("lang")
    groups = groups.withColumns({"place": F.row_number().over(by_lang.orderBy("source")) - 1, "n_sources": F.count(F.lit(1)).over(by_lang), "lang_own": F.sum("own").over(by_lang), "vocabulary": F.sum("firsts").over(by_lang)})
    groups = stored(groups.select("lang", "source", "rows", F.col("place").cast("long").alias("place"), "n_sources", "vocabulary", F.floor(F.col("place") / block).cast("long").alias("block"), F.floor((F.col("n_sources") - 1) / block).cast("long").alias("last"), (F.col("own") + PRIOR * F.col("vocabulary")).alias("total"), (F.col("lang_own") + PRIOR * F.col("vocabulary")).alias("lang_total")), "groups")
    placed = lookup(kept.drop("first"), groups, ["lang", "source"], "rows")

    over = placed.withColumns({"p": share(F.col("n") + PRIOR, F.col("total")), "q": share(F.col("lang_n") + PRIOR, F.col("lang_total"))}).where("p > q")
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    found = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    sizes = groups.agg(F.sum("rows").alias("rows"), F.max("n_sources").alias("sources")).collect()[0]
    slices = max(1, -(-(sizes["rows"] or 0) // max(slice_rows, min(sizes["sources"] or 1, block) ** 2)))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda x: F.struct(F.least("block", x).alias("a"), F.greatest("block", x).alias("b")))
    dealt = placed.select("lang", F.pmod(F.xxhash64("term"), F.lit(slices)).alias("slice"), F.explode(pairs).alias("pair"), "term", "place", "n", "present").select("lang", "slice", "pair.a", "pair.b", "term", "place", "n", "present")
    slice_ = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))
    each = groups.withColumn("slice", slice_).withColumn("pair", F.explode(pairs)).select("lang", "slice", "pair.a", "pair.b", "source", "place", "total", "n_sources", "vocabulary", "block")
    each = each.toDF(*each.columns)  # columns of their own, apart from those that the lookup has added
    keys = ["lang", "slice", "a", "b"]
    sums = dealt.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInArrow(lambda key, left, right: _tile(heavy, key, left, right), "lang string, source string, item string, value long")
    apart = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    near = apart.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return near.unionByName(found)
