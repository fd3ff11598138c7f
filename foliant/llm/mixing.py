"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

1. A row per source: its size, target, and how many of its blocks are drawn (repeats counted). This table may be as long as the
   documents; it is ranked and summed by ranges, and only sums over it reach the driver.
2. Sources are dealt to groups by their rank (up to GROUPS sources, each is one). The splitting tree gives each output shard
   its number of draws of each group; a group's draws are permuted and dealt to shards by those numbers.
3. A source's documents lie in a permuted order and are cut into blocks; its draws visit the blocks in a permuted order, so
   each draw takes a block of its own. What a document gives is what the draws of its blocks take, in the shards of these.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.shared import lookup, small, stored, tasks

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and of a source's target as a share of the source's words.
SHARE, LIMIT = 1.5, 2.0
#: A source is cut into so many blocks at most; smaller sources into single words.
BLOCKS = 4096
#: Parts of a source's permuted order whose words are summed before they are placed (prefix sums in two levels).
PARTS = 1024
#: Columns of the splitting tree: its numbers, one for each shard and group, are all that the driver holds.
GROUPS = 2048
#: numpy draws without replacement from fewer things than this.
URN = 1_000_000_000
#: Plans of so many sources (some 200 bytes each) are broadcast; in longer ones only large sources are, and others are joined by a shuffle.
FEW_SOURCES = 100_000
#: Parts of a word that are summed where sources of single words share rounded draws.
UNIT = 1 << 20

def word_count(text: Column) -> Column:
    """Number of runs of [^\\x20\\x09-\\x0D] (null: 0)."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", -1)
    blank = lambda x: F.when(x == "", 1).otherwise(0)
    ends = F.when(F.size(parts) == 1, blank(parts[0])).otherwise(blank(parts[0]) + blank(F.element_at(parts, -1)))
    return (F.size(parts) - ends).cast("long")


def without_replacement(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each kind ``take`` draws without replacement give; an urn too large for numpy is drawn from by halves."""
    if counts.sum() < URN:
        return rng.multivariate_hypergeometric(counts, take, method="marginals") if take else np.zeros_like(counts)
    half = counts // 2
    first = min(take // 2, int(half.sum()))
    return without_replacement(half, first, rng) + without_replacement(counts - half, take - first, rng)


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Draws of each group (columns) in each output shard (rows).

    A node holds a number of draws of each group for a range of shards. Its left half gets a draw without replacement of
    its share of them (a multivariate hypergeometric one), the right half the rest; so all quotas are met exactly.
    """
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    part = without_replacement(quotas, int(quotas.sum()) * left // shards, rng)
    return np.vstack([split_tree(part, left, rng), split_tree(quotas - part, shards - left, rng)])


def primes_over(n: int, many: int = 64) -> list[int]:
    """The next primes over n: each is a step through n things or fewer that meets all of them."""
    out, k = [], n + 1
    while len(out) < many:
        if all(k % d for d in range(2, math.isqrt(k) + 1)):
            out.append(k)
        k += 1
    return out


def _running(ranged: DataFrame, value: Column, by: list[str], name: str) -> DataFrame:
    """Adds the sum of value over the rows before, for each ``by``; ranged: part (number of a range of the order) and source."""
    parts = ranged.groupBy("part", *by).agg(F.sum(value).alias("in_part")).collect()  # a row per range of the shuffle
    total, offsets = {}, []
    for r in sorted(parts, key=lambda r: r["part"]):
        key = tuple(r[b] for b in by)
        offsets.append((r["part"], *key, total.get(key, 0)))
        total[key] = total.get(key, 0) + r["in_part"]
    own = Window.partitionBy("part", *by).orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.sparkSession.createDataFrame(offsets, f"part int, {''.join(f'{b} int, ' for b in by)}offset long")
    within = ranged.withColumn("within", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return within.join(F.broadcast(before), ["part", *by]).withColumn(name, F.col("offset") + F.col("within")).drop("offset", "within")


def source_plan(sums: DataFrame, shards: int, seed: int, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """sums: source, words, docs, a row per source. Returns what is drawn of each source, and the shards' ends in each group.

    Targets are share x all words by weight; a target stops at limit x its source's size, and the excess goes to the others
    by weight. A source of single words takes the part of a word that those before it, of its weight, were short of.
    """
    order = F.col("source").asc_nulls_last()
    ranged = stored(sums.repartitionByRange(tasks(sums.sparkSession), order).withColumn("part", F.spark_partition_id()), "sources")
    placed = stored(_running(ranged, F.lit(1), [], "place").withColumn("kind", (F.col("place") % len(weights)).cast("int")), "placed")
    total = share * (placed.agg(F.sum("words")).collect()[0][0] or 0)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("kind") + 1)
    per, stopped = 0.0, -1
    while True:  # what stops at its limit makes the others' shares larger, until no more do
        full = F.lit(per) * weight > limit * F.col("words")
        kinds = placed.where("words > 0").groupBy("kind").agg(F.count_if(full).alias("full"), F.count_if(~full).alias("free"), F.coalesce(F.sum(F.when(full, F.col("words"))), F.lit(0)).alias("words")).collect()
        if sum(r["full"] for r in kinds) == stopped or not any(r["free"] for r in kinds):
            break
        stopped = sum(r["full"] for r in kinds)
        per = (total - limit * sum(r["words"] for r in kinds)) / sum(weights[r["kind"]] * r["free"] for r in kinds)
    target = F.when(F.col("words") == 0, 0.0).when(full, limit * F.col("words")).otherwise(F.lit(per) * weight)
    block = F.greatest(F.lit(1), F.ceil(F.col("words") / blocks)).cast("long")
    sized = placed.withColumns({"target": target, "block": block}).withColumn("blocks", F.ceil(F.col("words") / F.col("block")).cast("long"))
    most = F.col("blocks") * math.floor(limit)
    single = (F.col("block") == 1) & (F.col("target") < limit * F.col("words"))
    units = F.when(single, F.round(F.col("target") * UNIT).cast("long")).otherwise(0)
    sized = _running(sized.withColumn("units", units), F.col("units"), ["kind"], "before")
    whole = lambda x: F.floor((x + UNIT // 2) / F.lit(UNIT)).cast("long")
    drawn = F.when(single, whole(F.col("before") + F.col("units")) - whole(F.col("before"))).when(F.col("target") >= limit * F.col("words"), most).otherwise(F.round(F.col("target") / F.col("block")).cast("long"))
    groups = max(1, min(GROUPS, GROUPS * 512 // shards))
    steps = primes_over(blocks)
    random = lambda name, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "source"), n)
    step = F.element_at(F.array(*map(F.lit, steps)), (random("step", F.lit(len(steps))) + 1).cast("int"))
    made = sized.withColumns({"drawn": F.least(F.greatest(drawn, F.lit(0)), most), "group": (F.col("place") % groups).cast("int"), "step": step, "shift": random("shift", F.greatest(F.col("blocks"), F.lit(1)))})
    made = made.withColumn("base", F.coalesce(F.sum("drawn").over(Window.partitionBy("group").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    made = stored(made.select("source", F.col("words").alias("source_size"), "docs", "target", "block", "blocks", "drawn", "step", "shift", "group", "base"), "plan")
    quotas = np.zeros(groups, dtype=np.int64)
    for r in made.groupBy("group").agg(F.sum("drawn").alias("n")).collect():  # GROUPS rows at most
        quotas[r["group"]] = r["n"]
    ends = np.cumsum(split_tree(quotas, shards, np.random.default_rng(seed)), axis=0)
    rows = []
    for g in np.flatnonzero(quotas).tolist():
        n, rng = int(quotas[g]), np.random.default_rng([seed, g])
        near = int(rng.integers(1, n + 1))
        rows.append((g, n, next(k for k in range(near, 2 * near + 2 * n) if math.gcd(k, n) == 1) % max(n, 2), int(rng.integers(0, n)), ends[:, g].tolist()))
    return made, sums.sparkSession.createDataFrame(rows, "group int, draws long, group_step long, group_shift long, ends array<long>")


def mix(docs: DataFrame, shards: int = 16, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, start and draws (what the mix takes of it).

    draws: array of (shard, epoch, block, place, first, last): in that shard, words first..last-1 of the text, which are a
    part of that block; a shard's parts are ordered by place. A null text has size 0 and no draws; the null source comes
    last; sources without words have target 0. Repeated rows are taken apart; an empty table gives no rows; other columns
    are ignored.

    The permuted order of a source's rows is by a hash of all that tells rows apart, so that reruns agree. It is summed in
    two levels, so no task gets a whole source.
    """
    rows = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")), "mix")
    return _draws(rows, shards, seed, weights, share, limit).drop("tie")


DRAW = "struct<shard:int,epoch:long,block:long,place:long,first:long,last:long>"


def _draws(sized: DataFrame, shards: int, seed: int, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """sized: doc_id, source, size, tie (tells texts apart) and any columns to carry."""
    # a source's name with "=" before it, so that it can be joined by; the null source has none
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("at")
    parts = stored(sized.groupBy("source", _part(seed).alias("part")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")), "parts")
    made, ends = source_plan(parts.groupBy("source").agg(F.sum("words").alias("words"), F.sum("docs").alias("docs")), shards, seed, weights, share, limit)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(name, "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))

    order = Window.partitionBy("source", "part").orderBy("order", "doc_id", "tie")
    placed = sized.withColumns({"part": _part(seed), "order": _order(seed)})
    placed = placed.withColumn("within", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.withColumn("at", name).join(small(offsets), ["at", "part"])
    placed = placed.withColumn("start", F.col("before") + F.col("within")).drop("before", "within", "part", "order")
    found = made.withColumn("at", name).drop("source")
    if found.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        placed = placed.join(F.broadcast(found), "at")
    else:
        placed = lookup(stored(placed, "placed-rows"), found, ["at"], "docs")
    placed = placed.drop("at", "docs")
    placed = placed.join(F.broadcast(ends.withColumnRenamed("draws", "group_draws")), "group", "left")

    def draw(block: Column, epoch: Column) -> Column:
        rank = (block * F.col("step") + F.col("shift") + epoch) % F.col("blocks") + epoch * F.col("blocks")
        first = F.greatest(block * F.col("block"), F.col("start")) - F.col("start")
        last = F.least((block + 1) * F.col("block"), F.col("start") + F.col("size")) - F.col("start")
        at = ((F.col("base") + rank) * F.col("group_step") + F.col("group_shift")) % F.col("group_draws")
        shard = F.when(rank < F.col("drawn"), F.size(F.filter("ends", lambda end: end <= at)))
        place = F.xxhash64(F.lit(seed), F.lit("place"), "source", rank)
        return F.struct(shard.alias("shard"), epoch.alias("epoch"), block.alias("block"), place.alias("place"), first.alias("first"), last.alias("last"))

    last = F.floor((F.col("start") + F.col("size") - 1) / F.col("block")).cast("long")
    own = F.sequence(F.floor(F.col("start") / F.col("block")).cast("long"), last)
    epochs = F.sequence(F.lit(0).cast("long"), F.lit(math.floor(limit) - 1).cast("long"))
    every = F.filter(F.flatten(F.transform(epochs, lambda e: F.transform(own, lambda b: draw(b, e)))), lambda d: d["shard"].isNotNull())
    draws = F.when((F.col("size") > 0) & (F.col("drawn") > 0), every).otherwise(F.from_json(F.lit("[]"), f"array<{DRAW}>"))
    return placed.withColumn("draws", draws).drop("step", "shift", "ends", "drawn", "blocks", "block", "group", "base", "group_draws", "group_step", "group_shift")


def _order(seed: int) -> Column:
    """By all that tells rows apart, so that rows without doc_id or of one id are dealt apart too."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("tie"))


def _part(seed: int) -> Column:
    return F.pmod(F.shiftright(_order(seed), 20), F.lit(PARTS))


def taken(draws: Column) -> Column:
    """The words that the draws of all shards take."""
    return F.aggregate(draws, F.lit(0).cast("long"), lambda n, d: n + d["last"] - d["first"])


def _mixed(docs: DataFrame, seed: int, shards: int) -> DataFrame:
    """row, shard: a row of docs for each draw that has its first word, shards dealt together and in a shuffled order."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    sized = docs.select(row).select("row", "row.doc_id", "row.source", word_count(F.col("row.text")).alias("size"), F.xxhash64("row.text").alias("tie"))
    drawn = _draws(sized, shards, seed)
    firsts = F.filter("draws", lambda d: d["first"] == 0)
    nothing = F.array(F.lit(None).cast(DRAW))
    rows = drawn.select("row", "doc_id", "tie", F.explode(F.when(F.col("size") > 0, firsts).otherwise(nothing)).alias("draw"))
    rows = rows.select("row", "doc_id", F.coalesce("draw.shard", F.pmod(_order(seed), F.lit(shards)).cast("int")).alias("shard"), F.coalesce("draw.place", _order(seed)).alias("place"))
    # a shard of a large mix is several slices, each shuffled by one task; their number follows that of the tasks
    slices = -(-4 * tasks(docs.sparkSession) // shards)
    return rows.repartition("shard", F.pmod("place", F.lit(slices))).sortWithinPartitions("shard", "place", "doc_id").select("row", "shard")


def mixed_documents(docs: DataFrame, seed: int = 7, shards: int = 16) -> DataFrame:
    """The mix by whole documents, with the columns of docs: a row stays once for each draw that has its first word.

    A source's words come near its target, as its documents are drawn with the share its blocks have. Rows without
    words stay once; so do null texts. The null source is one of its own; repeated rows are drawn apart; an empty table gives
    no rows. A shard's rows are dealt together and put in the shard's own shuffled order.
    """
    return _mixed(docs, seed, shards).select("row.*")


def write_shards(docs: DataFrame, path: str, seed: int = 7, shards: int = 16) -> None:
    """Writes the mix of mixed_documents as Parquet, a folder ``shard=K`` for each shard, in its shuffled order."""
    name = "shard" if "shard" not in {c.lower() for c in docs.columns} else "mix_shard"
    _mixed(docs, seed, shards).select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
