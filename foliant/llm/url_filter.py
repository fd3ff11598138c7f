"""URL filters: rules of host and path in a sorted array of 64-bit digests, probed by binary search.

The array is one file in the shared folder, which Spark hands to every executor that asks for it (a new one too); tasks map it
into memory, so the workers of a machine share its pages. A hit counts only if the stored string is the one that was sought.
"""

from __future__ import annotations

import os
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.shared import scratch, stored

#: Rules of more bytes than this are not handed to executors but joined.
MAPPED = 64 << 20
#: Bytes of an entry besides its string: digest, end and verdict.
ENTRY = 17
SEED = 42


def host_of(url: Column) -> Column:
    """What is after the first "://" up to "/", "?", "#" or the end, A-Z in lower case; empty without "://" and for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What is after the host up to "?", "#" or the end; empty without "://" and for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def digests(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), dtype=np.uint64, count=len(keys))


class DigestArray:
    """Sorted 64-bit digests with their strings and verdicts, as one block of bytes."""

    def __init__(self, data: np.ndarray):
        n, self.longest, many = data[:24].view("<u8").astype(int).tolist()
        at = 24 + 8 * many
        #: How long the longest host is, and how long the rules' paths are.
        self.lengths = data[24:at].view("<u8").astype(int).tolist()
        self.keys = data[at : at + 8 * n].view("<u8")
        self.ends = data[at + 8 * n : at + 16 * n].view("<u8")
        self.blocks = data[at + 16 * n : at + 17 * n]
        self.strings = data[at + 17 * n :]

    @staticmethod
    def packed(rules: list[tuple[bytes, bool]], key=digests) -> bytes:
        """rules: the different strings and whether they block. An entry without a verdict of its own marks a host."""
        hosts = {r.partition(b"/")[0] for r, _ in rules}
        entries = [(b"/" + h, 2) for h in sorted(hosts)] + [(r, int(block)) for r, block in rules]
        keys = key([e for e, _ in entries])
        order = np.argsort(keys, kind="stable").tolist()
        sizes = np.array([len(entries[k][0]) for k in order], dtype="<u8")
        lengths = sorted({len(r) - len(r.partition(b"/")[0]) for r, _ in rules})
        head = np.array([len(entries), max(map(len, hosts), default=0), len(lengths), *lengths], dtype="<u8")
        verdicts = bytes(entries[k][1] for k in order)
        return head.tobytes() + keys[order].astype("<u8").tobytes() + np.cumsum(sizes, dtype="<u8").tobytes() + verdicts + b"".join(entries[k][0] for k in order)

    @classmethod
    def mapped(cls, path: str) -> DigestArray:
        return cls(np.memmap(path, dtype=np.uint8, mode="r"))

    def string(self, at: int) -> bytes:
        return self.strings[int(self.ends[at - 1]) if at else 0 : int(self.ends[at])].tobytes()

    def find(self, wanted: list[bytes], key=digests) -> np.ndarray:
        """Where each string stands, -1 for those that don't; equal digests are told apart by the strings."""
        found = np.full(len(wanted), -1)
        if not len(wanted) or not len(self.keys):
            return found
        sought = key(wanted)
        at = np.searchsorted(self.keys, sought)
        open_ = np.arange(len(wanted))
        while len(open_):  # once for most, again only along a run of equal digests
            open_ = open_[at[open_] < len(self.keys)]
            open_ = open_[self.keys[at[open_]] == sought[open_]]
            same = np.array([self.string(int(at[k])) == wanted[k] for k in open_.tolist()], dtype=bool)
            found[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
        return found


def suffixes(host: bytes, longest: int) -> list[bytes]:
    """The host and those it is a subdomain of, the longest first; those longer than any rule's are left out."""
    out, at = [], max(0, len(host) - longest)
    if at:
        at = host.find(b".", at - 1) + 1
        if not at:
            return out
    while True:
        out.append(host[at:])
        at = host.find(b".", at) + 1
        if not at:
            return out


def candidates(hosts: list[bytes], path: bytes, lengths: list[int]) -> Iterator[bytes]:
    """The rules that could fit a url of these hosts (it and its parents) and this path."""
    for h in hosts:
        for k in lengths[: bisect_right(lengths, len(path))]:
            yield h + path[:k]


#: Strings looked up at once.
PROBES = 1 << 16


def judged(array: DigestArray, urls: list[tuple[bytes, bytes]], key=digests) -> list[tuple[bytes, bool] | None]:
    """For each host and path the longest rule that fits, of equally long ones that of the longer host, and whether it blocks."""
    own, of = [], []
    for i, (host, _) in enumerate(urls):
        mine = suffixes(host, array.longest)
        own += mine
        of += [i] * len(mine)
    known: list[list[bytes]] = [[] for _ in urls]
    for k in np.flatnonzero(array.find([b"/" + h for h in own], key) >= 0).tolist():
        known[of[k]].append(own[k])
    best: list[tuple[bytes, bool] | None] = [None] * len(urls)
    names, of = [], []

    def probe() -> None:
        for k, at in zip(of, array.find(names, key).tolist(), strict=True):
            if at >= 0 and ((rule := array.string(at)) and (best[k] is None or len(rule) > len(best[k][0]))):
                best[k] = rule, bool(array.blocks[at])
        names.clear()
        of.clear()

    for i, (_, path) in enumerate(urls):
        for name in candidates(known[i], path, array.lengths):
            names.append(name)
            of.append(i)
            if len(names) >= PROBES:
                probe()
    probe()
    return best


def rule_table(rules: DataFrame) -> DataFrame:
    """rule, block: the different rules (host, path, verdict); hosts in lower case; of two verdicts on one rule block holds. Rules without host or verdict and paths that don't begin with "/" are left out; a null path is empty."""
    host = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.coalesce("path", F.lit(""))
    usable = rules.where((host != "") & F.col("verdict").isin("allow", "block") & ~host.contains("/") & ((path == "") | path.startswith("/")))
    return usable.groupBy(F.concat(host, path).alias("rule")).agg(F.max(F.col("verdict") == "block").alias("block"))


def _written(spark: SparkSession, data: bytes) -> str:
    """The file's name in the folder that Spark hands to executors."""
    path = f"{scratch(spark, 'url-rules')}.bin"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.deleteOnExit(place)
    out = store.create(place)
    for k in range(0, len(data), 1 << 20):
        out.write(data[k : k + (1 << 20)])
    out.close()
    spark.sparkContext.addFile(place.makeQualified(store.getUri(), store.getWorkingDirectory()).toString())
    return os.path.basename(path)


VERDICTS = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
DDL = "page_id long, host string, path string, rule string, verdict string"


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", mapped: int = MAPPED) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per row of pages (page_id, url); rules: host, path, verdict (allow or block).

    A rule fits its host and all subdomains, if the path starts with the rule's; the longest rule wins, of equally long ones
    that of the longer host. Urls that no rule fits, null ones and those without "://" (host and path empty) have no rule and
    the verdict ``default``. Repeated rows are judged alike; an empty table gives no rows; without rules all have the
    default; other columns are ignored. Rules of at most ``mapped`` bytes are looked up in a mapped array, in one
    pass without a shuffle; longer lists are joined by their strings.
    """
    spark = pages.sparkSession
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    kept = stored(rule_table(rules), "rules")
    size = kept.agg(F.coalesce(F.sum(F.octet_length("rule") * 2 + 2 * ENTRY), F.lit(0))).collect()[0][0]
    if size > mapped:
        return _joined(split, kept, default)
    name = _written(spark, DigestArray.packed(sorted((r["rule"].encode(), r["block"]) for r in kept.collect())))  # at most ``mapped`` bytes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray.mapped(SparkFiles.get(name))
        for batch in batches:
            urls = [(h.encode(), p.encode()) for h, p in zip(*(batch.column(c).to_pylist() for c in ("host", "path")), strict=True)]
            found = judged(array, urls)
            rule = pa.array([f and f[0].decode() for f in found], pa.string())
            verdict = pa.array([default if f is None else "block" if f[1] else "allow" for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), rule, verdict], schema=VERDICTS)

    return split.mapInArrow(work, DDL)


def _joined(split: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by joins, for lists of any length: hosts first, so that paths are cut only where a rule may fit."""
    spark = split.sparkSession
    host = F.substring_index("rule", "/", 1)
    parents = rules.groupBy(host.alias("parent")).agg(F.array_sort(F.collect_set(F.length("rule") - F.length(host))).alias("lengths"))
    rows = stored(split.withColumn("row", F.monotonically_increasing_id()), "urls")
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    # a url meets each of its hosts' lengths of paths once
    hosts = rows.select("host").where("host != ''").distinct().select("host", F.explode(suffix).alias("parent"))
    own = hosts.join(parents, "parent")
    found = rows.select("row", "host", "path").join(own, "host").select("row", F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.struct(F.concat("parent", F.substring("path", F.lit(1), n)).alias("rule"), F.length("parent").alias("n")))).alias("c"))
    best = found.select("row", "c.rule", "c.n").join(rules, "rule").groupBy("row").agg(F.max_by(F.struct("rule", "block"), F.struct(F.octet_length("rule"), "n")).alias("best"))
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.block"), "block").otherwise("allow")
    return rows.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
