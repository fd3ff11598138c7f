"""Removal of lines that spread over many sites, by HyperLogLog sketches and exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import cut, small, stored

#: A line on so many distinct sites is boilerplate.
SITES = 5
#: log2 of a sketch's registers; its relative error is 1.04 / sqrt(2^LG_K).
LG_K = 10
#: Estimates within this share of the threshold are counted exactly: over four standard errors.
MARGIN = 0.15


def lines_of(text: Column) -> Column:
    """A text's lines (null: none); \\n ends a line."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def line_key(line: Column) -> Column:
    """Lines are equal after white space around them went."""
    return F.xxhash64(_trimmed(line))


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\x0b\x0c"))


def spread_lines(seen: DataFrame, sites: int = SITES, lg_k: int = LG_K, margin: float = MARGIN) -> DataFrame:
    """Keys (column key) that are on at least so many distinct sites; seen: key, site (not null), a row per document and line.

    Up to 2^(lg_k - 3) sites, 128 by default, a sketch holds the hashes themselves and its estimate is right; with higher
    thresholds an estimate is wrong by more than the margin for less than one line in 10,000.
    """
    spread = seen.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch")).select("key", F.hll_sketch_estimate("sketch").alias("about"))
    spread = cut(spread.where(F.col("about") > sites * (1 - margin) - 0.5))
    high = F.col("about") > sites * (1 + margin) + 0.5
    # a row per line and site after the partial aggregation, however many documents repeat it
    exact = seen.join(small(spread.where(~high).select("key")), "key", "left_semi").groupBy("key", "site").agg(F.lit(1).alias("one")).groupBy("key").agg(F.sum("one").alias("n"))
    return spread.where(high).select("key").unionByName(exact.where(F.col("n") >= sites).select("key"))


def line_dedup(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, clean_text.

    A line that is on at least ``sites`` distinct sites goes from every text (all of its copies); the other lines stay in
    order, joined by \\n. Lines are compared without white space around them; blank lines always stay; a null site is a
    site of its own. A null text gives null, no lines and nothing removed. Repeated rows, and rows without doc_id, are
    handled like all others. Other columns are ignored. An empty table gives no rows.
    """
    # a line's site is kept as a hash; rows are told apart by text and id, so that copies of a text don't meet in one task
    where = F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(f"`{site}`").cast("string")), F.lit("")))
    keys = F.array_distinct(F.transform(F.filter(lines_of(F.col("text")), lambda x: F.length(_trimmed(x)) > 0), line_key))
    told = [F.coalesce("doc_id", F.lit(-1)).alias("id"), F.xxhash64("text").alias("text_key")]
    seen = stored(docs.select(*told, where.alias("site"), keys.alias("keys")), "line-dedup")
    flat = seen.select("id", "text_key", "site", F.explode("keys").alias("key"))
    bad = small(cut(spread_lines(flat.select("key", "site"), sites)))
    hits = flat.join(bad, "key", "left_semi").groupBy("id", "text_key").agg(F.collect_set("key").alias("bad"))
    joined = docs.select("doc_id", "text", *told).join(hits, ["id", "text_key"], "left").withColumn("lines", lines_of(F.col("text")))
    stay = F.when(F.col("bad").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("bad", line_key(x))))
    kept = joined.select("doc_id", "text", F.size("lines").cast("long").alias("n_lines"), stay.alias("stay"))
    clean = F.when(F.col("text").isNull(), F.lit(None).cast("string")).otherwise(F.array_join("stay", "\n"))
    return kept.select("doc_id", "n_lines", (F.col("n_lines") - F.size("stay")).alias("n_removed"), clean.alias("clean_text"))
