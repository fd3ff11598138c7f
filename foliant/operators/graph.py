"""The link graph of books: adjacency, dead ends, orphan links, reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import death, is_missing, references, victory
from foliant.operators.folding import folded


def edges(sections: DataFrame) -> DataFrame:
    """book_id, src, dst, n_sections: a row for each reference."""
    return sections.select("book_id", F.col("section_number").alias("src"), "n_sections", F.explode(references(F.col("content"))).alias("dst"))


def incoming(sections: DataFrame) -> DataFrame:
    """book_id, node, sources: who refers to each section and to each target outside the book."""
    back = edges(sections).groupBy("book_id", F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("sources"))
    every = sections.select("book_id", F.col("section_number").alias("node"))
    return every.join(back, ["book_id", "node"], "full_outer").select("book_id", "node", F.coalesce("sources", F.array().cast("array<int>")).alias("sources"))


def dead_ends(sections: DataFrame) -> DataFrame:
    return sections.where((F.size(references(F.col("content"))) == 0) & ~is_missing(F.col("content"))).select("book_id", "section_number")


def terminal(sections: DataFrame) -> DataFrame:
    """Dead ends that are a death or a victory."""
    content = F.col("content")
    return sections.where(death(content) | victory(content)).select("book_id", "section_number")


def orphan_links(sections: DataFrame) -> DataFrame:
    """References out of 1..n_sections."""
    return edges(sections).where(~F.col("dst").between(1, F.col("n_sections"))).select("book_id", F.col("src"), F.col("dst"))


def depths(sections: DataFrame, entry: int = 1) -> DataFrame:
    """book_id, section_number, depth: shortest distance from the entry, a book at a time over its lists of targets.

    One pass, however deep the books are: a book's lists are searched by one task, which many books share. A book without the entry
    has no rows; a number that occurs twice leads where all its rows do.
    """

    def search(book: list[dict]) -> list[tuple]:
        out: dict[int, list[int]] = {}
        for r in book:
            out.setdefault(r["section_number"], []).extend(r["targets"] or [])
        found = {entry: 0} if entry in out else {}
        front = list(found)
        while front:
            after = {dst for src in front for dst in out.get(src, ()) if dst not in found}
            depth = found[front[0]] + 1
            found.update(dict.fromkeys(after, depth))
            front = list(after)
        return list(found.items())

    targets = F.filter(references(F.col("content")), lambda t: t.between(1, F.col("n_sections")))
    rows = sections.select("book_id", F.col("section_number").cast("int").alias("section_number"), targets.alias("targets"))
    return folded(rows, "book_id", "section_number", search, "section_number int, depth int")


def max_depth(sections: DataFrame, entry: int = 1) -> DataFrame:
    """book_id, max_depth: the largest depth of each book; 0 for one without the entry."""
    every = sections.select("book_id").distinct()
    deepest = depths(sections, entry).groupBy("book_id").agg(F.max("depth").alias("max_depth"))
    return every.join(deepest, "book_id", "left").select("book_id", F.coalesce("max_depth", F.lit(0)).alias("max_depth"))
