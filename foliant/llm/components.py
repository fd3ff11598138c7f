"""Connected components of a graph of links, by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import stored


def roots(edges: DataFrame, root: str) -> DataFrame:
    """edges: a, b (long). One row per vertex that has an edge to another: node, root, with the same root within a component.

    Each pass's tables go below the folder ``root``, which the caller deletes.

    In each pass a vertex takes the label of its smallest neighbour's smallest neighbour (twice over), and the graph of labels
    takes the graph's place: vertices of one label are connected, and every edge stays one between labels. So
    components stay as they are, and a pass at least halves the vertices that still have edges.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", root)
    out, turn = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label"))
        low = stored(low, f"low-{turn}", root)
        up = low.select(F.col("node").alias("label"), F.col("label").alias("next"))
        label = stored(low.join(up, "label").select("node", F.col("next").alias("label")).join(up, "label").select("node", F.col("next").alias("label")), f"label-{turn}", root)
        if out is None:
            out = label
        else:
            nxt = label.select(F.col("node").alias("label"), F.col("label").alias("next"))
            out = stored(out.join(nxt, "label", "left").select("node", F.coalesce("next", "label").alias("label")), f"out-{turn}", root)
        to = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        joined = edges.join(to("a"), "a").join(to("b"), "b").where("a_label <> b_label")
        edges = stored(joined.select(F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b")).distinct(), f"edges-{turn}", root)
        turn += 1
    if out is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return out.withColumnRenamed("label", "root")
