"""Connected components of an edge list by repeated contraction.

Every node points to its least neighbour (or itself, if that is less); edges are rewritten to the pointed-to nodes,
loops and repeats go, and the next round works on what is left. Ids should be hashes: then a round shrinks the
graph by a constant factor in expectation. Nothing is collected: each round's pointers are a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm import common as c


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b long); no row for nodes without edges."""
    edges = edges.select("a", "b").where("a <> b")
    rounds: list[DataFrame] = []
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = c.write_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), name)
        if up.isEmpty():
            break
        rounds.append(up)
        left, right = (up.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root")) for k in ("a", "b"))
        edges = edges.join(left, "a").join(right, "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a <> b")
        edges = c.write_table(edges.distinct(), name)
    if not rounds:
        return up
    label = rounds[-1]
    for up in reversed(rounds[:-1]):
        above = label.select(F.col("node").alias("root"), F.col("root").alias("top"))
        label = up.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return label
