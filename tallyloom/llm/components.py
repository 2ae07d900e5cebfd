"""Connected components of a sparse graph by repeated contraction, all in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rows of one task that writes a round's table.
ROWS_PER_PART = 500_000
#: Far more rounds than a constant share per round leaves any graph.
ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node of ``edges`` (a, b longs).

    Each round sends every node to the neighbour (or itself) whose id has the smallest hash, under a
    hash that differs by round, and replaces the ends of all edges by where they went; edges within
    one node go. A constant share of the nodes goes each round, so rounds grow with the logarithm of
    the largest component. Self-loops keep a node without other edges in the result.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    parts = 1 + edges.count() // ROWS_PER_PART  # few links make few files

    def kept(df: DataFrame, name: str) -> DataFrame:
        return stored(df.coalesce(parts), name)

    labels = kept(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("at", F.col("node")), "labels")
    edges = edges.where("a <> b")
    for round_ in range(ROUNDS):
        if edges.isEmpty():
            break
        if round_ == ROUNDS - 1:
            raise RuntimeError(f"edges are left after {round_} rounds")
        both = edges.union(edges.select("b", "a"))
        salted = F.xxhash64("node", F.lit(round_))
        goes = (
            both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b", F.lit(round_)).alias("h"), F.col("b").alias("to"))).alias("best"))
            .select("node", F.when(F.col("best.h") < salted, F.col("best.to")).otherwise(F.col("node")).alias("to"))
        )
        goes = kept(goes, "goes")
        edges = (
            edges.join(goes.withColumnsRenamed({"node": "a", "to": "to_a"}), "a")
            .join(goes.withColumnsRenamed({"node": "b", "to": "to_b"}), "b")
            .where("to_a <> to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        )
        edges = kept(edges, "edges")
        labels = kept(labels.join(goes.withColumnsRenamed({"node": "at"}), "at", "left").select("node", F.coalesce("to", "at").alias("at")), "labels")
    smallest = labels.groupBy("at").agg(F.min("node").alias("component"))
    return labels.join(smallest, "at").select("node", "component")
