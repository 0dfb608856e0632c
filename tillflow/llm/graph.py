"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillflow.llm.shared import settle


def _digest(edges: DataFrame) -> tuple:
    """Count and an order-free checksum: equal for equal edge sets."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _hook(edges: DataFrame, smaller: bool) -> DataFrame:
    """Links the neighbours of each node to the smallest node among them and itself.

    ``smaller``: only the neighbours below the node, and the node itself; else only those above it.
    Minima pre-aggregate before the shuffle and no neighbour list is built, so a node with very many edges is no
    problem; Spark splits its rows in the join.
    """
    if smaller:
        sided = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = sided.groupBy("u").agg(F.min("v").alias("m"))
        joined = sided.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        linked = joined.unionByName(low.select("u", F.col("m").alias("v")))
    else:
        sided = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sided.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        linked = sided.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.where(F.col("u") != F.col("v")).distinct()


def component_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v: long) that is not the smallest of its component.

    Alternating large-star and small-star steps (Kiveris et al. 2014) until nothing changes; the label is the smallest
    node. Each round's edges are written to the shared folder, so lineage stays one round long and a lost executor
    costs its running tasks only. Chains halve each round; ``max_rounds`` only guards against a fault and raises.
    """
    edges = settle(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "edges")
    before = _digest(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = settle(_hook(_hook(edges, smaller=False), smaller=True), "edges")
        after = _digest(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("Components have not converged.")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
