"""Closure of components under audited edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labeltrail.session import cut_lineage


#: Edges up to which a round of the closure runs in one partition, so that it needs no shuffle; more are shuffled.
FEW_EDGES = 1 << 18


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()


def _with_least(edges: DataFrame, whole: bool) -> DataFrame:
    """(a, b, m): m is the smallest b of an a; `whole` edges lie in one partition, where a window needs no shuffle."""
    if whole:
        return edges.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")


def _large_star(edges: DataFrame, whole: bool) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    return _oriented(_with_least(both, whole).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b")))


def _small_star(edges: DataFrame, whole: bool) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    low = _with_least(edges, whole)  # the smallest neighbour's own row links the node itself
    return _oriented(low.select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")))


def connected_minimum(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, canonical) with the smallest id of each connected component, for linked nodes.

    Large-star/small-star rounds: minima and joins only, no neighbour list is collected, so
    a hub node is combined on the map side.  Each round is checkpointed to cut lineage.  The edges never grow in number; once
    there are at most FEW_EDGES of them, a round takes a few tasks in place of several shuffles
    into all partitions.
    """
    current = cut_lineage(_oriented(edges.select(F.col(edges.columns[0]).alias("a"), F.col(edges.columns[1]).alias("b"))))
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = state(current)
    for _ in range(max_rounds):
        whole = before[0] <= FEW_EDGES
        current = cut_lineage(_small_star(_large_star(current.coalesce(1) if whole else current, whole), whole))
        after = state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("component closure did not settle")
    current = current.coalesce(1) if before[0] <= FEW_EDGES else current
    # now every edge leads to the smallest id of its component
    return current.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("canonical")), F.struct(F.col("b").alias("node"), F.col("b").alias("canonical"))))).distinct()


def merge_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components after union along audited edges: canonical id is the smallest original id, with its size in nodes.

    nodes: (node_id, component_id, role); edges: (node_a, node_b).  An edge that is not between known nodes of different
    components and roles is an error, as the audit that made it has failed.
    """
    c = nodes.select("node_id", "component_id", "role")
    end = lambda s: c.select(F.col("node_id").alias(f"node_{s}"), F.col("component_id").alias(f"c{s}"), F.col("role").alias(f"r{s}"))
    pairs = cut_lineage(edges.select("node_a", "node_b").distinct().join(end("a"), "node_a", "left").join(end("b"), "node_b", "left"))
    sound = F.coalesce((F.col("ca") != F.col("cb")) & (F.col("ra") != F.col("rb")), F.lit(False))
    wrong = pairs.where(~sound).count()
    if wrong:
        raise ValueError(f"{wrong} edges are not between known nodes of different components and roles")
    canon = connected_minimum(pairs.select("ca", "cb").distinct())
    out = c.join(canon.withColumnRenamed("node", "component_id"), "component_id", "left")
    out = out.select("node_id", "component_id", F.coalesce("canonical", "component_id").alias("merged_id"))
    sizes = out.groupBy("merged_id").agg(F.count("*").alias("merged_size"))
    return out.join(sizes, "merged_id").select("node_id", "component_id", "merged_id", "merged_size")


def cross_role_edges(hits: DataFrame, nodes: DataFrame, identity: float, coverage: float) -> DataFrame:
    """Qualifying hits whose two ends sit in different roles."""
    q = nodes.select(F.col("node_id").alias("query_node"), F.col("role").alias("query_role"))
    r = nodes.select(F.col("node_id").alias("target_node"), F.col("role").alias("target_role"))
    strong = hits.where((F.col("fident") > identity) & (F.col("qcov") >= coverage) & (F.col("tcov") >= coverage))
    return strong.join(q, "query_node").join(r, "target_node").where(F.col("query_role") != F.col("target_role"))
