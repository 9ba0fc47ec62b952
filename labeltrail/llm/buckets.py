"""Links between members of shared buckets, without comparing all pairs of a group of copies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labeltrail.llm.common import release, staged
from labeltrail.operators.components import connected_minimum


def within_difference(a: Callable[[str], Column], b: Callable[[str], Column], size: str, sketch: list[str], similarity: float) -> Column:
    """Whether sizes and odd sketches leave a Jaccard similarity possible; never rules out a pair that has it.

    An odd sketch flips one of its bits for each element, so two sketches differ in no more bits than the sets differ in elements, and
    sets of n and m elements at the similarity differ in at most (n + m) * (1 - similarity) / (1 + similarity).
    """
    apart = F.lit(0)
    for c in sketch:
        apart = apart + F.bit_count(a(c).bitwiseXOR(b(c)))
    n, m = a(size), b(size)
    return (F.least(n, m) >= similarity * F.greatest(n, m)) & (apart * (1 + similarity) <= (n + m) * (1 - similarity) + 1e-6)


def shared_buckets(keys: DataFrame) -> DataFrame:
    """The rows (key, node) of keys that more than one node has."""
    full = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    return staged(keys.join(full, "key"), "buckets")


def bucket_links(buckets: DataFrame, plausible: Callable[[DataFrame], DataFrame], verified: Callable[[DataFrame], DataFrame],
                 fits: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None) -> tuple[list[DataFrame], DataFrame]:
    """Tables of verified links (a, b) that connect whatever the buckets' pairs can connect, and the components (node, component) of the linked nodes.

    buckets: key, node and facts about the node, by which `fits` rules pairs out before they are made.  Works in rounds:
    1. the first node of each bucket is compared with the others and leaves.
    2. members of the 16 smallest components of a bucket meet four members of each other component, which mostly joins what
       belongs together.
    3. and on: members of the 256, 1024, ... smallest components meet all members of other components, and leave.
    A bucket ends when one component is left: a group of copies costs a few comparisons a member, and any pair that could
    still join two components is compared in the end.  Pairs are not verified twice.  What a round has staged goes with the
    round, but for its pairs and links.
    """
    facts = [c for c in buckets.columns if c not in ("key", "node")]
    links, component, tested, turn = [], None, None, 0
    while True:
        done = [buckets]
        if component is None:
            rows = buckets.withColumns({"component": F.col("node"), "c": F.lit(1).cast("long")})
        else:
            rows = buckets.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
            sizes = rows.groupBy("key", "component").agg(F.count("*").alias("c"))
            mixed = sizes.groupBy("key").agg(F.count("*").alias("parts")).where("parts > 1").select("key")
            rows = rows.join(sizes.join(mixed, "key"), ["key", "component"])
        rows = rows.select("key", "node", "component", "c", *facts)
        if turn:
            rows = staged(rows, "open")
            done.append(rows)
            if rows.isEmpty():
                break
            place = F.row_number().over(Window.partitionBy("key").orderBy("c", "component", "node"))
            first = rows.withColumn("place", place).where(F.col("place") <= (16 if turn == 1 else 256 * 4 ** (turn - 2))).drop("place")
        else:
            first = rows.join(rows.groupBy("key").agg(F.min("node").alias("node")), ["key", "node"])
        first = staged(first.select("key", F.col("node").alias("pivot"), F.col("component").alias("own"), *[F.col(c).alias(f"pivot_{c}") for c in facts]), "pivots")
        done.append(first)
        others = rows
        if turn == 1:
            among = F.row_number().over(Window.partitionBy("key", "component").orderBy(F.xxhash64("node"), "node"))
            others = rows.withColumn("place", among).where(F.col("place") <= 4).drop("place")
        met = F.col("component") != F.col("own")
        if fits is not None:
            met = met & fits(F.col, lambda c: F.col(f"pivot_{c}"))
        pairs = others.join(first, "key").where(met).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = staged(plausible(pairs), "pairs")
        links.append(staged(verified(pairs).distinct(), "links"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        if turn == 1:
            release(*done[1:])
        else:  # pivots have met everybody
            left = rows.join(first.select("key", F.col("pivot").alias("node")), ["key", "node"], "left_anti")
            again = left.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
            buckets = staged(left.join(again.select("key"), "key").select("key", "node", *facts), "buckets")
            release(*done)
            if buckets.isEmpty():
                component, done = merged(component, links[-1]), [buckets]
                break
        turn += 1
        component = merged(component, links[-1])
    release(*done)
    return links, component


def merged(component: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after new links: only the graph of components that they join is closed."""
    if component is None:
        return staged(connected_minimum(links.select("a", "b")).select("node", F.col("canonical").alias("component")), "components")
    of = lambda c: component.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    ends = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        "a", "b", F.coalesce("of_a", "a").alias("ca"), F.coalesce("of_b", "b").alias("cb"))
    if ends.isEmpty():
        return component
    ends = staged(ends, "ends")
    roots = connected_minimum(ends.where(F.col("ca") != F.col("cb")).select("ca", "cb"))
    fresh = ends.select(F.col("a").alias("node"), F.col("ca").alias("component")).unionByName(ends.select(F.col("b").alias("node"), F.col("cb").alias("component")))
    every = component.unionByName(fresh.distinct().join(component.select("node"), "node", "left_anti"))
    out = every.join(roots.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("canonical", "component").alias("component"))
    out = staged(out, "components")
    release(component, ends)
    return out
