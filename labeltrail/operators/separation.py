"""Cutoffs inside a ranked list and running precision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltrail.operators.ranking import ranked, running_totals, top_k


def maximum_separation(rows: DataFrame, by: str, distance: str, tie: str, top: int = 10, limit: int = 5) -> DataFrame:
    """Number of outputs per query: the first above-mean gap among the nearest `top` distances.

    The centre is the mean of all but the nearest, padded with ten copies of the farthest;
    gaps compare neighbouring |distance - centre|.  Without a large gap, or when the first
    is `limit` or more positions down, one output is kept.
    """
    near = top_k(rows.select(by, distance, tie), [by], [(distance, "asc"), (tie, "asc")], top, "_r")
    v = near.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_r", distance))).alias("_l"))  # at most `top` entries
    v = v.withColumn("v", F.transform("_l", lambda x: x[distance]))
    n = F.size("v")
    total = F.aggregate(F.slice("v", 2, top), F.lit(0.0), lambda a, x: a + x)
    centre = (total + 10 * F.element_at("v", -1)) / (n - 1 + 10)
    v = v.withColumn("c", centre).withColumn("s", F.transform("v", lambda x: F.abs(x - F.col("c"))))
    gaps = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.abs(F.element_at("s", i + 1) - F.element_at("s", i)))).otherwise(
        F.array().cast("array<double>"))
    v = v.withColumn("g", gaps)
    mean = F.aggregate("g", F.lit(0.0), lambda a, x: a + x) / F.size("g")
    v = v.withColumn("m", F.when(F.size("g") > 0, mean))
    # A gap counts as large beyond rounding noise, so equal gaps never pick by chance.
    first = F.array_position(F.transform("g", lambda x: x > F.col("m") + 1e-12), F.lit(True))
    out = F.when((F.size("g") == 0) | (first == 0) | (first - 1 >= limit), F.lit(1)).otherwise(first)
    return v.select(by, out.cast("int").alias("outputs"))


def running_precision(rows: DataFrame, by: list[str], order: list[tuple[str, str]], y: str) -> DataFrame:
    """Average precision over a strict row order (ties already broken)."""
    r = ranked(rows.select(*by, *[c for c, _ in order], F.col(y).cast("int").alias("_y")), by, order, "_r")
    # Only positive rows matter: the c-th positive at rank r adds c/r.
    pos = running_totals(r.where(F.col("_y") == 1), by, "_r", {"k": F.count("*")}, "asc")
    hit = pos.groupBy(*by).agg(F.round(F.sum(F.col("cum_k") / F.col("_r")) / F.sum("k"), 9).alias("average_precision"))
    return rows.select(*by).distinct().join(hit, by, "left")
