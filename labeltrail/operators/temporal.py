"""Task labels between two releases of an item's documented activities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _counts(a: DataFrame, prefix: str) -> DataFrame:
    return a.groupBy("item").agg(F.count_distinct("l4").alias(f"{prefix}_l4"), F.count_distinct("exact").alias(f"{prefix}_exact"))


def task_labels(before: DataFrame, after: DataFrame) -> DataFrame:
    """Label counts, deepest recorded level and novelty of each item of the later release.

    A signature is (l4, exact).  `novel_signature`: some signature was unknown to the whole
    earlier release; `new_for_item`: some signature was not recorded for the item itself.
    """
    sig = ["l4", F.coalesce("exact", F.lit("")).alias("x")]
    s0, s1 = before.select("item", *sig).distinct(), after.select("item", *sig).distinct()
    known = s0.select("l4", "x", F.lit(1).alias("_g")).distinct()
    mine = s0.select("item", "l4", "x", F.lit(1).alias("_m"))
    j = s1.join(known, ["l4", "x"], "left").join(mine, ["item", "l4", "x"], "left")
    novelty = j.groupBy("item").agg(F.max(F.col("_g").isNull().cast("int")).alias("novel_signature"),
                                    F.max(F.col("_m").isNull().cast("int")).alias("new_for_item"))
    out = _counts(after, "after").join(_counts(before, "before"), "item", "left").join(novelty, "item")
    depth = F.when(F.col("after_exact") > 0, 3).when(F.col("after_l4") > 0, 2).otherwise(1)
    return out.select("item", F.coalesce("before_l4", F.lit(0)).alias("before_l4"), "after_l4", "after_exact", depth.alias("after_resolution"),
                      F.col("before_l4").isNull().cast("int").alias("new_item"), "novel_signature", "new_for_item")
