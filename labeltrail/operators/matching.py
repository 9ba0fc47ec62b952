"""Matched comparisons: exact strata, rank-paired calipers, paired methods, panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltrail.functions.hashing import key_text, u60
from labeltrail.operators.ranking import null_safe_join, ranked
from labeltrail.session import cut_lineage


def exact_stratum_match(rows: DataFrame, stratum: list[Column], treated: Column, control: Column, key: list[str],
                        cap: int | None = None) -> DataFrame:
    """1:1 pairs inside equal strata, both sides in keyed-hash order.

    The position inside a stratum is the join key, so one hot stratum spreads over all
    tasks.  `cap` keeps the first pairs in (stratum, position) order.
    """
    name = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("MISSING")) for c in stratum])
    base = rows.select(*key, name.alias("stratum_key"), treated.alias("_treated"), control.alias("_control"))
    base = cut_lineage(base.where(F.col("_treated") | F.col("_control")))  # read once per side and size check

    def side(cond: str, tag: str) -> DataFrame:
        h = u60(key_text(tag, *[F.col(k) for k in key]))
        s = base.where(cond).withColumn("_h", h)
        s = ranked(s, ["stratum_key"], [("_h", "asc"), *[(k, "asc") for k in key]], "position")
        return s.select("stratum_key", "position", *[F.col(k).alias(f"{tag.lower()}_{k}") for k in key])

    pairs = side("_treated", "T").join(side("_control", "C"), ["stratum_key", "position"])
    if cap is None:
        return pairs
    pairs = cut_lineage(pairs)
    n = pairs.groupBy("stratum_key").agg(F.count("*").alias("_n"))
    n = ranked(n, [], [("stratum_key", "asc")], "_i")
    from labeltrail.operators.ranking import running_totals

    before = running_totals(n, [], "_i", {"_m": F.sum("_n")}, "asc").select("_i", (F.col("cum__m") - F.col("_m")).alias("_before"))
    n = n.join(before, "_i").select("stratum_key", "_before")
    return pairs.join(n, "stratum_key").where(F.col("_before") + F.col("position") <= cap).drop("_before")


def rank_caliper_match(rows: DataFrame, strata: list[str], side: str, order: str, key: list[str],
                       calipers: dict[str, float], carry: list[str]) -> DataFrame:
    """Pair the i-th high row with the i-th low row of a stratum (by `order`), keep close pairs.

    A caliper only applies when both values are present.  Null strata are strata.
    """
    r = ranked(rows, [*strata, side], [(order, "asc"), *[(k, "asc") for k in key]], "position")
    cols = [*key, *calipers, *carry]
    pick = lambda v, p: r.where(F.col(side) == v).select(
        *strata, "position", *[F.col(c).alias(f"{p}_{c}") for c in dict.fromkeys(cols)])
    j = null_safe_join(pick(1, "high"), pick(0, "low"), [*strata, "position"])
    for c, limit in calipers.items():
        gap = F.abs(F.col("high_" + c) - F.col("low_" + c))
        j = j.where(gap.isNull() | (gap <= limit))
    return j


def paired_methods(rows: DataFrame, method: str, key: str, value: str, base: str, by: list[str]) -> DataFrame:
    """Mean difference of every other method against `base` on the queries both cover."""
    b = rows.where((F.col(method) == base) & F.col(value).isNotNull()).select(*by, key, F.col(value).alias("_base"))
    o = rows.where((F.col(method) != base) & F.col(value).isNotNull())
    d = o.join(b, [*by, key])
    return d.groupBy(*by, F.col(method).alias("baseline")).agg(
        F.count("*").alias("paired_queries"), F.round(F.avg("_base"), 9).alias("mean_base"),
        F.round(F.avg(value), 9).alias("mean_other"), F.round(F.avg(F.col("_base") - F.col(value)), 9).alias("mean_difference"))
