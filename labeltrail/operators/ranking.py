"""Ranking, top-k and running totals that survive a hot group.

`top_k` filters a `row_number`, which Spark turns into a WindowGroupLimit: every
map task sends at most k rows of a group.  `ranked` and `running_totals` need all
rows, so they range-partition by group and full sort key, with Spark's own order of
nulls and NaN, number or add up the rows inside each part in parallel, and add what
the earlier parts of the group hold.  There is one path for every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labeltrail.session import cut_lineage

Order = list[tuple[str, str]]


def _sort_cols(order: Order) -> list[Column]:
    return [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in order]


def top_k(df: DataFrame, by: list[str], order: Order, k: int, name: str = "rank") -> DataFrame:
    """First k rows per group in a total order, with their rank."""
    w = Window.partitionBy(*by).orderBy(*_sort_cols(order))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def top_one(df: DataFrame, by: list[str], order: Order) -> DataFrame:
    """Arg-max row per group; the order must list its tie keys."""
    return top_k(df, by, order, 1, "_top").drop("_top")


def _parts(df: DataFrame, by: list[str], order: Order) -> DataFrame:
    """Rows range-partitioned by group and order, with the number of their part in `_part`.

    Materialised, so that the numbers stay the same for every later step.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(b).asc() for b in by], *_sort_cols(order))
    return cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))


def _earlier(by: list[str]) -> Window:
    """The earlier parts of a group; a group has at most a row per part here."""
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def ranked(df: DataFrame, by: list[str], order: Order, name: str = "rank", bounded: bool = False) -> DataFrame:
    """Row number of every row in its group, over a total order (list the tie keys).

    `bounded` says the caller already cut every group to a fixed size, so a plain window will do.
    """
    if bounded:
        w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*_sort_cols(order))
        return df.withColumn(name, F.row_number().over(w).cast("bigint"))
    work, keys = _parts(df, by, order), [*by, "_part"]
    offsets = work.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(_earlier(by)), F.lit(0)))
    inside = Window.partitionBy(*keys).orderBy(*_sort_cols(order))
    out = null_safe_join(work, offsets.drop("_n"), keys)
    out = out.withColumn(name, (F.row_number().over(inside) + F.col("_before")).cast("bigint"))
    return out.drop("_part", "_before")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where a null equals a null; the keys come from the left."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, "_r_" + k)
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed["_r_" + k])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*["_r_" + k for k in keys])


def running_totals(df: DataFrame, by: list[str], value: str, sums: dict[str, Column], direction: str = "desc") -> DataFrame:
    """Totals per distinct value and running totals `cum_*` up to and including it.

    Equal values are one step, so curves built on the result are tie-safe.
    """
    order = [(value, direction)]
    work, keys = _parts(df.groupBy(*by, value).agg(*[c.alias(k) for k, c in sums.items()]), by, order), [*by, "_part"]
    offsets = work.groupBy(*keys).agg(*[F.sum(k).alias(f"_t_{k}") for k in sums])
    offsets = offsets.withColumns({f"_b_{k}": F.coalesce(F.sum(f"_t_{k}").over(_earlier(by)), F.lit(0)) for k in sums})
    offsets = offsets.drop(*[f"_t_{k}" for k in sums])
    inside = Window.partitionBy(*keys).orderBy(*_sort_cols(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = null_safe_join(work, offsets, keys)
    out = out.withColumns({f"cum_{k}": F.sum(k).over(inside) + F.col(f"_b_{k}") for k in sums})
    return out.drop("_part", *[f"_b_{k}" for k in sums])


def dense_index(df: DataFrame, key: str, within: list[str] | None = None, slices: int = 64) -> DataFrame:
    """Number distinct keys 0..k-1 (per `within` group) and attach k, in parallel.

    Order: SHA-256 slice of the key, then the key.  Slices of a hash are even, so no
    quantile pass is needed.
    """
    from labeltrail.functions.hashing import bucket

    within = within or []
    keys = df.select(*within, key).distinct().withColumn(
        "_s", bucket(F.col(key).cast("string"), slices))
    per = keys.groupBy(*within, "_s").agg(F.count(F.lit(1)).alias("_n"))
    groups = Window.partitionBy(*(within or [F.lit(0)]))
    per = per.withColumns({
        "_before": F.coalesce(F.sum("_n").over(
            groups.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "n_keys": F.sum("_n").over(groups),
    }).drop("_n")
    inside = Window.partitionBy(*within, "_s").orderBy(key)
    out = keys.join(per, [*within, "_s"])
    return out.withColumn("key_index", F.row_number().over(inside) - 1 + F.col("_before")).drop("_s", "_before")


def exact_quantiles(
    df: DataFrame,
    value: str,
    steps: int,
    by: list[str] | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles at j/steps, j = 0..steps, one row per j.

    Works from running counts of distinct values, so no task holds a whole column:
    a value covering ranks [a, b] answers exactly the grid points whose lower or
    upper neighbour rank lies in it.  `totals` passes ascending running totals (n, cum_n)
    that the caller already holds.
    """
    by = by or []
    if totals is None:
        clean = df.where(F.col(value).isNotNull())
        totals = running_totals(clean, by, value, {"n": F.count(F.lit(1))}, "asc")
    steps_df = totals
    total = steps_df.groupBy(*by).agg(F.max("cum_n").alias("_total"))
    rows = null_safe_join(steps_df, total, by) if by else attach_one_row(steps_df, total)
    m = F.lit(steps)
    span = F.greatest(F.col("_total") - 1, F.lit(1))
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1

    def ceil_div(x):
        return F.expr("0").cast("bigint") - F.floor(-x / span).cast("bigint")

    lone = F.col("_total") == 1
    low_from = ceil_div(first * m)
    low_to = ceil_div((last + 1) * m) - 1
    high_from = F.floor((first - 1) * m / span).cast("bigint") + 1
    high_to = F.floor(last * m / span).cast("bigint")

    def side(lo, hi, name):
        lo = F.when(lone, F.lit(0)).otherwise(F.greatest(lo, F.lit(0)))
        hi = F.when(lone, m).otherwise(F.least(hi, m))
        part = rows.where(hi >= lo).select(
            *by, "_total", F.col(value).cast("double").alias(name), F.explode(F.sequence(lo, hi)).alias("step"))
        return part

    low = side(low_from, low_to, "_low")
    high = side(high_from, high_to, "_high").drop("_total")
    both = null_safe_join(low, high, [*by, "step"])
    h = F.col("step") * (F.col("_total") - 1) / m
    frac = h - F.floor(h)
    return both.select(
        *by, F.col("step").cast("int").alias("step"),
        (F.col("_low") + (F.col("_high") - F.col("_low")) * frac).alias("quantile"),
        F.col("_total").alias("n_rows"))


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of an ungrouped aggregate (exactly one row) to every row."""
    return df.join(F.broadcast(one_row))


def previous_row(df: DataFrame, by: list[str], order: Order, columns: list[str]) -> DataFrame:
    """Attach `prev_*` values of the row before, over a total order.

    Rows are numbered and joined to their neighbour, so an ungrouped order needs no
    single-task window.
    """
    r = ranked(df, by, order, "_i")
    p = r.select(*by, (F.col("_i") + 1).alias("_i"), *[F.col(c).alias("prev_" + c) for c in columns])
    return null_safe_join(r, p, [*by, "_i"], "left").drop("_i")


def settled(one_row: DataFrame) -> DataFrame:
    """Compute an ungrouped aggregate once and keep its single row as a literal table."""
    return one_row.sparkSession.createDataFrame([one_row.first()], one_row.schema)
