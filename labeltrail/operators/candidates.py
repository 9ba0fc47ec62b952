"""Candidate retention, modality union, fusion ranks and outcome joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labeltrail.operators.ranking import ranked, top_k, top_one

RRF_CONSTANT = 60


def expand_levels(df: DataFrame, levels: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per (row, label level) with a label; levels maps endpoint name -> column."""
    items = F.array(*[F.struct(F.lit(e).alias("endpoint"), F.col(c).alias("label")) for e, c in levels.items()])
    out = df.select(*keep, F.explode(items).alias("_x")).select(*keep, "_x.endpoint", "_x.label")
    return out.where(F.col("label").isNotNull() & (F.col("label") != ""))


def label_outcomes(
    pairs: DataFrame, truth: DataFrame, labels: dict[str, str], outputs: dict[str, str],
    nullable: str = "EXACT",
) -> DataFrame:
    """Attach documented concordance per level to candidate rows.

    Candidate labels are matched to truth rows with one equi-join per level; the
    nullable level is null when either side has nothing recorded.
    """
    out = pairs
    for endpoint, column in labels.items():
        t = truth.where(F.col("endpoint") == endpoint)
        hit = t.select("query_id", F.col("label").alias(column), F.lit(True).alias("_hit"))
        out = out.join(hit, ["query_id", column], "left")
        value = F.coalesce("_hit", F.lit(False))
        if endpoint == nullable:
            known = t.groupBy("query_id").agg(F.lit(True).alias("_known"))
            out = out.join(known, "query_id", "left")
            value = F.when(F.col(column).isNotNull() & F.col("_known"), value)
        out = out.withColumn(outputs[endpoint], value).drop("_hit", "_known")
    return out


def outcomes_by_query(rows: DataFrame, documented: str, labels: dict[str, str], outputs: dict[str, str], nullable: str = "EXACT") -> DataFrame:
    """As `label_outcomes` where the truth are the labels of the query's own rows with `documented` = 1.

    A label is documented if any row of its query that holds it is.  All windows lie within a query, so rows that are dealt by
    query_id are not dealt again; no truth table is built and no row is joined.
    """
    out = rows
    for endpoint, column in labels.items():
        named = F.col(column).isNotNull() & (F.col(column) != "")
        said = F.coalesce(F.col(documented) == 1, F.lit(False)) & named
        value = F.max(said).over(Window.partitionBy("query_id", column))
        if endpoint == nullable:
            value = F.when(F.col(column).isNotNull() & F.max(said).over(Window.partitionBy("query_id")), value)
        out = out.withColumn(outputs[endpoint], value)
    return out


def method_winners(df: DataFrame, methods: dict[str, str], channels: dict[str, str], label: str) -> DataFrame:
    """Top-1 (query, method) rows from a wide score table."""
    items = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(channels[m]).alias("channel"),
                               F.col(c).cast("double").alias("score")) for m, c in methods.items()])
    long = df.select("query_id", "reference_id", F.col(label).alias("label"), F.explode(items).alias("_m"))
    long = long.select("query_id", "reference_id", "label", "_m.method", "_m.channel", "_m.score")
    best = top_one(long.where(F.col("score").isNotNull()), ["query_id", "method"],
                   [("score", "desc"), ("reference_id", "asc")])
    return best.select("query_id", "method", "channel", "label", "score", "reference_id")


def modality_ranks(hits: DataFrame, score: str, k: int, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """First k references of a query by one search score, ties by reference id."""
    return top_k(hits, [by], [(score, "desc"), ("reference_id", "asc")], k, rank)


def fused_union(first: DataFrame, second: DataFrame, first_score: str, second_score: str,
                names: tuple[str, str] = ("sequence", "structure"), constant: int = RRF_CONSTANT) -> DataFrame:
    """Full outer union of two ranked candidate sets with source class and fused score."""
    a, b = names
    key = ["query_id", "reference_id"]
    x = first.select(*key, F.col("rank").alias(f"{a}_rank"), F.col(first_score).alias(f"{a}_score"))
    y = second.select(*key, F.col("rank").alias(f"{b}_rank"), F.col(second_score).alias(f"{b}_score"))
    u = x.join(y, key, "full_outer")
    ra, rb = F.col(f"{a}_rank"), F.col(f"{b}_rank")
    source = F.when(ra.isNotNull() & rb.isNotNull(), f"{a}+{b}").when(ra.isNotNull(), f"{a}_only").otherwise(f"{b}_only")
    part = lambda r: F.coalesce(1.0 / (constant + r), F.lit(0.0))
    return u.withColumns({"source_class": source, "fused_score": part(ra) + part(rb)})


def fused_ranks(rows: DataFrame, modalities: list[tuple[Column, str]], k: int, constant: int = RRF_CONSTANT) -> DataFrame:
    """Rows that are among the first k of a modality, with `fused_score` and `fused_rank`, as `fused_union` and `budget_rank` of top-k rows.

    modalities: (which rows take part, score).  Rows name a (query, reference) once, or once for each of several names of a reference, which
    share a rank.  All windows lie within a query, so rows that are dealt by query_id are not dealt again and no row is joined.
    """
    out, parts = rows, []
    for i, (takes_part, score) in enumerate(modalities):
        order = [F.col(f"_in{i}").desc(), F.col(score).desc_nulls_last(), F.col("reference_id").asc_nulls_last()]
        out = out.withColumn(f"_in{i}", F.coalesce(takes_part, F.lit(False)))
        out = out.withColumn(f"_r{i}", F.when(F.col(f"_in{i}"), F.dense_rank().over(Window.partitionBy("query_id").orderBy(*order))))
        out = out.withColumn(f"_r{i}", F.when(F.col(f"_r{i}") <= k, F.col(f"_r{i}")))
        parts.append(F.coalesce(1.0 / (constant + F.col(f"_r{i}")), F.lit(0.0)))
    out = out.where(F.coalesce(*[F.col(f"_r{i}") for i in range(len(parts))]).isNotNull())
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    # rows without a reference are one row of each modality and do not fuse
    out = out.withColumn("fused_score", F.when(F.col("reference_id").isNull(), F.greatest(*parts)).otherwise(total))
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.col("fused_score").desc(), F.col("reference_id").asc_nulls_last()))
    return out.withColumn("fused_rank", rank.cast("bigint")).drop(*[f"_{c}{i}" for i in range(len(parts)) for c in ("in", "r")])


def union_by_aggregation(parts: list[DataFrame], first: list[str], least: list[str], most: list[str]) -> DataFrame:
    """Union of modality tables with missing columns, reduced per (query, reference)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    # Ignoring-null minimum instead of `first`: the same for single-valued columns, and
    # independent of task order.
    aggs = [F.min(c).alias(c) for c in first] + [F.min(c).alias(c) for c in least] + [F.max(c).alias(c) for c in most]
    return out.groupBy("query_id", "reference_id").agg(*aggs)


def budget_rank(rows: DataFrame, score: str, name: str, by: str = "query_id", bounded: bool = False) -> DataFrame:
    """Rank distinct references of a query by best fused score (null last, ties by id).

    A union of top-k modalities holds at most the sum of their k per query: pass `bounded`.
    """
    per = rows.groupBy(by, "reference_id").agg(F.coalesce(F.max(score), F.lit(float("-inf"))).alias("_best"))
    per = ranked(per, [by], [("_best", "desc"), ("reference_id", "asc")], name, bounded=bounded)
    return rows.join(per.select(by, "reference_id", name), [by, "reference_id"])


def retain_by_cluster(hits: DataFrame, order: list[tuple[str, str]], k: int, cluster: str = "cluster_id",
                      by: str = "query_id") -> DataFrame:
    """First hit per (query, cluster), then the first k clusters of the query."""
    first = top_one(hits, [by, cluster], order)
    return top_k(first, [by], order, k, "modality_rank")


def retention_status(queries: DataFrame, hits: DataFrame, kept: DataFrame, unavailable: DataFrame | None = None) -> DataFrame:
    """Counts and status of every query of the universe, zero-hit queries included."""
    raw = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("raw_hits"))
    keep = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("retained_hits"))
    out = queries.select("query_id").join(raw, "query_id", "left").join(keep, "query_id", "left")
    out = out.fillna(0, ["raw_hits", "retained_hits"])
    gone = F.lit(False)
    if unavailable is not None:
        out = out.join(unavailable.select("query_id", F.lit(True).alias("_gone")).distinct(), "query_id", "left")
        gone = F.coalesce("_gone", F.lit(False))
    status = (F.when(gone, "INPUT_UNAVAILABLE").when(F.col("raw_hits") == 0, "ZERO_HITS")
              .when(F.col("retained_hits") == 0, "NOTHING_ELIGIBLE").otherwise("RETAINED"))
    return out.select("query_id", "raw_hits", "retained_hits", status.alias("status"))


def expand_activities(union: DataFrame, library: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidate x activity rows, per-query expansion status)."""
    expanded = union.join(library, "reference_id")
    n = union.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"))
    m = expanded.groupBy("query_id").agg(F.count(F.lit(1)).alias("activity_rows"))
    status = n.join(m, "query_id", "left").fillna(0, ["activity_rows"])
    state = F.when(F.col("activity_rows") == 0, "NO_ACTIVITY").otherwise("EXPANDED")
    return expanded, status.withColumn("status", state)


def cumulative_hits(ranked_labels: DataFrame, truth: DataFrame, ks: list[int], by: list[str]) -> DataFrame:
    """Distinct labels and distinct documented labels reached within each k.

    Keeps only the first rank of a label, so each (query, label) is one row before the
    k grid is applied; no candidate list is collected.
    """
    firsts = ranked_labels.groupBy(*by, "label").agg(F.min("rank").alias("first_rank"))
    firsts = firsts.join(truth.withColumn("_true", F.lit(1)), [*by, "label"], "left")
    grid = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    inside = firsts.select(*by, "label", "_true", "first_rank", grid).where(F.col("first_rank") <= F.col("k"))
    return inside.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("labels"), F.count("_true").alias("true_labels"))
