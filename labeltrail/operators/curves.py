"""Ranking metrics, threshold curves and cutoff selection from running totals.

Every curve is built from totals per distinct score (`running_totals`), never from
rows joined to a threshold list, so its cost is one aggregation of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labeltrail.functions.measures import n_if, ratio, wilson_lower
from labeltrail.operators.ranking import exact_quantiles, null_safe_join, ranked, running_totals
from labeltrail.session import cut_lineage

NO_CUTOFF = 1.000001


def ranking_metrics(rows: DataFrame, by: list[str], score: str, y: str, weight: str | None = None,
                    digits: int = 9, curves: int | None = None) -> DataFrame:
    """Weighted AUROC and average precision; equal scores count as one step.

    `curves`: `by` is one column of whole numbers below it, one for each curve over the same rows; they are dealt once, and only the
    average precision is returned, not rounded.
    """
    if curves is not None:
        return sliced_average_precision(rows, by[0], curves - 1, score, y, weight)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    t = F.col(y).cast("boolean")
    cell = lambda cond: F.sum(F.when(cond, w).otherwise(F.lit(0.0)))
    steps = running_totals(rows, by, score, {"pos": cell(t), "neg": cell(~t)}, "desc")
    pos, neg, cp, cn = (F.col(x) for x in ("pos", "neg", "cum_pos", "cum_neg"))
    agg = steps.groupBy(*by).agg(
        F.sum(neg * (cp - pos / 2)).alias("area"), F.sum(pos * ratio(cp, cp + cn)).alias("ap"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return agg.select(
        *by, F.when(both, F.round(F.col("area") / (F.col("positives") * F.col("negatives")), digits)).alias("auroc"),
        F.when(both, F.round(F.col("ap") / F.col("positives"), digits)).alias("average_precision"),
        "positives", "negatives")


#: Slices of a curve, a power of two.
SLICES = 64


def sliced_average_precision(grid: DataFrame, step: str, last: int, score: str, y: str, weight: str) -> DataFrame:
    """(step, average_precision) of many curves over the same rows, steps 0..last; as `ranking_metrics`, null without both outcomes.

    Rows are dealt once, by step and slice of the score between approximate quantiles; totals of the slices, added up where the rows
    are, give what lies above each.  `grid` is computed three times: it should come from a table that is at hand.
    """
    w, t = F.col(weight).cast("double"), F.col(y).cast("boolean")
    x = grid.select(step, score, F.when(t, w).otherwise(0.0).alias("pos"), F.when(~t, w).otherwise(0.0).alias("neg"))
    cuts = F.percentile_approx(score, F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)]), F.lit(20 * SLICES))
    found = {r[0]: r[1] for r in x.groupBy(step).agg(cuts).collect()}  # SLICES numbers a step
    cuts = F.array(*[F.array(*[F.lit(float(c)) for c in sorted(found.get(i) or [0.0] * (SLICES - 1))]) for i in range(last + 1)])
    x = x.withColumn("_own", F.get(cuts, F.col(step))).withColumn("_slice", F.lit(0))
    half = SLICES // 2
    while half:  # binary search, one column after the other
        x = x.withColumn("_slice", F.col("_slice") + F.when(F.get("_own", F.col("_slice") + (half - 1)) <= F.col(score), half).otherwise(0))
        half //= 2
    x = x.drop("_own")
    sums = x.groupBy(step, "_slice").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))  # steps x SLICES rows
    above = Window.partitionBy(step).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(step, "_slice", *[F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias("_" + c) for c in ("pos", "neg")])
    inside = Window.partitionBy(step, "_slice").orderBy(F.col(score).desc_nulls_last())  # equal scores are one place
    x = x.withColumns({"_cp": F.sum("pos").over(inside), "_cn": F.sum("neg").over(inside)}).join(F.broadcast(sums), [step, "_slice"])
    p = F.col("_cp") + F.col("_pos")
    m = x.groupBy(step).agg(F.sum(F.col("pos") * ratio(p, p + F.col("_cn") + F.col("_neg"))).alias("ap"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return m.select(step, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("ap") / F.col("p")).alias("average_precision"))


def grid_totals(rows: DataFrame, by: list[str], score: str, steps: int, sums: dict[str, Column]) -> DataFrame:
    """For each quantile cutoff j/steps of the score: the cutoff and sums over rows at or above it."""
    clean = rows.where(F.col(score).isNotNull())
    totals = cut_lineage(running_totals(clean, by, score, {"n": F.count(F.lit(1)), **sums}, "asc"))
    n_all = totals.groupBy(*by).agg(F.max("cum_n").alias("_total"))
    cuts = exact_quantiles(clean, score, steps, by, totals=totals)
    joined = totals.join(n_all, by) if by else totals.join(F.broadcast(n_all))
    span = F.greatest(F.col("_total") - 1, F.lit(1))
    last = F.floor((F.col("cum_n") - 1) * F.lit(steps) / span).cast("int")
    step = F.when(F.col("_total") == 1, F.lit(steps)).otherwise(last)
    per = joined.groupBy(*by, step.alias("step")).agg(
        F.sum("n").alias("accepted"), *[F.sum(k).alias(k) for k in sums])
    above = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("step").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    grid = cuts.join(per, [*by, "step"], "left").fillna(0, ["accepted", *sums])
    grid = grid.withColumns({k: F.sum(k).over(above) for k in ["accepted", *sums]})
    return grid.withColumnRenamed("quantile", "threshold")


def safe_cutoffs(rows: DataFrame, by: list[str], score: str, y: str, targets: list[float], minimum: int = 100,
                 steps: int = 1000) -> DataFrame:
    """Per target precision: lowest quantile cutoff with enough rows and a Wilson bound that holds."""
    grid = grid_totals(rows, by, score, steps, {"correct": F.sum(F.col(y).cast("int"))})
    grid = grid.withColumn("target", F.explode(F.array(*[F.lit(float(x)) for x in targets])))
    low = wilson_lower("correct", "accepted")
    ok = (F.col("accepted") >= minimum) & (low >= F.col("target")) & (F.col("n_rows") >= minimum)
    pick = F.min(F.when(ok, F.struct("threshold", "accepted", "correct", low.alias("low")))).alias("b")
    out = grid.groupBy(*by, "target").agg(pick, F.max("n_rows").alias("queries"))
    hit = F.coalesce("b.accepted", F.lit(0))
    return out.select(
        *by, "target", F.coalesce("b.threshold", F.lit(NO_CUTOFF)).alias("threshold"), hit.alias("accepted"),
        F.coalesce("b.correct", F.lit(0)).alias("accepted_correct"),
        F.round(ratio("b.correct", "b.accepted"), 9).alias("precision"), F.round("b.low", 9).alias("wilson_lower"),
        F.round(ratio(hit, F.col("queries")), 9).alias("coverage"))


def safe_cutoff(rows: DataFrame, by: list[str], score: str, y: str, desired: float, minimum: int = 100,
                steps: int = 1000) -> DataFrame:
    return safe_cutoffs(rows, by, score, y, [desired], minimum, steps).drop("target")


def hierarchy_rules(tops: dict[str, DataFrame], by: list[str], scores: dict[str, str], y: dict[str, str],
                    targets: list[float], minimum: int = 100, steps: int = 1000) -> DataFrame:
    """Cutoffs per (group, level, target); deeper levels only see rows that pass the L3 cutoff.

    `tops` holds the selected row per query and group for each level, L3 first.
    """
    levels = list(tops)
    base = levels[0]
    first = cut_lineage(safe_cutoffs(tops[base], by, scores[base], y[base], targets, minimum, steps)).withColumn("level", F.lit(base))
    out, gate = first, first.select(*by, "target", F.col("threshold").alias("_gate"))
    for level in levels[1:]:
        gated = tops[level].join(gate, by).where(F.col(scores[base]) >= F.col("_gate"))
        rule = safe_cutoffs(gated.withColumnRenamed("target", "_want"), [*by, "_want"], scores[level], y[level],
                            targets, minimum, steps).where(F.col("_want") == F.col("target")).drop("_want")
        # A group whose gate admits nobody still needs its (unreachable) cutoff row.
        empty = gate.select(*by, "target").join(rule, [*by, "target"], "left").withColumn("level", F.lit(level))
        out = out.unionByName(empty.fillna({"threshold": NO_CUTOFF, "accepted": 0, "accepted_correct": 0, "coverage": 0.0}))
    return out


def guarded_cutoff(rows: DataFrame, score: str, y: str, cluster: str, source: str, internal: str, target: float,
                   guard: float, replicates: int, context: str, steps: int = 120, minimum: int = 50,
                   min_clusters: int = 20, guard_rows: int = 8) -> DataFrame:
    """Quantile cutoff with the most accepted rows such that precision, its cluster-bootstrap
    lower bound and every sizeable outside source hold; one row, or none when nothing qualifies.
    """
    rows = cut_lineage(rows.select(score, y, cluster, source))
    totals = cut_lineage(running_totals(rows, [], score, {"n": F.count("*")}, "asc"))
    n_all = totals.agg(F.max("cum_n").alias("_total"))
    step = F.floor((F.col("cum_n") - 1) * F.lit(steps) / F.greatest(F.col("_total") - 1, F.lit(1))).cast("int")
    mark = totals.join(F.broadcast(n_all)).select(score, step.alias("_s"))
    cells = rows.groupBy(score, source, cluster).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("int")).alias("ok"))
    cells = cut_lineage(cells.join(mark, score).groupBy("_s", source, cluster).agg(F.sum("n").alias("n"), F.sum("ok").alias("ok")))
    upto = F.explode(F.sequence(F.lit(0), F.col("_s"))).alias("step")
    per_source = cells.groupBy("_s", source).agg(F.sum("n").alias("n"), F.sum("ok").alias("ok")).select(source, "n", "ok", upto)
    per_source = per_source.groupBy("step", source).agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
    breach = (F.col(source) != internal) & (F.col("n") >= guard_rows) & (F.col("ok") / F.col("n") < guard)
    acc = per_source.groupBy("step").agg(F.sum("n").alias("accepted"), F.sum("ok").alias("correct"),
                                         n_if(breach).alias("breaches"))
    cl = cells.groupBy(cluster).agg(F.max("_s").alias("_s")).groupBy("_s").agg(F.count("*").alias("c")).select(
        "c", upto).groupBy("step").agg(F.sum("c").alias("clusters"))
    cuts = exact_quantiles(rows, score, steps, totals=totals).select("step", F.col("quantile").alias("threshold"))
    grid = cuts.join(acc, "step").join(cl, "step").withColumn("precision", F.col("correct") / F.col("accepted"))
    grid = cut_lineage(grid)  # one row per grid point
    first_steps = grid.groupBy("threshold").agg(F.min("step").alias("step"))
    grid = grid.join(first_steps, ["threshold", "step"], "left_semi")
    fine = grid.where((F.col("accepted") >= minimum) & (F.col("clusters") >= min_clusters)
                      & (F.col("precision") >= target) & (F.col("breaches") == 0))
    # at most steps + 1 numbers, the most rows first: the first whose lower bound holds is the answer, so no later one is resampled
    passing = [r.step for r in fine.orderBy(F.col("accepted").desc(), F.col("precision").desc(), "threshold").collect()]
    cells = cells.groupBy("_s", cluster).agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
    done = 0
    while True:
        tried = passing[done:2 * done + 1]  # 1, 2, 4, ... at once
        at = F.array(*[F.lit(j) for j in tried]) if tried else F.array().cast("array<int>")
        boot = cells.select(cluster, "n", "ok", F.explode(F.filter(at, lambda j: j <= F.col("_s"))).alias("step"))
        low = cut_lineage(count_lower_bound(boot, cluster, ["step"], replicates, context))
        good = fine.join(low, "step").where(F.col("lower") >= target)
        done += len(tried)
        if done == len(passing) or not good.isEmpty():
            break
    return good.agg(F.max(F.struct("accepted", "precision", (-F.col("threshold")).alias("neg"), "clusters", "lower")).alias("b")).where(
        F.col("b").isNotNull()).select(
        (-F.col("b.neg")).alias("threshold"), "b.accepted", "b.clusters", F.round("b.precision", 9).alias("precision"),
        F.round("b.lower", 9).alias("lower"))


def count_lower_bound(cells: DataFrame, cluster: str, by: list[str], replicates: int, context: str) -> DataFrame:
    """2.5% cluster-bootstrap bound of ok/n from cells that already hold counts."""
    from labeltrail.operators.resample import draw, replicate_sums

    totals = cells.groupBy(cluster, *by).agg(F.sum("ok").alias("ok"), F.sum("n").alias("n"))
    draws = draw(totals, cluster, replicates, context, by)
    reps = replicate_sums(totals, draws, cluster, by, ["ok", "n"], by)
    return reps.groupBy(*by).agg(F.percentile(ratio("ok", "n"), F.lit(0.025)).alias("lower"))


def best_f1_cutoff(rows: DataFrame, by: list[str], score: str, y: str, weight: str, steps: int = 200) -> DataFrame:
    """Cutoff of the largest weighted F1 over quantile cutoffs; lowest cutoff on ties."""
    w, t = F.col(weight).cast("double"), F.col(y).cast("boolean")
    grid = grid_totals(rows, by, score, steps, {
        "tp": F.sum(F.when(t, w).otherwise(0.0)), "fp": F.sum(F.when(~t, w).otherwise(0.0))})
    total = grid.groupBy(*by).agg(F.max("tp").alias("positives"))
    g = grid.join(total, by) if by else grid.join(F.broadcast(total))
    f1 = F.coalesce(ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives")), F.lit(0.0))
    best = g.groupBy(*by).agg(F.min(F.struct((-F.round(f1, 12)).alias("neg"), F.col("threshold"))).alias("b"))
    return best.select(*by, F.col("b.threshold").alias("threshold"), F.round(-F.col("b.neg"), 9).alias("f1"))


def ece_equal_width(rows: DataFrame, by: list[str], p: str, y: str, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal-width bins, last bin closed on the right."""
    b = F.least(F.floor(F.col(p).cast("double") * bins), F.lit(bins - 1))
    per = rows.groupBy(*by, b.alias("bin")).agg(
        F.count("*").alias("n"), F.sum(F.col(p).cast("double")).alias("sp"), F.sum(F.col(y).cast("double")).alias("sy"))
    return per.groupBy(*by).agg(F.round(F.sum(F.abs(F.col("sy") - F.col("sp"))) / F.sum("n"), 9).alias("ece"),
                                F.sum("n").alias("n"))


def equal_count_bins(rows: DataFrame, by: list[str], p: str, y: str, tie: str, bins: int = 10) -> DataFrame:
    """Calibration table over equal-count bins of the ranked probability."""
    rows = cut_lineage(rows.select(*by, p, y, tie))
    r = ranked(rows, by, [(p, "asc"), (tie, "asc")], "_rank")
    n = rows.groupBy(*by).agg(F.count("*").alias("_total"))
    r = r.join(n, by) if by else r.join(F.broadcast(n))
    b = F.least(F.floor((F.col("_rank") - 1) * bins / F.col("_total")), F.lit(bins - 1)) + 1
    return r.groupBy(*by, b.cast("int").alias("bin")).agg(
        F.count("*").alias("queries"), F.round(F.avg(F.col(p).cast("double")), 9).alias("mean_predicted"),
        F.round(F.avg(F.col(y).cast("double")), 9).alias("observed_precision"),
        F.min(p).alias("min_probability"), F.max(p).alias("max_probability"))


def ece_equal_count(bins: DataFrame, by: list[str]) -> DataFrame:
    gap = F.col("queries") * F.abs(F.col("mean_predicted") - F.col("observed_precision"))
    return bins.groupBy(*by).agg(F.round(F.sum(gap) / F.sum("queries"), 8).alias("ece"))


def risk_coverage(rows: DataFrame, by: list[str], p: str, y: str, tie: str, points: int = 100) -> DataFrame:
    """Precision and risk of the most confident share of rows, for an even coverage grid."""
    rows = cut_lineage(rows.select(*by, p, y, tie))
    r = ranked(rows, by, [(p, "desc"), (tie, "asc")], "_rank")
    n = rows.groupBy(*by).agg(F.count("*").alias("_total"))
    r = r.join(n, by) if by else r.join(F.broadcast(n))
    size = lambda g: F.greatest(F.lit(1), F.bround(g * F.col("_total") / points, 0)).cast("bigint")
    guess = F.ceil((F.col("_rank") - 0.5) * points / F.col("_total"))
    near = [F.greatest(F.lit(1), guess + d) for d in (-1, 0, 1)]
    step = F.when(size(near[0]) >= F.col("_rank"), near[0]).when(size(near[1]) >= F.col("_rank"), near[1]).otherwise(near[2])
    per = r.groupBy(*by, "_total", step.cast("int").alias("step")).agg(
        F.count("*").alias("n"), F.sum(F.col(y).cast("int")).alias("ok"), F.min(p).alias("low"))
    grid = n.select(*by, "_total", F.explode(F.sequence(F.lit(1), F.lit(points))).alias("step"))
    upto = Window.partitionBy(*(by or [F.lit(0)])).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = grid.join(per, [*by, "_total", "step"], "left").fillna(0, ["n", "ok"])
    # A grid point that repeats the size of the one before shares its totals; the first
    # points of a tiny group all accept one row.
    g = g.withColumns({"accepted_rows": size(F.col("step")), "_n": F.sum("n").over(upto), "_ok": F.sum("ok").over(upto),
                       "min_probability": F.min("low").over(upto)})
    return g.select(
        *by, "step", F.round(F.col("_n") / F.col("_total"), 9).alias("coverage"), F.col("_n").alias("accepted_rows"),
        F.round(F.col("_ok") / F.col("_n"), 9).alias("precision"),
        F.round(1 - F.col("_ok") / F.col("_n"), 9).alias("risk"), "min_probability")


def operating_points(rows: DataFrame, score: str, y: str, cluster: str, total_queries: int, points: int = 20,
                     target: float = 0.95, min_accepted: int = 50, min_clusters: int = 20) -> DataFrame:
    """Tie-inclusive acceptance at the score that reaches each target coverage.

    One row per distinct cutoff (with the first target it serves).  Clusters accepted at
    a cutoff are those whose best score reaches it: a running count, not a distinct set.
    """
    clean = rows.where(F.col(score).isNotNull())
    steps = running_totals(clean, [], score, {"n": F.count("*"), "ok": F.sum(F.col(y).cast("int"))}, "desc")
    first = F.floor((F.col("cum_n") - F.col("n")) * points / total_queries) + 1
    last = F.least(F.floor(F.col("cum_n") * points / total_queries), F.lit(points))
    hit = steps.where(last >= first).select(
        (first / points).alias("target_coverage"), F.col(score).alias("threshold"),
        F.col("cum_n").alias("accepted"), F.col("cum_ok").alias("correct"))
    best = clean.groupBy(cluster).agg(F.max(score).alias(score))
    marks = hit.select(F.col("threshold").alias(score)).withColumn("c", F.lit(0)).unionByName(
        best.groupBy(score).agg(F.count("*").alias("c")))
    run = running_totals(marks, [], score, {"c": F.sum("c")}, "desc")
    out = hit.join(run.select(F.col(score).alias("threshold"), F.col("cum_c").alias("clusters")), "threshold")
    precision = ratio("correct", "accepted")
    return out.select(
        F.round("target_coverage", 9).alias("target_coverage"), "threshold", "accepted", "clusters",
        F.round(F.col("accepted") / total_queries, 9).alias("coverage"), F.round(precision, 9).alias("precision"),
        ((F.col("accepted") >= min_accepted) & (F.col("clusters") >= min_clusters) & (precision >= target)).cast("int")
        .alias("qualifies"))


def binned_rates(rows: DataFrame, by: list[str], metric: str, edges: list[float], targets: list[str], weight: str,
                 cluster: str, query: str = "query_id", replicates: int = 2000, context: str = "curve") -> DataFrame:
    """Weighted outcome rate per left-closed evidence bin with row, query and cluster counts.

    Each rate has a 95% interval from resampling the clusters of its bin.
    """
    valid = rows.where(F.col(metric).isNotNull())
    b = left_closed_bin(F.col(metric), edges)
    valid = valid.withColumn("bin", b).where(F.col("bin").isNotNull())
    w = F.col(weight).cast("double")
    agg = valid.groupBy(*by, "bin").agg(
        F.min(metric).alias("bin_lower"), F.max(metric).alias("bin_upper"), F.count("*").alias("pair_rows"),
        F.count_distinct(query).alias("queries"), F.count_distinct(cluster).alias("clusters"),
        *[F.round(ratio(F.sum(w * F.col(t).cast("int")), F.sum(w)), 9).alias("rate_" + t) for t in targets])
    cells = valid.groupBy(*by, "bin", cluster).agg(F.sum(w).alias("w"), *[F.sum(w * F.col(t).cast("int")).alias("w_" + t) for t in targets])
    return null_safe_join(agg, rate_intervals(cells, [*by, "bin"], cluster, targets, "rate_", replicates, context), [*by, "bin"])


def rate_intervals(cells: DataFrame, by: list[str], cluster: str, targets: list[str], prefix: str, replicates: int, context: str) -> DataFrame:
    """95% intervals of weighted rates per group from cluster totals w and w_<target>; a group's own clusters are resampled."""
    from labeltrail.operators.resample import draw, interval, replicate_sums

    cells = cut_lineage(cells)
    draws = draw(cells, cluster, replicates, context, by)
    reps = replicate_sums(cells, draws, cluster, by, ["w", *["w_" + t for t in targets]], by)
    names = [prefix + t for t in targets]
    return interval(reps.select(*by, "replicate", *[ratio("w_" + t, "w").alias(n) for t, n in zip(targets, names)]), by, names, replicates)


def left_closed_bin(x: Column, edges: list[float]) -> Column:
    """Bin number for [e0, e1), [e1, e2), ...; null outside."""
    out = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        cond = (x >= lo) & (x < hi)
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out


def right_closed_bin(x: Column, edges: list[float]) -> Column:
    """Bin number for (-inf, e0], (e0, e1], ..., (ek, inf)."""
    out = F.when(x <= edges[0], F.lit(0))
    for i, hi in enumerate(edges[1:], 1):
        out = out.when(x <= hi, F.lit(i))
    return out.when(x.isNotNull(), F.lit(len(edges)))


def threshold_sweep(rows: DataFrame, by: list[str], metric: str, thresholds: list[float], targets: list[str], weight: str,
                    cluster: str, minimum: int = 20, replicates: int = 0, context: str = "threshold", plain: bool = False) -> DataFrame:
    """Weighted precision and coverage at fixed cutoffs with at least `minimum` rows; with `plain` also unweighted `raw_precision_*`.

    Rows are first reduced per (group, cluster, highest cutoff reached).  A cluster counts at the cutoffs up to its highest, so only totals
    per cutoff are spread.  With `replicates`, each precision has a 95% interval from resampling the clusters above its cutoff.
    """
    valid = rows.where(F.col(metric).isNotNull())
    level = sum((F.when(F.col(metric) >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    w = F.col(weight).cast("double")
    sums = ["w", *["w_" + t for t in targets], *["n_" + t for t in targets]]
    cells = valid.withColumn("_level", level).groupBy(*by, cluster, "_level").agg(
        F.count("*").alias("n"), F.sum(w).alias("w"), *[F.sum(w * F.col(t).cast("int")).alias("w_" + t) for t in targets],
        *[F.sum(F.col(t).cast("int")).alias("n_" + t) for t in targets])
    total = cells.groupBy(*by).agg(F.sum("w").alias("_all"))
    cuts = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("_i"), F.lit(float(t)).alias("threshold"))
                               for i, t in enumerate(thresholds)])).alias("_t")
    at_cuts = lambda d: d.select("*", cuts).where(F.col("_level") >= F.col("_t._i")).withColumn("threshold", F.col("_t.threshold"))
    if replicates:
        spread = at_cuts(cells).groupBy(*by, "threshold", cluster).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])
        spread = cut_lineage(spread.withColumn("clusters", F.lit(1).cast("bigint")))
    else:
        highest = cells.groupBy(*by, cluster).agg(F.max("_level").alias("_level")).groupBy(*by, "_level").agg(F.count("*").alias("clusters"))
        levels = cells.groupBy(*by, "_level").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])
        spread = at_cuts(levels.unionByName(highest, allowMissingColumns=True))  # groups x cutoffs rows
    out = spread.groupBy(*by, "threshold").agg(F.sum("n").alias("pair_rows"), F.sum("clusters").alias("clusters"), *[F.sum(c).alias(c) for c in sums])
    out = null_safe_join(out.where(F.col("pair_rows") >= minimum), total, by)
    out = out.select(*by, "threshold", "pair_rows", "clusters", F.round(ratio("w", "_all"), 9).alias("coverage"),
                     *[F.round(ratio("w_" + t, "w"), 9).alias("precision_" + t) for t in targets],
                     *[F.round(ratio("n_" + t, "pair_rows"), 9).alias("raw_precision_" + t) for t in targets if plain])
    if not replicates:
        return out
    kept = null_safe_join(spread.drop("clusters"), out.select(*by, "threshold"), [*by, "threshold"], "left_semi")
    return null_safe_join(out, rate_intervals(kept, [*by, "threshold"], cluster, targets, "precision_", replicates, context), [*by, "threshold"])


def stratified_rates(rows: DataFrame, strata: dict[str, str], targets: list[str], weight: str, cluster: str,
                     minimum: int = 100) -> DataFrame:
    """Weighted rates per (stratum type, stratum) with at least `minimum` rows."""
    items = F.array(*[F.struct(F.lit(k).alias("stratum_type"), F.coalesce(F.col(v).cast("string"), F.lit("null")).alias("value"))
                      for k, v in strata.items()])
    long = rows.select(cluster, weight, *targets, F.inline(items))
    w = F.col(weight).cast("double")
    out = long.groupBy("stratum_type", "value").agg(
        F.count("*").alias("pair_rows"), F.count_distinct(cluster).alias("clusters"),
        *[F.round(ratio(F.sum(w * F.col(t).cast("int")), F.sum(w)), 9).alias("rate_" + t) for t in targets])
    return out.where(F.col("pair_rows") >= minimum)


def boundary_tie(rows: DataFrame, by: list[str], score: str, y: str, k: int) -> DataFrame:
    """Precision at k when the k-th score is tied: lowest, highest and expected value."""
    steps = running_totals(rows, by, score, {"n": F.count("*"), "good": F.sum(F.col(y).cast("int"))}, "desc")
    edge = steps.where((F.col("cum_n") >= k) & (F.col("cum_n") - F.col("n") < k))
    above = F.col("cum_good") - F.col("good")
    slots = k - (F.col("cum_n") - F.col("n"))
    lo = above + F.greatest(F.lit(0), slots - (F.col("n") - F.col("good")))
    hi = above + F.least(slots, F.col("good"))
    return edge.select(
        *by, F.col(score).alias("boundary_score"), F.col("n").alias("tie_size"), slots.alias("tie_slots"),
        F.round(lo / k, 9).alias("precision_min"), F.round(hi / k, 9).alias("precision_max"),
        F.round((above + slots * F.col("good") / F.col("n")) / k, 9).alias("precision_expected"))


def average_rank_correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman correlation with average ranks for ties."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = both
    for name in (x, y):
        s = running_totals(both.select(name), [], name, {"n": F.count("*")}, "asc")
        s = s.select(name, (F.col("cum_n") - (F.col("n") - 1) / 2).alias("_r_" + name))
        out = out.join(s, name)
    return out.agg(F.count("*").alias("n"), F.round(F.corr("_r_" + x, "_r_" + y), 9).alias("spearman"))


def native_policy(rows: DataFrame, by: list[str], score: str, y: str, cluster: str, minimum: int, min_clusters: int,
                  precision: float, replicates: int = 2000, context: str = "native") -> DataFrame:
    """Best single-score cutoff over every distinct value, in both directions, one row per group.

    Chooses most accepted rows, then precision, then the lower bound of its cluster bootstrap interval, then the cutoff nearest
    zero.  A group without a qualifying cutoff abstains: direction NONE, nothing accepted.

    In one direction accepted rows grow from cutoff to cutoff, so at most one cutoff a direction can win, and only those are
    resampled.
    """
    from labeltrail.operators.resample import draw, interval, replicate_sums

    rows = cut_lineage(rows.select(*by, score, F.col(y).cast("int").alias("_y"), cluster))
    scored = rows.where(F.col(score).isNotNull())
    parts = []
    for direction, order, best in (("HIGH", "desc", F.max), ("LOW", "asc", F.min)):
        steps = running_totals(scored, by, score, {"n": F.count("*"), "ok": F.sum("_y")}, order)
        firsts = scored.groupBy(*by, cluster).agg(best(score).alias(score)).groupBy(*by, score).agg(F.count("*").alias("c"))
        marks = steps.select(*by, score, F.lit(0).cast("bigint").alias("c")).unionByName(firsts)
        cl = running_totals(marks, by, score, {"c": F.sum("c")}, order).select(*by, score, "cum_c")
        s = null_safe_join(steps, cl, [*by, score]).withColumn("direction", F.lit(direction))
        parts.append(s.select(*by, "direction", F.col(score).alias("threshold"), F.col("cum_n").alias("accepted"),
                              F.col("cum_ok").alias("correct"), F.col("cum_c").alias("clusters")))
    cand = parts[0].unionByName(parts[1]).withColumn("precision", F.round(F.col("correct") / F.col("accepted"), 9))
    cand = cand.where((F.col("accepted") >= minimum) & (F.col("clusters") >= min_clusters) & (F.col("precision") >= precision))
    top = cand.groupBy(*by, "direction").agg(F.max(F.struct("accepted", "precision", "threshold", "clusters")).alias("b"))
    top = cut_lineage(top.select(*by, "direction", "b.*"))  # at most two rows a group
    best = top.groupBy(*by).agg(F.max(F.struct("accepted", "precision")).alias("_best"))
    top = null_safe_join(top, best, by).where(F.struct("accepted", "precision") == F.col("_best")).drop("_best")
    inside = F.when(F.col("direction") == "HIGH", F.col(score) >= F.col("threshold")).otherwise(F.col(score) <= F.col("threshold"))
    cells = null_safe_join(scored, top.select(*by, "direction", "threshold"), by).where(inside)
    groups = [*by, "direction"]
    cells = cut_lineage(cells.groupBy(*groups, cluster).agg(F.sum("_y").alias("ok"), F.count("*").alias("n")))
    reps = replicate_sums(cells, draw(cells, cluster, replicates, context, groups), cluster, groups, ["ok", "n"], groups)
    ci = interval(reps.withColumn("precision", ratio("ok", "n")), groups, ["precision"], replicates)
    pick = null_safe_join(top, ci, groups).groupBy(*by).agg(F.max(F.struct(
        "accepted", "precision", "precision_lower", (-F.abs("threshold")).alias("near"), "direction", "threshold", "clusters",
        "precision_upper")).alias("b"))
    out = null_safe_join(rows.select(*by).distinct(), pick, by, "left")
    return out.select(*by, F.coalesce("b.direction", F.lit("NONE")).alias("direction"), "b.threshold",
                      F.coalesce("b.accepted", F.lit(0)).alias("accepted"), F.coalesce("b.clusters", F.lit(0)).alias("clusters"),
                      "b.precision", "b.precision_lower", "b.precision_upper",
                      F.when(F.col("b").isNull(), "ABSTAIN").otherwise("FROZEN").alias("policy_status"))
