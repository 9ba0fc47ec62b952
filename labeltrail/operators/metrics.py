"""Aggregations with explicit denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltrail.functions.measures import COUNT_COLUMNS, n_if, ratio, set_measures
from labeltrail.functions.states import SIX_STATES, seven_state

ONE = "*"


def state_counts(trace: DataFrame, by: list[str] | None = None) -> DataFrame:
    return trace.groupBy(*(by or ["endpoint"]), "state").agg(F.count(ONE).alias("queries"))


def output_summary(trace: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Selection and acceptance counts; unknown acceptance and unknown truth stay apart."""
    acc, ev, ok = F.col("accepted") == 1, F.col("evaluable") == 1, F.col("selected_concordant")
    return trace.groupBy(*(by or ["endpoint"])).agg(
        F.count(ONE).alias("queries"), n_if(ev).alias("evaluable_queries"),
        F.count("selected_candidate_id").alias("selected_queries"), n_if(ok == 1).alias("selected_concordant"),
        F.count("accepted").alias("acceptance_known_queries"), n_if(acc).alias("accepted_queries"),
        n_if(acc & ev).alias("evaluable_accepted"), n_if(acc & ev & (ok == 1)).alias("accepted_concordant"),
        n_if(acc & ev & (ok == 0)).alias("accepted_disagreements"))


def six_state_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    state = F.col("state")
    avail = ~state.isin(SIX_STATES[:2])
    accepted = state.isin(SIX_STATES[1], SIX_STATES[3], SIX_STATES[5])
    share = lambda cond, n=None: F.round(ratio(n_if(cond), F.count(ONE) if n is None else n), 9)
    return rows.groupBy(*by).agg(
        F.count(ONE).alias("queries"), share(avail).alias("candidate_available"),
        share(state.isin(SIX_STATES[4:]), n_if(avail)).alias("top1_given_available"),
        share(accepted).alias("coverage"), share(state == SIX_STATES[5], n_if(accepted)).alias("accepted_precision"),
        share(state == SIX_STATES[4]).alias("correct_rejected"),
        share(state.isin(SIX_STATES[1], SIX_STATES[3])).alias("wrong_accepted"))


def state_partition(rows: DataFrame, states: list[str], by: list[str]) -> DataFrame:
    """Exclusive shares of every state, zero rows included, summing to the total."""
    wide = rows.groupBy(*by).agg(F.count(ONE).alias("denominator"), *[
        n_if(F.col("state") == s).alias(s) for s in states])
    items = F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("queries")) for s in states])
    out = wide.select(*by, "denominator", F.inline(items))
    return out.withColumn("fraction", F.round(ratio("queries", "denominator"), 9))


def transitions(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Counts of (state under mode a, state under mode b)."""
    one = lambda p: seven_state("documented", f"{p}_available", f"{p}_correct", f"{p}_accepted")
    # Availability in a mode only counts for documented queries.
    return rows.groupBy(*by, one(a).alias("from_state"), one(b).alias("to_state")).agg(F.count(ONE).alias("queries"))


def event_columns(a: str, b: str) -> dict[str, Column]:
    t = F.col("documented")
    acc = {p: F.col(f"{p}_accepted") for p in (a, b)}
    good = {p: acc[p] & F.col(f"{p}_correct") & t for p in (a, b)}
    wrong = {p: acc[p] & ~F.col(f"{p}_correct") & t for p in (a, b)}
    return {
        f"{a}_accepted_concordant": good[a], f"{b}_accepted_concordant": good[b],
        "gain": ~good[a] & good[b], "retained": good[a] & good[b], "loss": good[a] & ~good[b],
        "disagreement_new": ~wrong[a] & wrong[b], "disagreement_repaired": wrong[a] & ~wrong[b],
        f"{a}_unevaluable": acc[a] & ~t, f"{b}_unevaluable": acc[b] & ~t}


def paired_events(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[n_if(v).alias(k) for k, v in event_columns(a, b).items()])


def sum_counts(rows: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Summed count vector, optionally weighted."""
    w = F.lit(1) if weight is None else F.col(weight)
    return rows.groupBy(*by).agg(*[F.sum(F.col(k) * w).alias(k) for k in COUNT_COLUMNS])


def set_summary(rows: DataFrame, by: list[str], digits: int = 9) -> DataFrame:
    """Ratio-of-sums measures per group."""
    total = sum_counts(rows, by)
    return total.select(*by, *COUNT_COLUMNS, *[F.round(v, digits).alias(k) for k, v in set_measures().items()])


def component_totals(rows: DataFrame, component: str, by: list[str], columns: list[str],
                     universe: DataFrame | None = None) -> DataFrame:
    """Sums per (component, by); with `universe`, absent components appear with zeros."""
    out = rows.groupBy(component, *by).agg(*[F.sum(c).alias(c) for c in columns])
    if universe is None:
        return out
    cells = universe.select(component).distinct().join(F.broadcast(rows.select(*by).distinct()))
    return cells.join(out, [component, *by], "left").fillna(0, columns)


def three_rates(rows: DataFrame, by: list[str], component: str) -> DataFrame:
    """Any-match, output coverage and label concordance: pooled and equal-component rates.

    Two aggregations: per component, then over components; both map-side combined.
    """
    kinds = [("any_match", "hit", "evaluable"), ("output_coverage", "has_output", "n"),
             ("label_concordance", "matched_output_count", "output_count")]
    cols = sorted({x for _, a, b in kinds for x in (a, b)})
    per = rows.groupBy(*by, component).agg(*[F.sum(F.coalesce(x, F.lit(0))).alias(x) for x in cols])
    items = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(a).alias("num"), F.col(b).alias("den"))
                      for k, a, b in kinds])
    long = per.select(*by, component, F.inline(items))
    return long.groupBy(*by, "metric").agg(
        F.sum("num").alias("numerator"), F.sum("den").alias("denominator"),
        F.round(100 * ratio(F.sum("num"), F.sum("den")), 6).alias("percent"),
        F.round(F.avg(F.when(F.col("den") > 0, 100 * ratio("num", "den"))), 6).alias("equal_component_percent"),
        F.count(ONE).alias("components"))


def tagged(rows: DataFrame, tags: dict[str, Column], name: str = "group") -> DataFrame:
    """Copy each row once per overlapping group it belongs to."""
    tag = F.explode(F.filter(F.array(*[F.when(cond, F.lit(k)) for k, cond in tags.items()]), lambda x: x.isNotNull()))
    return rows.select("*", tag.alias(name))


def confusion_metrics(rows: DataFrame, by: list[str], score: str, y: str, cutoff, weight: str | None = None) -> DataFrame:
    """Weighted precision, recall, F1, MCC and balanced accuracy at a cutoff."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    p, t = F.col(score) >= cutoff, F.col(y) == 1
    cell = lambda cond: F.coalesce(F.sum(F.when(cond, w)), F.lit(0.0))
    s = rows.groupBy(*by).agg(cell(p & t).alias("tp"), cell(p & ~t).alias("fp"), cell(~p & t).alias("fn"),
                              cell(~p & ~t).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    r = lambda x: F.round(x, 9)
    mcc_den = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return s.select(
        *by, r(zero(ratio(tp, tp + fp))).alias("precision"), r(zero(ratio(tp, tp + fn))).alias("recall"),
        r(zero(ratio(2 * tp, 2 * tp + fp + fn))).alias("f1"), r(zero(ratio(tp * tn - fp * fn, mcc_den))).alias("mcc"),
        r((zero(ratio(tp, tp + fn)) + zero(ratio(tn, tn + fp))) / 2).alias("balanced_accuracy"))


def probability_losses(rows: DataFrame, by: list[str], p: str, y: str) -> DataFrame:
    """Brier score and log loss (probabilities clipped at 1e-7)."""
    q = F.least(F.greatest(F.col(p).cast("double"), F.lit(1e-7)), F.lit(1 - 1e-7))
    t = F.col(y).cast("double")
    return rows.groupBy(*by).agg(
        F.count(ONE).alias("n"), F.round(F.avg((F.col(p).cast("double") - t) ** 2), 9).alias("brier"),
        F.round(-F.avg(t * F.log(q) + (1 - t) * F.log(1 - q)), 9).alias("log_loss"))


def numeric_smd(rows: DataFrame, by: list[str], treated: str, columns: list[str]) -> DataFrame:
    """Standardised mean difference with pooled sample variance (ddof 1)."""
    items = F.array(*[F.struct(F.lit(x).alias("covariate"), F.col(x).cast("double").alias("x")) for x in columns])
    long = rows.select(*by, treated, F.inline(items))
    t = F.col(treated)
    m = lambda cond: F.avg(F.when(cond, F.col("x")))
    v = lambda cond: F.var_samp(F.when(cond, F.col("x")))
    out = long.groupBy(*by, "covariate").agg(m(t).alias("m1"), m(~t).alias("m0"), v(t).alias("v1"), v(~t).alias("v0"))
    pooled = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    return out.select(*by, "covariate", F.round(F.coalesce(ratio(F.col("m1") - F.col("m0"), pooled), F.lit(0.0)), 6).alias("smd"))


def categorical_max_smd(rows: DataFrame, treated: str, column: str) -> DataFrame:
    """Largest absolute SMD over the levels of a categorical column, with its level."""
    t = F.col(treated)
    level = F.coalesce(F.col(column).cast("string"), F.lit("MISSING"))
    per = rows.groupBy(level.alias("level")).agg(n_if(t).alias("n1"), n_if(~t).alias("n0"))
    total = per.agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    from labeltrail.operators.ranking import attach_one_row

    x = attach_one_row(per, total)
    p1, p0 = ratio("n1", "t1"), ratio("n0", "t0")
    pooled = F.sqrt((p1 * (1 - p1) + p0 * (1 - p0)) / 2)
    smd = F.round(F.coalesce(F.abs(ratio(p1 - p0, pooled)), F.lit(0.0)), 9)
    best = x.select("level", smd.alias("smd")).agg(
        F.min(F.struct((-F.col("smd")).alias("neg"), F.col("level"))).alias("b"))
    return best.select(F.lit(column).alias("covariate"), F.col("b.level").alias("worst_level"), (-F.col("b.neg")).alias("max_smd"))


def majority_agreement(votes: DataFrame, by: list[str]) -> DataFrame:
    """Vote counts per (by, label) with the group's totals, rank of votes, lead and entropy."""
    per = votes.groupBy(*by, "label").agg(
        F.count_distinct("method").alias("candidate_votes"), F.count_distinct("channel").alias("supporting_channels"))
    stats = per.groupBy(*by).agg(
        F.count(ONE).alias("candidate_set_size"), F.sum("candidate_votes").alias("total_votes"),
        F.max("candidate_votes").alias("top_votes"),
        F.array_sort(F.collect_set("candidate_votes")).alias("_levels"),
        (F.log(F.sum("candidate_votes").cast("double"))
         - F.sum(F.col("candidate_votes") * F.log(F.col("candidate_votes").cast("double"))) / F.sum("candidate_votes")).alias("_h"))
    size = F.col("candidate_set_size")
    second = F.when(F.size("_levels") > 1, F.element_at("_levels", -2)).otherwise(F.lit(0))
    stats = stats.withColumns({
        "agreement_entropy": F.when(size <= 1, F.lit(0.0)).otherwise(F.round(F.col("_h") / F.log(size.cast("double")), 9)),
        "second_votes": second.cast("bigint")}).drop("_h", "_levels")
    out = per.join(stats, by)
    return out.withColumns({
        "vote_lead": F.col("candidate_votes") - F.col("second_votes"),
        "is_plurality": (F.col("candidate_votes") == F.col("top_votes")).cast("int")})
