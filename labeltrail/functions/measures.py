"""Column expressions for rates, bounds and set-valued counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNT_COLUMNS = ["n", "evaluable", "emitted", "hit", "exact", "tp", "pred_evaluable", "truth_labels", "emitted_labels"]
METRICS = ["coverage", "concordant_coverage", "query_concordance", "exact_set_concordance", "micro_precision",
           "micro_recall", "micro_f1", "mean_emitted_labels"]


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def ratio(a, b) -> Column:
    """a/b as double, null on a zero denominator."""
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def rate(cond, given=None, digits: int = 9) -> Column:
    """Share of rows meeting a condition among rows meeting `given`."""
    cond = c(cond)
    num = F.count(F.when(cond if given is None else cond & c(given), 1))
    den = F.count(F.lit(1)) if given is None else F.count(F.when(c(given), 1))
    return F.round(ratio(num, den), digits)


def n_if(cond) -> Column:
    return F.count(F.when(c(cond), 1))


def set_counts(predicted: Column, truth: Column) -> dict[str, Column]:
    """Nine counts comparing a predicted label set with a documented label set."""
    p, t = F.array_distinct(predicted), F.array_distinct(truth)
    known = F.size(t) > 0
    tp = F.when(known, F.size(F.array_intersect(p, t))).otherwise(0)
    same = known & (F.size(p) == F.size(t)) & (tp == F.size(t))
    values = [F.lit(1), known, F.size(p) > 0, tp > 0, same, tp, F.when(known, F.size(p)).otherwise(0), F.size(t), F.size(p)]
    return {k: v.cast("bigint") for k, v in zip(COUNT_COLUMNS, values)}


def set_measures(cols: dict[str, Column] | None = None) -> dict[str, Column]:
    """Eight ratio-of-sums measures over summed counts; null on a zero denominator."""
    g = cols or {k: F.col(k) for k in COUNT_COLUMNS}
    pairs = [(g["emitted"], g["n"]), (g["hit"], g["n"]), (g["hit"], g["evaluable"]), (g["exact"], g["evaluable"]),
             (g["tp"], g["pred_evaluable"]), (g["tp"], g["truth_labels"]),
             (2 * g["tp"], g["pred_evaluable"] + g["truth_labels"]), (g["emitted_labels"], g["n"])]
    return {m: ratio(a, b) for m, (a, b) in zip(METRICS, pairs)}


def wilson_lower(successes, n, z: float = 1.959963984540054) -> Column:
    """Wilson score lower bound; null for n = 0."""
    s, m = c(successes).cast("double"), c(n).cast("double")
    p = F.try_divide(s, m)
    zz = z * z
    centre = p + zz / (2 * m)
    spread = z * F.sqrt((p * (1 - p) + zz / (4 * m)) / m)
    return F.when(m > 0, (centre - spread) / (1 + zz / m))


def sigmoid(z) -> Column:
    """Logistic function that never exponentiates a large positive number."""
    x = c(z)
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))
