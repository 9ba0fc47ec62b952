"""Guards, abstaining rows, hard cases and the propensity model against small brute-force versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labeltrail.operators import components, curves, learning, resample, sampling


def test_hard_cases_of_known_and_unknown_sides(spark):
    rows = spark.createDataFrame([
        (1, 0.2, 0.9, 0.9, None, True, True, True, 1, 2), (2, 0.5, 0.9, 0.9, 3, True, True, True, 1, None),
        (3, 0.9, 0.8, 0.8, 3, True, False, False, 1, 1), (4, None, None, None, None, False, False, None, None, None)],
        "id int, ident double, q double, t double, rk int, l3 boolean, l4 boolean, exact boolean, qs int, rs int")
    c = F.col
    flags = sampling.hard_case_flags(c("ident"), c("q"), c("t"), c("rk"), c("l3"), c("l4"), c("exact"), c("exact").isNotNull(), c("l3"), c("qs"), c("rs"))
    got = {r.id: r.f for r in rows.select("id", flags.alias("f")).collect()}
    assert got == {1: f"{sampling.H6}+{sampling.H7}", 2: sampling.NO_HARD_CASE,
                   3: "+".join([sampling.H1, sampling.H3, sampling.H4, sampling.H5]), 4: sampling.NO_HARD_CASE}


def test_too_small_a_sample_is_an_error(spark):
    rows = spark.createDataFrame([(i, i, i % 2 == 0) for i in range(6)], "id int, g int, hard boolean").withColumn("exact", F.lit("e")).withColumn("l4", F.lit("l"))
    args = (["id"], ["g"], "exact", "l4", "hard", 10, 4, 4)
    assert sampling.balanced_sample(rows, *args, minimum=4).count() == 4
    with pytest.raises(ValueError, match="fewer than 5"):
        sampling.balanced_sample(rows, *args, minimum=5)


def test_closure_takes_audited_edges_only(spark):
    nodes = spark.createDataFrame([(1, 10, "A"), (2, 11, "B"), (3, 12, "A"), (4, 12, "A"), (5, 13, "B")], "node_id int, component_id int, role string")
    edge = lambda *e: spark.createDataFrame(list(e), "node_a int, node_b int")
    got = {tuple(r) for r in components.merge_components(nodes, edge((1, 2), (2, 3), (1, 2))).collect()}
    assert got == {(1, 10, 10, 4), (2, 11, 10, 4), (3, 12, 10, 4), (4, 12, 10, 4), (5, 13, 13, 1)}
    assert components.merge_components(nodes, edge()).where("merged_id <> component_id").count() == 0
    for bad in ((1, 9), (3, 4), (1, 3)):
        with pytest.raises(ValueError, match="1 edges"):
            components.merge_components(nodes, edge((1, 2), bad))


def test_native_policy_freezes_or_abstains(spark):
    rng = np.random.default_rng(5)
    rows = [(m, float(s), bool(rng.random() < (s / 10 if m == "good" else 0.2)), int(rng.integers(30)))
            for m in ("good", "bad") for s in rng.integers(0, 11, 200)]
    rows.append((None, None, True, 1))
    df = spark.createDataFrame(rows, "m string, s double, y boolean, c int")
    got = {r.m: r for r in curves.native_policy(df, ["m"], "s", "y", "c", 20, 5, 0.8, 200).collect()}
    assert set(got) == {"good", "bad", None}
    for m in ("bad", None):
        assert got[m].policy_status == "ABSTAIN" and got[m].accepted == 0 and got[m].threshold is None and got[m].direction == "NONE"
    mine = [r for r in rows if r[0] == "good"]
    fits = []
    for t in {r[1] for r in mine}:
        for d, inside in (("HIGH", lambda v: v >= t), ("LOW", lambda v: v <= t)):
            kept = [r for r in mine if inside(r[1])]
            p = round(sum(r[2] for r in kept) / len(kept), 9)
            if len(kept) >= 20 and len({r[3] for r in kept}) >= 5 and p >= 0.8:
                fits.append((len(kept), p, d, t))
    best = max(fits)
    assert (got["good"].accepted, got["good"].precision, got["good"].direction, got["good"].threshold) == best
    assert got["good"].precision_lower <= best[1] <= got["good"].precision_upper


def test_sign_flips_of_groups_equal_those_of_each_alone(spark):
    df = spark.createDataFrame([("a", 1.0)] * 70 + [("a", -1.0)] * 9 + [("b", 2.0), ("b", -2.0), ("b", 1.0)] + [("z", 0.0)] * 3, "g string, d double")
    got = {r.g: (r.n, r["mean"], r.exceed, r.p_value) for r in resample.sign_flip_test(df, "d", 300, "x", ["g"]).collect()}
    for g in ("a", "b", "z"):
        r = resample.sign_flip_test(df.where(F.col("g") == g), "d", 300, "x").first()
        assert got[g] == (r.n, r["mean"], r.exceed, r.p_value)
    assert got["z"] == (3, 0.0, 300, 1.0) and got["a"][3] < 0.01


def newton(x, y):
    """Logistic model with intercept, penalty |b|^2 / 2 on the summed loss."""
    a = np.c_[np.ones(len(x)), x]
    w, keep = np.zeros(a.shape[1]), np.r_[0.0, np.ones(x.shape[1])]
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(keep), a.T @ (p - y) + keep * w)
    return w


def test_propensity_is_fitted_on_one_cohort_and_binned_on_another(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    score = x[:, 0] + rng.normal(size=400)
    rows = [(i, int(i % 2), None if i % 17 == 0 else float(x[i, 0]), float(x[i, 1]), float(score[i])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, part int, a double, b double, s double")
    got = {r.id: r for r in learning.propensity_bins(df.where("part = 0"), df.where("part = 1"), ["a", "b"], "s").collect()}

    def side(part, low=None, high=None):
        mine = [r for r in rows if r[1] == part]
        s = np.array([r[4] for r in mine])
        low, high = np.quantile(s, [0.25, 0.75]) if low is None else (low, high)
        kept = [r for r in mine if r[4] <= low or r[4] >= high]
        return kept, np.array([[np.nan if v is None else v for v in r[2:4]] for r in kept]), np.array([float(r[4] >= high) for r in kept]), low, high

    _, fx, fy, low, high = side(0)
    kept, tx, ty, _, _ = side(1, low, high)
    fill = np.nanmedian(fx, axis=0)
    fx, tx = np.where(np.isnan(fx), fill, fx), np.where(np.isnan(tx), fill, tx)
    mean, sd = fx.mean(axis=0), fx.std(axis=0)
    w = newton((fx - mean) / sd, fy)
    p = lambda v: 1 / (1 + np.exp(-(np.c_[np.ones(len(v)), (v - mean) / sd] @ w)))
    edges = np.unique(np.quantile(p(fx), np.linspace(0, 1, 11)))
    assert set(got) == {r[0] for r in kept}
    for r, high_row, value in zip(kept, ty, p(tx)):
        assert got[r[0]].high == high_row and abs(got[r[0]].propensity - value) < 1e-5
        if np.min(np.abs(edges - value)) > 1e-4:
            assert got[r[0]].bin == np.sum(edges[1:-1] < value)


def test_few_edges_give_equal_widths(spark):
    df = spark.createDataFrame([(i, 1.0, float(i)) for i in range(40)], "id int, a double, s double")
    got = learning.propensity_bins(df, df, ["a"], "s").select("bin", "high").collect()
    assert len(got) == 20 and {r.bin for r in got} == {4} | ({5} & {r.bin for r in got})
    with pytest.raises(ValueError, match="outer quartiles"):
        learning.propensity_bins(df.where("id < 0"), df, ["a"], "s")
