"""The range-partitioned paths must equal the plain windows."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from labeltrail.operators import components, curves, learning, matching, ranking, resample, sampling


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows: one group holds 60%, one score value holds a third of all rows."""
    df = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 5 < 3, 0).otherwise(F.col("id") % 7).alias("g"),
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.pmod(F.col("id") * 7919, F.lit(1000)) / 1000).alias("s"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    return df.cache()


@pytest.fixture(scope="module")
def odd_keys(spark):
    """One group holds most rows; null groups, shared string prefixes, null, NaN, -0.0, ids above 2**53."""
    i = F.col("id")
    return spark.range(600).select(
        (F.lit(2**60) + i).alias("id"), F.when(i % 5 < 3, 0).when(i % 5 == 4, 1).alias("g"),
        F.concat(F.lit("a long shared prefix "), F.pmod(i * 37, F.lit(90)).cast("string")).alias("t"),
        F.when(i % 11 == 0, F.lit(float("nan"))).when(i % 7 == 0, F.lit(-0.0)).when(i % 3 == 0, F.lit(0.0)).when(i % 13 != 0, F.pmod(i * 7919, F.lit(50)) / 50).alias("d")).cache()


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("order", [[("t", "asc"), ("id", "desc")], [("d", "desc"), ("id", "asc")], [("d", "asc"), ("t", "desc"), ("id", "asc")], [("id", "desc")]])
def test_ranked_equals_the_plain_window(odd_keys, by, order):
    a = ranking.ranked(odd_keys, by, order, bounded=True).select("id", "rank")
    b = ranking.ranked(odd_keys, by, order).select("id", "rank")
    assert a.exceptAll(b).count() == 0 and b.count() == 600


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_running_totals_equal_the_plain_window(odd_keys, by, direction):
    b = ranking.running_totals(odd_keys, by, "d", {"n": F.count("*"), "s": F.sum(F.lit(1.0))}, direction)
    col = F.col("d").desc_nulls_last() if direction == "desc" else F.col("d").asc_nulls_last()
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a = odd_keys.groupBy(*by, "d").agg(F.count("*").alias("n")).withColumn("cum_n", F.sum("n").over(w))
    cols = [*by, "d", "n", "cum_n"]
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0 and a.count() == b.count()


def test_exact_quantiles_match_numpy(skewed):
    x = np.array([r.s for r in skewed.select("s").collect()])
    q = ranking.exact_quantiles(skewed, "s", 200).orderBy("step").collect()
    assert np.allclose([r.quantile for r in q], np.quantile(x, np.linspace(0, 1, 201)), atol=1e-12)


def test_dense_index_is_a_permutation(skewed):
    r = ranking.dense_index(skewed, "id").agg(F.count("*").alias("n"), F.min("key_index").alias("a"), F.max("key_index").alias("b"), F.count_distinct("key_index").alias("d")).first()
    assert (r.n, r.a, r.b, r.d) == (3000, 0, 2999, 3000)


def test_auc_against_pairs(skewed):
    rows = skewed.where("id < 400")
    p = rows.toPandas()
    pos, neg = p.s[p.y == 1].to_numpy(), p.s[p.y == 0].to_numpy()
    want = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    assert abs(curves.ranking_metrics(rows, [], "s", "y").first().auroc - want) < 1e-9


def test_draws_conserve_components(skewed):
    comp = skewed.select("g").distinct()
    d = resample.zero_filled(resample.component_draws(comp, "g", 10, "t"), comp, "g", 10)
    k = comp.count()
    assert [r.s for r in d.groupBy("replicate").agg(F.sum("multiplicity").alias("s")).collect()] == [k] * 10


def test_interval_is_null_when_a_replicate_is_undefined(spark):
    v = spark.createDataFrame([(0, 1.0), (1, float("nan"))], "replicate int, v double")
    r = resample.interval(v, [], ["v"], 2).first()
    assert r.v_lower is None and r.v_finite == 1


def test_boundary_tie_and_weighted_cut(spark):
    d = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.8, 1), (0.7, 0)], "s double, y int")
    r = curves.boundary_tie(d, [], "s", "y", 1).first()
    assert (r.precision_min, r.precision_max, r.precision_expected) == (0.0, 1.0, 0.5)


def test_mcnemar_against_binomial(spark):
    from math import comb

    d = spark.createDataFrame([(1, 0)] * 9 + [(0, 1)] * 2 + [(1, 1)] * 3, "h int, l int")
    r = resample.paired_difference(d, [], "h", "l").first()
    want = min(1.0, 2 * sum(comb(11, i) for i in range(3)) / 2**11)
    assert (r.n10, r.n01) == (9, 2) and abs(r.mcnemar_p - want) < 1e-9


def test_pps_scale_reaches_target(spark):
    d = spark.range(200).select((1 / (F.col("id") + 1)).alias("w"))
    c = sampling.pps_scale(d, "w", 50).first().scale
    assert abs(sum(min(1.0, c / (i + 1)) for i in range(200)) - 50) < 1e-6


def test_keyed_picks_equal_a_plain_loop(spark):
    import hashlib
    import random

    def walk(i, size, key):
        bits = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        while size > 1:
            left, right = i >> bits, i & mask
            for t in range(6):
                left, right = right, left ^ (int(hashlib.sha256(f"{key}|{t}|{right}".encode()).hexdigest()[:15], 16) & mask)
            i = (left << bits) | right
            if i < size:
                return i
        return 0

    rng = random.Random(1)
    items = [(rng.choice("pq"), f"l{rng.randrange(4)}", rng.choice([None, "e1", "e2", "e3"]), rng.randrange(6), i) for i in range(160)]
    truth = [(q, "l4", f"l{rng.randrange(5)}") for q in range(12)] + [(q, "exact", f"e{rng.randrange(1, 5)}") for q in range(12) for _ in range(2)]
    queries = [(q, label, rng.randrange(7)) for q in range(13) for label in "pqr"] + [(3, None, 1)]
    last = lambda x: (x is None, x or "")
    pool = sorted(items, key=lambda r: (last(r[1]), last(r[2]), r[3], r[4]))
    for divergent in (False, True):
        got = sampling.keyed_picks(spark.createDataFrame(queries, "query_id long, label string, node long"),
                                   spark.createDataFrame(items, "label string, l4 string, exact string, node long, item long").repartition(5), 4, "src", 7,
                                   spark.createDataFrame(truth, "query_id long, level string, label string") if divergent else None)
        want = []
        for q, label, node in queries:
            said = {(lv, x) for i, lv, x in truth if i == q} if divergent else set()
            free = [r for r in pool if r[0] == label and r[3] != node and ("l4", r[1]) not in said and ("exact", r[2]) not in said]
            k = min(4, len(free))
            want += [(q, label, free[walk(i, len(free), f"7|{q}|src:{label}")][4], len(free), k / len(free)) for i in range(k)]
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(500, i) for i in range(501, 600)]
    e = spark.createDataFrame(path + hub + [(900, 901)], "a long, b long")
    r = {x.node: x.canonical for x in components.connected_minimum(e).collect()}
    assert all(r[i] == 100 for i in range(100, 161)) and all(r[i] == 500 for i in range(500, 600)) and r[901] == 900


def test_few_edges_close_in_few_tasks_and_as_many_edges_do(spark, monkeypatch):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)] + [(7, 7)]
    table = spark.createDataFrame(edges, "a long, b long")
    before, tracker = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext.statusTracker()
    found, tasks = [], []
    spark.conf.set("spark.sql.shuffle.partitions", 37)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for most in (components.FEW_EDGES, 0):
            monkeypatch.setattr(components, "FEW_EDGES", most)
            spark.sparkContext.setJobGroup(f"closure {most}", "closure")
            found.append(sorted(map(tuple, components.connected_minimum(table).collect())))
            stages = {i for j in tracker.getJobIdsForGroup(f"closure {most}") for i in tracker.getJobInfo(j).stageIds}
            tasks.append(sum(x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found[0] == found[1] and dict(found[0])[1040] == 1000 and 10 * tasks[0] < tasks[1]


def test_nearest_neighbours_blocks_agree_with_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    d = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>")
    got = learning.nearest_neighbours(d, d, 3, blocks=4).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.argsort(-(u @ u.T), axis=1, kind="stable")[:, :3]
    assert all(want[r.query_id][r["rank"] - 1] == r.item for r in got) and len(got) == 180


def test_matching_is_one_to_one(skewed):
    m = matching.exact_stratum_match(skewed, [F.col("g")], F.col("y") == 1, F.col("y") == 0, ["id"])
    assert m.count() == m.select("t_id").distinct().count() == m.select("c_id").distinct().count()
