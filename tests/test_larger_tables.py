"""Steps that failed on larger tables: what they send, shuffle and round."""

import numpy as np
from pyspark.sql import functions as F

from labeltrail.operators import joins


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_position_map_looks_symbols_up_in_the_row(spark):
    a = spark.createDataFrame([(1, 5, 3, "A-CD", "AB-D"), (2, 1, 1, "", "AB"), (3, 1, 2, "xyz", "xy")],
                              "pair_id long, query_start int, reference_start long, query_alignment string, reference_alignment string")
    sites = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (2, 1), (3, 2), (4, 1), (1, 2**40)], "pair_id long, position long")
    out = joins.position_map(a, sites)
    got = {(r[0], r[1]): tuple(r[2:]) for r in out.collect()}
    outside, none = (None, None, None, "REFERENCE_SITE_OUTSIDE_ALIGNMENT"), (None, None, None, "NO_VALID_BACKTRACE")
    assert got == {(1, 2): outside, (1, 3): (5, "A", "A", "PASS"), (1, 4): (None, None, "B", "REFERENCE_SITE_ALIGNS_TO_QUERY_GAP"),
                   (1, 5): (7, "D", "D", "PASS"), (1, 6): outside, (1, 2**40): outside, (2, 1): none, (3, 2): none, (4, 1): none}
    assert "Generate" not in plan_of(out) and "BroadcastExchange" not in plan_of(out)


def test_distances_round_like_their_sql(spark):
    import duckdb

    from labeltrail.plans.ranking_queries import distances

    prices = [(i, 0, p) for i, p in enumerate([2003.5, 2010.5, 2011.5, 84197.5, 900.68, 104999.91] + [1000.5 + i for i in range(4000)])]
    hits = spark.createDataFrame(prices, "reference_id long, source_id long, price double")
    got = {r.reference_id: r.d for r in distances(type("T", (), {"hits": hits})).collect()}
    for i, _, p in prices[:6] + prices[6::40]:
        assert got[i] == duckdb.execute("select round(?::double/1000, 3)", [p]).fetchone()[0]


def test_draws_stay_on_the_executors(spark, monkeypatch):
    import hashlib

    from labeltrail.operators import draws, resample

    monkeypatch.setattr(draws, "PIECE", 4)
    monkeypatch.setattr(draws, "blocks", None)  # blocks of the matrix pass through the driver
    rows = [("a" if i % 3 else "b", 100 + i, f"g{i % 2}", float(i * i % 11), None if i % 5 else i) for i in range(31)]
    t = spark.createDataFrame(rows, "w string, c long, g string, x double, y long")
    d = resample.draw(t, "c", 7, "ctx", ["w"])
    got = {(r.g, r.w, r.replicate): (r.x, r.y) for r in resample.replicate_sums(t, d, "c", ["g"], ["x", "y"], ["w"]).collect()}
    want = {}
    number = lambda s: int(hashlib.sha256(s.encode()).hexdigest()[:15], 16)
    for w in "ab":
        keys = sorted({r[1] for r in rows if r[0] == w}, key=lambda k: (number(str(k)) % 64, k))
        for rep in range(7):
            for i in range(len(keys)):
                for r in (r for r in rows if r[1] == keys[number(f"ctx|{w}|{rep}|{i}") % len(keys)]):
                    x, y = want.get((r[2], w, rep), (0.0, None))
                    want[r[2], w, rep] = (x + r[3], y if r[4] is None else (y or 0) + r[4])
    assert got == want


def test_curves_of_few_places_come_from_sums_per_place(spark, monkeypatch):
    from labeltrail.operators import draws, resample

    t = spark.range(400).select((F.col("id") % 37).alias("c"), (F.col("id") % 7 / 7).alias("p"), (F.col("id") * 5 % 13 / 13).alias("q"),
                                (F.col("id") * 11 % 17 < 6).cast("int").alias("y"), (F.col("id") % 3).cast("double").alias("w"), (F.col("id") % 37 % 2).cast("int").alias("d"))
    run = lambda: [r.first().asDict() for r in (resample.ranking_difference_bootstrap(t, "c", ("p", "q"), "y", "w", 30, "k"),
                                                resample.oriented_auc_bootstrap(t, "c", "d", "p", 30, "k"))]
    with monkeypatch.context() as m:
        m.setattr(draws, "PLACES", 1)  # sorted passes
        long = run()
    monkeypatch.setattr(draws, "blocks", None)
    assert run() == long


def test_score_change_deals_rows_once(spark):
    from labeltrail.operators import trace

    rows = [(1, 1, 0.5, 0.5, "a", True, 7), (1, 2, 0.6, 0.5, "b", False, 3), (1, 3, 0.6, 0.4, "b", True, 2), (2, 1, 0.1, 0.2, "a", False, 1)]
    t = spark.createDataFrame(rows, "q long, rk int, raw double, cal double, lab string, ok boolean, id long").withColumn("comp", F.col("q") * 10)
    out = trace.score_change(t, ["q"], {1: 1, 99: 99}, "rk", "raw", "cal", "lab", "ok", "id", ["comp"])
    got = {(r.q, r.budget): (r.comp, r.candidate_rows, r.candidate_labels, r.raw_top_rows, r.raw_top_labels, r.calibrated_top_rows, r.calibrated_top_labels,
                             r.raw_levels_in_calibrated_top, r.raw_winner, r.calibrated_winner, r.calibrated_tie_loss, r.raw_tie_loss) for r in out.collect()}
    assert got == {(1, 1): (10, 1, 1, 1, 1, 1, 1, 1, 7, 7, 0, 0), (1, 99): (10, 3, 2, 2, 1, 2, 2, 2, 2, 3, 1, 0),
                   (2, 1): (20, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0), (2, 99): (20, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0)}
    assert plan_of(out).split("Initial Plan")[-1].count("Exchange ") == 1


def test_redactor_is_fitted_on_all_documents(spark, monkeypatch):
    from labeltrail.llm import pii

    class Seen(Exception):
        pass

    def spy(rows):
        raise Seen(rows.select("h").distinct().count(), rows.count())

    monkeypatch.setattr(pii, "featured", spy)
    docs = spark.range(4400).select("id", F.concat(F.lit("write to a"), (F.col("id") % 4200).cast("string"), F.lit("@b.org now")).alias("text"))
    try:
        pii.fit_redactor(docs)
        raise AssertionError("not fitted")
    except Seen as seen:
        assert seen.args[0] == 4200 and seen.args[1] == pii.candidates(docs.where("id < 4200"), "text", ["id"]).count()


def test_outcomes_need_one_deal_by_query(spark, tmp_path):
    from labeltrail.operators.candidates import expand_levels, label_outcomes, outcomes_by_query
    from labeltrail.plans.tables import Tables

    rows = [(1, 1, 1, "a", "a.x", "a.x.1"), (1, 2, 0, "a", "a.y", None), (1, 3, 0, "b", "b.x", "b.x.1"), (2, 4, 0, "a", "a.x", "a.x.1"), (3, 5, 1, None, "a.y", None),
            (3, 6, None, "", "a.y", "a.x.1"), (4, 7, 1, "", "", ""), (4, 8, 0, "", "", ""), (5, 9, 1, "c", "c.x", "c.x.1"), (5, 10, 0, "c", "c.x", "c.x.2")]
    x = spark.createDataFrame(rows, "query_id long, reference_id long, returned int, l3 string, l4 string, exact string")
    labels, outputs = {"L3": "l3", "L4": "l4", "EXACT": "exact"}, {"L3": "s3", "L4": "s4", "EXACT": "sx"}
    truth = expand_levels(x.where("returned = 1"), labels, ["query_id"]).distinct()
    names = ["query_id", "reference_id", "s3", "s4", "sx"]
    got, want = outcomes_by_query(x, "returned", labels, outputs), label_outcomes(x, truth, labels, outputs)
    assert sorted(got.select(*names).collect()) == sorted(want.select(*names).collect())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = plan_of(Tables(spark, "/root/testdata/sf0.001").scored)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # pairs, pairs and references by reference, rows and queries by query
    assert plan.count("Exchange hashpartitioning") <= 5


def test_blends_multiply_distinct_scores_only(spark, monkeypatch):
    from labeltrail.operators import curves, features

    seen = []
    real = curves.ranking_metrics
    monkeypatch.setattr(curves, "ranking_metrics", lambda rows, *a, **k: seen.append(rows.count()) or real(rows, *a, **k))
    x = spark.createDataFrame([(float(i % 3), float(i % 2), i % 5 == 0, 1.0 + i % 4) for i in range(600)], "a double, b double, y boolean, w double")
    features.choose_blend(x, "a", "b", "y", "w", 4).collect()
    assert seen == [5 * 12]  # grid points times distinct (a, b, y), not 5 * 600


def test_ranks_inside_a_query_are_not_dealt_again(spark, monkeypatch):
    from labeltrail.operators import ranking
    from labeltrail.plans import BUILDERS
    from labeltrail.plans.tables import Tables

    monkeypatch.setattr(ranking, "_parts", None)  # range-partitions and writes all rows
    t = Tables(spark, "/root/testdata/sf0.001")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        ranks, hits = BUILDERS["w15_dense_vote_rank"](t), BUILDERS["a51_hit_at_k_reciprocal_rank"](t)
        # pairs, pairs and references by reference, rows by query, once for the labels and once for their totals
        assert plan_of(ranks).count("Exchange hashpartitioning") <= 8
        assert ranks.count() > 0 and hits.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_picks_are_dealt_without_the_blocks_of_their_node(spark, monkeypatch):
    from labeltrail.operators import sampling

    monkeypatch.setattr(sampling, "OWN_QUERIES", 3)
    items = [("", f"f{i % 5}", f"f{i % 5}.{i}", i % 7, i) for i in range(140)]
    pool = spark.createDataFrame(items, "label string, l4 string, exact string, node int, item long")
    queries = spark.createDataFrame([(q, "", q % 7 if q % 9 else None) for q in range(40)], "query_id long, label string, node int")
    truth = spark.createDataFrame([(q, "l4", f"f{q % 5}") for q in range(0, 40, 2)] + [(q, "exact", "f1.6") for q in range(0, 40, 3)], "query_id long, level string, label string")
    dealt = []
    frame = type(queries)
    real = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda df, *a: dealt.append(df.columns) or real(df, *a))
    out = sampling.keyed_picks(queries, pool, 1000, "s", 1, truth).collect()
    assert dealt and not [c for c in dealt if "_b" in c or "_own" in c]
    for q in range(40):
        said4 = {f"f{q % 5}"} if q % 2 == 0 else set()
        saidx = {"f1.6"} if q % 3 == 0 else set()
        want = {i[4] for i in items if i[3] != (q % 7 if q % 9 else None) and i[1] not in said4 and i[2] not in saidx}
        got = [r for r in out if r.query_id == q]
        assert sorted(r.item for r in got) == sorted(want) and {r.eligible for r in got} == {len(want)}


def test_picks_walk_no_list_of_their_node(spark):
    """Own blocks are passed by search: no query meets them, and a task's batches need not end with a group."""
    from labeltrail.operators import sampling

    items = [("ab"[i % 2], f"f{i % 11}", f"f{i % 11}.{i}" if i % 3 else None, i % 4, i) for i in range(400)]
    pool = spark.createDataFrame(items, "label string, l4 string, exact string, node int, item long")
    queries = spark.createDataFrame([(q, "ab"[q % 2], q % 5 if q % 9 else None) for q in range(60)], "query_id long, label string, node int")
    truth = spark.createDataFrame([(q, "l4", f"f{(q + d) % 11}") for q in range(0, 60, 2) for d in range(2)] + [(q, "exact", f"f{i % 11}.{i}") for q in range(0, 60, 3) for i in (1, 2, 4, 5, 22, 25)],
                                  "query_id long, level string, label string")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = []
    try:
        for rows in (3, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            out = sampling.keyed_picks(queries, pool, 500, "s", 1, truth)
            assert "aggregate(" not in plan_of(out)
            got.append(out.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(map(str, got[0])) == sorted(map(str, got[1]))
    for q in range(60):
        said = {f"f{(q + d) % 11}" for d in range(2)} if q % 2 == 0 else set()
        exact = {f"f{i % 11}.{i}" for i in (1, 2, 4, 5, 22, 25)} if q % 3 == 0 else set()
        want = {i[4] for i in items if i[0] == "ab"[q % 2] and i[3] != (q % 5 if q % 9 else None) and i[1] not in said and i[2] not in exact}
        assert sorted(r.item for r in got[0] if r.query_id == q) == sorted(want)


def test_guarded_cutoff_resamples_no_cutoff_after_the_answer(spark, monkeypatch):
    from labeltrail.operators import curves

    # precision rises with the score: the lower bound holds from some cutoff on
    rows = spark.createDataFrame([(i / 400, int((i * 7919) % 400 < i), i % 80, "F") for i in range(400)], "s double, y int, c long, src string")
    asked, real = [], curves.count_lower_bound

    def bound(cells, *rest):
        asked.extend(r.step for r in cells.select("step").distinct().collect())
        return real(cells, *rest)

    monkeypatch.setattr(curves, "count_lower_bound", bound)
    for target in (0.7, 0.999):
        asked.clear()
        got = curves.guarded_cutoff(rows, "s", "y", "c", "src", "F", target, 0.2, 50, "t", steps=20).collect()
        cells = spark.createDataFrame([(j, i % 80, int((i * 7919) % 400 < i)) for j in range(21) for i in range(400) if i >= 399 * j / 20], "step int, c long, y int")
        low = {r.step: r.lower for r in real(cells.groupBy("c", "step").agg(F.count("*").alias("n"), F.sum("y").alias("ok")), "c", ["step"], 50, "t").collect()}
        held = {j: [int((i * 7919) % 400 < i) for i in range(400) if i >= 399 * j / 20] for j in range(21)}
        fit = [j for j in range(21) if len(held[j]) >= 50 and sum(held[j]) / len(held[j]) >= target and low[j] >= target]
        assert [(r.accepted, r.lower) for r in got] == [(len(held[j]), round(low[j], 9)) for j in fit[:1]]
        if fit:
            fine = [j for j in range(21) if len(held[j]) >= 50 and sum(held[j]) / len(held[j]) >= target]
            assert len(asked) == len(set(asked)) <= 2 * fine.index(fit[0]) + 1


def test_median_of_few_values_joins_no_row_to_its_draws(spark, monkeypatch):
    from labeltrail.operators import draws, resample

    rows = spark.createDataFrame([(q, m, s, None if q % 17 == 0 else float((q * q + s) % 7)) for q in range(90) for m in "ab" for s in (1, 2) if (q + len(m) * s) % 5], "q long, method string, s int, v double")
    asked = []
    real = resample.component_draws
    monkeypatch.setattr(resample, "component_draws", lambda *a: asked.append(1) or real(*a))
    got = {}
    for most in (draws.PLACES, 0):
        monkeypatch.setattr(draws, "PLACES", most)
        got[most] = sorted(map(tuple, resample.row_bootstrap_median(rows, "q", "v", ["method", "s"], 15, "t", ["method"]).collect()))
        assert len(asked) == (0 if most else 1)
    first, second = got.values()
    assert first == second and len(first) == 4


def test_top_share_sends_no_matrix_through_the_driver(spark, monkeypatch):
    from labeltrail.operators import draws, resample

    rng = np.random.default_rng(3)
    rows = [(int(c), float(s), i, bool(g)) for i, (c, s, g) in enumerate(zip(rng.integers(0, 300, 4000), rng.integers(0, 8, 4000), rng.integers(0, 2, 4000)))]
    rows += [(7, 3.0, 4000 + i, i % 3 == 0) for i in range(900)]  # a hot component
    table = spark.createDataFrame(rows, "c long, s double, id long, y boolean")
    monkeypatch.setattr(draws, "blocks", None)  # the matrix by blocks
    want = []
    keys = {r.c: r.key_index for r in resample.dense_index(table, "c").collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[2]))
    index, good = np.array([keys[r[0]] for r in order]), np.array([r[3] for r in order])
    for r in range(40):
        m = draws._drawn(f"t|{r}|".encode(), 300)[index].astype(int)
        k = np.floor(0.1 * m.sum())
        want.append((np.clip(k - (np.cumsum(m) - m), 0, m) * good).sum() / k)
    for spread in (8.0, 0.0):  # the second finds cuts out of its range
        monkeypatch.setattr(resample, "SPREAD", spread)
        got = resample.top_share_bootstrap(table, "c", "s", "id", "y", 0.1, 40, "t").first()
        assert got.top_precision_finite == 40
        assert np.allclose([got.top_precision_lower, got.top_precision_upper], np.percentile(want, [2.5, 97.5]), atol=1e-8)


def test_blends_are_dealt_once(spark, monkeypatch):
    from labeltrail.operators import curves, features, ranking

    rng = np.random.default_rng(11)
    x = [(float(round(a, 2)), int(b) / 5, bool(t), float(w)) for a, b, t, w in zip(rng.normal(size=700), rng.integers(0, 6, 700), rng.integers(0, 2, 700), rng.integers(1, 9, 700))]
    table = spark.createDataFrame(x + [(float("nan"), 0.2, True, 1.0), (1e9, 0.4, False, 2.0)], "a double, b double, y boolean, w double")
    grid = table.select("y", "w", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("step"), "a", "b").withColumn("s", F.round(F.col("step") / 5 * F.col("a") + (1 - F.col("step") / 5) * F.col("b"), 9))
    want = sorted((r.step, r.average_precision) for r in curves.ranking_metrics(grid, ["step"], "s", "y", "w").collect())
    monkeypatch.setattr(ranking, "_parts", None)  # range-partitions and writes all rows
    got = curves.ranking_metrics(grid, ["step"], "s", "y", "w", curves=6)
    assert sorted((r.step, round(r.average_precision, 9)) for r in got.collect()) == want
    best = features.choose_blend(table, "a", "b", "y", "w", 5).first()
    top = max(ap for _, ap in want)
    assert (best.alpha, best.average_precision) == (min(i for i, ap in want if ap == top) / 5, top)


def test_fused_candidates_are_dealt_by_query_once(spark):
    from labeltrail.operators import candidates as cd
    from labeltrail.plans import BUILDERS
    from labeltrail.plans.tables import Tables
    from labeltrail.plans.trace_queries import fused_scored

    rows = [(q, r if r % 11 else None, float((q * r) % 5) if r % 7 else None, float((q + r) % 3), (q * r) % 4, r % 3) for q in range(12) for r in range(1, 3 + q)]
    rows = [x for x in rows if x[1] is not None or x[0] == 11]
    x = spark.createDataFrame(rows, "query_id int, reference_id int, a double, b double, c int, d int")
    key = ["query_id", "reference_id", "fused_rank", "fused_score"]
    got = cd.fused_ranks(x, [(F.col("c") <= 2, "a"), (F.col("d") <= 1, "b")], 4)
    union = cd.fused_union(cd.modality_ranks(x.where("c <= 2"), "a", 4), cd.modality_ranks(x.where("d <= 1"), "b", 4), "a", "b")
    want = cd.budget_rank(union, "fused_score", "fused_rank", bounded=True)
    known = F.col("reference_id").isNotNull()
    assert sorted(got.where(known).select(key).collect()) == sorted(want.where(known).select(key).collect())
    twice = x.crossJoin(spark.range(2))  # two names of a reference share its rank
    twice = cd.fused_ranks(twice, [(F.col("c") <= 2, "a"), (F.col("d") <= 1, "b")], 4).where(known)
    assert sorted(twice.select(key).distinct().collect()) == sorted(got.where(known).select(key).collect())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        t = Tables(spark, "/root/testdata/sf0.001")
        # pairs, pairs and references by reference, rows and queries by query
        assert plan_of(fused_scored(t)).count("Exchange hashpartitioning") <= 5
        assert plan_of(BUILDERS["m15_raw_vs_calibrated_selection"](t)).count("Exchange hashpartitioning") <= 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_sweep_spreads_totals_and_no_cluster(spark):
    from labeltrail.operators import curves

    rng = np.random.default_rng(2)
    rows = [("gh"[int(a)] if a < 2 else None, int(c) if c else None, float(m), float(w), bool(y)) for a, c, m, w, y in
            zip(rng.integers(0, 3, 900), rng.integers(0, 40, 900), rng.integers(0, 11, 900) / 10, rng.integers(1, 5, 900), rng.integers(0, 2, 900))]
    x = spark.createDataFrame(rows, "g string, c long, m double, w double, y boolean")
    cuts = [0.0, 0.25, 0.5, 0.9]
    got = curves.threshold_sweep(x, ["g"], "m", cuts, ["y"], "w", "c", 20, plain=True)
    want = []
    for g in {r[0] for r in rows}:
        for t in cuts:
            own = [r for r in rows if r[0] == g and r[2] >= t]
            if len(own) >= 20:
                w = sum(r[3] for r in own)
                want.append((g, t, len(own), len({r[1] for r in own}), round(w / sum(r[3] for r in rows if r[0] == g), 9), round(sum(r[3] for r in own if r[4]) / w, 9),
                             round(sum(r[4] for r in own) / len(own), 9)))
    key = lambda r: (str(r[0]), r[1])
    names = ["g", "threshold", "pair_rows", "clusters", "coverage", "precision_y", "raw_precision_y"]
    assert sorted(map(tuple, got.select(names).collect()), key=key) == sorted(want, key=key)
    assert not [line for line in plan_of(got).split("\n") if "Exchange" in line and "threshold#" in line and " c#" in line]
