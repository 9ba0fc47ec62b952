"""Cutoff rules, score-change diagnosis and per-method summaries (A34 and later)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labeltrail.functions import measures as ms
from labeltrail.functions.binomial import exact_lower_bound
from labeltrail.operators import curves, matching, metrics, resample
from labeltrail.operators.ranking import exact_quantiles, top_k, top_one
from labeltrail.plans.metric_queries import SAFE_Q, TOP_SQL, VOTE_SQL, WILSON, agreement, tops
from labeltrail.plans.registry import query
from labeltrail.plans.replay import H60, REPS, ci_sql, draws_sql, index_sql  # noqa: F401
from labeltrail.plans.trace_queries import FUSED_SQL, fused_scored


@query("a34_domain_guarded_cutoff", f"""with so as (select raw s, row_number() over (order by raw) - 1 i, count(*) over () n from v_top),
    q as (select j, l.s + (h.s - l.s)*(j*(l.n-1)/120.0::double - (j*(l.n-1))//120) thr from (select unnest(range(121)) j) join so l on l.i = (j*(l.n-1))//120 join so h on h.i = (j*(l.n-1)+119)//120),
    q1 as (select thr, min(j) j from q group by 1),
    src as (select j, thr, stratum, count(*) n, sum(same_l3::int) ok from q1 join v_top v on v.raw >= thr group by 1, 2, 3),
    acc as (select j, thr, sum(n) n, sum(ok) ok, count(*) filter (where stratum <> 'F' and n >= 8 and ok::double/n < 0.2) br from src group by 1, 2),
    fine as (select acc.*, c.c from acc join (select j, count(distinct component_id) c from q1 join v_top v on v.raw >= thr group by 1) c using (j)
       where n >= 50 and c.c >= 20 and ok::double/n >= 0.25 and br = 0),
    cells as (select f.j step, component_id, sum(same_l3::int) ok, count(*) n from fine f join v_top v on v.raw >= f.thr group by 1, 2),
    dr as ({draws_sql("cells", "component_id", 200, "guard", "step")}),
    low as (select step, quantile_cont(p, 0.025) lower from (select step, replicate, sum(ok*multiplicity)::double/sum(n*multiplicity) p from cells join dr using (step, component_id) group by 1, 2) group by 1)
    select thr threshold, n::bigint accepted, c clusters, round(ok::double/n, 9) "precision", round(lower, 9) lower from fine join low on low.step = fine.j
    where lower >= 0.25 order by n desc, ok::double/n desc, thr limit 1""", TOP_SQL)
def _a34(t):
    return curves.guarded_cutoff(tops(t), "raw", "same_l3", "component_id", "stratum", "F", 0.25, 0.2, 200, "guard", steps=120)


BUDGETS = [1, 2, 99]
RULE_SQL = {"v_btop": """select * from (select f.*, s.ident, b budget, 'L3' as lv, row_number() over (partition by f.query_id, b order by f.raw desc, f.reference_id) rn
      from v_fused_scored f join v_scored s using (query_id, reference_id) cross join (select unnest([1,2,99]) b) where fused_rank <= b) where rn = 1
    union all select * from (select f.*, s.ident, b budget, 'L4' as lv, row_number() over (partition by f.query_id, b order by s.ident desc, f.reference_id) rn
      from v_fused_scored f join v_scored s using (query_id, reference_id) cross join (select unnest([1,2,99]) b) where fused_rank <= b) where rn = 1""", **FUSED_SQL}


def _safe_cte(name, src, score, y, keys, m, minimum):
    """CTEs that find the lowest safe cutoff of `src` per keys and target column `target`."""
    k = ", ".join(keys)
    on = " and ".join(f"h.{x} = l.{x}" for x in keys)
    return f"""{name}_s as (select {k}, {score} s, row_number() over (partition by {k} order by {score}) - 1 i, count(*) over (partition by {k}) n from {src}),
    {name}_q as (select distinct {", ".join("l." + x for x in keys)}, l.s + (h.s - l.s)*(j*(l.n-1)/{m}.0::double - (j*(l.n-1))//{m}) thr
      from (select unnest(range({m}+1)) j) join {name}_s l on l.i = (j*(l.n-1))//{m} join {name}_s h on {on} and h.i = (j*(l.n-1)+{m}-1)//{m}),
    {name}_x as (select {", ".join("q." + x for x in keys)}, thr, count(*) n, sum({y}::int) s from {name}_q q join {src} v on {" and ".join(f"v.{x} = q.{x}" for x in keys)} and v.{score} >= thr group by all),
    {name}_b as (select {k}, min_by(x, thr) b from {name}_x x where n >= {minimum} and {WILSON} >= target group by all)"""


@query("a35_budget_rule_table", f"""with t3 as (select *, unnest([0.2, 0.3])::double target from v_btop where lv = 'L3'),
    {_safe_cte("a", "t3", "raw", "same_l3", ["budget", "target"], 1000, 60)},
    g as (select d.budget, d.target, coalesce(b.b.thr, 1.000001) thr, coalesce(b.b.n, 0) n, coalesce(b.b.s, 0)::bigint ok, d.c from
      (select budget, target, count(*) c from t3 group by 1, 2) d left join a_b b using (budget, target)),
    t4 as (select v.*, g.target from v_btop v join g using (budget) where v.lv = 'L4' and v.raw >= g.thr),
    {_safe_cte("e", "t4", "ident", "same_l4", ["budget", "target"], 1000, 60)}
    select 'L3' level, budget, target, thr threshold, n accepted, ok accepted_correct, round(n::double/c, 9) coverage from g
    union all select 'L4', g.budget, g.target, coalesce(b.b.thr, 1.000001), coalesce(b.b.n, 0), coalesce(b.b.s, 0)::bigint, round(coalesce(b.b.n, 0)::double/coalesce(d.c, 1), 9)
      from g left join (select budget, target, count(*) c from t4 group by 1, 2) d using (budget, target) left join e_b b using (budget, target)""", RULE_SQL)
def _a35(t):
    rows = fused_scored(t, "ident")
    rows = rows.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in BUDGETS]))).where(F.col("fused_rank") <= F.col("budget"))
    tie = ("reference_id", "asc")
    picks = {lv: top_one(rows, ["query_id", "budget"], [(s, "desc"), tie]) for lv, s in (("L3", "raw"), ("L4", "ident"))}
    out = curves.hierarchy_rules(picks, ["budget"], {"L3": "raw", "L4": "ident"}, {"L3": "same_l3", "L4": "same_l4"},
                                 [0.2, 0.3], 60, 1000)
    return out.select("level", "budget", "target", "threshold", "accepted", "accepted_correct", "coverage")


@query("a36_numeric_smd", """select covariate, round(coalesce((m1-m0)/nullif(sqrt((v1+v0)/2), 0), 0), 6) smd from (select covariate, avg(x) filter (where tr) m1, avg(x) filter (where not tr) m0,
    var_samp(x) filter (where tr) v1, var_samp(x) filter (where not tr) v0 from (select "role" = 'RETEST' tr, unnest(['raw','qty','disc']) covariate, unnest([raw, qty, disc]) x from v_scored) group by 1)""")
def _a36(t):
    return metrics.numeric_smd(t.scored.withColumn("treated", F.col("role") == "RETEST"), [], "treated", ["raw", "qty", "disc"])


@query("a37_categorical_max_smd", """with s as (select 'family' covariate, family lv, "role" = 'RETEST' tr from v_scored union all select 'exact', coalesce(exact, 'MISSING'), "role" = 'RETEST' from v_scored),
    p as (select covariate, lv, count(*) filter (where tr)::double / sum(count(*) filter (where tr)) over (partition by covariate) p1,
      count(*) filter (where not tr)::double / sum(count(*) filter (where not tr)) over (partition by covariate) p0 from s group by 1, 2),
    d as (select *, round(coalesce(abs((p1-p0)/nullif(sqrt((p1*(1-p1)+p0*(1-p0))/2), 0)), 0), 9) smd from p)
    select covariate, min(lv) worst_level, max(smd) max_smd from (select *, max(smd) over (partition by covariate) m from d) where smd = m group by 1""")
def _a37(t):
    s = t.scored.withColumn("treated", F.col("role") == "RETEST")
    return metrics.categorical_max_smd(s, "treated", "family").unionByName(metrics.categorical_max_smd(s, "treated", "exact"))


@query("a38_frequency_census", """select query_id, reference_id, count(*) over (partition by reference_id) activity_frequency, count(*) over (partition by family) family_frequency,
    count(*) over (partition by component_id) component_frequency from v_scored""")
def _a38(t):
    from labeltrail.operators.sampling import with_frequencies

    rows = t.scored.select("query_id", "reference_id", "family", "component_id")
    return with_frequencies(rows, {"activity_frequency": "reference_id", "family_frequency": "family",
                                   "component_frequency": "component_id"}).drop("family", "component_id")


@query("a42_boundary_tie_precision", """with r as (select *, row_number() over (partition by "role" order by cal desc) rn from v_top),
    e as (select "role", cal c from r where rn = 60), x as (select e."role", e.c, count(*) filter (where cal > c) ab, count(*) filter (where cal = c) m,
      count(*) filter (where cal > c and same_l3) a, count(*) filter (where cal = c and same_l3) g from e join v_top v using ("role") group by 1, 2)
    select "role", c boundary_score, m tie_size, 60 - ab tie_slots, round((a + greatest(0, 60-ab-(m-g)))/60.0::double, 9) precision_min,
      round((a + least(60-ab, g))/60.0::double, 9) precision_max, round((a + (60-ab)*g/m::double)/60, 9) precision_expected from x""", TOP_SQL)
def _a42(t):
    return curves.boundary_tie(tops(t), ["role"], "cal", "same_l3", 60)


PANEL_SQL = {"v_panel": """select query_id, method, k panel_size, max(sim) similarity, bool_or(hit) hit from (select query_id, method, sim, hit, row_number() over (partition by query_id, method order by sc desc, reference_id) rn from (
      select query_id, reference_id, ident sim, coalesce(same_l4, false) hit, unnest(['RAW','QTY','DISC']) "method", unnest([raw, qty, disc]) sc from v_scored)) join (select unnest([1,2,3]) k) on rn <= k group by 1, 2, 3"""}


def panels(t):
    """Best similarity and label hit among the first n rows of three ranking policies."""
    items = F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).cast("double").alias("sc")) for m, c in (("RAW", "raw"), ("QTY", "qty"), ("DISC", "disc"))]))
    long = t.scored.select("query_id", "reference_id", F.col("ident").alias("sim"), F.col("same_l4").alias("hit"), items)
    first = top_k(long, ["query_id", "method"], [("sc", "desc"), ("reference_id", "asc")], 3)
    first = first.withColumn("panel_size", F.explode(F.sequence(F.col("rank"), F.lit(3))))
    return first.groupBy("query_id", "method", "panel_size").agg(F.max("sim").alias("similarity"), F.max("hit").alias("hit"))


@query("a43_panel_metrics", """select "method", panel_size, count(*) queries, round(avg(similarity), 9) mean_similarity, round(median(similarity), 9) median_similarity,
    round(avg((similarity >= 0.5)::int), 9) ge_0_5, round(avg((similarity >= 0.7)::int), 9) ge_0_7, round(avg((similarity >= 0.8)::int), 9) ge_0_8, round(avg(hit::int), 9) exact_recall from v_panel group by 1, 2""", PANEL_SQL)
def _a43(t):
    p = panels(t)
    share = lambda x: F.round(F.avg((F.col("similarity") >= x).cast("int")), 9)
    out = p.groupBy("method", "panel_size").agg(
        F.count("*").alias("queries"), F.round(F.avg("similarity"), 9).alias("mean_similarity"), share(0.5).alias("ge_0_5"),
        share(0.7).alias("ge_0_7"), share(0.8).alias("ge_0_8"), F.round(F.avg(F.col("hit").cast("int")), 9).alias("exact_recall"))
    med = exact_quantiles(p, "similarity", 2, ["method", "panel_size"]).where(F.col("step") == 1)
    return out.join(med.select("method", "panel_size", F.round("quantile", 9).alias("median_similarity")), ["method", "panel_size"])


@query("w27_panel_of_top_labels", """select query_id, "method", panel_size, similarity, hit::int hit from v_panel""", PANEL_SQL)
def _w27(t):
    return panels(t).withColumn("hit", F.col("hit").cast("int"))


@query("j13_paired_method_difference", """select panel_size, b.m baseline, count(*) paired_queries, round(avg(a.similarity), 9) mean_base, round(avg(b.similarity), 9) mean_other, round(avg(a.similarity - b.similarity), 9) mean_difference
    from v_panel a join (select query_id, panel_size, "method" m, similarity from v_panel) b using (query_id, panel_size) where a."method" = 'RAW' and b.m <> 'RAW' group by 1, 2""", PANEL_SQL)
def _j13(t):
    return matching.paired_methods(panels(t), "method", "query_id", "similarity", "RAW", ["panel_size"])


@query("a44_method_score_pivot", """select query_id, max(score) filter (where "method" = 'PRICE') price, max(score) filter (where "method" = 'QTY') qty,
    max(score) filter (where "method" = 'DISC') disc, max(score) filter (where "method" = 'TAX') tax from v_votes group by 1""")
def _a44(t):
    p = t.votes.groupBy("query_id").pivot("method", ["PRICE", "QTY", "DISC", "TAX"]).agg(F.max("score"))
    return p.toDF("query_id", "price", "qty", "disc", "tax")


CHANGE_SQL = {"v_change": """select w.query_id, w.endpoint, w.budget, w.component_id, m.candidate_rows, m.candidate_labels, m.matching_candidate, m.raw_top_rows, m.raw_top_labels, m.calibrated_top_rows, m.calibrated_top_labels,
      m.raw_levels_in_calibrated_top, (m.calibrated_top_rows > m.raw_top_rows)::int top_set_expanded, w.rr raw_winner, c.rr calibrated_winner, (w.rr <> c.rr)::int winner_row_changed, (w.lab <> c.lab)::int winner_label_changed,
      w.ok::int raw_concordant, c.ok::int calibrated_concordant, (w.ok and not c.ok)::int raw_only_concordant, (c.ok and not w.ok)::int calibrated_only_concordant,
      (not c.ok and m.cal_match)::int calibrated_tie_loss, (not w.ok and m.raw_match)::int raw_tie_loss from
      (select * from (select *, row_number() over (partition by query_id, endpoint, budget order by raw desc, rr) rn from v_pool) where rn = 1) w
      join (select * from (select *, row_number() over (partition by query_id, endpoint, budget order by cal desc, rr) rn from v_pool) where rn = 1) c using (query_id, endpoint, budget)
      join (select query_id, endpoint, budget, count(*) candidate_rows, count(distinct lab) candidate_labels, max(ok::int) matching_candidate,
          count(*) filter (where raw = mr) raw_top_rows, count(distinct lab) filter (where raw = mr) raw_top_labels, count(*) filter (where cal = mc) calibrated_top_rows,
          count(distinct lab) filter (where cal = mc) calibrated_top_labels, count(distinct raw) filter (where cal = mc) raw_levels_in_calibrated_top,
          bool_or(ok and cal = mc) cal_match, bool_or(ok and raw = mr) raw_match
        from (select *, max(raw) over (partition by query_id, endpoint, budget) mr, max(cal) over (partition by query_id, endpoint, budget) mc from v_pool) group by 1, 2, 3) m using (query_id, endpoint, budget)""",
    "v_pool": """select query_id, reference_id rr, raw, cal, component_id, unnest(['L3','L4']) endpoint, unnest([l3,l4]) lab, unnest([same_l3, same_l4]) ok, b budget
      from v_fused_scored cross join (select unnest([1,2,3,99]) b) where fused_rank <= b""", **FUSED_SQL}
SUMS = ['matching_candidate', 'top_set_expanded', 'winner_row_changed', 'winner_label_changed', 'raw_concordant', 'calibrated_concordant',
        'raw_only_concordant', 'calibrated_only_concordant', 'calibrated_tie_loss', 'raw_tie_loss']


def score_changes(t):
    from labeltrail.operators.trace import score_change

    rows = fused_scored(t)
    items = F.inline(F.array(*[F.struct(F.lit(e).alias("endpoint"), F.col(lb).alias("label"), F.col(ok).alias("ok"))
                               for e, lb, ok in (("L3", "l3", "same_l3"), ("L4", "l4", "same_l4"))]))
    rows = rows.select("query_id", "reference_id", "component_id", "raw", "cal", "fused_rank", items)
    return score_change(rows, ["query_id", "endpoint"], {1: 1, 2: 2, 3: 3, 99: 99}, "fused_rank", "raw", "cal", "label", "ok",
                        "reference_id", ["component_id"], dealt=True)


@query("m15_raw_vs_calibrated_selection", "select * exclude (component_id) from v_change", CHANGE_SQL)
def _m15(t):
    return score_changes(t).drop("component_id")


@query("a45_score_change_summary", f"""select endpoint, budget, count(*) queries, count(distinct component_id) components, {", ".join(f"sum({s})::bigint {s}" for s in SUMS)},
    count(*) filter (where raw_top_labels > 1) raw_multilabel_top, count(*) filter (where calibrated_top_labels > 1) calibrated_multilabel_top,
    count(*) filter (where calibrated_tie_loss = 1 and raw_concordant = 1) tie_loss_raw_concordant, count(*) filter (where calibrated_tie_loss = 1 and raw_concordant = 0) tie_loss_raw_discordant,
    count(*) filter (where calibrated_tie_loss = 1 and top_set_expanded = 1) tie_loss_expanded, count(*) filter (where calibrated_tie_loss = 1 and top_set_expanded = 0) tie_loss_unchanged from v_change group by 1, 2""", CHANGE_SQL)
def _a45(t):
    c = score_changes(t)
    tie = F.col("calibrated_tie_loss") == 1
    return c.groupBy("endpoint", "budget").agg(
        F.count("*").alias("queries"), F.count_distinct("component_id").alias("components"), *[F.sum(s).alias(s) for s in SUMS],
        ms.n_if(F.col("raw_top_labels") > 1).alias("raw_multilabel_top"), ms.n_if(F.col("calibrated_top_labels") > 1).alias("calibrated_multilabel_top"),
        ms.n_if(tie & (F.col("raw_concordant") == 1)).alias("tie_loss_raw_concordant"), ms.n_if(tie & (F.col("raw_concordant") == 0)).alias("tie_loss_raw_discordant"),
        ms.n_if(tie & (F.col("top_set_expanded") == 1)).alias("tie_loss_expanded"), ms.n_if(tie & (F.col("top_set_expanded") == 0)).alias("tie_loss_unchanged"))


@query("a47_budget_coverage_precision_oracle", """with u as (select count(*) t from v_queries where "role" = 'RETEST'),
    p as (select f.*, b from v_fused_scored f cross join (select unnest([1,2,3,99]) b) where "role" = 'RETEST' and fused_rank <= b),
    w as (select b, count(*) cand, count(*) filter (where cal >= 0.3::float) acc, count(*) filter (where cal >= 0.3::float and same_l4) okc from (select *, row_number() over (partition by query_id, b order by cal desc, reference_id) rn from p) where rn = 1 group by 1),
    o as (select b, count(distinct query_id) filter (where same_l4) orc from p group by 1)
    select b budget, u.t queries_total, cand queries_with_candidate, acc accepted, okc accepted_correct, orc oracle_queries, round(acc::double/u.t, 9) coverage, round(okc::double/nullif(acc, 0), 9) "precision",
      round(okc::double/u.t, 9) correct_coverage, round(orc::double/u.t, 9) oracle_fraction from w join o using (b) cross join u""", FUSED_SQL)
def _a47(t):
    total = t.queries.where(F.col("role") == "RETEST").count()
    rows = fused_scored(t).where(F.col("role") == "RETEST")
    rows = rows.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in (1, 2, 3, 99)]))).where(F.col("fused_rank") <= F.col("budget"))
    top = top_one(rows, ["query_id", "budget"], [("cal", "desc"), ("reference_id", "asc")])
    ok = F.col("cal") >= F.lit(0.3).cast("float")
    m = top.groupBy("budget").agg(F.count("*").alias("queries_with_candidate"), ms.n_if(ok).alias("accepted"), ms.n_if(ok & F.col("same_l4")).alias("accepted_correct"))
    o = rows.groupBy("budget", "query_id").agg(F.max("same_l4").alias("any_ok")).groupBy("budget").agg(ms.n_if("any_ok").alias("oracle_queries"))
    r = lambda a, b: F.round(ms.ratio(a, b), 9)
    n = F.lit(total).cast("bigint")
    return m.join(o, "budget").select(
        "budget", n.alias("queries_total"), "queries_with_candidate", "accepted", "accepted_correct", "oracle_queries", r("accepted", n).alias("coverage"),
        r("accepted_correct", "accepted").alias("precision"), r("accepted_correct", n).alias("correct_coverage"), r("oracle_queries", n).alias("oracle_fraction"))


@query("a48_any_correct_per_query", "select query_id, bool_or(same_l3)::int any_l3, bool_or(same_l4)::int any_l4, bool_or(coalesce(same_exact, false))::int any_exact from v_scored group by 1")
def _a48(t):
    a = lambda x: F.max(F.coalesce(F.col(x), F.lit(False)).cast("int"))
    return t.scored.groupBy("query_id").agg(a("same_l3").alias("any_l3"), a("same_l4").alias("any_l4"), a("same_exact").alias("any_exact"))


@query("a49_role_count_ledger", """select "role", count(*) queries, count(distinct component_id) components, round(count(*)::double/sum(count(*)) over (), 9) share from v_queries group by 1""")
def _a49(t):
    from labeltrail.operators.ranking import attach_one_row

    g = t.queries.groupBy("role").agg(F.count("*").alias("queries"), F.count_distinct("component_id").alias("components"))
    return attach_one_row(g, g.agg(F.sum("queries").alias("_n"))).select("role", "queries", "components", F.round(F.col("queries") / F.col("_n"), 9).alias("share"))


@query("a50_selective_accuracy_by_cohort", """select stratum, count(*) queries, round(avg((raw >= 0.35)::int), 9) coverage, round(avg(same_l3::int) filter (where raw >= 0.35), 9) selective_accuracy,
    round(avg((not same_l3)::int) filter (where raw >= 0.35), 9) overannotation_rate, round(avg(same_l3::int), 9) top1_accuracy from v_top group by 1""", TOP_SQL)
def _a50(t):
    ok, acc = F.col("same_l3"), F.col("raw") >= 0.35
    return tops(t).groupBy("stratum").agg(F.count("*").alias("queries"), ms.rate(acc).alias("coverage"), ms.rate(ok, acc).alias("selective_accuracy"),
                                          ms.rate(~ok, acc).alias("overannotation_rate"), ms.rate(ok).alias("top1_accuracy"))


@query("a51_hit_at_k_reciprocal_rank", """with r as (select query_id, "role", same_l4, row_number() over (partition by query_id order by raw desc, reference_id) rn from v_scored),
    q as (select query_id, "role", min(rn) filter (where same_l4) f from r group by 1, 2)
    select "role", count(*) queries, round(avg((f is not null)::int), 9) candidate_available, round(avg(coalesce(f = 1, false)::int), 9) hit_1, round(avg(coalesce(f <= 5, false)::int), 9) hit_5, round(avg(coalesce(1.0::double/f, 0)), 9) mrr from q group by 1""")
def _a51(t):
    from labeltrail.operators.ranking import ranked

    # rows are already dealt by query, so a window inside it needs no further exchange
    r = ranked(t.scored, ["query_id"], [("raw", "desc"), ("reference_id", "asc")], bounded=True)
    q = r.groupBy("query_id", "role").agg(F.min(F.when(F.col("same_l4"), F.col("rank"))).alias("f"))
    f = F.col("f")
    z = lambda c: F.round(F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), 9)
    return q.groupBy("role").agg(F.count("*").alias("queries"), ms.rate(f.isNotNull()).alias("candidate_available"), z(f == 1).alias("hit_1"),
                                 z(f <= 5).alias("hit_5"), z(1 / f).alias("mrr"))


@query("a52_blinded_cohort_measure", f"""with recursive a as (select stratum, component_id, count(*) n, sum(same_l3::int) ok from v_top where raw >= 0.3 group by 1, 2),
    t as (select stratum, count(*) tot from v_queries group by 1), dr as ({draws_sql("a", "component_id", 2000, "measure", "stratum")}),
    b as (select stratum, quantile_cont(p, 0.025) lo, quantile_cont(p, 0.975) hi from (select stratum, replicate, sum(ok*multiplicity)::double/sum(n*multiplicity) p from a join dr using (stratum, component_id) group by 1, 2) group by 1),
    h as (select stratum, sum(n)::bigint n, sum(ok)::bigint s, 0.0::double lo, 1.0::double hi, 0 i from a group by 1 having sum(ok) > 0 union all
      select stratum, n, s, case when q < 0.025 then m else lo end, case when q < 0.025 then hi else m end, i + 1 from (select *, list_sum(list_transform(range(s, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k*ln(m) + (n - k)*ln(1 - m)))) q
        from (select *, (lo + hi)/2 m from h where i < 60))),
    cp as (select stratum, (lo + hi)/2 cp from h where i = 60)
    select stratum, any_value(round(coalesce(cp, 0), 8)) exact_lower, tot total_queries, sum(n)::bigint accepted, count(*) clusters, round(sum(n)::double/tot, 9) coverage, sum(ok)::bigint correct, round(sum(ok)::double/sum(n), 9) "precision",
      round(lo, 9) lower, round(hi, 9) upper, (sum(n) >= 50 and count(*) >= 20 and sum(ok)::double/sum(n) >= 0.3 and lo >= 0.3)::int qualifies from a join t using (stratum) join b using (stratum) left join cp using (stratum) group by stratum, tot, lo, hi""", TOP_SQL)
def _a52(t):
    acc = tops(t).where(F.col("raw") >= 0.3)
    m = resample.precision_lower_bound(acc, "component_id", ["stratum"], "same_l3", 2000, "measure")
    total = t.queries.groupBy("stratum").agg(F.count("*").alias("total_queries"))
    q = (F.col("n") >= 50) & (F.col("clusters") >= 20) & (F.col("precision") >= 0.3) & (F.col("lower") >= 0.3)
    return m.join(total, "stratum").select("stratum", "total_queries", F.col("n").alias("accepted"), "clusters", F.round(F.col("n") / F.col("total_queries"), 9).alias("coverage"),
                                           F.col("ok").alias("correct"), "precision", "lower", "upper", q.cast("int").alias("qualifies"),
                                           F.round(exact_lower_bound(F.col("ok"), F.col("n")), 8).alias("exact_lower"))


@query("a53_unique_mapping_resolution", """select query_id, exact, case when count(distinct l4) = 1 then min(l4) end l4, case when count(distinct l4) = 1 then 'UNIQUE_MAPPING' else 'AMBIGUOUS_MAPPING' end basis
    from (select p.query_id, r.ref_name exact, r.l4 from v_pairs p join v_refs r using (reference_id)) group by 1, 2""")
def _a53(t):
    from labeltrail.operators.joins import unique_mapping

    p = t.pairs.select("query_id", "reference_id").join(t.refs.select("reference_id", F.col("ref_name").alias("exact"), "l4"), "reference_id")
    return unique_mapping(p, ["query_id", "exact"], "l4")


CONS_SQL = {"v_winner": """select a.query_id, a.label, a.candidate_votes, a.supporting_channels, a.total_votes, t.label is not null correct from (
      select *, row_number() over (partition by query_id order by candidate_votes desc, supporting_channels desc, label) rn from v_agree) a
      left join v_truth t on t.query_id = a.query_id and t.endpoint = 'L4' and t.label = a.label where rn = 1""", **VOTE_SQL}


def vote_winners(t):
    w = top_one(agreement(t), ["query_id"], [("candidate_votes", "desc"), ("supporting_channels", "desc"), ("label", "asc")])
    truth = t.truth.where(F.col("endpoint") == "L4").select("query_id", "label", F.lit(True).alias("_t"))
    return w.join(truth, ["query_id", "label"], "left").withColumn("correct", F.coalesce("_t", F.lit(False))).drop("_t")


@query("a54_consensus_policies", """with s as (select unnest(['TWO_METHODS','TWO_CHANNELS','STRICT_MAJORITY','ALL_AGREE']) system), x as (select s.system, w.*, case s.system when 'TWO_METHODS' then candidate_votes >= 2 when 'TWO_CHANNELS' then supporting_channels >= 2
      when 'STRICT_MAJORITY' then total_votes >= 2 and candidate_votes::double/total_votes > 0.5 else total_votes >= 2 and candidate_votes = total_votes end acc from v_winner w cross join s)
    select system, count(*) queries, count(*) filter (where acc) accepted, round(avg(acc::int), 9) coverage, round(avg(correct::int) filter (where acc), 9) "precision" from x group by 1""", CONS_SQL)
def _a54(t):
    v, c, n = F.col("candidate_votes"), F.col("supporting_channels"), F.col("total_votes")
    rules = {"TWO_METHODS": v >= 2, "TWO_CHANNELS": c >= 2, "STRICT_MAJORITY": (n >= 2) & (v / n > 0.5), "ALL_AGREE": (n >= 2) & (v == n)}
    rows = vote_winners(t).select("correct", F.inline(F.array(*[F.struct(F.lit(k).alias("system"), e.alias("acc")) for k, e in rules.items()])))
    return rows.groupBy("system").agg(F.count("*").alias("queries"), ms.n_if("acc").alias("accepted"), ms.rate("acc").alias("coverage"), ms.rate("correct", "acc").alias("precision"))


METHOD_SQL = {"v_mtop": """select v.*, q.component_id, t.label is not null correct from v_votes v join v_queries q using (query_id) left join v_truth t on t.query_id = v.query_id and t.endpoint = 'L4' and t.label = v.label"""}


def method_tops(t):
    truth = t.truth.where(F.col("endpoint") == "L4").select("query_id", "label", F.lit(True).alias("_t"))
    m = t.votes.join(truth, ["query_id", "label"], "left").withColumn("correct", F.coalesce("_t", F.lit(False))).drop("_t")
    return m.join(t.queries.select("query_id", "component_id"), "query_id")


@query("a55_single_method_precision_coverage", """select "method", (select count(*) from v_queries) queries_total, count(*) queries_with_prediction, round(count(*)::double/(select count(*) from v_queries), 9) raw_coverage,
    round(avg(correct::int), 9) precision_top1, round(sum(correct::int)::double/(select count(*) from v_queries), 9) correct_coverage from v_mtop group by 1""", METHOD_SQL)
def _a55(t):
    n = F.lit(t.queries.count()).cast("bigint")
    return method_tops(t).groupBy("method").agg(n.alias("queries_total"), F.count("*").alias("queries_with_prediction"), F.round(F.count("*") / n, 9).alias("raw_coverage"),
                                                ms.rate("correct").alias("precision_top1"), F.round(ms.n_if("correct") / n, 9).alias("correct_coverage"))


#: Precision that a frozen cutoff must reach.
NATIVE_PRECISION = 0.335


@query("a56_native_score_policy", f"""with d as (select "method", direction, case when direction = 'HIGH' then score else -score end x, correct, component_id from v_mtop cross join (select unnest(['HIGH','LOW']) direction)),
    s as (select "method", direction, x, count(*) n, sum(correct::int) ok from d group by 1, 2, 3),
    f as (select "method", direction, x, count(*) cl from (select "method", direction, component_id, max(x) x from d group by 1, 2, 3) group by 1, 2, 3),
    c as (select "method", direction, x, sum(n) over w n, sum(ok) over w ok, sum(coalesce(cl, 0)) over w cl from s left join f using ("method", direction, x) window w as (partition by "method", direction order by x desc)),
    q as (select *, round(ok::double/n, 9) pr from c where n >= 20 and cl >= 10 and round(ok::double/n, 9) >= {NATIVE_PRECISION}),
    top as (select * from (select *, rank() over (partition by "method" order by n desc, pr desc) rk from (select * from q qualify row_number() over (partition by "method", direction order by n desc) = 1)) where rk = 1),
    cells as (select "method", direction, component_id, sum(correct::int) ok, count(*) n from d join top using ("method", direction) where d.x >= top.x group by 1, 2, 3),
    dr as ({draws_sql("cells", "component_id", REPS, "native", '"method", direction')}),
    reps as (select "method", direction, replicate, sum(ok*multiplicity)::double/sum(n*multiplicity) "precision" from cells join dr using ("method", direction, component_id) group by 1, 2, 3),
    best as (select * from (select *, case when direction = 'HIGH' then x else -x end thr from top) join (select "method", direction, {ci_sql(["precision"])} from reps group by 1, 2) using ("method", direction)
      qualify row_number() over (partition by "method" order by precision_lower desc, abs(thr), direction desc, thr desc) = 1)
    select m."method", coalesce(direction, 'NONE') direction, thr threshold, coalesce(n, 0)::bigint accepted, coalesce(cl, 0)::bigint clusters, pr "precision", precision_lower, precision_upper,
      case when n is null then 'ABSTAIN' else 'FROZEN' end policy_status from (select distinct "method" from v_mtop) m left join best using ("method")""", METHOD_SQL)
def _a56(t):
    return curves.native_policy(method_tops(t), ["method"], "score", "correct", "component_id", 20, 10, NATIVE_PRECISION, REPS)


@query("a57_spearman_of_metric_pairs", """with r as (select rank() over (order by raw) + (count(*) over (partition by raw) - 1)/2.0::double a, rank() over (order by ref_price) + (count(*) over (partition by ref_price) - 1)/2.0::double b from v_scored join v_refs using (reference_id))
    select count(*) n, round(corr(a, b), 9) spearman from r""")
def _a57(t):
    rows = t.scored.select("reference_id", "raw").join(t.refs.select("reference_id", "ref_price"), "reference_id")
    return curves.average_rank_correlation(rows, "raw", "ref_price")


@query("a58_accepted_errors_with_evidence", """select w.query_id, w.label, w.candidate_votes, p.n_pairs, p.best_ident from v_winner w join (select query_id, count(*) n_pairs, max(qty/50) best_ident from v_pairs group by 1) p using (query_id)
    where w.candidate_votes >= 2 and not w.correct""", CONS_SQL)
def _a58(t):
    from labeltrail.operators.joins import many_to_one

    e = t.pairs.groupBy("query_id").agg(F.count("*").alias("n_pairs"), F.max(F.col("qty") / 50).alias("best_ident"))
    w = vote_winners(t).where((F.col("candidate_votes") >= 2) & ~F.col("correct")).select("query_id", "label", "candidate_votes")
    return many_to_one(w, e, ["query_id"])


@query("a59_outcome_by_agreement", """select candidate_votes agreement, count(*) queries, round(avg(correct::int), 9) "precision", count(distinct component_id) clusters from v_winner join v_queries using (query_id) group by 1""", CONS_SQL)
def _a59(t):
    w = vote_winners(t).join(t.queries.select("query_id", "component_id"), "query_id")
    return w.groupBy(F.col("candidate_votes").alias("agreement")).agg(F.count("*").alias("queries"), ms.rate("correct").alias("precision"), F.count_distinct("component_id").alias("clusters"))
