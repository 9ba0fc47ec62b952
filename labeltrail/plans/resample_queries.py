"""Cluster bootstrap, permutation and multiplicity-adjusted tests (R rows), A41."""

from __future__ import annotations

from pyspark.sql import functions as F

from labeltrail.functions import measures as ms
from labeltrail.functions.hashing import key_text, sha_hex, u60
from labeltrail.operators import matching, metrics, resample
from labeltrail.plans.metric_queries import COUNTS_SQL, MEASURES_SQL, TOP_SQL, count_rows, tops
from labeltrail.plans.registry import query
from labeltrail.plans.replay import H60, REPS, ci_sql, draws_sql, index_sql
from labeltrail.plans.selection_queries import METHOD_SQL, PANEL_SQL, method_tops, panels
from labeltrail.plans.trace_queries import PAIRED_SQL, SIX_SQL, paired_modes, six_rows

#: Replicates of the exported draw table, which has a row for each component and replicate.
EXPORTED = 200


BOOT = {"v_draws": draws_sql("v_queries", "component_id", REPS, "boot"), **COUNTS_SQL}


def rep_measures():
    k = {c: f"sum(multiplicity*{c})" for c in ms.COUNT_COLUMNS}
    pairs = [("emitted", "n"), ("hit", "n"), ("hit", "evaluable"), ("exact", "evaluable"), ("tp", "pred_evaluable"), ("tp", "truth_labels"), None, ("emitted_labels", "n")]
    out = []
    for m, p in zip(ms.METRICS, pairs):
        a, b = ("2*" + k["tp"], f"({k['pred_evaluable']}+{k['truth_labels']})") if p is None else (k[p[0]], k[p[1]])
        out.append(f"({a})::double/nullif({b},0) {m}")
    return ", ".join(out)


R01_SQL = f"""with comp as (select component_id, endpoint, "method", {", ".join(f"sum({c}) {c}" for c in ms.COUNT_COLUMNS)} from v_counts group by 1, 2, 3),
    reps as (select endpoint, "method", replicate, {rep_measures()} from comp join v_draws using (component_id) group by 1, 2, 3),
    pt as (select endpoint, "method", count(*) components, {MEASURES_SQL} from comp group by 1, 2)
    select * from pt join (select endpoint, "method", {ci_sql(ms.METRICS)} from reps group by 1, 2) using (endpoint, "method")"""


@query("r01_cluster_bootstrap", R01_SQL, BOOT)
def _r01(t):
    return resample.bootstrap_ratios(count_rows(t), "component_id", ["endpoint", "method"], ms.COUNT_COLUMNS, ms.set_measures(), REPS, "boot", t.queries)


@query("r02_component_draws", f"""select c.component_id, r replicate, coalesce(d.multiplicity, 0) multiplicity from (select distinct component_id from v_queries) c
    cross join (select unnest(range({EXPORTED})) r) left join v_draws d on d.component_id = c.component_id and d.replicate = r""", BOOT)
def _r02(t):
    return resample.zero_filled(resample.component_draws(t.queries, "component_id", EXPORTED, "boot"), t.queries, "component_id", EXPORTED)


@query("r03_replay_saved_draws", """with comp as (select component_id, endpoint, "method", sum(hit) a, sum(evaluable) b from v_counts group by 1, 2, 3)
    select endpoint, "method", replicate, round(sum(a*multiplicity)::double/nullif(sum(b*multiplicity), 0), 9) any_match from comp join v_draws using (component_id) group by 1, 2, 3""", BOOT)
def _r03(t):
    saved = resample.draw(t.queries, "component_id", REPS, "boot")
    totals = metrics.component_totals(count_rows(t), "component_id", ["endpoint", "method"], ["hit", "evaluable"])
    s = resample.replicate_sums(totals, saved, "component_id", ["endpoint", "method"], ["hit", "evaluable"])
    return s.select("endpoint", "method", "replicate", F.round(ms.ratio("hit", "evaluable"), 9).alias("any_match"))


@query("r04_paired_contrast", f"""with comp as (select component_id, endpoint, "method", {", ".join(f"sum({c}) {c}" for c in ms.COUNT_COLUMNS)} from v_counts group by 1, 2, 3),
    reps as (select endpoint, "method" m, replicate, {rep_measures()} from comp join v_draws using (component_id) group by 1, 2, 3)
    select endpoint, {ci_sql(["d_concordance", "d_precision"])} from (select a.endpoint, a.query_concordance - b.query_concordance d_concordance, a.micro_precision - b.micro_precision d_precision
      from reps a join reps b on a.endpoint = b.endpoint and a.replicate = b.replicate and a.m = 'PRICE' and b.m = 'QTY') group by 1""", BOOT)
def _r04(t):
    totals = metrics.component_totals(count_rows(t), "component_id", ["endpoint", "method"], ms.COUNT_COLUMNS)
    draws = resample.draw(t.queries, "component_id", REPS, "boot")
    s = resample.replicate_sums(totals, draws, "component_id", ["endpoint", "method"], ms.COUNT_COLUMNS)
    m = ms.set_measures()
    s = s.select("endpoint", "method", "replicate", m["query_concordance"].alias("c"), m["micro_precision"].alias("p"))
    one = lambda v, x: F.max(F.when(F.col("method") == v, F.col(x)))
    d = s.groupBy("endpoint", "replicate").agg((one("PRICE", "c") - one("QTY", "c")).alias("d_concordance"),
                                               (one("PRICE", "p") - one("QTY", "p")).alias("d_precision"))
    return resample.interval(d, ["endpoint"], ["d_concordance", "d_precision"], REPS)


@query("r05_finite_draw_interval", f"""with comp as (select component_id, stratum, priority, count(*) filter (where total > 495000) a, count(*) filter (where total > 499000) b from v_queries group by 1, 2, 3),
    reps as (select stratum, priority, replicate, sum(b*multiplicity)::double/nullif(sum(a*multiplicity), 0) v from comp join v_draws using (component_id) group by 1, 2, 3)
    select stratum, priority, case when count(v) = {REPS} then round(quantile_cont(v, 0.025), 9) end v_lower, case when count(v) = {REPS} then round(quantile_cont(v, 0.975), 9) end v_upper, count(v) v_finite from reps group by 1, 2""", BOOT)
def _r05(t):
    q = t.queries.withColumns({"a": (F.col("total") > 495000).cast("int"), "b": (F.col("total") > 499000).cast("int")})
    totals = metrics.component_totals(q, "component_id", ["stratum", "priority"], ["a", "b"])
    s = resample.replicate_sums(totals, resample.draw(t.queries, "component_id", REPS, "boot"), "component_id", ["stratum", "priority"], ["a", "b"])
    return resample.interval(s.withColumn("v", ms.ratio("b", "a")), ["stratum", "priority"], ["v"], REPS)


@query("r06_block_bootstrap_rates", f"""with comp as (select component_id, "role", sum(weight) w, sum(weight*same_l3::int) a, sum(weight*same_l4::int) b from v_scored group by 1, 2),
    dr as ({draws_sql("v_scored", "component_id", REPS, "block", '"role"')}),
    reps as (select "role", replicate, sum(a*multiplicity)/sum(w*multiplicity) rate_l3, sum(b*multiplicity)/sum(w*multiplicity) rate_l4 from comp join dr using (component_id, "role") group by 1, 2)
    select "role", {ci_sql(["rate_l3", "rate_l4"])} from reps group by 1""")
def _r06(t):
    w = F.col("weight")
    rows = t.scored.select("component_id", "role", w.alias("w"), (w * F.col("same_l3").cast("int")).alias("a"), (w * F.col("same_l4").cast("int")).alias("b"))
    totals = metrics.component_totals(rows, "component_id", ["role"], ["w", "a", "b"])
    draws = resample.draw(totals, "component_id", REPS, "block", ["role"])
    s = resample.replicate_sums(totals, draws, "component_id", ["role"], ["w", "a", "b"], ["role"])
    return resample.interval(s.withColumns({"rate_l3": ms.ratio("a", "w"), "rate_l4": ms.ratio("b", "w")}), ["role"], ["rate_l3", "rate_l4"], REPS)


AP_REPS = """(select replicate, sum(pos*cp/nullif(cp+cn, 0))/sum(pos) ap from (select *, sum(pos) over (partition by replicate order by s desc) cp, sum(neg) over (partition by replicate order by s desc) cn from (
      select replicate, {s} s, sum(case when same_l3 then weight*multiplicity else 0 end) pos, sum(case when not same_l3 then weight*multiplicity else 0 end) neg from v_top join dr using (component_id) group by 1, 2)) group by 1)"""


@query("r07_ranking_difference_bootstrap", f"""with dr as ({draws_sql("v_top", "component_id", REPS, "rank")})
    select {ci_sql(["delta"], 8)} from (select b.ap - a.ap delta from {AP_REPS.format(s="ident")} a join {AP_REPS.format(s="cal")} b using (replicate))""", TOP_SQL)
def _r07(t):
    out = resample.ranking_difference_bootstrap(tops(t), "component_id", ("ident", "cal"), "same_l3", "weight", REPS, "rank")
    return out.select(F.round("delta_lower", 8).alias("delta_lower"), F.round("delta_upper", 8).alias("delta_upper"), "delta_finite")


R08_DOM = {"v_dom": """select component_id, ("role" = 'RETEST')::int domain, round(ident, 2) p from v_top""", **TOP_SQL}


def domain_rows(t):
    return tops(t).select("component_id", (F.col("role") == "RETEST").cast("int").alias("domain"), F.round("ident", 2).alias("p"))


AUC_REPS = """(select replicate, sum(neg*(cp - pos/2.0::double))/nullif(sum(pos)*sum(neg), 0) a from (select *, sum(pos) over (partition by replicate order by p desc) cp from (
      select replicate, p, sum(case when {one} then m else 0 end) pos, sum(case when not {one} then m else 0 end) neg from {src} group by 1, 2)) group by 1)"""


@query("r08_domain_auc_bootstrap", f"""with dr as ({draws_sql("v_dom", "component_id", REPS, "auc", "domain")}),
    j as (select d.*, dr.replicate, dr.multiplicity m from v_dom d join dr using (component_id, domain))
    select {ci_sql(["auc"])} from (select greatest(a, 1-a) auc from {AUC_REPS.format(one="domain = 1", src="j")})""", R08_DOM)
def _r08(t):
    return resample.oriented_auc_bootstrap(domain_rows(t), "component_id", "domain", "p", REPS, "auc")


PREC = """with a as (select {g}, component_id, count(*) n, sum(correct::int) ok from v_mtop group by 1, 2), dr as ({d}),
    b as (select {g}, quantile_cont(p, 0.025) lo, quantile_cont(p, 0.975) hi from (select {g}, replicate, sum(ok*multiplicity)::double/sum(n*multiplicity) p from a join dr using ({g}, component_id) group by 1, 2) group by 1)
    select {g}, sum(ok)::bigint ok, sum(n)::bigint n, count(*) clusters, round(sum(ok)::double/sum(n), 9) "precision", round(lo, 9) "lower", round(hi, 9) "upper" from a join b using ({g}) group by {g}, lo, hi"""


@query("r09_cluster_precision_bound", PREC.format(g='"method"', d=draws_sql("v_mtop", "component_id", REPS, "prec", '"method"')), METHOD_SQL)
def _r09(t):
    return resample.precision_lower_bound(method_tops(t), "component_id", ["method"], "correct", REPS, "prec")


@query("r10_row_bootstrap_mean", f"""with dr as ({draws_sql("v_panel", "query_id", REPS, "rows", '"method"')}),
    reps as (select "method", panel_size, replicate, sum(similarity*multiplicity)/sum(multiplicity) mean from v_panel join dr using ("method", query_id) group by 1, 2, 3)
    select * from (select "method", panel_size, count(*) n, round(avg(similarity), 9) mean from v_panel group by 1, 2) join (select "method", panel_size, {ci_sql(["mean"], 6)} from reps group by 1, 2) using ("method", panel_size)""", PANEL_SQL)
def _r10(t):
    return resample.row_bootstrap_mean(panels(t), "query_id", "similarity", ["method", "panel_size"], REPS, "rows", ["method"])


@query("r10b_row_bootstrap_median", f"""with dr as ({draws_sql("v_panel", "query_id", 20, "med", '"method"')}),
    x as (select "method", panel_size, replicate, similarity v, sum(multiplicity) over (partition by "method", panel_size, replicate order by similarity rows unbounded preceding) c, multiplicity m, sum(multiplicity) over (partition by "method", panel_size, replicate) n from v_panel join dr using ("method", query_id)),
    reps as (select "method", panel_size, replicate, (max(v) filter (where c-m < (n+1)//2 and c >= (n+1)//2) + max(v) filter (where c-m < n//2+1 and c >= n//2+1))/2 median from x group by 1, 2, 3)
    select "method", panel_size, {ci_sql(["median"], 6)} from reps group by 1, 2""", PANEL_SQL)
def _r10b(t):
    return resample.row_bootstrap_median(panels(t), "query_id", "similarity", ["method", "panel_size"], 20, "med", ["method"])


@query("r11_family_block_bootstrap", f"""with p as (select v."method", v.panel_size, v.query_id, v.similarity s, case when q.component_id % 3 = 0 then 'QUERY::'||v.query_id::varchar else q.component_id::varchar end block
      from v_panel v join v_queries q using (query_id)),
    tot as (select "method", panel_size, block, sum(s) s, count(*) n from p group by 1, 2, 3), dr as ({draws_sql("p", "block", REPS, "fam")}),
    reps as (select "method", panel_size, replicate, sum(s*multiplicity)/sum(n*multiplicity) mean from tot join dr using (block) group by 1, 2, 3)
    select * from (select "method", panel_size, count(*) blocks from tot group by 1, 2) join (select "method", panel_size, {ci_sql(["mean"], 8)} from reps group by 1, 2) using ("method", panel_size)""", PANEL_SQL)
def _r11(t):
    by = ["method", "panel_size"]
    p = panels(t).join(t.queries.select("query_id", "component_id"), "query_id")
    known = F.when(F.col("component_id") % 3 != 0, F.col("component_id").cast("string"))
    p = p.withColumns({"block": F.coalesce(known, F.concat(F.lit("QUERY::"), F.col("query_id").cast("string"))), "n": F.lit(1)})
    totals = metrics.component_totals(p.withColumn("s", F.col("similarity")), "block", by, ["s", "n"])
    s = resample.replicate_sums(totals, resample.draw(totals, "block", REPS, "fam"), "block", by, ["s", "n"])
    ci = resample.interval(s.withColumn("mean", ms.ratio("s", "n")), by, ["mean"], REPS, 8)
    return totals.groupBy(*by).agg(F.count("*").alias("blocks")).join(ci, by)


@query("r12_top_share_bootstrap", f"""with dr as ({draws_sql("v_top", "component_id", REPS, "share")}),
    pos as (select component_id, same_l3::int y, row_number() over (order by cal desc, query_id) rn from v_top),
    x as (select replicate, y, multiplicity m, sum(multiplicity) over (partition by replicate order by rn rows unbounded preceding) c, sum(multiplicity) over (partition by replicate) n from pos join dr using (component_id)),
    reps as (select replicate, sum(least(m, greatest(floor(0.1::double*n) - (c-m), 0))*y)/max(floor(0.1::double*n)) top_precision from x group by 1)
    select {ci_sql(["top_precision"])} from reps""", TOP_SQL)
def _r12(t):
    return resample.top_share_bootstrap(tops(t), "component_id", "cal", "query_id", "same_l3", 0.1, REPS, "share")


@query("r13_hierarchy_gap_bootstrap", f"""with comp as (select component_id, count(*) n, sum(same_l3::int - same_l4::int) g34, sum(same_l4::int - coalesce(same_exact, false)::int) g4x from v_scored group by 1),
    dr as ({draws_sql("v_scored", "component_id", REPS, "gap")}), reps as (select replicate, sum(g34*multiplicity)::double/sum(n*multiplicity) gap_l3_l4, sum(g4x*multiplicity)::double/sum(n*multiplicity) gap_l4_exact from comp join dr using (component_id) group by 1)
    select (select count(*) from comp) components, (select round(sum(g34)::double/sum(n), 9) from comp) gap_l3_l4, (select round(sum(g4x)::double/sum(n), 9) from comp) gap_l4_exact, {ci_sql(["gap_l3_l4", "gap_l4_exact"])} from reps""")
def _r13(t):
    i = lambda x: F.coalesce(F.col(x), F.lit(False)).cast("int")
    rows = t.scored.select("component_id", F.lit(1).alias("n"), (i("same_l3") - i("same_l4")).alias("g34"), (i("same_l4") - i("same_exact")).alias("g4x"))
    return resample.bootstrap_ratios(rows, "component_id", [], ["n", "g34", "g4x"], {"gap_l3_l4": ms.ratio("g34", "n"), "gap_l4_exact": ms.ratio("g4x", "n")}, REPS, "gap")


DIFF_SQL = {"v_diff": """select b."method", panel_size, a.query_id, round(a.similarity*50)::bigint - round(b.similarity*50)::bigint d from v_panel a join v_panel b using (query_id, panel_size) where a."method" = 'RAW' and b."method" <> 'RAW'""", **PANEL_SQL}


def paired_diff(t):
    """Similarity of the first policy less that of every other, per query and panel size."""
    p = panels(t).select("query_id", "panel_size", "method", F.round(F.col("similarity") * 50).cast("bigint").alias("s"))
    first = p.where(F.col("method") == "RAW").select("query_id", "panel_size", F.col("s").alias("_first"))
    return p.where(F.col("method") != "RAW").join(first, ["query_id", "panel_size"]).withColumn("d", F.col("_first") - F.col("s"))


FLIPS = 20_000


@query("r14_sign_flip_permutation", f"""with c as (select "method", panel_size, abs(d)::double v, count(*) c, sum(d) s from v_diff group by 1, 2, 3), b as (select *, case when v > 0 then least(c - 60*b, 60) else 0 end::int m from (select *, unnest(range((c + 59)//60)) b from c) where v > 0 or b = 0),
    h as (select r, v, b, {H60.format("'flip|'||r||'|'||v::decimal(38,9)::varchar||'|'||b")} h from (select distinct v, b from b) cross join (select unnest(range({FLIPS})) r)),
    f as (select "method", panel_size, r, sum(v*(2*bit_count(h & ((1::bigint << m) - 1)) - m)) s from b join h using (v, b) group by 1, 2, 3),
    o as (select "method", panel_size, sum(s) s, sum(c) n from c group by 1, 2) select "method", panel_size, n::bigint n, round(o.s::double/n, 9) mean, count(*) filter (where abs(f.s) >= abs(o.s)) exceed,
    round((count(*) filter (where abs(f.s) >= abs(o.s)) + 1)/{FLIPS + 1}.0::double, 9) p_value from f join o using ("method", panel_size) group by 1, 2, n, o.s""", DIFF_SQL)
def _r14(t):
    return resample.sign_flip_test(paired_diff(t), "d", FLIPS, "flip", ["method", "panel_size"])


PERMUTATIONS = 1000


@query("r15_cluster_label_permutation", f"""with cl as (select component_id, max(domain) d from v_dom group by 1),
    pr as (select component_id, r replicate, row_number() over (partition by r order by {H60.format("'perm|'||r||'|'||component_id")}, component_id) <= (select sum(d) from cl) lab from cl cross join (select unnest(range({PERMUTATIONS})) r)
      union all select component_id, -1, d = 1 from cl),
    j as (select replicate, p, lab, count(*) m from v_dom join pr using (component_id) group by all),
    a as (select replicate, round(greatest(a, 1-a), 9) auc from {AUC_REPS.format(one="lab", src="j")}), o as (select auc from a where replicate = -1)
    select max(o.auc) auc, count(*) filter (where a.auc >= o.auc) exceed, round((count(*) filter (where a.auc >= o.auc) + 1)/{PERMUTATIONS + 1}.0::double, 9) p_value from a cross join o where replicate >= 0""", R08_DOM)
def _r15(t):
    return resample.cluster_label_permutation(domain_rows(t), "component_id", "domain", "p", PERMUTATIONS, "perm")


@query("r16_random_panel_expectation", """with x as (select query_id, ident, same_l4::int h, row_number() over (partition by query_id order by ident, reference_id desc) i, count(*) over (partition by query_id) n from v_scored)
    select query_id, round(sum(ident*case when n = 1 then 1 else 2.0::double*(i - 1)/(n*(n - 1.0::double)) end), 9) expected_best,
      round(case when n = 1 then sum(h) else 1 - (n - sum(h))*(n - sum(h) - 1.0::double)/(n*(n - 1.0::double)) end, 9) expected_hit from x group by query_id, n""")
def _r16(t):
    return resample.random_panel_expectation(t.scored, "query_id", "reference_id", "ident", "same_l4", 2)


WL = """(({s}::double/{n} + 3.8414588206941236/(2*{n}) - 1.959963984540054*sqrt(({s}::double/{n}*(1-{s}::double/{n}) + 3.8414588206941236/(4*{n}))/{n})) / (1 + 3.8414588206941236/{n}))"""


@query("r17_wilson_lower_bound", f"""select family, s, n, round({WL.format(s="s", n="n")}, 9) "lower" from (select family, count(*) n, sum(same_l3::int)::bigint s from v_scored group by 1)""")
def _r17(t):
    g = t.scored.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.col("same_l3").cast("int")).alias("s"))
    return g.select("family", "s", "n", F.round(ms.wilson_lower("s", "n"), 9).alias("lower"))


@query("r18_bh_adjustment", """with p as (select family, round(1.0::double/(1 + sum(same_l3::int)), 9) + round(avg(ident), 9)/100 p from v_scored group by 1), r as (select *, row_number() over (order by p, family) rn, count(*) over () m from p)
    select family, p, round(least(1, min(p*m/rn) over (order by rn desc)), 9) adjusted from r""")
def _r18(t):
    p = t.scored.groupBy("family").agg((F.round(1 / (1 + F.sum(F.col("same_l3").cast("int"))), 9) + F.round(F.avg("ident"), 9) / 100).alias("p"))
    return resample.bh_adjust(p, "p", "family").select("family", "p", F.round("adjusted", 9).alias("adjusted"))


@query("r19_context_keyed_seed", """select component_id, sha256('20260819|'||'calibration|'||component_id::varchar||'|'||n::varchar) seed from (select component_id, count(*) n from v_queries group by 1)""")
def _r19(t):
    g = t.queries.groupBy("component_id").agg(F.count("*").alias("n"))
    return g.select("component_id", sha_hex(key_text(20260819, "calibration", F.col("component_id"), F.col("n"))).alias("seed"))


@query("r20_six_state_bootstrap", f"""with comp as (select q.component_id, endpoint, count(*) n, sum((state not like 'CANDIDATE_ABSENT%')::int) av, sum(accepted::int) ac, sum((state = 'TOP1_CORRECT_ACCEPTED')::int) ok
      from v_six join v_queries q using (query_id) group by 1, 2), dr as ({draws_sql("v_queries", "component_id", REPS, "six")}),
    reps as (select endpoint, replicate, sum(av*multiplicity)::double/sum(n*multiplicity) availability, sum(ac*multiplicity)::double/sum(n*multiplicity) coverage, sum(ok*multiplicity)::double/nullif(sum(ac*multiplicity), 0) accepted_precision from comp join dr using (component_id) group by 1, 2)
    select * from (select endpoint, count(*) components, round(sum(av)::double/sum(n), 9) availability, round(sum(ac)::double/sum(n), 9) coverage, round(sum(ok)::double/sum(ac), 9) accepted_precision from comp group by 1)
      join (select endpoint, {ci_sql(["availability", "coverage", "accepted_precision"])} from reps group by 1) using (endpoint)""", SIX_SQL)
def _r20(t):
    s = six_rows(t).join(t.queries.select("query_id", "component_id"), "query_id")
    i = lambda c: c.cast("int")
    rows = s.select("component_id", "endpoint", F.lit(1).alias("n"), i(~F.col("state").startswith("CANDIDATE_ABSENT")).alias("av"),
                    i(F.col("accepted")).alias("ac"), i(F.col("state") == "TOP1_CORRECT_ACCEPTED").alias("ok"))
    return resample.bootstrap_ratios(rows, "component_id", ["endpoint"], ["n", "av", "ac", "ok"], {
        "availability": ms.ratio("av", "n"), "coverage": ms.ratio("ac", "n"), "accepted_precision": ms.ratio("ok", "ac")}, REPS, "six", t.queries)


@query("r21_paired_transition_bootstrap", f"""with e as (select q.component_id, endpoint, (s_accepted and s_correct and documented) s, (f_accepted and f_correct and documented) f from v_modes join v_queries q using (query_id)),
    comp as (select component_id, endpoint, count(*) n, sum((f and not s)::int) g, sum((s and not f)::int) l from e group by 1, 2), dr as ({draws_sql("v_queries", "component_id", REPS, "trans")}),
    reps as (select endpoint, replicate, sum(g*multiplicity)::double/sum(n*multiplicity) gain, sum(l*multiplicity)::double/sum(n*multiplicity) loss from comp join dr using (component_id) group by 1, 2)
    select * from (select endpoint, count(*) components, round(sum(g)::double/sum(n), 9) gain, round(sum(l)::double/sum(n), 9) loss from comp group by 1) join (select endpoint, {ci_sql(["gain", "loss"])} from reps group by 1) using (endpoint)""", PAIRED_SQL)
def _r21(t):
    m = paired_modes(t).join(t.queries.select("query_id", "component_id"), "query_id")
    ev = metrics.event_columns("s", "f")
    rows = m.select("component_id", "endpoint", F.lit(1).alias("n"), ev["gain"].cast("int").alias("g"), ev["loss"].cast("int").alias("l"))
    return resample.bootstrap_ratios(rows, "component_id", ["endpoint"], ["n", "g", "l"], {"gain": ms.ratio("g", "n"), "loss": ms.ratio("l", "n")}, REPS, "trans", t.queries)


@query("r22_paired_coverage_vs_best_method", f"""with best as (select "method" m from v_mtop group by 1 order by sum(correct::int) desc, 1 limit 1),
    d as (select q.component_id, count(*) n, sum(coalesce(t.same_l4, false)::int - coalesce(v.correct, false)::int) d from v_queries q left join v_top t using (query_id) left join (select * from v_mtop where "method" = (select m from best)) v on v.query_id = q.query_id group by 1),
    dr as ({draws_sql("v_queries", "component_id", REPS, "cover")}), reps as (select replicate, sum(d*multiplicity)::double/sum(n*multiplicity) difference from d join dr using (component_id) group by 1)
    select (select m from best) best_method, (select count(*) from d) components, (select round(sum(d)::double/sum(n), 9) from d) difference, {ci_sql(["difference"])} from reps""", {**METHOD_SQL, **TOP_SQL})
def _r22(t):
    m = method_tops(t)
    best = m.groupBy("method").agg(F.sum(F.col("correct").cast("int")).alias("ok")).agg(F.min(F.struct((-F.col("ok")).alias("o"), "method")).alias("b"))
    best = best.select(F.col("b.method").alias("best_method"))
    rival = m.join(F.broadcast(best), m["method"] == F.col("best_method")).select("query_id", F.col("correct").cast("int").alias("b"))
    ours = tops(t).select("query_id", F.col("same_l4").cast("int").alias("a"))
    rows = t.queries.select("query_id", "component_id").join(ours, "query_id", "left").join(rival, "query_id", "left").fillna(0, ["a", "b"])
    rows = rows.select("component_id", F.lit(1).alias("n"), (F.col("a") - F.col("b")).alias("d"))
    out = resample.bootstrap_ratios(rows, "component_id", [], ["n", "d"], {"difference": ms.ratio("d", "n")}, REPS, "cover", t.queries)
    from labeltrail.operators.ranking import attach_one_row

    return attach_one_row(out, best)


MATCH_SQL = {"v_strata": """select concat_ws('|', l3, stratum, (case when ident <= 0.2 then 0 when ident <= 0.5 then 1 when ident <= 0.8 then 2 else 3 end)::varchar) st, query_id, reference_id, same_l3 from v_scored""",
    "v_match": f"""select t.st stratum_key, t.rn "position", t.query_id t_query_id, t.reference_id t_reference_id, c.query_id c_query_id, c.reference_id c_reference_id from
      (select *, row_number() over (partition by st order by {H60.format("'T|'||query_id||'|'||reference_id")}, query_id, reference_id) rn from v_strata where same_l3) t
      join (select *, row_number() over (partition by st order by {H60.format("'C|'||query_id||'|'||reference_id")}, query_id, reference_id) rn from v_strata where not same_l3) c using (st, rn)""",
    "v_caliper": """select h.family, h.rn "position", h.query_id high_query_id, l.query_id low_query_id, h.same_l3 hl3, l.same_l3 ll3, h.same_l4 hl4, l.same_l4 ll4 from
      (select *, row_number() over (partition by family order by raw, query_id, reference_id) rn from v_scored where ident >= 0.5) h join
      (select *, row_number() over (partition by family order by raw, query_id, reference_id) rn from v_scored where ident < 0.5) l using (family, rn)
      where abs(h.raw - l.raw) <= 0.1 and abs(h.disc - l.disc) <= 0.06"""}


@query("j19_exact_stratum_matching", """with b as (select stratum_key, count(*) n, coalesce(sum(count(*)) over (order by stratum_key rows between unbounded preceding and 1 preceding), 0) before from v_match group by 1)
    select m.* from v_match m join b using (stratum_key) where before + m."position" <= 500""", MATCH_SQL)
def _j19(t):
    from labeltrail.operators.curves import right_closed_bin

    s = t.scored
    strata = [F.col("l3"), F.col("stratum"), right_closed_bin(F.col("ident"), [0.2, 0.5, 0.8])]
    return matching.exact_stratum_match(s, strata, F.col("same_l3"), ~F.col("same_l3"), ["query_id", "reference_id"], cap=500)


def caliper_pairs(t):
    s = t.scored.withColumn("high", (F.col("ident") >= 0.5).cast("int"))
    return matching.rank_caliper_match(s, ["family"], "high", "raw", ["query_id", "reference_id"], {"raw": 0.1, "disc": 0.06}, ["same_l3", "same_l4"])


@query("j20_rank_caliper_matching", """select family, "position", high_query_id, low_query_id, hl3::int high_l3, ll3::int low_l3 from v_caliper""", MATCH_SQL)
def _j20(t):
    return caliper_pairs(t).select("family", "position", "high_query_id", "low_query_id", F.col("high_same_l3").cast("int").alias("high_l3"), F.col("low_same_l3").cast("int").alias("low_l3"))


@query("a41_discordance_odds_mcnemar", """with p as (select unnest(['L3','L4']) endpoint, unnest([hl3, hl4])::int h, unnest([ll3, ll4])::int l, family from v_caliper),
    s as (select endpoint, count(*) pairs, round(avg(h), 9) high_rate, round(avg(l), 9) low_rate, round(avg(h-l), 9) risk_difference, count(*) filter (where h > l) n10, count(*) filter (where h < l) n01 from p group by 1)
    select *, round((n10+0.5::double)/(n01+0.5::double), 9) odds_ratio, round(case when n10 = n01 then 1.0::double else least(1.0::double, 2*(select sum(exp(lgamma(n10+n01+1) - lgamma(i+1) - lgamma(n10+n01-i+1) - (n10+n01)*ln(2))) from (select unnest(range(0, least(n10, n01)+1)) i))) end, 9) mcnemar_p from s""", MATCH_SQL)
def _a41(t):
    p = caliper_pairs(t)
    items = F.inline(F.array(*[F.struct(F.lit(e).alias("endpoint"), F.col("high_" + c).alias("h"), F.col("low_" + c).alias("l")) for e, c in (("L3", "same_l3"), ("L4", "same_l4"))]))
    return resample.paired_difference(p.select(items), ["endpoint"], "h", "l")
