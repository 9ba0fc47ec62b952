"""Set-valued metrics, retrieval ceilings, curves, calibration and selection rules (A rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labeltrail.functions import measures as ms
from labeltrail.operators import candidates as cd
from labeltrail.operators import curves, metrics, trace
from labeltrail.operators.ranking import exact_quantiles, ranked, top_k, top_one
from labeltrail.plans.registry import query
from labeltrail.plans.replay import REPS, ci_sql, draws_sql
from labeltrail.plans.trace_queries import FUSED_SQL, TRACE_SQL, budget_states, trace_of

CNT = ", ".join(f"sum({c})::bigint {c}" for c in ms.COUNT_COLUMNS)
MEASURES_SQL = """round(sum(emitted)::double/nullif(sum(n),0),9) coverage, round(sum(hit)::double/nullif(sum(n),0),9) concordant_coverage,
  round(sum(hit)::double/nullif(sum(evaluable),0),9) query_concordance, round(sum(exact)::double/nullif(sum(evaluable),0),9) exact_set_concordance,
  round(sum(tp)::double/nullif(sum(pred_evaluable),0),9) micro_precision, round(sum(tp)::double/nullif(sum(truth_labels),0),9) micro_recall,
  round(2*sum(tp)::double/nullif(sum(pred_evaluable)+sum(truth_labels),0),9) micro_f1, round(sum(emitted_labels)::double/nullif(sum(n),0),9) mean_emitted_labels"""
COUNTS_SQL = {
    "v_pred": """select distinct query_id, method, endpoint, label from (
        select query_id, method, unnest(['L3','L4']) endpoint, unnest([l3,l4]) label from (
          select query_id, 'PRICE' as method, reference_id, row_number() over (partition by query_id order by price desc, reference_id) rn, 2 k from v_pairs where disc <= 0.07
          union all select query_id, 'QTY', reference_id, row_number() over (partition by query_id order by qty desc, reference_id), 1 from v_pairs where tax <= 0.06)
        join v_refs using (reference_id) where rn <= k)""",
    "v_counts": """select q.query_id, q.endpoint, m.method, qq.component_id, qq.stratum, 1 n, (len(q.truth_labels) > 0)::int evaluable, (np > 0)::int emitted,
        (tp > 0)::int hit, (tp > 0 and tp = np and tp = len(q.truth_labels))::int exact, tp,
        case when len(q.truth_labels) > 0 then np else 0 end pred_evaluable, len(q.truth_labels) truth_labels, np emitted_labels from (
        select q.query_id, q.endpoint, m.method, count(p.label) np, count(*) filter (where list_contains(q.truth_labels, p.label)) tp
        from v_trace_queries q cross join (select unnest(['PRICE','QTY']) as method) m left join v_pred p
          on p.query_id = q.query_id and p.endpoint = q.endpoint and p.method = m.method group by 1, 2, 3) m
        join v_trace_queries q using (query_id, endpoint) join v_queries qq using (query_id)""",
}


def predicted_rows(t):
    p = t.pairs.join(t.refs.select("reference_id", "l3", "l4"), "reference_id")
    tie = ("reference_id", "asc")
    a = top_k(p.where(F.col("disc") <= 0.07), ["query_id"], [("price", "desc"), tie], 2).withColumn("method", F.lit("PRICE"))
    b = top_k(p.where(F.col("tax") <= 0.06), ["query_id"], [("qty", "desc"), tie], 1).withColumn("method", F.lit("QTY"))
    both = cd.expand_levels(a.unionByName(b), {"L3": "l3", "L4": "l4"}, ["query_id", "method"])
    return both.distinct()


def count_rows(t):
    """Nine-count vector per (query, endpoint, method); every query of the universe appears."""
    pred = predicted_rows(t).groupBy("query_id", "endpoint", "method").agg(F.collect_set("label").alias("predicted"))
    q = t.trace_queries.withColumn("method", F.explode(F.array(F.lit("PRICE"), F.lit("QTY"))))
    q = q.join(t.queries.select("query_id", "component_id", "stratum"), "query_id")
    q = q.join(pred, ["query_id", "endpoint", "method"], "left")
    none = F.array().cast("array<string>")
    cols = ms.set_counts(F.coalesce("predicted", none), F.col("truth_labels"))
    return q.select("query_id", "endpoint", "method", "component_id", "stratum", *[v.alias(k) for k, v in cols.items()])


@query("a03_set_count_vector", f"select query_id, endpoint, method, {', '.join(ms.COUNT_COLUMNS)} from v_counts", COUNTS_SQL)
def _a03(t):
    return count_rows(t).drop("component_id", "stratum")


@query("a04_ratio_of_sums", f"select endpoint, method, {CNT}, {MEASURES_SQL} from v_counts group by 1, 2", COUNTS_SQL)
def _a04(t):
    return metrics.set_summary(count_rows(t), ["endpoint", "method"])


@query("a05_component_totals", f"""select c.component_id, m.endpoint, m.method, {", ".join(f"coalesce(sum(x.{k}), 0)::bigint {k}" for k in ("n", "hit", "tp", "emitted_labels"))}
    from (select distinct component_id from v_queries) c cross join (select distinct endpoint, method from v_counts) m
    left join v_counts x on x.component_id = c.component_id and x.endpoint = m.endpoint and x.method = m.method group by 1, 2, 3""", COUNTS_SQL)
def _a05(t):
    return metrics.component_totals(count_rows(t), "component_id", ["endpoint", "method"], ["n", "hit", "tp", "emitted_labels"], t.queries)


THREE_SQL = {"v_three": """select component_id, endpoint, method, sum(n) n, sum(evaluable) evaluable, sum(hit) hit, sum(emitted) has_output,
    sum(emitted_labels) output_count, sum(tp) matched_output_count from v_counts group by 1, 2, 3""", **COUNTS_SQL}
THREE_LONG = """select endpoint, method, component_id, unnest(['any_match','output_coverage','label_concordance']) metric,
    unnest([hit, has_output, matched_output_count]) num, unnest([evaluable, n, output_count]) den from v_three"""


@query("a06_three_rate_metrics", f"""select endpoint, method, metric, sum(num)::bigint numerator, sum(den)::bigint denominator,
    round(100*sum(num)::double/nullif(sum(den),0), 6) percent, round(avg(case when den > 0 then 100*num::double/den end), 6) equal_component_percent,
    count(*) components from ({THREE_LONG}) group by 1, 2, 3""", THREE_SQL)
def _a06(t):
    return metrics.three_rates(three_rows(t), ["endpoint", "method"], "component_id")


def three_rows(t):
    return count_rows(t).withColumnsRenamed({"emitted": "has_output", "emitted_labels": "output_count", "tp": "matched_output_count"})


@query("a07_equal_component_rate", f"""select endpoint, method, metric, round(avg(case when den > 0 then 100*num::double/den end), 6) equal_component_percent
    from ({THREE_LONG}) group by 1, 2, 3""", THREE_SQL)
def _a07(t):
    return metrics.three_rates(three_rows(t), ["endpoint", "method"], "component_id").select(
        "endpoint", "method", "metric", "equal_component_percent")


STATES6 = ['NO_LIBRARY_SUPPORT', 'ABSENT_FROM_SAVED_UNION', 'OUTSIDE_TOP50', 'STRICT_SCORE_LOSS', 'CALIBRATED_TIE_LOSS', 'CONCORDANT_TOP1']
PIVOT = ", ".join(f"count(*) filter (where state = '{s}') {s.lower()}" for s in STATES6)


@query("a08_component_diagnosis", f"""select b.endpoint, q.component_id, count(*) queries, sum(concordant)::bigint concordant, {PIVOT}
    from v_budget b join v_queries q using (query_id) group by 1, 2""", FUSED_SQL)
def _a08(t):
    b = budget_states(t).join(t.queries.select("query_id", "component_id"), "query_id")
    return b.groupBy("endpoint", "component_id").agg(
        F.count("*").alias("queries"), F.sum("concordant").alias("concordant"),
        *[ms.n_if(F.col("state") == s).alias(s.lower()) for s in STATES6])


@query("a09_overlapping_groups", f"""with b as (select b.*, q.component_id, q.stratum from v_budget b join v_queries q using (query_id)),
    big as (select endpoint, min(component_id) big from (select endpoint, component_id, count(*) n, max(count(*)) over (partition by endpoint) m from b group by 1, 2) where n = m group by 1),
    g as (select b.*, unnest([x for x in ['ALL', 'STRATUM_'||stratum, case when component_id <> big then 'EXCLUDING_LARGEST' end,
       case when stratum = 'F' and component_id <> big then 'F_EXCLUDING_LARGEST' end] if x is not null]) grp from b join big using (endpoint))
    select endpoint, grp "group", count(*) queries, count(distinct component_id) components, sum(concordant)::bigint concordant,
      round(100*avg(concordant), 6) percent, {PIVOT} from g group by 1, 2""", FUSED_SQL)
def _a09(t):
    b = budget_states(t).join(t.queries.select("query_id", "component_id", "stratum"), "query_id")
    size = b.groupBy("endpoint", "component_id").agg(F.count("*").alias("n"))
    big = size.groupBy("endpoint").agg(F.min(F.struct((-F.col("n")).alias("n"), "component_id")).alias("b")).select(
        "endpoint", F.col("b.component_id").alias("big"))
    b = b.join(big, "endpoint")
    rest = F.col("component_id") != F.col("big")
    tags = {"ALL": F.lit(True), "EXCLUDING_LARGEST": rest, "F_EXCLUDING_LARGEST": rest & (F.col("stratum") == "F")}
    tags.update({f"STRATUM_{s}": F.col("stratum") == s for s in ("F", "O", "P")})
    g = metrics.tagged(b, tags)
    return g.groupBy("endpoint", "group").agg(
        F.count("*").alias("queries"), F.count_distinct("component_id").alias("components"),
        F.sum("concordant").alias("concordant"), F.round(100 * F.avg("concordant"), 6).alias("percent"),
        *[ms.n_if(F.col("state") == s).alias(s.lower()) for s in STATES6])


KS = [1, 2, 4]
CEIL_SQL = {"v_mods": """select query_id, modality, rk, unnest(['L3','L4']) endpoint, unnest([l3,l4]) label from (
      select query_id, reference_id, rk, 'sequence' modality from v_seq union all select query_id, reference_id, rk, 'structure' from v_str
      union all select query_id, reference_id, least(coalesce(s.rk, 99), coalesce(t.rk, 99)), 'union' from v_seq s full join v_str t using (query_id, reference_id))
      join v_refs using (reference_id)""",
    "v_ceil": """select query_id, endpoint, modality, k, count(distinct label) labels, count(distinct label) filter (where tr) true_labels from (
      select m.*, k, exists (select 1 from v_truth t where t.query_id = m.query_id and t.endpoint = m.endpoint and t.label = m.label) tr
      from v_mods m cross join (select unnest([1,2,4]) k) where rk <= k) group by 1, 2, 3, 4""", **FUSED_SQL}


def modality_labels(t):
    seq = cd.modality_ranks(t.pairs.where(F.col("disc") <= 0.08), "price", 4).select(
        "query_id", "reference_id", "rank", F.lit("sequence").alias("modality"))
    st = cd.modality_ranks(t.pairs.where(F.col("tax") <= 0.06), "qty", 4).select(
        "query_id", "reference_id", "rank", F.lit("structure").alias("modality"))
    each = seq.unionByName(st)
    both = each.groupBy("query_id", "reference_id").agg(F.min("rank").alias("rank")).withColumn("modality", F.lit("union"))
    rows = each.unionByName(both).join(t.refs.select("reference_id", "l3", "l4"), "reference_id")
    return cd.expand_levels(rows, {"L3": "l3", "L4": "l4"}, ["query_id", "modality", "rank"])


def ceiling(t):
    labels = modality_labels(t)
    mods = F.explode(F.array(F.lit("sequence"), F.lit("structure"), F.lit("union"))).alias("modality")
    truth = t.truth.where(F.col("endpoint") != "EXACT").select("query_id", "endpoint", "label", mods)
    return cd.cumulative_hits(labels, truth, KS, ["query_id", "endpoint", "modality"])


@query("a11_cumulative_labels_at_k", "select * from v_ceil", CEIL_SQL)
def _a11(t):
    return ceiling(t)


@query("a10_retrieval_ceiling", """with base as (select q.query_id, q."role", q.total > 200000 has_structure, e.endpoint, m.modality, k.k, coalesce(n.n, 0) nt
       from v_queries q cross join (select unnest(['L3','L4']) endpoint) e cross join (select unnest(['sequence','structure','union']) modality) m
       cross join (select unnest([1,2,4]) k) k left join (select query_id, endpoint, count(*) n from v_truth group by 1, 2) n
         on n.query_id = q.query_id and n.endpoint = e.endpoint),
    f as (select b.*, coalesce(c.labels, 0) > 0 cand, coalesce(c.true_labels, 0) tl, unnest(['all', b."role"]) part,
       from base b left join v_ceil c using (query_id, endpoint, modality, k)),
    g as (select *, unnest(case when has_structure then ['all_queries','structure_available'] else ['all_queries'] end) cohort from f)
    select part, cohort, modality, k, endpoint, count(*) total_queries, count(*) filter (where nt > 0) truth_queries,
      count(*) filter (where nt > 0 and cand) with_candidate, count(*) filter (where nt > 0 and tl > 0) correct_queries,
      round(count(*) filter (where nt > 0 and tl > 0)::double / nullif(count(*) filter (where nt > 0), 0), 9) any_correct_recall,
      round(sum(case when nt > 0 then tl::double/nt end) / nullif(count(*) filter (where nt > 0), 0), 9) macro_label_recall
    from g group by 1, 2, 3, 4, 5""", CEIL_SQL)
def _a10(t):
    n = t.truth.where(F.col("endpoint") != "EXACT").groupBy("query_id", "endpoint").agg(F.count("*").alias("nt"))
    cells = F.explode(F.array(*[F.struct(F.lit(e).alias("endpoint"), F.lit(m).alias("modality"), F.lit(k).alias("k"))
                                for e in ("L3", "L4") for m in ("sequence", "structure", "union") for k in KS])).alias("c")
    q = t.queries.select("query_id", "role", (F.col("total") > 200000).alias("has_structure"), cells).select(
        "query_id", "role", "has_structure", "c.*")
    q = q.join(n, ["query_id", "endpoint"], "left").join(ceiling(t), ["query_id", "endpoint", "modality", "k"], "left")
    q = q.fillna(0, ["nt", "labels", "true_labels"])
    known, good = F.col("nt") > 0, F.col("true_labels") > 0
    # Sums per (role, structure flag) first: the overlapping parts and cohorts are then
    # copies of a few summary rows instead of copies of every query.
    small = q.groupBy("role", "has_structure", "modality", "k", "endpoint").agg(
        F.count("*").alias("n"), ms.n_if(known).alias("t"), ms.n_if(known & (F.col("labels") > 0)).alias("c"), ms.n_if(known & good).alias("g"),
        F.sum(F.when(known, F.col("true_labels") / F.col("nt"))).alias("r"))
    x = metrics.tagged(small, {"all": F.lit(True), **{r: F.col("role") == r for r in ("TRAIN", "DEV", "CAL_FIT", "CAL_RULE", "RETEST")}}, "part")
    x = metrics.tagged(x, {"all_queries": F.lit(True), "structure_available": F.col("has_structure")}, "cohort")
    return x.groupBy("part", "cohort", "modality", "k", "endpoint").agg(
        F.sum("n").alias("total_queries"), F.sum("t").alias("truth_queries"), F.sum("c").alias("with_candidate"), F.sum("g").alias("correct_queries"),
        F.round(ms.ratio(F.sum("g"), F.sum("t")), 9).alias("any_correct_recall"), F.round(ms.ratio(F.sum("r"), F.sum("t")), 9).alias("macro_label_recall"))


@query("a12_weighted_rate", """select "role", round(sum(weight*same_l3::int)/sum(weight), 9) rate_l3, round(sum(weight*same_l4::int)/sum(weight), 9) rate_l4
    from v_scored group by 1""")
def _a12(t):
    w = F.col("weight")
    r = lambda y: F.round(ms.ratio(F.sum(w * F.col(y).cast("int")), F.sum(w)), 9)
    return t.scored.groupBy("role").agg(r("same_l3").alias("rate_l3"), r("same_l4").alias("rate_l4"))


EDGES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.01]


RATE_CELLS = "component_id, sum(weight) w, sum(weight*same_l3::int) w3, sum(weight*same_l4::int) w4"


def rate_reps(prefix):
    return ", ".join(f"sum(w{n}*multiplicity)/sum(w*multiplicity) {prefix}_same_l{n}" for n in (3, 4))


@query("a13_binned_transfer_curve", f"""with s as (select *, case when ident < 0.2 then 0 when ident < 0.4 then 1 when ident < 0.6 then 2 when ident < 0.8 then 3 else 4 end bin from v_scored),
    cells as (select "role", bin, {RATE_CELLS} from s group by 1, 2, 3), dr as ({draws_sql("cells", "component_id", REPS, "curve", '"role", bin')}),
    reps as (select "role", bin, replicate, {rate_reps("rate")} from cells join dr using ("role", bin, component_id) group by 1, 2, 3)
    select * from (select "role", bin, min(ident) bin_lower, max(ident) bin_upper, count(*) pair_rows, count(distinct query_id) queries, count(distinct component_id) clusters,
      round(sum(weight*same_l3::int)/sum(weight), 9) rate_same_l3, round(sum(weight*same_l4::int)/sum(weight), 9) rate_same_l4 from s group by 1, 2)
      join (select "role", bin, {ci_sql(["rate_same_l3", "rate_same_l4"])} from reps group by 1, 2) using ("role", bin)""")
def _a13(t):
    return curves.binned_rates(t.scored, ["role"], "ident", EDGES, ["same_l3", "same_l4"], "weight", "component_id", replicates=REPS)


@query("a14_threshold_sweep", f"""with s as (select *, sum(weight) over (partition by "role") tw from v_scored where "role" in ('CAL_FIT','RETEST')),
    x as (select s.*, th::double threshold from s cross join (select unnest([0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 0.95]) th) where ident >= th::double),
    p as (select "role", threshold, count(*) pair_rows, count(distinct component_id) clusters, round(sum(weight)/max(tw), 9) coverage,
      round(sum(weight*same_l3::int)/sum(weight), 9) precision_same_l3, round(sum(weight*same_l4::int)/sum(weight), 9) precision_same_l4 from x group by 1, 2 having count(*) >= 20),
    cells as (select "role", threshold, {RATE_CELLS} from x semi join p using ("role", threshold) group by 1, 2, 3), dr as ({draws_sql("cells", "component_id", REPS, "threshold", '"role", threshold')}),
    reps as (select "role", threshold, replicate, {rate_reps("precision")} from cells join dr using ("role", threshold, component_id) group by 1, 2, 3)
    select * from p join (select "role", threshold, {ci_sql(["precision_same_l3", "precision_same_l4"])} from reps group by 1, 2) using ("role", threshold)""")
def _a14(t):
    rows = t.scored.where(F.col("role").isin("CAL_FIT", "RETEST"))  # fitting and final cohorts
    return curves.threshold_sweep(rows, ["role"], "ident", [0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 0.95], ["same_l3", "same_l4"], "weight", "component_id",
                                  replicates=REPS)


WILSON = """((s::double/n + 3.8414588206941236/(2*n) - 1.959963984540054*sqrt((s::double/n*(1-s::double/n) + 3.8414588206941236/(4*n))/n)) / (1 + 3.8414588206941236/n))"""


@query("a15_family_boundaries", f"""with x as (select fam, th, count(*) n, sum(same_l3::int) s, count(distinct component_id) c, sum(weight*same_l3::int)/sum(weight) pr
      from (select *, unnest([family, 'ALL_FAMILIES']) fam from v_scored where "role" <> 'RETEST')
      cross join (select unnest([0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,0.95])::double th) where ident >= th group by 1, 2),
    sel as (select fam, min(th) threshold from x where n >= 50 and c >= 5 and {WILSON} >= 0.44 group by 1),
    te as (select fam, s.threshold, count(*) n, sum(same_l3::int) s from (select *, unnest([family, 'ALL_FAMILIES']) fam from v_scored where "role" = 'RETEST') v
       join sel s using (fam) where ident >= s.threshold group by 1, 2)
    select x.fam family, sel.threshold, x.n pairs, x.c clusters, round(x.pr, 9) "precision", coalesce(te.n, 0) test_pairs, round(te.s::double/te.n, 9) test_precision
    from sel join x on x.fam = sel.fam and x.th = sel.threshold left join te on te.fam = sel.fam""")
def _a15(t):
    cuts = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
    rows = t.scored.select("role", "ident", "weight", "component_id", "same_l3", F.explode(
        F.array("family", F.lit("ALL_FAMILIES"))).alias("family"))
    fit = rows.where(F.col("role") != "RETEST").withColumn("ok", F.col("same_l3").cast("int"))
    s = curves.threshold_sweep(fit, ["family"], "ident", cuts, ["same_l3"], "weight", "component_id", 50, plain=True)
    s = s.withColumnRenamed("raw_precision_same_l3", "raw_precision")
    low = ms.wilson_lower(F.round(F.col("raw_precision") * F.col("pair_rows"), 0), "pair_rows")
    ok = s.where((F.col("clusters") >= 5) & (low >= 0.44))
    best = ok.groupBy("family").agg(F.min_by(F.struct("threshold", "pair_rows", "clusters", "precision_same_l3"), "threshold").alias("b"))
    best = best.select("family", "b.threshold", F.col("b.pair_rows").alias("pairs"), "b.clusters", F.col("b.precision_same_l3").alias("precision"))
    test = rows.where(F.col("role") == "RETEST").join(best.select("family", "threshold"), "family").where(
        F.col("ident") >= F.col("threshold")).groupBy("family").agg(
        F.count("*").alias("test_pairs"), F.round(F.avg(F.col("same_l3").cast("int")), 9).alias("test_precision"))
    return best.join(test, "family", "left").fillna(0, ["test_pairs"])


@query("a16_stratified_rates", """select stratum_type, value, count(*) pair_rows, count(distinct component_id) clusters,
    round(sum(weight*same_l3::int)/sum(weight), 9) rate_same_l3, round(sum(weight*same_l4::int)/sum(weight), 9) rate_same_l4 from (
      select *, unnest(['type','stratum','family','exact']) stratum_type, unnest([l3, stratum, family, coalesce(exact, 'null')]) "value" from v_scored)
    group by 1, 2 having count(*) >= 100""")
def _a16(t):
    return curves.stratified_rates(t.scored, {"type": "l3", "stratum": "stratum", "family": "family", "exact": "exact"},
                                   ["same_l3", "same_l4"], "weight", "component_id")


AUC = """select {g}, round(sum(neg*(cp - pos/2))/nullif(max(tp)*max(tn), 0), 9) auroc, case when max(tp)*max(tn) > 0 then round(sum(pos*cp/nullif(cp+cn,0))/max(tp), 9) end average_precision, max(tp) positives, max(tn) negatives
    from (select *, sum(pos) over (partition by {g} order by s desc) cp, sum(neg) over (partition by {g} order by s desc) cn,
      sum(pos) over (partition by {g}) tp, sum(neg) over (partition by {g}) tn from (
      select {g}, {s} s, sum(case when {y} then w else 0 end) pos, sum(case when not {y} then w else 0 end) neg from {src} group by all)) group by {g}"""


def auc_sql(group, score, y, src, weight="weight"):
    return AUC.format(g=group, s=score, y=y, src=f"(select *, {weight}::double w from {src})")


@query("a25_weighted_auroc_average_precision", auc_sql('"role"', "raw", "same_l4", "v_scored"))
def _a25(t):
    return curves.ranking_metrics(t.scored, ["role"], "raw", "same_l4", "weight")


@query("a25b_tied_score_auroc", auc_sql("stratum", "cal", "same_l3", "v_scored"))
def _a25b(t):
    return curves.ranking_metrics(t.scored, ["stratum"], "cal", "same_l3", "weight")


@query("a25c_document_length_quality", auc_sql("lang", "n_chars", "quality = 1", "(select * from documents join labels using (doc_id))", "1"))
def _a25c(t):
    d = t.raw("documents").select("doc_id", "lang", "n_chars").join(t.raw("labels"), "doc_id")
    return curves.ranking_metrics(d, ["lang"], "n_chars", "quality")


BENCH = {"v_bench": """select design, lv level, y, ident, weight, query_id, component_id from (
    select *, unnest([x for x in [case when rq >= 90 and rr < 80 then 'random_row_split' end, case when "role" = 'RETEST' then 'component_split' end,
      case when fam >= 85 then 'family_holdout' end, case when released >= timestamp '1998-01-01' then 'temporal_new' end] if x is not null]) design
    from (select s.*, q.released, ('0x'||substr(sha256('row|'||s.query_id::varchar),1,15))::bigint % 100 rq,
      ('0x'||substr(sha256('row|'||s.reference_id::varchar),1,15))::bigint % 100 rr, ('0x'||substr(sha256('fam|'||s.family),1,15))::bigint % 100 fam
      from v_scored s join v_queries q using (query_id))) b, lateral (select unnest(['L3','L4']) lv, unnest([b.same_l3, b.same_l4]) y)"""}


def benchmark_cohorts(t):
    """Pairs copied into each benchmark design they belong to, one row per level."""
    from labeltrail.functions.hashing import bucket, key_text

    s = t.scored.join(t.queries.select("query_id", "released"), "query_id")
    rq, rr = bucket(key_text("row", F.col("query_id")), 100), bucket(key_text("row", F.col("reference_id")), 100)
    s = metrics.tagged(s, {
        "random_row_split": (rq >= 90) & (rr < 80), "component_split": F.col("role") == "RETEST",
        "family_holdout": bucket(key_text("fam", F.col("family")), 100) >= 85,
        "temporal_new": F.col("released") >= F.lit("1998-01-01").cast("timestamp")}, "design")
    lv = F.inline(F.array(*[F.struct(F.lit(k).alias("level"), F.col(c).alias("y")) for k, c in (("L3", "same_l3"), ("L4", "same_l4"))]))
    return s.select("design", "ident", "weight", "query_id", "component_id", lv)


def benchmark(t):
    rows = benchmark_cohorts(t)
    n = rows.groupBy("design", "level").agg(
        F.count("*").alias("pair_rows"), F.count_distinct("query_id").alias("queries"), F.count_distinct("component_id").alias("clusters"),
        F.round(F.sum(F.col("weight") * F.col("y").cast("int")) / F.sum("weight"), 9).alias("positive_rate"))
    return n.join(curves.ranking_metrics(rows, ["design", "level"], "ident", "y", "weight"), ["design", "level"], "left")


BENCH_SQL = f"""select n.*, a.auroc, a.average_precision, a.positives, a.negatives from (select design, level, count(*) pair_rows, count(distinct query_id) queries,
    count(distinct component_id) clusters, round(sum(weight*y::int)/sum(weight), 9) positive_rate from v_bench group by 1, 2) n
    join ({auc_sql("design, level", "ident", "y", "v_bench")}) a using (design, level)"""


@query("a17_benchmark_designs", BENCH_SQL, BENCH)
def _a17(t):
    return benchmark(t)


@query("a18_random_strict_gap", f"""with b as ({BENCH_SQL}) select r.level, r.average_precision random_ap, s.average_precision strict_ap,
    round(r.average_precision - s.average_precision, 8) gap, round(s.average_precision / r.average_precision, 8) strict_to_random,
    r.pair_rows random_pairs, s.pair_rows strict_pairs from b r join b s on r.level = s.level and r.design = 'random_row_split' and s.design = 'component_split'""", BENCH)
def _a18(t):
    b = benchmark(t)
    pick = lambda d, p: b.where(F.col("design") == d).select(
        "level", F.col("average_precision").alias(p + "_ap"), F.col("pair_rows").alias(p + "_pairs"))
    j = pick("random_row_split", "random").join(pick("component_split", "strict"), "level")
    return j.select("level", "random_ap", "strict_ap", F.round(F.col("random_ap") - F.col("strict_ap"), 8).alias("gap"),
                    F.round(F.col("strict_ap") / F.col("random_ap"), 8).alias("strict_to_random"), "random_pairs", "strict_pairs")


@query("a19_hierarchy_gap_by_family", """select family, count(*) pairs, round(avg(same_l3::int - same_l4::int), 9) gap_l3_l4,
    round(avg(same_l4::int - coalesce(same_exact, false)::int), 9) gap_l4_exact, count(*) filter (where same_l3 and not same_l4) broad_only from v_scored group by 1""")
def _a19(t):
    i = lambda x: F.coalesce(F.col(x), F.lit(False)).cast("int")
    return t.scored.groupBy("family").agg(
        F.count("*").alias("pairs"), F.round(F.avg(i("same_l3") - i("same_l4")), 9).alias("gap_l3_l4"),
        F.round(F.avg(i("same_l4") - i("same_exact")), 9).alias("gap_l4_exact"),
        ms.n_if(F.col("same_l3") & ~F.col("same_l4")).alias("broad_only"))


@query("a20_unique_list_json", """select c.c_nationkey, to_json(list_sort(list(distinct c_mktsegment)))::varchar segments from customer c group by 1""")
def _a20(t):
    from labeltrail.functions.labels import sorted_json

    return t.raw("customer").groupBy("c_nationkey").agg(sorted_json(F.collect_set("c_mktsegment")).alias("segments"))


@query("a21_split_leakage", """select kind, count(*) groups, count(*) filter (where n > 1) leaking from (
    select 'component' kind, component_id::varchar g, count(distinct "role") n from v_scored group by 2 union all
    select 'family', family, count(distinct "role") from v_scored group by 2 union all
    select 'reference', reference_id::varchar, count(distinct "role") from v_scored group by 2) group by 1""")
def _a21(t):
    from labeltrail.operators.checks import groups_spanning_splits

    return groups_spanning_splits(t.scored, {"component": "component_id", "family": "family", "reference": "reference_id"}, "role")


VOTE_SQL = {"v_votestats": """select *, count(*) over w candidate_set_size, sum(candidate_votes) over w total_votes, max(candidate_votes) over w top_votes from (
      select query_id, label, count(distinct method) candidate_votes, count(distinct channel) supporting_channels from v_votes group by 1, 2) window w as (partition by query_id)""",
    "v_agree": """select v.query_id, v.label, v.candidate_votes, v.supporting_channels, v.candidate_set_size, v.total_votes::bigint total_votes, v.top_votes,
      case when v.candidate_set_size <= 1 then 0.0 else round(h.h / ln(v.candidate_set_size), 9) end agreement_entropy,
      coalesce(s.second, 0) second_votes, v.candidate_votes - coalesce(s.second, 0) vote_lead, (v.candidate_votes = v.top_votes)::int is_plurality
      from v_votestats v join (select query_id, ln(sum(candidate_votes)) - sum(candidate_votes*ln(candidate_votes))/sum(candidate_votes) h from v_votestats group by 1) h using (query_id)
      left join (select query_id, max(candidate_votes) "second" from v_votestats where candidate_votes < top_votes group by 1) s using (query_id)"""}


def agreement(t):
    return metrics.majority_agreement(t.votes, ["query_id"])


@query("a22_vote_counts_and_lead", "select query_id, label, candidate_votes, second_votes, vote_lead, candidate_set_size, is_plurality from v_agree", VOTE_SQL)
def _a22(t):
    return agreement(t).select("query_id", "label", "candidate_votes", "second_votes", "vote_lead", "candidate_set_size", "is_plurality")


@query("a23_vote_entropy", "select distinct query_id, round(agreement_entropy::double, 8) agreement_entropy from v_agree", VOTE_SQL)
def _a23(t):
    return agreement(t).select("query_id", F.round("agreement_entropy", 8).alias("agreement_entropy")).distinct()


@query("a24_label_support_pooling", """select query_id, l4 label, max(raw) best_score, count(distinct case when raw >= 0.25 then reference_id end) supporting_references,
    count(distinct case when raw >= 0.25 then cluster_id end) supporting_clusters from v_scored group by 1, 2""")
def _a24(t):
    ok = F.col("raw") >= 0.25
    return t.scored.groupBy("query_id", F.col("l4").alias("label")).agg(
        F.max("raw").alias("best_score"), F.count_distinct(F.when(ok, F.col("reference_id"))).alias("supporting_references"),
        F.count_distinct(F.when(ok, F.col("cluster_id"))).alias("supporting_clusters"))


@query("a26_cutoff_metrics", """with s as (select "role", sum(weight) filter (where raw >= 0.3 and same_l3) tp, sum(weight) filter (where raw >= 0.3 and not same_l3) fp,
      sum(weight) filter (where raw < 0.3 and same_l3) fn, sum(weight) filter (where raw < 0.3 and not same_l3) tn from v_scored group by 1)
    select "role", round(tp/(tp+fp), 9) "precision", round(tp/(tp+fn), 9) recall, round(2*tp/(2*tp+fp+fn), 9) f1,
      round((tp*tn-fp*fn)/(sqrt(tp+fp)*sqrt(tp+fn)*sqrt(tn+fp)*sqrt(tn+fn)), 9) mcc, round((tp/(tp+fn)+tn/(tn+fp))/2, 9) balanced_accuracy from s""")
def _a26(t):
    return metrics.confusion_metrics(t.scored.withColumn("y", F.col("same_l3").cast("int")), ["role"], "raw", "y", 0.3, "weight")


QUANT = {"v_sorted": """select "role", raw s, row_number() over (partition by "role" order by raw) - 1 i, count(*) over (partition by "role") n from v_scored"""}


def quantile_sql(m, src="v_sorted", g='"role"'):
    """Cutoffs at j/m from sorted rows, with integer arithmetic for the neighbours."""
    return f"""select l.{g} {g}, j, l.n, l.s + (h.s - l.s) * (j*(l.n-1)/{m}.0::double - (j*(l.n-1))//{m}) thr
      from (select unnest(range({m}+1)) j) join {src} l on l.i = (j*(l.n-1))//{m}
      join {src} h on h.{g} = l.{g} and h.i = (j*(l.n-1) + {m} - 1)//{m}"""


@query("a27_best_f1_cutoff", f"""with q as ({quantile_sql(200)}), f as (select q."role", thr, round(2*sum(weight) filter (where same_l3 and raw >= thr) /
      (sum(weight) filter (where raw >= thr) + sum(weight) filter (where same_l3)), 12) f from (select distinct "role", thr from q) q join v_scored s using ("role") group by 1, 2)
    select "role", min(thr) threshold, round(max(f), 9) f1 from (select *, max(f) over (partition by "role") m from f) where f = m group by 1""", QUANT)
def _a27(t):
    return curves.best_f1_cutoff(t.scored, ["role"], "raw", "same_l3", "weight")


@query("a28_brier_and_log_loss", """select "role", count(*) n, round(avg((ident - same_l3::int)**2), 9) brier,
    round(-avg(same_l3::int*ln(q) + (1-same_l3::int)*ln(1-q)), 9) log_loss from (select *, least(greatest(ident, 1e-7), 1-1e-7) q from v_scored) group by 1""")
def _a28(t):
    return metrics.probability_losses(t.scored, ["role"], "ident", "same_l3")


@query("a29_ece_equal_width", """select "role", round(sum(abs(sy - sp))/sum(n), 9) ece, sum(n)::bigint n from (select "role", least(floor(ident*15), 14) b, count(*) n,
    sum(ident) sp, sum(same_l3::int) sy from v_scored group by 1, 2) group by 1""")
def _a29(t):
    return curves.ece_equal_width(t.scored, ["role"], "ident", "same_l3")


TOP_SQL = {"v_top": """select query_id, component_id, "role", stratum, raw, cal, ident, same_l3, same_l4, same_exact, l3, l4, reference_id, family, weight from (
    select *, row_number() over (partition by query_id order by cal desc, raw desc, reference_id) rn from v_scored) where rn = 1"""}


def tops(t):
    return top_one(t.scored, ["query_id"], [("cal", "desc"), ("raw", "desc"), ("reference_id", "asc")])


EQBINS = """select "role", (least(floor((rn-1)*10/n), 9)+1)::int bin, count(*) queries, round(avg(raw), 9) mean_predicted, round(avg(same_l3::int), 9) observed_precision,
    min(raw) min_probability, max(raw) max_probability from (select *, row_number() over (partition by "role" order by raw, query_id) rn, count(*) over (partition by "role") n from v_top) group by 1, 2"""


@query("a30_equal_count_calibration_bins", EQBINS, TOP_SQL)
def _a30(t):
    return curves.equal_count_bins(tops(t), ["role"], "raw", "same_l3", "query_id")


@query("a30b_ece_equal_count", f"""select "role", round(sum(queries*abs(mean_predicted-observed_precision))/sum(queries), 8) ece from ({EQBINS}) group by 1""", TOP_SQL)
def _a30b(t):
    return curves.ece_equal_count(curves.equal_count_bins(tops(t), ["role"], "raw", "same_l3", "query_id"), ["role"])


@query("a31_risk_coverage", """with r as (select *, row_number() over (partition by "role" order by raw desc, query_id) rn, count(*) over (partition by "role") n from v_top),
    g as (select "role", n, c, greatest(1, round_even(c*n/100::double, 0))::bigint k from (select distinct "role", n from r) cross join (select unnest(range(1, 101)) c))
    select g."role", c::int step, round(count(*)::double/g.n, 9) coverage, count(*) accepted_rows, round(sum(same_l3::int)::double/count(*), 9) "precision",
      round(1 - sum(same_l3::int)::double/count(*), 9) risk, min(raw) min_probability from g join r on r."role" = g."role" and r.rn <= g.k group by g."role", c, g.n""", TOP_SQL)
def _a31(t):
    return curves.risk_coverage(tops(t), ["role"], "raw", "same_l3", "query_id")


@query("a32_operating_curve", """with n as (select count(*) t from v_queries), r as (select *, row_number() over (order by raw desc, query_id) rn from v_top),
    g as (select j/20.0::double tc, raw thr from (select unnest(range(1, 21)) j) cross join n join r on r.rn = ceil(j*n.t/20.0::double)),
    d as (select min(tc) tc, thr from g group by thr)
    select round(d.tc, 9) target_coverage, thr threshold, count(*) accepted, count(distinct component_id) clusters, round(count(*)::double/max(n.t), 9) coverage,
      round(avg(same_l3::int), 9) "precision", (count(*) >= 50 and count(distinct component_id) >= 20 and avg(same_l3::int) >= 0.3)::int qualifies
    from d cross join n join v_top v on v.raw >= d.thr group by d.tc, thr""", TOP_SQL)
def _a32(t):
    total = t.queries.count()
    return curves.operating_points(tops(t), "raw", "same_l3", "component_id", total, target=0.3)


SAFE_Q = {"v_tsorted": """select "role", raw s, row_number() over (partition by "role" order by raw) - 1 i, count(*) over (partition by "role") n from v_top""", **TOP_SQL}


def safe_sql(m, desired, minimum, g='"role"'):
    return f"""with q as ({quantile_sql(m, "v_tsorted")}), x as (select q."role", thr, count(*) n, sum(same_l3::int) s from (select distinct "role", thr from q) q
      join v_top v using ("role") where v.raw >= thr group by 1, 2),
    b as (select "role", min_by(x, thr) b from x where n >= {minimum} and {WILSON} >= {desired} group by 1)
    select t."role", coalesce(b.b.thr, 1.000001) threshold, coalesce(b.b.n, 0) accepted, coalesce(b.b.s, 0)::bigint accepted_correct, round(b.b.s::double/b.b.n, 9) "precision",
      round((select {WILSON} from (select b.b.s s, b.b.n n)), 9) wilson_lower, round(coalesce(b.b.n, 0)::double/t.c, 9) coverage
    from (select "role", count(*) c from v_top group by 1) t left join b using ("role")"""


@query("a33_safe_cutoff", safe_sql(1000, 0.3, 60), SAFE_Q)
def _a33(t):
    return curves.safe_cutoff(tops(t), ["role"], "raw", "same_l3", 0.3, 60)
