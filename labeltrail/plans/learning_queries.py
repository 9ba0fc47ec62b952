"""Feature tables and fitted steps (L rows) and temporal task labels (M17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labeltrail.functions import measures as ms
from labeltrail.operators import features as ft
from labeltrail.operators import learning, refits
from labeltrail.operators.candidates import expand_levels
from labeltrail.operators.curves import left_closed_bin
from labeltrail.operators.ranking import attach_one_row, exact_quantiles, top_k
from labeltrail.plans.metric_queries import TOP_SQL, auc_sql, tops
from labeltrail.plans.registry import query
from labeltrail.plans.selection_queries import H60

ISO_SQL = {"v_cell": """select "role", cal::double x, sum(weight*same_l3::int) sy, sum(weight) w from v_scored where "role" = 'CAL_FIT' group by 1, 2""",
    "v_iso": """select x, max(v) iso from (select c.x, j.x jx, min(s.sy/s.w) v from v_cell c join v_cell j on j.x <= c.x
      join (select a.x ax, b.x bx, sum(m.sy) sy, sum(m.w) w from v_cell a join v_cell b on a.x <= b.x join v_cell m on m.x between a.x and b.x group by 1, 2) s on s.ax = j.x and s.bx >= c.x group by 1, 2) group by 1""",
    "v_bp": """select x, iso, lag(x) over (order by x) px, lag(iso) over (order by x) pi, lead(x) over (order by x) nx, lead(iso) over (order by x) ni from v_iso"""}


def fitted(t):
    return learning.fit_isotonic(t.scored.where(F.col("role") == "CAL_FIT"), "cal", "same_l3", "weight")


@query("l01_isotonic_fit", "select x, round(iso, 8) y from v_iso", ISO_SQL)
def _l01(t):
    # Fitted values at the calibration scores themselves.
    m = fitted(t)
    x = t.scored.where(F.col("role") == "CAL_FIT").select(F.col("cal").cast("double").alias("x")).distinct()
    return m.copy().setFeaturesCol("x").setPredictionCol("y").transform(x).select("x", F.round("y", 8).alias("y"))


@query("l02_calibrator_apply", """select s.query_id, s.reference_id, round(case when s.c <= (select min(x) from v_iso) then (select iso from v_iso order by x limit 1) when s.c >= (select max(x) from v_iso) then (select iso from v_iso order by x desc limit 1)
    else b.iso + (coalesce(b.ni, b.iso) - b.iso) * (s.c - b.x)/(coalesce(b.nx, b.x + 1) - b.x) end, 5) calibrated from (select query_id, reference_id, cal::double c from v_scored) s asof left join v_bp b on s.c >= b.x""", ISO_SQL)
def _l02(t):
    out = learning.apply_isotonic(t.scored, fitted(t), "cal", "calibrated")
    return out.select("query_id", "reference_id", F.round(F.col("calibrated").cast("double"), 5).alias("calibrated"))


PREP_SQL = {"v_fit": """select median(price) pm, median(q) qm from (select price, case when disc <= 0.08 then qty end q from v_scored where "role" = 'TRAIN')""",
    "v_fit2": """select pm, qm, avg(price) pa, stddev_samp(price) ps, avg(coalesce(q, qm)) qa, stddev_samp(coalesce(q, qm)) qs from (select price, case when disc <= 0.08 then qty end q from v_scored where "role" = 'TRAIN') cross join v_fit group by 1, 2"""}


def prep_rows(t):
    return t.scored.select("query_id", "reference_id", "role", "stratum", "price", F.when(F.col("disc") <= 0.08, F.col("qty")).alias("qty"))


@query("l03_preprocessing_matrix", """select query_id, reference_id, round((price - pa)/ps, 6) price, round((coalesce(case when disc <= 0.08 then qty end, qm) - qa)/qs, 6) qty, (stratum = 'F')::int::float "stratum_F", (stratum = 'O')::int::float "stratum_O", 0::float "stratum_MISSING" from v_scored cross join v_fit2""", PREP_SQL)
def _l03(t):
    rows = prep_rows(t)
    f = ft.fit_numeric(rows.where(F.col("role") == "TRAIN"), ["price", "qty"])
    x = ft.apply_numeric(rows, f, ["price", "qty"])
    hot = ft.one_hot(x, "stratum", ["F", "O", "MISSING"])
    return x.select("query_id", "reference_id", F.round("price", 6).alias("price"), F.round("qty", 6).alias("qty"), *[v.alias(k) for k, v in hot.items()])


LINEAR = {"intercept": -1.0, "median": {"raw": 0.25, "m": 0.5}, "center": {"raw": 0.26, "m": 0.5}, "scale": {"raw": 0.14, "m": 0.29},
          "coefficient": {"raw": 0.8, "m": -0.4}, "missing": {"m": 0.3}}


@query("l04_portable_linear_scorer", """select query_id, reference_id, round(p, 9) probability, (p >= 0.3)::int accepted from (select query_id, reference_id, case when z >= 0 then 1/(1+exp(-z)) else exp(z)/(1+exp(z)) end p from (
    select query_id, reference_id, -1.0 + (raw - 0.26)/0.14*0.8 + (coalesce(m, 0.5) - 0.5)/0.29*(-0.4) + (m is null)::int*0.3 z from (select *, case when tax <= 0.06 then ident end m from v_scored)))""")
def _l04(t):
    x = t.scored.withColumn("m", F.when(F.col("tax") <= 0.06, F.col("ident")))
    p = ft.linear_score(LINEAR, ["raw", "m"])
    return x.select("query_id", "reference_id", F.round(p, 9).alias("probability"), (p >= 0.3).cast("int").alias("accepted"))


SEED, FOLDS = 20260819, 5
DOMAIN_COLUMNS = ["raw", "ident", "disc"]


def domain_table(t):
    """Rows of two cohorts without a common component: a role is a component's."""
    return tops(t).select("query_id", "component_id", "raw", "ident", F.when(F.col("disc") <= 0.08, F.col("disc")).alias("disc"), (F.col("role") == "RETEST").cast("int").alias("domain"))


FOLD_SQL = {"v_domain": """select v.query_id, v.component_id, v.raw::double raw, v.ident::double ident, case when v.disc <= 0.08 then v.disc::double end disc, ("role" = 'RETEST')::int domain from (select *, row_number() over (partition by query_id order by cal desc, raw desc, reference_id) rn from v_scored) v where rn = 1""",
    "v_group": f"""select *, row_number() over (partition by n, domain order by h, component_id) - 1 j from (select component_id, domain, count(*) n, {H60.format(f"'{SEED}|FOLD|'||component_id")} h from v_domain group by 1, 2)""",
    "v_class": "select domain, n, count(*) c, row_number() over (partition by domain order by n desc) i from v_group group by 1, 2",
    "v_deal": f"""with recursive s as (select unnest([0, 1]) domain, 0::bigint i, 0::bigint n, list_transform(range({FOLDS}), lambda x: 0::bigint) loads, [0::bigint] fill
      union all select c.domain, c.i, c.n, list_transform(range(1, {FOLDS + 1}), lambda f: s.loads[f] + c.n*(c.c // {FOLDS} + (list_position(o.fill, f) <= c.c % {FOLDS})::int)), o.fill
      from s join v_class c on c.domain = s.domain and c.i = s.i + 1,
      lateral (select list_transform(list_sort(list_transform(range(1, {FOLDS + 1}), lambda f: {{'l': s.loads[f], 'f': f}})), lambda e: e.f) fill) o) select * from s where i > 0""",
    "v_fold": f"select g.component_id, (d.fill[(g.j % {FOLDS} + 1)::int] - 1)::int fold from v_group g join v_deal d using (domain, n)"}


@query("l05b_stratified_group_folds", "select query_id, domain, fold from v_domain join v_fold using (component_id)", {**TOP_SQL, **FOLD_SQL})
def _l05b(t):
    return refits.stratified_group_folds(domain_table(t), "component_id", "domain", FOLDS, SEED).select("query_id", "domain", "fold")


# Gradient steps of a fixed length, at most the inverse of the largest curvature, until they settle.
OOF_SQL = {"v_value": """select d.query_id, d.component_id, d.domain, f.fold, raw, ident, coalesce(disc, (select median(disc) from v_domain)) disc, (disc is null)::int flag from v_domain d join v_fold f using (component_id)""",
    "v_scale": f"""select k, count(*) n, sum(domain) n1, avg(raw) ma, stddev_pop(raw) sa, avg(ident) mb, stddev_pop(ident) sb, avg(disc) mc, stddev_pop(disc) sc, avg(flag) md, stddev_pop(flag) sd
      from v_value join (select unnest(range({FOLDS})) k) on fold <> k group by 1""",
    "v_x": """select k, query_id, fold, domain y, case when fold = k then 0 when domain = 1 then n/(2.0::double*n1) else n/(2.0::double*(n - n1)) end w,
      [(raw - ma)/sa, (ident - mb)/sb, (disc - mc)/sc, (flag - md)/sd, 1.0::double] x from v_value cross join v_scale""",
    "v_theta": f"""with recursive t as (select k, 0 i, [0.0::double, 0, 0, 0, 0] th from (select unnest(range({FOLDS})) k)
      union all select t.k, t.i + 1, [t.th[j] - (t.th[j] + 0.1*g[j])/(1 + 0.1*1.25*n) for j in [1, 2, 3, 4, 5]] from t join (select t2.k, t2.i, [sum(r*x[1]), sum(r*x[2]), sum(r*x[3]), sum(r*x[4]), sum(r*x[5])] g, sum(w) n
        from (select t.k, t.i, v.x, v.w, v.w*(1/(1 + exp(-list_dot_product(t.th, v.x))) - v.y) r from t join v_x v on v.k = t.k and v.w > 0) t2 group by 1, 2) q on q.k = t.k where t.i < 900)
      select k, th from t where i = 900"""}


@query("l05_domain_classifier_out_of_fold", "select query_id, y domain, fold, round(1/(1 + exp(-list_dot_product(th, x))), 4) probability from v_x join v_theta using (k) where fold = k", {**TOP_SQL, **FOLD_SQL, **OOF_SQL})
def _l05(t):
    p = refits.out_of_fold_probabilities(domain_table(t), DOMAIN_COLUMNS, "domain", "component_id", FOLDS, SEED)
    return p.select("query_id", "domain", "fold", F.round("probability", 4).alias("probability"))


@query("l06_cohort_shift_audit")
def _l06(t):
    return learning.cohort_shift_audit(domain_table(t), DOMAIN_COLUMNS, "component_id", "domain", SEED, "audit", FOLDS)


@query("l07_propensity_bins")
def _l07(t):
    """Fitted on one cohort, applied to another."""
    rows = t.scored.select("query_id", "reference_id", "role", "raw", "disc", "tax", "ident")
    p = learning.propensity_bins(rows.where(F.col("role") == "DEV"), rows.where(F.col("role") == "RETEST"), ["raw", "disc", "tax"], "ident")
    return p.groupBy("bin").agg(F.count("*").alias("pairs"), F.sum("high").alias("high"))


@query("l08_binomial_coefficients")
def _l08(t):
    return learning.binomial_coefficients(t.scored, ["raw", "ident", "disc"], "same_l3").withColumn("estimate", F.round("estimate", 4))


@query("l09_seed_ensemble_mean", """select query_id, reference_id, ((raw + (raw + disc/100) + (raw - tax/100))/3)::float ensemble from v_scored""")
def _l09(t):
    items = F.explode(F.array(F.col("raw"), F.col("raw") + F.col("disc") / 100, F.col("raw") - F.col("tax") / 100)).alias("s")
    return ft.ensemble_mean(t.scored.select("query_id", "reference_id", items), ["query_id", "reference_id"], "s")


@query("l10_blend_weight_choice", f"""with g as (select st, same_l3, weight, round(st/40.0::double*raw + (1 - st/40.0::double)*ident, 9) score from v_scored cross join (select unnest(range(41)) st)), a as ({auc_sql("st", "score", "same_l3", "g")})
    select round(min(st)/40.0::double, 6) alpha, max(ap) average_precision from (select st, round(average_precision, 9) ap, max(round(average_precision, 9)) over () m from a) where ap = m""")
def _l10(t):
    return ft.choose_blend(t.scored, "raw", "ident", "same_l3", "weight", 40)


META_SQL = {"v_meta": """select p_partkey id, p_size length, p_brand family, e.embedding, [p_brand, p_type] domains, p_size % 3 <> 0 has_structure from part left join embeddings e on e.vec_id = p_partkey"""}


@query("l11_pair_feature_table", """select p.query_id, p.reference_id, round(list_cosine_similarity(q.embedding::double[], r.embedding::double[]), 6) embedding_cosine, round(least(q.length, r.length)::double/greatest(q.length, r.length), 9) length_ratio, abs(q.length - r.length)::bigint length_difference,
    round(ln(1 + q.length), 8) log_query_length, case when q.id is null and r.id is null then null else round(len(list_intersect(q.domains, r.domains))::double/len(list_distinct(list_concat(q.domains, r.domains))), 9) end domain_jaccard, (q.family = r.family)::int family_match,
    (q.has_structure and r.has_structure)::int both_structures, (q.embedding is not null and r.embedding is not null)::int embedding_available from (select distinct source_id query_id, reference_id from v_hits) p join v_meta q on q.id = p.query_id join v_meta r on r.id = p.reference_id""", META_SQL)
def _l11(t):
    p = t.raw("part").join(t.raw("embeddings").select(F.col("vec_id").alias("p_partkey"), "embedding"), "p_partkey", "left")
    meta = p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("length"), F.col("p_brand").alias("family"), "embedding",
                    F.array("p_brand", "p_type").alias("domains"), (F.col("p_size") % 3 != 0).alias("has_structure"))
    pairs = t.hits.select(F.col("source_id").alias("query_id"), "reference_id").distinct()
    known = meta.select("id")
    pairs = pairs.join(known.withColumnRenamed("id", "query_id"), "query_id", "left_semi").join(known.withColumnRenamed("id", "reference_id"), "reference_id", "left_semi")
    return ft.pair_features(pairs.select("query_id", "reference_id"), meta, meta)


EV_SQL = {"v_ev": """select * from (select query_id, endpoint, "method", channel, label, score, round(score - lead(score) over w, 9) margin, row_number() over w rn from (select p.query_id, p.reference_id, unnest(['L3','L4']) endpoint, unnest([r.l3, r.l4]) label, m."method", m.channel, m.score
      from v_pairs p join v_refs r using (reference_id), lateral (select unnest(['PRICE','QTY','DISC','TAX']) "method", unnest(['A','B','C','C']) channel, unnest([p.price, p.qty, case when p.disc >= 0.02 then p.disc end, case when p.tax >= 0.03 then p.tax end]) score) m where m.score is not null)
      window w as (partition by query_id, endpoint, "method" order by score desc, reference_id)) where rn = 1"""}
TOOLS = ["PRICE", "QTY", "DISC", "TAX"]


def evidence_votes(t):
    """Top-1 label per (query, level, tool) with its margin over the runner-up."""
    p = t.pairs.join(t.refs.select("reference_id", "l3", "l4"), "reference_id")
    vals = {"PRICE": F.col("price"), "QTY": F.col("qty"), "DISC": F.when(F.col("disc") >= 0.02, F.col("disc")), "TAX": F.when(F.col("tax") >= 0.03, F.col("tax"))}
    items = F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(ch).alias("channel"), vals[m].alias("score")) for m, ch in zip(TOOLS, "ABCC")]))
    long = p.select("query_id", "reference_id", "l3", "l4", items).where(F.col("score").isNotNull())
    two = top_k(long, ["query_id", "method"], [("score", "desc"), ("reference_id", "asc")], 2)
    f = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c))).alias(c)
    g = two.groupBy("query_id", "method").agg(f("channel"), f("l3"), f("l4"), f("score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("_s"))
    g = g.withColumn("margin", F.round(F.col("score") - F.col("_s"), 9))
    return expand_levels(g, {"L3": "l3", "L4": "l4"}, ["query_id", "method", "channel", "score", "margin"])


@query("l12_tool_evidence_features", """with w as (select query_id, endpoint, max(label) filter (where "method"='PRICE') lp, max(label) filter (where "method"='QTY') lq, max(label) filter (where "method"='DISC') ld, max(label) filter (where "method"='TAX') lt, max(score) filter (where "method"='PRICE') sp, max(score) filter (where "method"='QTY') sq,
      max(margin) filter (where "method"='PRICE') mp, max(margin) filter (where "method"='QTY') mq from v_ev group by 1, 2),
    c as (select query_id, endpoint, label, count(*) n, count(distinct channel) ch from v_ev group by 1, 2, 3), s as (select query_id, endpoint, count(*) k, sum(n) tot, max(n) top, list_sort(list(n), 'desc') l, -sum(n*ln(n)) a from c group by 1, 2)
    select w.query_id, w.endpoint, lp candidate_label, tot::bigint available_tools, k candidate_set_size, round((ln(tot) + a/tot)/greatest(ln(k), 1e-12), 7) agreement_entropy, c.n candidate_votes, (case when k > 1 then l[2] else 0 end)::bigint second_votes, (c.n = top)::int is_plurality, c.ch supporting_channels,
      (coalesce(ld = lp, false)::int + coalesce(lt = lp, false)::int) old_agreement_count, coalesce(lq = lp, false)::int lead_second_agree, sp "score_PRICE", case when lq = lp then sq end "support_score_QTY", mp "margin_PRICE", case when lq = lp then mq end "support_margin_QTY", (coalesce(ld = lp, false)::int + coalesce(lt = lp, false)::int >= 2)::int old_agree_ge2
    from w join s using (query_id, endpoint) join c on c.query_id = w.query_id and c.endpoint = w.endpoint and c.label = w.lp""", EV_SQL)
def _l12(t):
    e = ft.tool_evidence(evidence_votes(t), ["query_id", "endpoint"], "PRICE", "QTY", ["DISC", "TAX"])
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return e.select("query_id", "endpoint", "candidate_label", big("available_tools"), big("candidate_set_size"), F.round("agreement_entropy", 7).alias("agreement_entropy"), big("candidate_votes"), big("second_votes"),
                    "is_plurality", big("supporting_channels"), "old_agreement_count", "lead_second_agree", "score_PRICE", "support_score_QTY", "margin_PRICE", "support_margin_QTY", "old_agree_ge2")


@query("l13_candidate_matrix", """with c as (select query_id, endpoint, label, max(("method"='PRICE')::int) support_PRICE, max(("method"='QTY')::int) support_QTY, max(("method"='DISC')::int) support_DISC, max(("method"='TAX')::int) support_TAX, max(score) filter (where "method"='QTY') support_score_QTY from v_ev group by 1, 2, 3),
    q as (select query_id, endpoint, count(*) available_tools, max(score) filter (where "method"='PRICE') query_score_PRICE from v_ev group by 1, 2)
    select query_id, endpoint, label, available_tools, query_score_PRICE "query_score_PRICE", support_score_QTY "support_score_QTY", support_PRICE + support_QTY + support_DISC + support_TAX supporting_tools, support_PRICE + support_QTY + greatest(support_DISC, support_TAX) supporting_channels from c join q using (query_id, endpoint)""", EV_SQL)
def _l13(t):
    m = ft.candidate_matrix(evidence_votes(t), ["query_id", "endpoint"], TOOLS, dict(zip(TOOLS, "ABCC")))
    return m.select("query_id", "endpoint", "label", "available_tools", "query_score_PRICE", "support_score_QTY", "supporting_tools", "supporting_channels")


@query("l14_exact_nearest_neighbours", """select query_id, item, rk "rank", round(s, 6) similarity from (select a.vec_id query_id, b.vec_id item, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) s, row_number() over (partition by a.vec_id order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, b.vec_id) rk
    from embeddings a cross join embeddings b where a.vec_id % 2 = 1 and b.vec_id % 2 = 0) where rk <= 5""")
def _l14(t):
    e = t.raw("embeddings").select("vec_id", "embedding")
    n = learning.nearest_neighbours(e.where(F.col("vec_id") % 2 == 1), e.where(F.col("vec_id") % 2 == 0), 5)
    return n.select("query_id", "item", F.col("rank"), F.round("similarity", 6).alias("similarity"))


@query("l15_outcome_targets_and_masks", """select query_id, reference_id, same_l3::int::float y_same_l3, same_l4::int::float y_same_l4, coalesce(same_exact, false)::int::float y_same_exact, 1::float mask_same_l3, (same_exact is not null)::int::float mask_same_exact from v_scored""")
def _l15(t):
    o = ft.outcome_targets(t.scored, ["same_l3", "same_l4", "same_exact"], ["same_exact"])
    return o.select("query_id", "reference_id", "y_same_l3", "y_same_l4", "y_same_exact", "mask_same_l3", "mask_same_exact")


M17_SQL = {"v_sig": """select q.component_id item, q.released >= timestamp '1998-01-01' later, r.l4, r.exact, r.l3 from v_hits h join v_queries q using (query_id) join v_refs r using (reference_id) where flag = 'R'"""}


@query("m17_temporal_task_labels", """with o as (select item, later, count(distinct l3) n3, count(distinct l4) n4, count(distinct exact) nx from v_sig group by 1, 2), s as (select distinct item, later, l4, coalesce(exact, '') x from v_sig), g as (select distinct l4, x from s where not later),
      nv as (select item, max((l4, x) not in (select (l4, x) from g))::int novel_signature, max((not exists (select 1 from s p where p.item = s.item and not p.later and p.l4 = s.l4 and p.x = s.x))::int) new_for_item from (select * from s where later) s group by 1)
    select b.item, coalesce(a.n4, 0) before_l4, b.n4 after_l4, b.nx after_exact, (case when b.nx > 0 then 3 when b.n4 > 0 then 2 else 1 end)::int after_resolution, (a.item is null)::int new_item, nv.novel_signature, nv.new_for_item
    from (select * from o where later) b left join (select * from o where not later) a using (item) join nv on nv.item = b.item""".replace("max((l4, x) not in (select (l4, x) from g))::int", "max((not exists (select 1 from g where g.l4 = s.l4 and g.x = s.x))::int)"), M17_SQL)
def _m17(t):
    from labeltrail.operators.temporal import task_labels

    q = t.queries.select("query_id", F.col("component_id").alias("item"), (F.col("released") >= F.lit("1998-01-01").cast("timestamp")).alias("later"))
    a = t.hits.where(F.col("flag") == "R").select("query_id", "reference_id").join(q, "query_id").join(t.refs.select("reference_id", "l3", "l4", "exact"), "reference_id")
    return task_labels(a.where(~F.col("later")), a.where("later"))
