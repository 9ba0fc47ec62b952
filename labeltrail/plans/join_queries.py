"""Joins and release maps (J rows), components (G rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labeltrail.functions import labels as lb
from labeltrail.functions import measures as ms
from labeltrail.functions.hashing import bucket
from labeltrail.functions.states import concordance_depth
from labeltrail.operators import candidates as cd
from labeltrail.operators import components, joins, metrics
from labeltrail.operators.ranking import ranked, top_k, top_one
from labeltrail.plans.metric_queries import CEIL_SQL, TOP_SQL, tops
from labeltrail.plans.ranking_queries import CLUSTER_SQL
from labeltrail.plans.registry import query
from labeltrail.plans.sampling_queries import HARD_SQL, balanced
from labeltrail.plans.selection_queries import H60, METHOD_SQL, method_tops
from labeltrail.plans.trace_queries import FUSED_SQL, fused, fused_scored


@query("j01_many_to_one_left_join", "select p.query_id, p.reference_id, r.family from v_pairs p left join (select reference_id, family from v_refs where cluster_id > 10) r using (reference_id)")
def _j01(t):
    right = t.refs.where(F.col("cluster_id") > 10).select("reference_id", "family")
    return joins.many_to_one(t.pairs.select("query_id", "reference_id"), right, ["reference_id"])


@query("j02_one_to_one_join", "select q.query_id, q.total, n.n from v_queries q join (select query_id, count(*) n from v_pairs group by 1) n using (query_id)")
def _j02(t):
    return joins.one_to_one(t.queries.select("query_id", "total"), t.pairs.groupBy("query_id").agg(F.count("*").alias("n")), ["query_id"])


@query("j03_candidate_binding", """select binding, count(*) candidates from (select case when r.reference_id is null then 'UNBOUND' when p.l3 is not distinct from r.l3 and p.exact is not distinct from r.exact then 'BOUND_AGREES' else 'BOUND_DISAGREES' end binding
    from (select s.*, case when disc > 0.08 then 'OTHER' else s.l3 end l3b from v_scored s) p0 join (select query_id, reference_id, case when disc > 0.08 then 'OTHER' else l3 end l3, exact from v_scored) p using (query_id, reference_id)
    left join (select * from v_refs where cluster_id > 5) r on r.reference_id = p.reference_id) group by 1""")
def _j03(t):
    c = t.scored.select("query_id", "reference_id", F.when(F.col("disc") > 0.08, "OTHER").otherwise(F.col("l3")).alias("l3"), "exact")
    b = joins.bind_candidates(c, t.refs.where(F.col("cluster_id") > 5), ["reference_id"], ["l3", "exact"])
    return b.groupBy("binding").agg(F.count("*").alias("candidates"))


@query("j04_modality_full_outer_union", "select query_id, reference_id, sequence_rank, structure_rank, sequence_score, structure_score, source_class from v_fused", FUSED_SQL)
def _j04(t):
    return fused(t).select("query_id", "reference_id", "sequence_rank", "structure_rank", "sequence_score", "structure_score", "source_class")


@query("j05_union_by_aggregation", """select query_id, reference_id, r.family, s.rk sequence_rank, s.price sequence_best, t.rk structure_rank, t.qty structure_best from v_seq s full join v_str t using (query_id, reference_id) join v_refs r using (reference_id)""", FUSED_SQL)
def _j05(t):
    fam = t.refs.select("reference_id", "family")
    a = cd.modality_ranks(t.pairs.where(F.col("disc") <= 0.08), "price", 4).join(fam, "reference_id").select(
        "query_id", "reference_id", "family", F.col("rank").alias("sequence_rank"), F.col("price").alias("sequence_best"))
    b = cd.modality_ranks(t.pairs.where(F.col("tax") <= 0.06), "qty", 4).join(fam, "reference_id").select(
        "query_id", "reference_id", "family", F.col("rank").alias("structure_rank"), F.col("qty").alias("structure_best"))
    return cd.union_by_aggregation([a, b], ["family"], ["sequence_rank", "structure_rank"], ["sequence_best", "structure_best"])


EXP_SQL = {"v_act": """select p_partkey reference_id, unnest(case when p_size % 7 = 0 then [] when p_size % 2 = 0 then [1, 2] else [1] end::integer[]) activity from part"""}


def activities(t):
    n = F.when(F.col("p_size") % 7 == 0, F.array().cast("array<int>")).when(F.col("p_size") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return t.raw("part").select(F.col("p_partkey").alias("reference_id"), F.explode(n).alias("activity"))


@query("j06_activity_expansion", "select f.query_id, f.reference_id, a.activity from v_fused f join v_act a using (reference_id)", {**FUSED_SQL, **EXP_SQL})
def _j06(t):
    return cd.expand_activities(fused(t).select("query_id", "reference_id"), activities(t))[0]


@query("j06b_expansion_status", """select status, count(*) queries, sum(candidates)::bigint candidates, sum(n)::bigint activity_rows from (select f.query_id, count(distinct f.reference_id) candidates, count(a.activity) n, case when count(a.activity) = 0 then 'NO_ACTIVITY' else 'EXPANDED' end status
    from v_fused f left join v_act a using (reference_id) group by 1) group by 1""", {**FUSED_SQL, **EXP_SQL})
def _j06b(t):
    s = cd.expand_activities(fused(t).select("query_id", "reference_id"), activities(t))[1]
    return s.groupBy("status").agg(F.count("*").alias("queries"), F.sum("candidates").alias("candidates"), F.sum("activity_rows").alias("activity_rows"))


@query("j07_train_label_library", """select r.l4 label, count(*) references_, count(distinct r.cluster_id) clusters from v_refs r where exact is not null and exists (select 1 from v_pairs p join v_queries q using (query_id) where p.reference_id = r.reference_id and q."role" = 'TRAIN') group by 1""")
def _j07(t):
    used = t.pairs.join(t.queries.where(F.col("role") == "TRAIN").select("query_id"), "query_id", "left_semi").select("reference_id").distinct()
    lib = t.refs.where(F.col("exact").isNotNull()).join(used, "reference_id", "left_semi")
    return lib.groupBy(F.col("l4").alias("label")).agg(F.count("*").alias("references_"), F.count_distinct("cluster_id").alias("clusters"))


@query("j08_semi_join_by_keys", "select query_id, reference_id from v_pairs where reference_id in (select reference_id from v_refs where family = 'Brand#12')")
def _j08(t):
    keys = t.refs.where(F.col("family") == "Brand#12").select("reference_id")
    return t.pairs.select("query_id", "reference_id").join(keys, "reference_id", "left_semi").select("query_id", "reference_id")


@query("j09_shard_reconciliation", """with p as (select query_id, reference_id, query_id % 8 s from v_pairs where disc <= 0.08), r as (select query_id, reference_id, (query_id + (tax >= 0.08)::int) % 8 s from v_pairs where disc >= 0.01)
    select problem, count(*) pairs from (select case when r.query_id is null then 'MISSING' when p.query_id is null then 'UNEXPECTED' when p.s <> r.s then 'WRONG_SHARD' end problem from p full join r on p.query_id = r.query_id and p.reference_id = r.reference_id) where problem is not null group by 1""")
def _j09(t):
    s = F.col("query_id") % 8
    p = t.pairs.where(F.col("disc") <= 0.08).select("query_id", "reference_id", s.alias("shard"))
    r = t.pairs.where(F.col("disc") >= 0.01).select("query_id", "reference_id", ((F.col("query_id") + (F.col("tax") >= 0.08).cast("int")) % 8).alias("shard"))
    return joins.reconcile(p, r, ["query_id", "reference_id"], "shard").groupBy("problem").agg(F.count("*").alias("pairs"))


@query("j10_truth_outcome_join", """select query_id, reference_id, same_l3::int same_l3, same_l4::int same_l4, same_exact::int same_exact, case when same_l4 then 4 when same_l3 then 3 else 0 end deepest from v_scored""")
def _j10(t):
    d = F.when(F.col("same_l4"), 4).when(F.col("same_l3"), 3).otherwise(0)
    i = lambda x: F.col(x).cast("int").alias(x)
    return t.scored.select("query_id", "reference_id", i("same_l3"), i("same_l4"), i("same_exact"), d.alias("deepest"))


@query("j11_pair_enrichment", """select p.query_id, p.reference_id, q.stratum, q."role", r.family, (c.c_mktsegment < 'H' and r.l3 < 'L')::int same_group, case when s.same_exact then 3 when s.same_l4 then 2 when s.same_l3 then 1 else 0 end depth, (q.component_id % 50 <> r.cluster_id)::int different_cluster
    from v_pairs p join v_queries q using (query_id) join v_refs r using (reference_id) join customer c on c.c_custkey = q.component_id join v_scored s using (query_id, reference_id)""")
def _j11(t):
    q = t.queries.select("query_id", F.col("component_id").alias("query_cluster")).join(
        t.raw("customer").select(F.col("c_custkey").alias("query_cluster"), F.col("c_mktsegment").alias("segment")), "query_cluster")
    s = t.scored.join(q, "query_id")
    return s.select("query_id", "reference_id", "stratum", "role", "family", ((F.col("segment") < "H") & (F.col("l3") < "L")).cast("int").alias("same_group"),
                    concordance_depth("same_l3", "same_l4", "same_exact").alias("depth"), (F.col("query_cluster") % 50 != F.col("cluster_id")).cast("int").alias("different_cluster"))


@query("j12_nearest_hit_per_query", """with h as (select query_id, reference_id, ident, (ident > 0.30 and 1 - 5*disc >= 0.70 and 1 - 5*tax >= 0.70) strict, disc, tax, case when cluster_id % 4 = 0 then 'TOOL' else 'FROZEN' end src from v_scored)
    select q.query_id, n.reference_id nearest_id, n.ident nearest_identity, coalesce(x.t, 0) excluded_tool, coalesce(x.f, 0) excluded_frozen from v_queries q left join (select * from (select *, row_number() over (partition by query_id order by strict desc, ident desc, disc, tax, reference_id) rn from h where src = 'FROZEN') where rn = 1) n using (query_id)
    left join (select query_id, max((strict and src = 'TOOL')::int) t, max((strict and src = 'FROZEN')::int) f from h group by 1) x using (query_id)""")
def _j12(t):
    strict = (F.col("ident") > 0.30) & (1 - 5 * F.col("disc") >= 0.70) & (1 - 5 * F.col("tax") >= 0.70)
    h = t.scored.select("query_id", "reference_id", "ident", "disc", "tax", strict.cast("int").alias("strict"), F.when(F.col("cluster_id") % 4 == 0, "TOOL").otherwise("FROZEN").alias("src"))
    near = top_one(h.where(F.col("src") == "FROZEN"), ["query_id"], [("strict", "desc"), ("ident", "desc"), ("disc", "asc"), ("tax", "asc"), ("reference_id", "asc")])
    flags = h.groupBy("query_id").agg(*[F.max(((F.col("strict") == 1) & (F.col("src") == s)).cast("int")).alias(n) for s, n in (("TOOL", "excluded_tool"), ("FROZEN", "excluded_frozen"))])
    out = t.queries.select("query_id").join(near.select("query_id", F.col("reference_id").alias("nearest_id"), F.col("ident").alias("nearest_identity")), "query_id", "left")
    return out.join(flags, "query_id", "left").fillna(0, ["excluded_tool", "excluded_frozen"])


@query("j14_pair_union_with_origin", """with a as (select query_id, reference_id, same_l3 from v_scored where disc <= 0.06), b as (select query_id, reference_id, case when tax >= 0.08 then not same_l3 else same_l3 end same_l3 from v_scored where tax >= 0.02)
    select query_id, reference_id, case when a.same_l3 is not null and b.same_l3 is not null then 'BOTH' when a.same_l3 is not null then 'RETRIEVAL' else 'AUGMENTATION' end origin, coalesce(a.same_l3, b.same_l3)::int same_l3, (a.same_l3 is null or b.same_l3 is null or a.same_l3 = b.same_l3)::int payload_agrees from a full join b using (query_id, reference_id)""")
def _j14(t):
    a = t.scored.where(F.col("disc") <= 0.06).select("query_id", "reference_id", "same_l3")
    b = t.scored.where(F.col("tax") >= 0.02).select("query_id", "reference_id", F.when(F.col("tax") >= 0.08, ~F.col("same_l3")).otherwise(F.col("same_l3")).alias("same_l3"))
    return joins.union_with_origin(a, b, ["query_id", "reference_id"], ["same_l3"]).withColumn("same_l3", F.col("same_l3").cast("int"))


@query("j15_alias_resolution", """with al as (select p_name alias, p_size node_id from part union select 'P'||p_partkey, p_size from part), n as (select p_name name, p_name a from part union select 'x'||p_partkey, case when p_partkey % 3 = 0 then 'P'||p_partkey else 'none' end from part)
    select name, case when count(distinct node_id) = 1 then min(node_id) end node_id, case when count(node_id) = 0 then 'UNKNOWN' when count(distinct node_id) = 1 then 'RESOLVED' else 'AMBIGUOUS' end status from n left join al on al.alias = n.a group by 1""")
def _j15(t):
    p = t.raw("part")
    al = p.select(F.col("p_name").alias("alias"), F.col("p_size").alias("node_id")).unionByName(
        p.select(F.concat(F.lit("P"), "p_partkey").alias("alias"), F.col("p_size").alias("node_id")))
    k = F.col("p_partkey")
    names = p.select(F.col("p_name").alias("name"), F.col("p_name").alias("a1"), F.col("p_name").alias("a2")).distinct().unionByName(
        p.select(F.concat(F.lit("x"), k).alias("name"), F.when(k % 3 == 0, F.concat(F.lit("P"), k)).otherwise("none").alias("a1"), F.lit("none").alias("a2")))
    return joins.resolve_aliases(al, names, ["a1", "a2"])


@query("j16_group_representative", """select cluster_id, reference_id, case when reference_id is null then 'UNAVAILABLE' else 'SELECTED' end status from (select distinct cluster_id from v_refs) left join (select cluster_id, reference_id from (select *, row_number() over (partition by cluster_id order by ref_price desc, reference_id) rn from v_refs where ref_price > 1000) where rn = 1) using (cluster_id)""")
def _j16(t):
    m = t.refs.where(F.col("ref_price") > 1000).select("cluster_id", "ref_price", "reference_id")
    return joins.group_representative(t.refs, m, "cluster_id", [("ref_price", "desc"), ("reference_id", "asc")]).select("cluster_id", "reference_id", "status")


REL_SQL = {"v_src": "select p_partkey entity_id, p_brand||'|'||(p_partkey // 3) ha, p_brand||'|'||(p_partkey // 3)||'|'||(p_size % 2) hd from part where p_partkey % 5 <> 0",
    "v_tgt": "select case when p_partkey % 7 = 0 then p_partkey + 1000000 else p_partkey end entity_id, case when p_partkey % 11 = 0 then 'revised' else p_brand end||'|'||(p_partkey // 3) ha, p_brand||'|'||(p_partkey // 3)||'|'||(case when p_partkey % 13 = 0 then 1 - p_size % 2 else p_size % 2 end) hd from part where p_partkey % 4 <> 0",
    "v_rel": """select s.entity_id source_id, t.entity_id target_id, case when s.ha <> t.ha then 'stable_id_chemistry_revision' when s.hd <> t.hd then 'direction_change' else 'stable_id_stable_chemistry' end relation from v_src s join v_tgt t using (entity_id)
      union all select s.entity_id, t.entity_id, case when nt > 1 then 'split' when ns > 1 then 'merge' else 'chemistry_equivalent_id_change' end from v_src s join (select ha, count(*) ns from v_src group by 1) a using (ha) join (select ha, count(*) nt from v_tgt group by 1) b using (ha) join v_tgt t on t.ha = s.ha where s.entity_id not in (select entity_id from v_tgt)
      union all select entity_id, null, 'obsolete_without_exact_replacement' from v_src where entity_id not in (select entity_id from v_tgt) and ha not in (select ha from v_tgt)""",
    "v_rel2": "select * from v_rel union all select null, t.entity_id, case when coalesce(ns, 0) = 0 then 'genuinely_novel_chemistry' when ns > 1 then 'merge' else 'chemistry_equivalent_id_change' end from v_tgt t left join (select ha, count(*) ns from v_src group by 1) a using (ha) where t.entity_id not in (select target_id from v_rel where target_id is not null)"}


def releases(t):
    p, k = t.raw("part"), F.col("p_partkey")
    third = F.floor(k / 3)
    src = p.where(k % 5 != 0).select(k.alias("entity_id"), F.concat_ws("|", "p_brand", third).alias("hash_any"), F.concat_ws("|", "p_brand", third, F.col("p_size") % 2).alias("hash_directed"))
    name = F.when(k % 11 == 0, "revised").otherwise(F.col("p_brand"))
    side = F.when(k % 13 == 0, 1 - F.col("p_size") % 2).otherwise(F.col("p_size") % 2)
    tgt = p.where(k % 4 != 0).select(F.when(k % 7 == 0, k + 1000000).otherwise(k).alias("entity_id"), F.concat_ws("|", name, third).alias("hash_any"), F.concat_ws("|", "p_brand", third, side).alias("hash_directed"))
    return src, tgt


@query("j17_cross_release_map", "select * from v_rel2", REL_SQL)
def _j17(t):
    return joins.release_map(*releases(t))


@query("j31_release_id_resolution", """select source_id, case when n = 1 and not bad then lo end target_id, case when n = 1 and not bad then rel else 'UNRESOLVED:'||rel end status from (select source_id, count(distinct target_id) n, min(target_id) lo, bool_or(relation not in ('stable_id_stable_chemistry','direction_change','merge','chemistry_equivalent_id_change')) bad, array_to_string(list_sort(list(distinct relation)), '+') rel from v_rel2 where source_id is not null group by 1)""", REL_SQL)
def _j31(t):
    cross = joins.release_map(*releases(t)).where(F.col("source_id").isNotNull())
    return joins.release_lookup(cross, [joins.STABLE, joins.TURNED, joins.MERGED, joins.RENAMED])


@query("j18_release_membership", """with c as (select distinct o_custkey k from orders), h as (select o_custkey k, max(case when o_orderdate < timestamp '1996-01-01' then o_orderpriority end) a, max(case when o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '2000-01-01' then o_orderpriority end) b from orders group by 1)
    select k component_id, case when a is not null and b is not null and a = b then 'T0_T1_STABLE' when a is not null and b is not null then 'T0_T1_CHANGED' when b is not null then 'NEW_IN_T1' when a is not null then 'ABSENT_IN_T1' else 'NEW_AFTER_T1' end membership from c join h using (k)""")
def _j18(t):
    ts = lambda s: F.lit(s).cast("timestamp")
    r = F.col("released")
    q = t.queries
    t0 = q.where(r < ts("1996-01-01")).groupBy("component_id").agg(F.max("priority").alias("content"))
    t1 = q.where((r >= ts("1996-01-01")) & (r < ts("2000-01-01"))).groupBy("component_id").agg(F.max("priority").alias("content"))
    return joins.release_membership(q.select("component_id").distinct(), t0, t1, "component_id", "content")


@query("j21_breakpoint_interpolation", """select query_id, reference_id, round(case when raw <= 0.05 then 0.02 when raw <= 0.15 then 0.02 + (raw-0.05)*0.8 when raw <= 0.3 then 0.1 + (raw-0.15)*2.0 when raw <= 0.5 then 0.4 + (raw-0.3)*2.5 else 0.9 end, 10)::double cal from v_scored""")
def _j21(t):
    x = lb.interpolate("raw", [0.05, 0.15, 0.3, 0.5], [0.02, 0.1, 0.4, 0.9])
    return t.scored.select("query_id", "reference_id", F.round(x, 10).alias("cal"))


@query("j23_dimension_lookup", "select c_custkey, n_name, r_name from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey")
def _j23(t):
    n = t.raw("nation").join(t.raw("region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return t.raw("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("j24_parallel_table_binding", """select count(*) bound, count(*) filter (where abs(a.w - b.w) < 1e-9) equal_weight, (select count(*) from v_scored) - count(*) unbound from (select query_id, reference_id, qty w from v_pairs) a join (select query_id, reference_id, weight w from v_scored) b using (query_id, reference_id)""")
def _j24(t):
    from labeltrail.operators.ranking import attach_one_row

    j = joins.one_to_one(t.pairs.select("query_id", "reference_id", F.col("qty").alias("a")), t.scored.select("query_id", "reference_id", F.col("weight").alias("b")), ["query_id", "reference_id"])
    j = j.agg(F.count("*").alias("bound"), ms.n_if(F.abs(F.col("a") - F.col("b")) < 1e-9).alias("equal_weight"))
    return attach_one_row(j, t.scored.agg(F.count("*").alias("_n"))).select("bound", "equal_weight", (F.col("_n") - F.col("bound")).alias("unbound"))


@query("j25_direct_pair_plan", f"""select query_id, reference_id, count(*) activity_rows, any_value(a.k) first_query_key, any_value(b.k) first_reference_key, case when any_value(c.k) is not null and any_value(d.k) is not null then 'BOTH_AVAILABLE' when any_value(c.k) is not null then 'REFERENCE_UNAVAILABLE' when any_value(d.k) is not null then 'QUERY_UNAVAILABLE' else 'BOTH_UNAVAILABLE' end second_state,
    ({H60.format("'first|'||query_id||'|'||reference_id")} % 16)::int shard from v_hits h left join (select p_partkey id, p_partkey*2 k from part) a on a.id = h.query_id left join (select p_partkey id, p_partkey*2 k from part) b on b.id = h.reference_id
    left join (select p_partkey id, p_size k from part where p_size > 20) c on c.id = h.query_id left join (select p_partkey id, p_size k from part where p_size > 20) d on d.id = h.reference_id group by 1, 2""")
def _j25(t):
    p = t.raw("part")
    first = p.select(F.col("p_partkey").alias("node_id"), (F.col("p_partkey") * 2).alias("db_key"))
    second = p.where(F.col("p_size") > 20).select(F.col("p_partkey").alias("node_id"), F.col("p_size").alias("db_key"))
    return joins.direct_pair_plan(t.hits, first, second, 16).select("query_id", "reference_id", "activity_rows", "first_query_key", "first_reference_key", "second_state", "shard")


@query("j26_external_truth_attach", "select query_id, \"method\", label, correct::int correct, (component_id % 7 <> 0)::int eligible, (correct and component_id % 7 <> 0)::int eligible_correct from v_mtop", METHOD_SQL)
def _j26(t):
    e = F.col("component_id") % 7 != 0
    i = lambda c: c.cast("int")
    return method_tops(t).select("query_id", "method", "label", i(F.col("correct")).alias("correct"), i(e).alias("eligible"), i(F.col("correct") & e).alias("eligible_correct"))


@query("j28_covariate_remap", "select q.query_id, c.c_mktsegment segment, c.c_acctbal balance, n.n_regionkey region from v_queries q left join customer c on c.c_custkey = q.component_id left join nation n on n.n_nationkey = c.c_nationkey")
def _j28(t):
    c = t.raw("customer").select(F.col("c_custkey").alias("component_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("n_nationkey"))
    q = joins.many_to_one(t.queries.select("query_id", "component_id"), c, ["component_id"])
    return joins.many_to_one(q, t.raw("nation").select("n_nationkey", F.col("n_regionkey").alias("region")), ["n_nationkey"]).select("query_id", "segment", "balance", "region")


ALIGN_SQL = {"v_ali": """select p_partkey pair_id, p_size query_start, p_partkey % 5 + 1 reference_start, case when p_partkey % 17 = 0 then '' else translate(p_name, 'aei', '---') end qa, translate(p_name, 'rst', '---') ra from part""",
    "v_pos": """select pair_id, reference_start - 1 + length(replace(substr(ra, 1, i), '-', '')) "position", query_start - 1 + length(replace(substr(qa, 1, i), '-', '')) q, substr(qa, i, 1) qs, substr(ra, i, 1) rs from (select *, unnest(range(1, length(ra)+1)) i from v_ali where length(qa) > 0) where substr(ra, i, 1) <> '-'""",
    "v_map": """select s.pair_id, s."position", case when p.qs <> '-' then p.q end query_position, case when p.qs <> '-' then p.qs end query_symbol, p.rs reference_symbol, case when length(a.qa) = 0 then 'NO_VALID_BACKTRACE' when p.qs is null then 'REFERENCE_SITE_OUTSIDE_ALIGNMENT' when p.qs = '-' then 'REFERENCE_SITE_ALIGNS_TO_QUERY_GAP' else 'PASS' end status
      from (select p_partkey pair_id, unnest([2, 5, 9])::bigint "position" from part) s join v_ali a using (pair_id) left join v_pos p on p.pair_id = s.pair_id and p."position" = s."position" """}


def site_map(t):
    p, k = t.raw("part"), F.col("p_partkey")
    a = p.select(k.alias("pair_id"), F.col("p_size").alias("query_start"), (k % 5 + 1).alias("reference_start"),
                 F.when(k % 17 == 0, "").otherwise(F.translate("p_name", "aei", "---")).alias("query_alignment"), F.translate("p_name", "rst", "---").alias("reference_alignment"))
    sites = p.select(k.alias("pair_id"), F.explode(F.array(*[F.lit(x).cast("bigint") for x in (2, 5, 9)])).alias("position"))
    return joins.position_map(a, sites)


@query("j29_aligned_position_map", "select * from v_map", ALIGN_SQL)
def _j29(t):
    return site_map(t)


@query("e26_alignment_status", "select status, count(*) sites from v_map group by 1", ALIGN_SQL)
def _e26(t):
    return site_map(t).groupBy("status").agg(F.count("*").alias("sites"))


@query("l16_mapped_site_pair_means", "select pair_id, count(*) sites, count(*) filter (where status = 'PASS') mapped, round(avg((query_symbol = reference_symbol)::int) filter (where status = 'PASS'), 9) identity, round(avg(query_position - \"position\") filter (where status = 'PASS'), 9) mean_shift from v_map group by 1", ALIGN_SQL)
def _l16(t):
    from labeltrail.operators.features import site_pair_means

    return site_pair_means(site_map(t))


@query("l17_site_status_shares", """select band, status, count(*) sites, round(count(*)::double/sum(count(*)) over (partition by band), 9) share, round(avg(query_position), 9) mean_position from (select *, (pair_id % 4)::int band from v_map) group by 1, 2""", ALIGN_SQL)
def _l17(t):
    from labeltrail.operators.features import status_shares

    return status_shares(site_map(t).withColumn("band", (F.col("pair_id") % 4).cast("int")), ["band"])


@query("j30_library_miss_decomposition", """select endpoint, reason, count(*) queries from (select q.query_id, e.endpoint, case when v.reference_id is null then 'NO_HIT' when r.reference_id is null then 'NO_REFERENCE_ACTIVITY' when (case e.endpoint when 'L4' then r.l4 else r.exact end) is null then 'NO_LEVEL_ANNOTATION' else 'EMITTED' end reason
    from v_queries q cross join (select unnest(['L4','EXACT']) endpoint) e left join v_top v using (query_id) left join (select * from v_refs where cluster_id > 8) r on r.reference_id = v.reference_id) group by 1, 2""", TOP_SQL)
def _j30(t):
    m = joins.library_miss(t.queries, tops(t), t.refs.where(F.col("cluster_id") > 8), {"L4": "l4", "EXACT": "exact"})
    return m.groupBy("endpoint", "reason").agg(F.count("*").alias("queries"))


@query("j32_query_domains_seen_in_fit", """with d as (select distinct query_id, r.family dom from v_pairs p join v_refs r using (reference_id) where tax <= 0.03), g as (select query_id, array_to_string(list_sort(list(dom)), ';') doms, count(*) n, min(dom) p from d group by 1)
    select q.query_id, coalesce(doms, '') domains, coalesce(n, 0) domain_count, coalesce(p, '__MISSING__') primary_domain, case when p is null then '__MISSING__' else coalesce((select min(l3) from v_refs f where f.family = g.p and f.l3 < 'M'), 'UNASSIGNED') end clan, coalesce(p in (select r.family from v_pairs x join v_refs r using (reference_id) where x.disc >= 0.1 and r.cluster_id > 40), false)::int seen_in_fit
    from v_queries q left join g using (query_id)""")
def _j32(t):
    calls = t.pairs.where(F.col("tax") <= 0.03).join(t.refs.select("reference_id", F.col("family").alias("domain")), "reference_id")
    clans = t.refs.where(F.col("l3") < "M").groupBy(F.col("family").alias("domain")).agg(F.min("l3").alias("clan"))
    seen = t.pairs.where(F.col("disc") >= 0.1).join(t.refs.where(F.col("cluster_id") > 40).select("reference_id", F.col("family").alias("domain")), "reference_id").select("domain")
    return joins.domains_per_query(t.queries, calls, clans, seen)


@query("j33_frozen_predictions_two_cohorts", """with c as (select *, unnest(case when fused_rank <= 2 then ['full','sampled'] else ['full'] end) cohort from v_fused_scored), o as (select cohort, query_id, bool_or(same_l4) av, count(*) n from c group by 1, 2),
    w as (select * from (select *, row_number() over (partition by cohort, query_id order by cal desc, reference_id) rn from c) where rn = 1)
    select cohort, count(*) queries, sum(av::int)::bigint candidate_available, sum(w.same_l4::int)::bigint top1_correct, sum(n)::bigint candidate_rows from w join o using (cohort, query_id) group by 1""", FUSED_SQL)
def _j33(t):
    c = metrics.tagged(fused_scored(t), {"full": F.lit(True), "sampled": F.col("fused_rank") <= 2}, "cohort")
    o = c.groupBy("cohort", "query_id").agg(F.max("same_l4").alias("av"), F.count("*").alias("n"))
    w = top_one(c, ["cohort", "query_id"], [("cal", "desc"), ("reference_id", "asc")]).select("cohort", "query_id", "same_l4")
    return w.join(o, ["cohort", "query_id"]).groupBy("cohort").agg(
        F.count("*").alias("queries"), ms.n_if("av").alias("candidate_available"), ms.n_if("same_l4").alias("top1_correct"), F.sum("n").alias("candidate_rows"))


XROLE = """select query_node, target_node, a."role" query_role, b."role" target_role from (select query_id query_node, reference_id target_node, qty/50 fident, 1 - 5*disc qcov, 1 - 5*tax tcov from v_pairs) h join v_queries a on a.query_id = query_node join v_queries b on b.query_id = target_node
    where fident > {identity} and qcov >= {coverage} and tcov >= {coverage} and a."role" <> b."role" """
EDGE_SQL = {"v_xrole": XROLE.format(identity=0.9, coverage=0.9),
    "v_cedge": """select distinct a.component_id a, b.component_id b from v_xrole join v_queries a on a.query_id = query_node join v_queries b on b.query_id = target_node"""}


def cross_edges(t, identity, coverage):
    h = t.pairs.select(F.col("query_id").alias("query_node"), F.col("reference_id").alias("target_node"), (F.col("qty") / 50).alias("fident"), (1 - 5 * F.col("disc")).alias("qcov"), (1 - 5 * F.col("tax")).alias("tcov"))
    return components.cross_role_edges(h, t.queries.select(F.col("query_id").alias("node_id"), "role"), identity, coverage)


@query("g01_component_closure", """with recursive sym as (select a x, b y from v_cedge union select b, a from v_cedge), reach as (select x node, x seen from sym union select r.node, s.y from reach r join sym s on s.x = r.seen)
    select *, count(*) over (partition by merged_id) merged_size from (select q.query_id node_id, q.component_id, coalesce(c.m, q.component_id) merged_id from v_queries q left join (select node, min(seen) m from reach group by 1) c on c.node = q.component_id)""", EDGE_SQL)
def _g01(t):
    nodes = t.queries.select(F.col("query_id").alias("node_id"), "component_id", "role")
    edges = cross_edges(t, 0.9, 0.9).select(F.col("query_node").alias("node_a"), F.col("target_node").alias("node_b"))
    return components.merge_components(nodes, edges)


@query("g02_cross_role_edges", XROLE.format(identity=0.3, coverage=0.7))
def _g02(t):
    return cross_edges(t, 0.3, 0.7).select("query_node", "target_node", "query_role", "target_role")
