"""Validation reports (V rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labeltrail.functions import states as st
from labeltrail.operators import checks
from labeltrail.operators.ranking import attach_one_row, ranked
from labeltrail.plans.metric_queries import BENCH
from labeltrail.plans.registry import query
from labeltrail.plans.ranking_queries import CLUSTER_SQL, retained
from labeltrail.plans.sampling_queries import ROLE_SQL


@query("v01_required_columns", "select count(*) rows, count(distinct query_id) queries from v_pairs")
def _v01(t):
    p = checks.require_columns(t.pairs, ["query_id", "reference_id", "price", "qty"], "pairs")
    return p.agg(F.count("*").alias("rows"), F.count_distinct("query_id").alias("queries"))


@query("v02_reject_outcome_columns", "select count(*) rows, round(avg(raw), 9) mean_raw from v_scored")
def _v02(t):
    features = t.scored.drop("same_l3", "same_l4", "same_exact")
    f = checks.reject_columns(features, ["truth_labels", "hit"], ["same_", "correct"], "features")
    return f.agg(F.count("*").alias("rows"), F.round(F.avg("raw"), 9).alias("mean_raw"))


@query("v03_unique_grain", "select l_orderkey, l_linenumber, count(*) \"rows\" from lineitem group by 1, 2 having count(*) > 1")
def _v03(t):
    return checks.duplicate_keys(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query("v04_key_inventory", """select k.c component_id, (a.c is not null)::int in_customer, (b.c is not null)::int in_orders, (e.c is not null)::int in_events from (select c_custkey c from customer union select o_custkey from orders union select user_id from events) k
    left join (select distinct c_custkey c from customer) a using (c) left join (select distinct o_custkey c from orders) b using (c) left join (select distinct user_id c from events) e using (c) where a.c is null or b.c is null or e.c is null""")
def _v04(t):
    k = lambda table, col: t.raw(table).select(F.col(col).alias("component_id"))
    return checks.key_inventory({"customer": k("customer", "c_custkey"), "orders": k("orders", "o_custkey"), "events": k("events", "user_id")}, ["component_id"])


@query("v05_value_ranges", """select "column", count(*) filter (where x is null) nulls, 0::bigint not_finite, count(*) filter (where x < 0 or x > 1) outside from (select unnest(['disc','tax','ident','raw']) "column", unnest([disc, tax, ident, raw*3]) x from v_scored) group by 1""")
def _v05(t):
    return checks.range_report(t.scored.withColumn("raw", F.col("raw") * 3), ["disc", "tax", "ident", "raw"])


ALN_SQL = {"v_aln": """select query_id, reference_id, source_id, line, qty, price, line qstart, (line + qty - 1)::int qend, 55 qlen, 1 tstart, qty::int tend, 50 tlen, round(qty/55, 3) qcov, round(qty/50 * case when line = 7 then 0.9 else 1 end, 3) tcov, 1 - disc fident, (qty + line % 3 - 1)::int alnlen from v_hits"""}


def alignments(t):
    q, line = F.col("qty"), F.col("line")
    return t.hits.select(
        "query_id", "reference_id", line.alias("qstart"), (line + q - 1).cast("int").alias("qend"), F.lit(55).alias("qlen"), F.lit(1).alias("tstart"), q.cast("int").alias("tend"),
        F.lit(50).alias("tlen"), F.round(q / 55, 3).alias("qcov"), F.round(q / 50 * F.when(line == 7, 0.9).otherwise(1.0), 3).alias("tcov"), (1 - F.col("disc")).alias("fident"),
        (q + line % 3 - 1).cast("int").alias("alnlen"))


@query("v06_alignment_rules", """select rule, count(*) violations from (select unnest([x for x in [case when not (fident between 0 and 1) then 'identity_range' end, case when not (qcov between 0 and 1) then 'qcov_range' end, case when not (tcov between 0 and 1) then 'tcov_range' end,
    case when not (qstart >= 1 and qend >= qstart and qend <= qlen) then 'query_coordinates' end, case when not (tstart >= 1 and tend >= tstart and tend <= tlen) then 'target_coordinates' end, case when not (alnlen >= greatest(qend-qstart+1, tend-tstart+1)) then 'alignment_length' end,
    case when not (abs(qcov - (qend-qstart+1)::double/qlen) <= 0.00101) then 'qcov_recomputed' end, case when not (abs(tcov - (tend-tstart+1)::double/tlen) <= 0.00101) then 'tcov_recomputed' end] if x is not null]) rule from v_aln) group by 1""", ALN_SQL)
def _v06(t):
    return checks.violations(alignments(t), checks.alignment_rules(), ["query_id", "reference_id"]).groupBy("rule").agg(F.count("*").alias("violations"))


@query("v07_component_in_one_role", """select 'component_in_several_roles' problem, stratum item from v_queries group by 2 having count(distinct "role") > 1 union all select 'role_without_items', 'HOLDOUT'""")
def _v07(t):
    return checks.roles_per_component(t.queries, "stratum", "role", ["TRAIN", "DEV", "CAL_FIT", "CAL_RULE", "RETEST", "HOLDOUT"])


@query("v08_nested_label_consistency", """select (split_part(l4, '.', 1) = l3)::int nested, (exact is null or starts_with(exact, l4||'.'))::int exact_nested, count(*) refs from v_refs group by 1, 2""")
def _v08(t):
    n = (F.substring_index("l4", ".", 1) == F.col("l3")).cast("int")
    x = (F.col("exact").isNull() | F.startswith(F.col("exact"), F.concat(F.col("l4"), F.lit(".")))).cast("int")
    return t.refs.groupBy(n.alias("nested"), x.alias("exact_nested")).agg(F.count("*").alias("refs"))


@query("v09_unknown_references", "select reference_id, count(*) pairs from v_pairs where reference_id not in (select reference_id from v_refs where exact is not null) group by 1")
def _v09(t):
    known = t.refs.where(F.col("exact").isNotNull()).select("reference_id")
    return t.pairs.join(known, "reference_id", "left_anti").groupBy("reference_id").agg(F.count("*").alias("pairs"))


@query("v10_conservation_census", """select count(*) rows_in, count(*) filter (where disc <= 0.07 and tax <= 0.06) kept, count(*) filter (where disc > 0.07) dropped_discount, count(*) filter (where disc <= 0.07 and tax > 0.06) dropped_tax, 1 balanced from v_hits""")
def _v10(t):
    d, x = F.col("disc") > 0.07, F.col("tax") > 0.06
    return checks.conservation(t.hits, ~d & ~x, {"discount": d, "tax": x})


@query("v11_length_identity_filter", """select count(*) kept from (select l_partkey query_node, l_suppkey reference_node, l_quantity::int qlen, (l_linenumber*7) tlen from lineitem) h
    where exists (select 1 from part where p_partkey = query_node and p_size = qlen) and exists (select 1 from part where p_partkey = reference_node and p_size = tlen)""")
def _v11(t):
    h = t.hits.select(F.col("reference_id").alias("query_node"), F.col("source_id").alias("reference_node"), F.col("qty").cast("int").alias("qlen"), (F.col("line") * 7).alias("tlen"))
    ledger = t.raw("part").select(F.col("p_partkey").alias("node_id"), F.col("p_size").alias("length"))
    return checks.length_identity_filter(h, ledger).agg(F.count("*").alias("kept"))


@query("v12_percent_to_fraction", "select query_id, reference_id, round(case when (select max(qty) from v_pairs) > 1 then qty/100 else qty end, 9) qty, disc from v_pairs")
def _v12(t):
    x = checks.unit_normalised(t.pairs, ["qty", "disc"])
    return x.select("query_id", "reference_id", F.round("qty", 9).alias("qty"), "disc")


@query("v13_numeric_coercion", "select query_id, try_cast(substr(priority, 1, (1 + query_id % 2)::int) as double) v from v_queries")
def _v13(t):
    text = F.substring(F.col("priority"), F.lit(1), (1 + F.col("query_id") % 2).cast("int"))
    return t.queries.select("query_id", text.try_cast("double").alias("v"))


@query("v14_strict_flags", "select case stratum when 'F' then 1 when 'O' then 0 end flag, count(*) queries from v_queries group by 1")
def _v14(t):
    text = F.when(F.col("stratum") == "F", "1").when(F.col("stratum") == "O", "0").otherwise("")
    f = t.queries.select(text.alias("text")).select(st.flag("text", optional=True).cast("int").alias("flag"))
    return f.groupBy("flag").agg(F.count("*").alias("queries"))


@query("v15_self_pair_exclusion", "select count(*) pairs, count(*) filter (where query_id = reference_id) self_pairs from v_pairs")
def _v15(t):
    p = t.pairs.select("query_id", "reference_id")
    rest = p.where(F.col("query_id") != F.col("reference_id")).agg(F.count("*").alias("_rest"))
    return attach_one_row(p.agg(F.count("*").alias("pairs")), rest).select("pairs", (F.col("pairs") - F.col("_rest")).alias("self_pairs"))


@query("v16_strict_similarity_exclusion", "select stratum, count(distinct query_id) filter (where ident > 0.30 and 1 - 5*disc >= 0.70 and 1 - 5*tax >= 0.70) excluded_queries, count(*) filter (where ident > 0.30 and 1 - 5*disc >= 0.70 and 1 - 5*tax >= 0.70) hits from v_scored group by 1")
def _v16(t):
    s = (F.col("ident") > 0.30) & (1 - 5 * F.col("disc") >= 0.70) & (1 - 5 * F.col("tax") >= 0.70)
    return t.scored.groupBy("stratum").agg(F.count_distinct(F.when(s, F.col("query_id"))).alias("excluded_queries"), F.count(F.when(s, 1)).alias("hits"))


@query("v17_prefer_first_measured", "select query_id, reference_id, coalesce(case when disc <= 0.03 then ident end, case when tax <= 0.03 then raw end, 0) metric from v_scored")
def _v17(t):
    m = F.coalesce(F.when(F.col("disc") <= 0.03, F.col("ident")), F.when(F.col("tax") <= 0.03, F.col("raw")), F.lit(0.0))
    return t.scored.select("query_id", "reference_id", m.alias("metric"))


@query("v18_ordered_groups", """with r as (select p.query_id, p.reference_id, p.cluster_id, modality_rank, w.raw from v_ret p join (select query_id, reference_id, row_number() over (partition by query_id order by qty desc, reference_id) raw from v_pairs) w using (query_id, reference_id))
    select query_id, (min(modality_rank) <> 1 or max(modality_rank) <> count(*))::int rank_gap, max(coalesce(raw <= prev, false)::int) raw_rank_order, (count(distinct cluster_id) < count(*))::int repeated_component
    from (select *, lag(raw) over (partition by query_id order by modality_rank) prev from r) group by 1""", CLUSTER_SQL)
def _v18(t):
    raw = ranked(t.pairs.select("query_id", "reference_id", "qty"), ["query_id"], [("qty", "desc"), ("reference_id", "asc")], "raw").drop("qty")
    r = retained(t).select("query_id", "reference_id", "cluster_id", "modality_rank").join(raw, ["query_id", "reference_id"])
    return checks.ranked_group_problems(r, "query_id", "modality_rank", "raw", "cluster_id")


@query("v19_grouped_input", "select event_type, count(*) filter (where prev is distinct from event_type) blocks, count(*) \"rows\" from (select *, lag(event_type) over (order by event_id) prev from events) group by 1")
def _v19(t):
    return checks.block_starts(t.raw("events"), "event_type", [("event_id", "asc")])


@query("v29_query_block_order", "select count(*) filter (where conv_id <> prev) block_changes, count(*) filter (where conv_id < prev) decreasing from (select conv_id, lag(conv_id) over (order by role, conv_id, turn) prev from conversations)")
def _v29(t):
    return checks.block_order_violations(t.raw("conversations"), "conv_id", [("role", "asc"), ("conv_id", "asc"), ("turn", "asc")])


@query("v20_task_audit", """with t as (select o_orderkey task, (o_orderkey % 5)::bigint expected from orders where o_orderstatus <> 'P'), r as (select l_orderkey task, count(*) receipts, max(l_linenumber)::bigint n, bool_or(l_tax >= 0.08) tr from lineitem where l_returnflag = 'R' group by 1)
    select status, count(*) tasks from (select case when t.task is null then 'UNPLANNED' when r.task is null then 'MISSING' when receipts > 1 then 'DUPLICATE' when tr then 'TRUNCATED' when n <> expected then 'INCOMPLETE' else 'COMPLETE' end status from t full join r using (task)) group by 1""")
def _v20(t):
    from labeltrail.operators.joins import audit_tasks

    o = t.raw("orders").where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("task"), (F.col("o_orderkey") % 5).alias("expected_rows"))
    r = t.hits.where(F.col("flag") == "R").select(F.col("query_id").alias("task"), F.col("line").cast("bigint").alias("rows"), (F.col("tax") >= 0.08).alias("truncated"))
    return audit_tasks(o, r, "task").groupBy("status").agg(F.count("*").alias("tasks"))


@query("v21_equal_input_equal_output", "select cal, family, count(distinct l3) outputs from v_scored group by 1, 2 having count(distinct l3) > 1")
def _v21(t):
    return checks.equal_in_equal_out(t.scored, ["family"], "cal", "l3")


@query("v22_monotonicity_violations", """select "role", count(*) filter (where lo < prev) violations from (select "role", raw2, lo, lag(hi) over (partition by "role" order by raw2) prev from (select "role", round(raw, 2) raw2, min(ident) lo, max(ident) hi from v_scored group by 1, 2)) group by 1""")
def _v22(t):
    return checks.monotonicity_violations(t.scored.withColumn("raw2", F.round("raw", 2)), ["role"], "raw2", "ident")


@query("v23_tolerant_comparison", """select query_id, reference_id, 'qty' "column", qty "left", qty + 1 "right" from v_pairs where n_hits > 1""")
def _v23(t):
    b = t.pairs.withColumns({"qty": F.when(F.col("n_hits") > 1, F.col("qty") + 1).otherwise(F.col("qty")), "price": F.col("price") * (1 + 1e-13)})
    return checks.tolerant_difference(t.pairs, b, ["query_id", "reference_id"], ["qty", "price"])


@query("v24_labels_outside_library", "select query_id, count(*) outside from (select distinct query_id, r.l4 from v_pairs p join v_refs r using (reference_id)) where l4 not in (select label from v_library where endpoint = 'L4') group by 1")
def _v24(t):
    lib = t.library.where(F.col("endpoint") == "L4").select(F.col("label").alias("l4"))
    p = t.pairs.join(t.refs.select("reference_id", "l4"), "reference_id").select("query_id", "l4").distinct()
    return p.join(lib, "l4", "left_anti").groupBy("query_id").agg(F.count("*").alias("outside"))


@query("v25_inference_role_guard", """select count(*) pairs, count(*) filter (where not coalesce(q."role" in ('DEV','RETEST'), false)) bad_query, count(*) filter (where not coalesce(r."role" = 'TRAIN', false)) bad_reference
    from v_pairs p left join v_queries q on q.query_id = p.query_id left join v_queries r on r.query_id = p.reference_id""")
def _v25(t):
    return checks.role_guard(t.pairs.select("query_id", "reference_id"), t.queries.select("query_id", "role"), "query_id", ["DEV", "RETEST"], "TRAIN")


@query("v26_curve_ordering_audit", """select design, (p3 >= p4)::int nested, round(p3 - p4, 8) gap from (select design, max(r) filter (where level = 'L3') p3, max(r) filter (where level = 'L4') p4 from (select design, level, round(sum(weight*y::int)/sum(weight), 9) r from v_bench group by 1, 2) group by 1)""", BENCH)
def _v26(t):
    from labeltrail.plans.metric_queries import benchmark_cohorts

    r = benchmark_cohorts(t).groupBy("design", "level").agg(F.round(F.sum(F.col("weight") * F.col("y").cast("int")) / F.sum("weight"), 9).alias("r"))
    w = r.groupBy("design").pivot("level", ["L3", "L4"]).agg(F.max("r"))
    return w.select("design", (F.col("L3") >= F.col("L4")).cast("int").alias("nested"), F.round(F.col("L3") - F.col("L4"), 8).alias("gap"))


@query("v27_exact_member_census", """with n as (select min(doc_id) node, text from documents group by 2), m as (select d.doc_id, case when d.doc_id % 10 = 0 and d.doc_id <> n.node then n.node + 1 else n.node end node, d.text from documents d join n using (text))
    select case when n.node is null then 'MEMBER_WITHOUT_NODE' when m.doc_id is null then 'NODE_WITHOUT_MEMBER' when n.text <> m.text then 'HASH_DIFFERS' else 'EXACT' end status, count(*) "rows", count(distinct coalesce(n.node, m.node)) nodes from n full join m on m.node = n.node group by 1""")
def _v27(t):
    d = t.raw("documents").select("doc_id", "text", F.sha2("text", 256).alias("h"))
    n = d.groupBy("h").agg(F.min("doc_id").alias("node_id"))
    moved = F.when((F.col("doc_id") % 10 == 0) & (F.col("doc_id") != F.col("node_id")), F.col("node_id") + 1).otherwise(F.col("node_id"))
    m = d.join(n, "h").select(moved.alias("node_id"), F.col("doc_id").alias("member_id"), F.col("text").alias("content"))
    return checks.member_census(n.select("node_id", F.col("h").alias("content_hash")), m)


@query("v28_raw_hit_sign_rule", """select modality, field, count(*) "rows", count(*) filter (where v is null) unparseable, count(*) filter (where v < 0 and not (field = 'bits' and modality = 'O')) negative from (select stratum modality, field, try_cast(txt as double) v from (
      select stratum, unnest(['bits','evalue']) field, unnest([(total - 250000)::varchar, case when query_id % 11 = 0 then 'n/a' else (query_id % 7 - 1)::varchar end]) txt from v_queries)) group by 1, 2""")
def _v28(t):
    q = t.queries.select(F.col("stratum").alias("modality"), (F.col("total") - 250000).cast("string").alias("bits"),
                         F.when(F.col("query_id") % 11 == 0, "n/a").otherwise((F.col("query_id") % 7 - 1).cast("string")).alias("evalue"))
    return checks.raw_hit_problems(q, ["bits", "evalue"], ["O"])
