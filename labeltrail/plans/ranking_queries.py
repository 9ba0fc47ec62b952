"""Ranking, retention, fusion (W rows), sorts and set operations (O, U rows), candidate joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from labeltrail.functions import measures as ms
from labeltrail.functions.hashing import key_text, u60
from labeltrail.functions.labels import sorted_json
from labeltrail.operators import candidates as cd
from labeltrail.operators import checks, curves, metrics, separation
from labeltrail.operators.ranking import attach_one_row, exact_quantiles, ranked, top_k, top_one
from labeltrail.plans.metric_queries import VOTE_SQL, agreement
from labeltrail.plans.registry import query
from labeltrail.plans.selection_queries import H60
from labeltrail.plans.trace_queries import FUSED_SQL, fused, fused_scored
from labeltrail.session import cut_lineage

PAIR_RAW = """(select query_id, reference_id, price, qty, cluster_id from v_pairs join v_refs using (reference_id))"""


@query("w01_rank_in_input_order", "select query_id, reference_id, row_number() over (partition by query_id order by reference_id) raw_rank from v_pairs")
def _w01(t):
    return ranked(t.pairs.select("query_id", "reference_id"), ["query_id"], [("reference_id", "asc")], "raw_rank")


CLUSTER_SQL = {"v_ret": f"""select * from (select query_id, reference_id, cluster_id, price, row_number() over (partition by query_id order by price desc, reference_id) modality_rank from (
      select *, row_number() over (partition by query_id, cluster_id order by price desc, reference_id) c from {PAIR_RAW}) where c = 1) where modality_rank <= 3"""}


def retained(t, rows=None):
    p = (rows if rows is not None else t.pairs).join(t.refs.select("reference_id", "cluster_id"), "reference_id")
    return cd.retain_by_cluster(p, [("price", "desc"), ("reference_id", "asc")], 3)


@query("w02_retain_first_per_cluster", "select * from v_ret", CLUSTER_SQL)
def _w02(t):
    return retained(t).select("query_id", "reference_id", "cluster_id", "price", "modality_rank")


@query("w03_retention_with_status", """select q.query_id, coalesce(r.n, 0) raw_hits, coalesce(k.n, 0) retained_hits, case when coalesce(r.n, 0) = 0 then 'ZERO_HITS' when coalesce(k.n, 0) = 0 then 'NOTHING_ELIGIBLE' else 'RETAINED' end status
    from v_queries q left join (select query_id, count(*) n from v_pairs group by 1) r using (query_id) left join (select query_id, count(*) n from (select query_id, reference_id from v_pairs p join v_refs using (reference_id) where disc <= 0.02) group by 1) k using (query_id)""")
def _w03(t):
    kept = t.pairs.where(F.col("disc") <= 0.02).join(t.refs.select("reference_id"), "reference_id", "left_semi")
    return cd.retention_status(t.queries, t.pairs, kept)


@query("w04_retention_input_unavailable", """select status, count(*) queries, sum(raw_hits)::bigint raw_hits, sum(retained_hits)::bigint retained_hits from (
    select coalesce(r.n, 0) raw_hits, coalesce(k.n, 0) retained_hits, case when q.priority = '5-LOW' then 'INPUT_UNAVAILABLE' when coalesce(r.n, 0) = 0 then 'ZERO_HITS' when coalesce(k.n, 0) = 0 then 'NOTHING_ELIGIBLE' else 'RETAINED' end status
    from v_queries q left join (select query_id, count(*) n from v_pairs group by 1) r using (query_id) left join (select query_id, count(*) n from v_ret group by 1) k using (query_id)) group by 1""", CLUSTER_SQL)
def _w04(t):
    gone = t.queries.where(F.col("priority") == "5-LOW")
    s = cd.retention_status(t.queries, t.pairs, retained(t), gone)
    return s.groupBy("status").agg(F.count("*").alias("queries"), F.sum("raw_hits").alias("raw_hits"), F.sum("retained_hits").alias("retained_hits"))


@query("w05_dedup_then_rank", """select * from (select query_id, reference_id, price, row_number() over (partition by query_id order by price desc, reference_id) retrieval_rank from (select query_id, reference_id, max(price) price from v_hits group by 1, 2)) where retrieval_rank <= 3""")
def _w05(t):
    best = t.hits.groupBy("query_id", "reference_id").agg(F.max("price").alias("price"))
    return top_k(best, ["query_id"], [("price", "desc"), ("reference_id", "asc")], 3, "retrieval_rank")


@query("w35_rank_cut_then_dedup", """select query_id, reference_id, min(rk) retrieval_rank from (select query_id, reference_id, row_number() over (partition by query_id order by price desc, reference_id, line, qty, disc, tax) rk from v_hits) where rk <= 3 group by 1, 2""")
def _w35(t):
    cut = top_k(t.hits, ["query_id"], [("price", "desc"), *[(c, "asc") for c in ("reference_id", "line", "qty", "disc", "tax")]], 3, "rk")
    return cut.groupBy("query_id", "reference_id").agg(F.min("rk").alias("retrieval_rank"))


@query("w06_reciprocal_rank_fusion", "select query_id, reference_id, source_class, round(fused_score, 9) fused_score from v_fused", FUSED_SQL)
def _w06(t):
    return fused(t).select("query_id", "reference_id", "source_class", F.round("fused_score", 9).alias("fused_score"))


@query("w07_fused_budget_rank", "select query_id, reference_id, fused_rank from v_fused_rank", FUSED_SQL)
def _w07(t):
    return cd.budget_rank(fused(t), "fused_score", "fused_rank", bounded=True).select("query_id", "reference_id", "fused_rank")


@query("w08_strategy_ranks", """select query_id, reference_id, row_number() over (partition by query_id order by fused_score desc, reference_id) fused_rank,
    case when sequence_rank is not null then row_number() over (partition by query_id order by sequence_rank nulls last, reference_id) end seq_rank, case when structure_rank is not null then row_number() over (partition by query_id order by structure_rank nulls last, reference_id) end str_rank from v_fused""", FUSED_SQL)
def _w08(t):
    f = fused(t)
    out = cd.budget_rank(f, "fused_score", "fused_rank", bounded=True)
    for col, name in (("sequence_rank", "seq_rank"), ("structure_rank", "str_rank")):
        r = ranked(f.where(F.col(col).isNotNull()).select("query_id", "reference_id", col), ["query_id"], [(col, "asc"), ("reference_id", "asc")], name, bounded=True)
        out = out.join(r.drop(col), ["query_id", "reference_id"], "left")
    return out.select("query_id", "reference_id", "fused_rank", "seq_rank", "str_rank")


@query("w09_arg_max_first_row", "select * exclude (rn) from (select query_id, reference_id, cal, same_l4::int same_l4, row_number() over (partition by query_id order by cal desc, reference_id) rn from v_scored) where rn = 1")
def _w09(t):
    best = top_one(t.scored, ["query_id"], [("cal", "desc"), ("reference_id", "asc")])
    return best.select("query_id", "reference_id", "cal", F.col("same_l4").cast("int").alias("same_l4"))


@query("w10_arg_max_under_budget", "select * exclude (rn) from (select query_id, b budget, reference_id, cal, row_number() over (partition by query_id, b order by cal desc, reference_id) rn from v_fused_scored cross join (select unnest([1,2,3,99]) b) where fused_rank <= b) where rn = 1", FUSED_SQL)
def _w10(t):
    rows = fused_scored(t).withColumn("budget", F.explode(F.array(*[F.lit(b) for b in (1, 2, 3, 99)]))).where(F.col("fused_rank") <= F.col("budget"))
    return top_one(rows, ["query_id", "budget"], [("cal", "desc"), ("reference_id", "asc")]).select("query_id", "budget", "reference_id", "cal")


@query("w11_top_score_set", """select query_id, count(*) top_rows, count(distinct l4) top_labels from (select *, max(cal) over (partition by query_id) m from v_scored) where cal = m group by 1""")
def _w11(t):
    s = t.scored.select("query_id", "cal", "l4")
    # Rows per score value first; the top value is then picked from those counts.
    per = s.groupBy("query_id", "cal").agg(F.count("*").alias("n"), F.count_distinct("l4").alias("labels"))
    return per.groupBy("query_id").agg(F.max(F.struct("cal", "n", "labels")).alias("b")).select("query_id", F.col("b.n").alias("top_rows"), F.col("b.labels").alias("top_labels"))


@query("w13_multi_key_winner", "select * exclude (rn) from (select query_id, label, candidate_votes, supporting_channels, row_number() over (partition by query_id order by candidate_votes desc, supporting_channels desc, label) rn from v_agree) where rn = 1", VOTE_SQL)
def _w13(t):
    return top_one(agreement(t), ["query_id"], [("candidate_votes", "desc"), ("supporting_channels", "desc"), ("label", "asc")]).select("query_id", "label", "candidate_votes", "supporting_channels")


LABEL_SQL = {"v_lab": """select query_id, l3 label, max(raw) score, max(ident) ident, min(disc) disc, count(distinct reference_id) refs, count(distinct cluster_id) clusters from v_scored group by 1, 2"""}


def label_rows(t):
    return t.scored.groupBy("query_id", F.col("l3").alias("label")).agg(
        F.max("raw").alias("score"), F.max("ident").alias("ident"), F.min("disc").alias("disc"), F.count_distinct("reference_id").alias("refs"), F.count_distinct("cluster_id").alias("clusters"))


@query("w14_four_ranking_policies", """select query_id, label, row_number() over (partition by query_id order by score desc, clusters desc, ident desc, label) rank_score, row_number() over (partition by query_id order by disc, ident desc, label) rank_first,
    row_number() over (partition by query_id order by ident desc, disc, label) rank_similarity, row_number() over (partition by query_id order by clusters desc, refs desc, ident desc, label) rank_frequency from v_lab""", LABEL_SQL)
def _w14(t):
    out = cut_lineage(label_rows(t))
    d, a = "desc", "asc"
    for name, order in {"rank_score": [("score", d), ("clusters", d), ("ident", d)], "rank_first": [("disc", a), ("ident", d)],
                        "rank_similarity": [("ident", d), ("disc", a)], "rank_frequency": [("clusters", d), ("refs", d), ("ident", d)]}.items():
        out = ranked(out, ["query_id"], [*order, ("label", a)], name)
    return out.select("query_id", "label", "rank_score", "rank_first", "rank_similarity", "rank_frequency")


@query("w15_dense_vote_rank", "select query_id, label, dense_rank() over (partition by query_id order by candidate_votes desc) vote_rank from v_votestats", VOTE_SQL)
def _w15(t):
    a = agreement(t).select("query_id", "label", "candidate_votes")
    by_votes = Window.partitionBy("query_id").orderBy(F.col("candidate_votes").desc())  # at most a label per method
    return a.select("query_id", "label", F.dense_rank().over(by_votes).cast("bigint").alias("vote_rank"))


@query("w16_first_rank", "select stratum, component_id, n, row_number() over (partition by stratum order by n desc, component_id) first_rank from (select stratum, component_id, count(*) n from v_queries group by 1, 2)")
def _w16(t):
    g = t.queries.groupBy("stratum", "component_id").agg(F.count("*").alias("n"))
    return ranked(g, ["stratum"], [("n", "desc"), ("component_id", "asc")], "first_rank")


@query("w17_share_of_group_total", "select query_id, reference_id, round(qty/sum(qty) over (partition by query_id), 9) share from v_pairs")
def _w17(t):
    total = t.pairs.groupBy("query_id").agg(F.sum("qty").alias("_t"))
    return t.pairs.join(total, "query_id").select("query_id", "reference_id", F.round(F.col("qty") / F.col("_t"), 9).alias("share"))


@query("w18_group_distinct_count", """select s.query_id, s.reference_id, n clusters_in_family from v_scored s join (select family, count(distinct cluster_id) n from v_scored group by 1) using (family)""")
def _w18(t):
    n = t.scored.groupBy("family").agg(F.count_distinct("cluster_id").alias("clusters_in_family"))
    return t.scored.select("query_id", "reference_id", "family").join(n, "family").drop("family")


@query("w19_first_matching_rank", "select query_id, min(fused_rank) filter (where same_l3) first_rank, count(*) candidates from v_fused_scored group by 1", FUSED_SQL)
def _w19(t):
    return fused_scored(t).groupBy("query_id").agg(F.min(F.when(F.col("same_l3"), F.col("fused_rank"))).alias("first_rank"), F.count("*").alias("candidates"))


SEP_SQL = {"v_dist": """select source_id, reference_id, d, row_number() over (partition by source_id order by d, reference_id) rn from (select l_suppkey source_id, l_partkey reference_id, round(min(l_extendedprice)/1000, 3) d from lineitem group by 1, 2)""",
    "v_sep": """with v as (select source_id, list(d order by rn) v from v_dist where rn <= 10 group by 1), c as (select source_id, v, (list_sum(v[2:]) + 10*v[len(v)]) / (len(v) - 1 + 10) centre from v),
      s as (select source_id, v, [abs(x - centre) for x in v] s from c), g as (select source_id, [abs(s[i+1] - s[i]) for i in range(1, len(s))] g from s)
      select source_id, case when len(g) = 0 then 1 else (select case when f is null then 1 when f - 1 >= 5 then 1 else f end from (select min(i) f from (select unnest(range(1, len(g)+1)) i) where g[i] > list_sum(g)/len(g) + 1e-12)) end outputs from g"""}


@query("w20_maximum_separation_cutoff", "select source_id, outputs::int outputs from v_sep", SEP_SQL)
def _w20(t):
    return separation.maximum_separation(distances(t), "source_id", "d", "reference_id")


def distances(t):
    # Rounded in binary, as the SQL does: half a thousandth is no tie of its decimal text (x * 1000 may fall below the half).
    return t.hits.groupBy("source_id", "reference_id").agg((F.round(F.min("price") / 1000 * 1000) / 1000).alias("d"))


@query("w21_full_distance_ordering", "select source_id, reference_id, rn distance_rank from v_dist", SEP_SQL)
def _w21(t):
    return ranked(distances(t), ["source_id"], [("d", "asc"), ("reference_id", "asc")], "distance_rank").drop("d")


@query("w22_native_hit_order", "select query_id, reference_id, row_number() over (partition by query_id order by qty desc, disc, reference_id) native_rank from v_pairs")
def _w22(t):
    r = ranked(t.pairs.select("query_id", "reference_id", "qty", "disc"), ["query_id"], [("qty", "desc"), ("disc", "asc"), ("reference_id", "asc")], "native_rank")
    return r.select("query_id", "reference_id", "native_rank")


@query("w24_quantile_bins", """with s as (select total s, row_number() over (order by total) - 1 i, count(*) over () n from v_queries), e as (select j, l.s + (h.s-l.s)*(j*(l.n-1)/4.0::double - (j*(l.n-1))//4) q from (select unnest([1,2,3]) j)
      join s l on l.i = (j*(l.n-1))//4 join s h on h.i = (j*(l.n-1)+3)//4)
    select bin, count(*) queries, min(total) lowest, max(total) highest from (select total, (select count(*) from e where e.q < total)::int bin from v_queries) group by 1""")
def _w24(t):
    cuts = exact_quantiles(t.queries, "total", 4).where(F.col("step").isin(1, 2, 3)).agg(F.array_sort(F.collect_set("quantile")).alias("_e"))  # three numbers
    q = attach_one_row(t.queries, cuts)
    b = F.size(F.filter("_e", lambda e: e < F.col("total")))
    return q.groupBy(b.alias("bin")).agg(F.count("*").alias("queries"), F.min("total").alias("lowest"), F.max("total").alias("highest"))


@query("w25_left_closed_bins", "select case when ident < 0.2 then 0 when ident < 0.4 then 1 when ident < 0.6 then 2 when ident < 0.8 then 3 else 4 end bin, count(*) pairs from v_scored group by 1")
def _w25(t):
    return t.scored.groupBy(curves.left_closed_bin(F.col("ident"), [0.0, 0.2, 0.4, 0.6, 0.8, 1.01]).alias("bin")).agg(F.count("*").alias("pairs"))


@query("w26_right_closed_bins", "select case when ident <= 0.2 then 0 when ident <= 0.5 then 1 when ident <= 0.8 then 2 else 3 end bin, count(*) pairs from v_scored group by 1")
def _w26(t):
    return t.scored.groupBy(curves.right_closed_bin(F.col("ident"), [0.2, 0.5, 0.8]).alias("bin")).agg(F.count("*").alias("pairs"))


@query("w28_top_k_label_proposals", "select * from (select source_id, label, score, row_number() over (partition by source_id order by score desc, label) \"rank\" from (select h.source_id, r.l4 label, max(h.price) score from v_hits h join v_refs r using (reference_id) group by 1, 2)) where \"rank\" <= 5")
def _w28(t):
    s = t.hits.join(t.refs.select("reference_id", F.col("l4").alias("label")), "reference_id").groupBy("source_id", "label").agg(F.max("price").alias("score"))
    return top_k(s, ["source_id"], [("score", "desc"), ("label", "asc")], 5)


@query("w29_global_top_n_by_hash", f"select query_id, reference_id from v_pairs order by {H60.format(chr(39) + 'cap|' + chr(39) + '||query_id||' + chr(39) + '|' + chr(39) + '||reference_id')}, query_id, reference_id limit 500")
def _w29(t):
    h = u60(key_text("cap", F.col("query_id"), F.col("reference_id")))
    return t.pairs.select("query_id", "reference_id", h.alias("h")).orderBy("h", "query_id", "reference_id").limit(500).drop("h")


@query("w30_running_precision_average_precision", """with r as (select "role", same_l3::int y, row_number() over (partition by "role" order by raw desc, query_id, reference_id) rn from v_scored), c as (select *, sum(y) over (partition by "role" order by rn) c from r)
    select "role", round(sum(y*c::double/rn)/nullif(sum(y), 0), 9) average_precision from c group by 1""")
def _w30(t):
    return separation.running_precision(t.scored, ["role"], [("raw", "desc"), ("query_id", "asc"), ("reference_id", "asc")], "same_l3")


@query("w31_top1_with_margin", """select query_id, "method", label, score raw_score, round(score - second, 9) top1_margin from (select *, lead(score) over (partition by query_id, "method" order by score desc, reference_id) "second", row_number() over (partition by query_id, "method" order by score desc, reference_id) rn
      from (select p.query_id, p.reference_id, r.l4 label, unnest(['PRICE','QTY']) "method", unnest([p.price, p.qty]) score from v_pairs p join v_refs r using (reference_id))) where rn = 1""")
def _w31(t):
    p = t.pairs.join(t.refs.select("reference_id", F.col("l4").alias("label")), "reference_id")
    items = F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("score")) for m, c in (("PRICE", "price"), ("QTY", "qty"))]))
    two = top_k(p.select("query_id", "reference_id", "label", items), ["query_id", "method"], [("score", "desc"), ("reference_id", "asc")], 2)
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    g = two.groupBy("query_id", "method").agg(first("label").alias("label"), first("score").alias("raw_score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("_s"))
    return g.select("query_id", "method", "label", "raw_score", F.round(F.col("raw_score") - F.col("_s"), 9).alias("top1_margin"))


@query("w32_diversified_pick", """select query_id, component_id, total from (select query_id, component_id, total, row_number() over (partition by component_id order by total desc, query_id) rn from v_queries) order by (rn > 1)::int, total desc, query_id limit 12""")
def _w32(t):
    q = t.queries.select("query_id", "component_id", "total")
    first = top_one(q, ["component_id"], [("total", "desc"), ("query_id", "asc")]).withColumn("_later", F.lit(0))
    rest = q.withColumn("_later", F.lit(1)).join(first.select("query_id"), "query_id", "left_anti").select("query_id", "component_id", "total", "_later")
    return first.select("query_id", "component_id", "total", "_later").unionByName(rest).orderBy("_later", F.desc("total"), "query_id").limit(12).drop("_later")


@query("w33_best_group_per_class", """with f as (select family, l3 cls, count(distinct reference_id) refs, count(distinct l4) labels, count(distinct exact) exacts, avg((exact is not null)::int) cov from v_refs group by 1, 2)
    select cls, family, refs, exacts, round(cov, 9) coverage from (select *, row_number() over (partition by cls order by refs desc, exacts desc, family) rn from f where refs >= 2) where rn = 1""")
def _w33(t):
    g = t.refs.groupBy("family", F.col("l3").alias("cls")).agg(F.count_distinct("reference_id").alias("refs"), F.count_distinct("exact").alias("exacts"),
                                                               F.round(F.avg(F.col("exact").isNotNull().cast("int")), 9).alias("coverage"))
    return top_one(g.where(F.col("refs") >= 2), ["cls"], [("refs", "desc"), ("exacts", "desc"), ("family", "asc")]).select("cls", "family", "refs", "exacts", "coverage")


@query("w34_one_pass_retention_allowed_roles", """select * from (select query_id, reference_id, cluster_id, row_number() over (partition by query_id order by price desc, reference_id) modality_rank from (
      select p.*, r.cluster_id, row_number() over (partition by p.query_id, r.cluster_id order by price desc, reference_id) c from v_pairs p join v_refs r using (reference_id) join v_queries q using (query_id) where q."role" in ('DEV','RETEST') and p.query_id <> p.reference_id) where c = 1) where modality_rank <= 3""")
def _w34(t):
    ok = t.queries.where(F.col("role").isin("DEV", "RETEST")).select("query_id")
    rows = t.pairs.where(F.col("query_id") != F.col("reference_id")).join(ok, "query_id", "left_semi")
    return retained(t, rows).select("query_id", "reference_id", "cluster_id", "modality_rank")


@query("o01_stable_multi_key_sort", "select query_id, total, stratum from v_queries order by stratum, total desc, query_id")
def _o01(t):
    return t.queries.select("query_id", "total", "stratum").orderBy("stratum", F.desc("total"), "query_id")


@query("o02_external_merge_sort", "select query_id, reference_id, source_id, line, qty from v_hits order by query_id, reference_id, source_id, line, qty")
def _o02(t):
    # Range-partitioned sort; runs spill to disk inside each task.
    return t.hits.select("query_id", "reference_id", "source_id", "line", "qty").orderBy("query_id", "reference_id", "source_id", "line", "qty")


@query("o03_head_by_hash_per_group", f"select \"role\", query_id from (select \"role\", query_id, row_number() over (partition by \"role\" order by {H60.format(chr(39) + 'head|' + chr(39) + '||query_id')}, query_id) rn from v_queries) where rn <= 20")
def _o03(t):
    q = t.queries.select("role", "query_id", u60(key_text("head", F.col("query_id"))).alias("h"))
    return top_k(q, ["role"], [("h", "asc"), ("query_id", "asc")], 20).select("role", "query_id")


@query("o04_seeded_audit_sample", f"select query_id, reference_id from v_pairs order by {H60.format(chr(39) + '20260819|' + chr(39) + '||query_id||' + chr(39) + '|' + chr(39) + '||reference_id')}, query_id, reference_id limit 100")
def _o04(t):
    h = u60(key_text(20260819, F.col("query_id"), F.col("reference_id")))
    return t.pairs.select("query_id", "reference_id", h.alias("h")).orderBy("h", "query_id", "reference_id").limit(100).drop("h")


@query("u01_union_with_missing_columns", "select query_id, reference_id, price, null::double qty from v_pairs where disc <= 0.02 union all select query_id, reference_id, null, qty from v_pairs where tax <= 0.02")
def _u01(t):
    a = t.pairs.where(F.col("disc") <= 0.02).select("query_id", "reference_id", "price")
    return a.unionByName(t.pairs.where(F.col("tax") <= 0.02).select("query_id", "reference_id", "qty"), allowMissingColumns=True)


@query("u02_union_keep_first", "select query_id, reference_id, min(o) origin from (select query_id, reference_id, 1 o from v_pairs where disc <= 0.02 union all select query_id, reference_id, 2 from v_pairs where tax <= 0.02) group by 1, 2")
def _u02(t):
    a = t.pairs.where(F.col("disc") <= 0.02).select("query_id", "reference_id", F.lit(1).alias("origin"))
    b = t.pairs.where(F.col("tax") <= 0.02).select("query_id", "reference_id", F.lit(2).alias("origin"))
    return a.unionByName(b).groupBy("query_id", "reference_id").agg(F.min("origin").alias("origin"))


@query("u03_distinct_on_key", "select distinct query_id, reference_id from v_hits")
def _u03(t):
    return t.hits.select("query_id", "reference_id").distinct()


@query("u04_label_set_algebra", """select p.query_id, len(list_intersect(p.l, t.l)) both_n, len([x for x in p.l if not list_contains(t.l, x)]) only_pred, len(list_distinct(list_concat(p.l, t.l))) union_n
    from (select query_id, list(distinct l3) l from v_pairs join v_refs using (reference_id) group by 1) p join (select query_id, list(label) l from v_truth where endpoint = 'L3' group by 1) t using (query_id)""")
def _u04(t):
    p = t.pairs.join(t.refs.select("reference_id", "l3"), "reference_id").select("query_id", "l3").distinct().groupBy("query_id").agg(F.collect_set("l3").alias("p"))
    q = t.truth.where(F.col("endpoint") == "L3").groupBy("query_id").agg(F.collect_set("label").alias("q"))
    j = p.join(q, "query_id")
    n = lambda c: F.size(c).cast("bigint")
    return j.select("query_id", n(F.array_intersect("p", "q")).alias("both_n"), n(F.array_except("p", "q")).alias("only_pred"), n(F.array_union("p", "q")).alias("union_n"))


@query("u05_multiset_equality", "select 0::bigint only_left, (select count(*) from v_hits where tax > 0.07) only_right")
def _u05(t):
    a = t.hits.where(F.col("tax") <= 0.07)
    miss = a.exceptAll(t.hits).agg(F.count("*").alias("only_left"))
    return attach_one_row(miss, t.hits.exceptAll(a).agg(F.count("*").alias("only_right")))


@query("u06_id_union_with_provenance", """select id, to_json(list_sort(list(distinct src)))::varchar sources from (select o_custkey id, 'orders' src from orders union all select c_custkey, 'customer' from customer union all select user_id, 'events' from events) group by 1""")
def _u06(t):
    parts = [("orders", "o_custkey"), ("customer", "c_custkey"), ("events", "user_id")]
    u = None
    for table, col in parts:
        p = t.raw(table).select(F.col(col).alias("id"), F.lit(table).alias("src"))
        u = p if u is None else u.unionByName(p)
    return u.distinct().groupBy("id").agg(sorted_json(F.collect_set("src")).alias("sources"))


@query("u07_derived_id_lists", """select p_partkey id, p_brand from part where p_partkey not in (select l_partkey from lineitem where l_discount >= 0.1)""")
def _u07(t):
    used = t.raw("lineitem").where(F.col("l_discount") >= 0.1).select(F.col("l_partkey").alias("id")).distinct()
    return t.raw("part").select(F.col("p_partkey").alias("id"), "p_brand").join(used, "id", "left_anti")
