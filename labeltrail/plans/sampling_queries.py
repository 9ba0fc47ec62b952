"""Hash splits and samplers (P rows), balanced picks, role plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from labeltrail.functions import measures as ms
from labeltrail.functions.hashing import bucket64, key_text, split_by_share, stable_split, unit_interval
from labeltrail.operators import metrics, sampling
from labeltrail.operators.candidates import modality_ranks
from labeltrail.operators.checks import groups_spanning_splits
from labeltrail.operators.ranking import attach_one_row, ranked, top_k
from labeltrail.plans.registry import query
from labeltrail.plans.selection_queries import H60

U = "('0x'||substr(sha256({}),1,16))::ubigint"
F01 = "(" + U + "::double/18446744073709551616.0)"


def split_sql(seed, ns, g):
    h = F01.format(f"'{seed}|{ns}|'||{g}")
    return f"case when {g} is null or {g} = '' or {g} = 'UNASSIGNED' then 'UNASSIGNED' when {h} < 0.70 then 'train' when {h} < 0.85 then 'validation' else 'test' end"


@query("p01_stable_group_split", f"""select exact grp, {split_sql(20260819, 'sequence', 'exact')} split, count(*) items from v_refs group by 1, 2""")
def _p01(t):
    return t.refs.groupBy(F.col("exact").alias("grp")).agg(F.count("*").alias("items")).withColumn("split", stable_split("grp", 20260819, "sequence"))


@query("p02_bucket_split_60_20_20", f"""select component_id, case when b < 60 then 'FIT' when b < 80 then 'CAL' else 'SELECT' end part from (select distinct component_id, {U.format("'20260819|'||component_id::varchar")} % 100 b from v_queries)""")
def _p02(t):
    b = bucket64(key_text(20260819, F.col("component_id")), 100)
    return t.queries.select("component_id").distinct().select("component_id", F.when(b < 60, "FIT").when(b < 80, "CAL").otherwise("SELECT").alias("part"))


@query("p03_hash_fold_id", f"""select ({U.format("'7|'||component_id::varchar")} % 5)::int fold, count(*) queries, count(distinct component_id) components from v_queries group by 1""")
def _p03(t):
    return t.queries.groupBy(bucket64(key_text(7, F.col("component_id")), 5).alias("fold")).agg(F.count("*").alias("queries"), F.count_distinct("component_id").alias("components"))


@query("p04_row_split_80_10_10", f"""select query_id, case when h < 0.8 then 'train' when h < 0.9 then 'validation' else 'test' end part from (select query_id, {F01.format("'random|20260819|'||query_id::varchar")} h from v_queries)""")
def _p04(t):
    return t.queries.select("query_id", split_by_share(key_text("random", 20260819, F.col("query_id")), [("train", 0.8), ("validation", 0.1), ("test", 0.1)]).alias("part"))


# Names under which the schemes' groups are hashed.  The three sequence clusterings are not nested.
SCHEMES = {"sequence30": "cluster_id::varchar", "sequence40": "cluster_id::varchar||'|'||family", "sequence50": "ref_name",
           "pfam_family": "family", "pfam_clan": "l3", "cath_superfamily": "l4", "taxonomy_species": "exact"}


@query("p05_multi_scheme_splits", "select *, sequence30_split split from (select reference_id, " + ", ".join(f"{split_sql(20260819, k, v)} {k}_split" for k, v in SCHEMES.items()) + " from v_refs)")
def _p05(t):
    cluster = F.col("cluster_id").cast("string")
    groups = {"sequence30": cluster, "sequence40": F.concat(cluster, F.lit("|"), "family"), "sequence50": F.col("ref_name"),
              "pfam_family": F.col("family"), "pfam_clan": F.col("l3"), "cath_superfamily": F.col("l4"), "taxonomy_species": F.col("exact")}
    return sampling.scheme_splits(t.refs, "reference_id", groups, 20260819, "sequence30")


@query("p06_multi_label_holdout", f"""with l as (select distinct query_id, {split_sql(20260819, 'holdout', 'label')} s from v_truth where endpoint = 'EXACT')
    select q.query_id, case when n is null then 'UNASSIGNED_NO_LABEL' when n = 1 then s else 'EXCLUDED_CROSS_SPLIT' end split from v_queries q left join (select query_id, count(*) n, min(s) s from l group by 1) using (query_id)""")
def _p06(t):
    return sampling.holdout_by_labels(t.queries, t.truth.where(F.col("endpoint") == "EXACT"), 20260819, "holdout")


ROLE_SHARES = [("TRAIN", 0.6), ("DEV", 0.2), ("CAL", 0.1), ("TEST", 0.1)]
ROLE_SQL = {"v_assign": f"""select component_id, n, case when sm <= 15 then ['DEV','CAL','TEST'][((sm - 1) % 3)::int + 1] else r end assigned from (
      select *, case when b::double/tot < 0.6 then 'TRAIN' when b::double/tot < 0.8 then 'DEV' when b::double/tot < 0.9 then 'CAL' else 'TEST' end r from (
        select *, coalesce(sum(case when sm > 15 then n end) over (order by h rows between unbounded preceding and 1 preceding), 0) b, sum(case when sm > 15 then n end) over () tot from (
          select *, row_number() over (order by n, h, component_id) sm from (select component_id, count(*) n, {H60.format("'20260819|'||component_id::varchar")} h from v_queries group by 1))))"""}


def assigned(t):
    comp = t.queries.groupBy("component_id").agg(F.count("*").alias("n"))
    return sampling.assign_roles(comp, "component_id", "n", ROLE_SHARES, 5, 20260819)


@query("p07_component_role_assignment", "select component_id, n, assigned \"role\" from v_assign", ROLE_SQL)
def _p07(t):
    return assigned(t)


@query("p08_expand_roles_to_items", """select assigned "role", count(*) queries, count(distinct component_id) components, sum((total > 250000)::int)::bigint large from v_queries join v_assign using (component_id) group by 1""", ROLE_SQL)
def _p08(t):
    from labeltrail.operators.joins import many_to_one

    x = many_to_one(t.queries.drop("role"), assigned(t).select("component_id", "role"), ["component_id"], "inner")
    return x.groupBy("role").agg(F.count("*").alias("queries"), F.count_distinct("component_id").alias("components"), ms.n_if(F.col("total") > 250000).alias("large"))


@query("p09_bernoulli_sample", f"""select query_id, reference_id, round(p, 9) sampling_probability, round(1/p, 6) sample_weight from (select *, least(1.0::double, 2000.0::double/count(*) over ()) p, {F01.format("'20260819|'||query_id||'|'||reference_id")} h from v_pairs) where h <= p""")
def _p09(t):
    s = sampling.bernoulli_sample(t.pairs.select("query_id", "reference_id"), ["query_id", "reference_id"], 2000, 20260819)
    return s.select("query_id", "reference_id", F.round("sampling_probability", 9).alias("sampling_probability"), F.round("sample_weight", 6).alias("sample_weight"))


PPS_SQL = {"v_pool2": """select query_id, reference_id, round((1/sqrt(count(*) over (partition by reference_id)))*(1/sqrt(count(*) over (partition by family)))*(case when same_l3 and not same_l4 then 3 else 1 end)*(case when same_l3 then 1.5 else 1 end), 9) w from v_scored"""}


def pps_pool(t):
    rows = t.scored.select("query_id", "reference_id", "family", "same_l3", "same_l4")
    x = sampling.with_frequencies(rows, {"na": "reference_id", "nf": "family"})
    w = (1 / F.sqrt("na")) * (1 / F.sqrt("nf")) * F.when(F.col("same_l3") & ~F.col("same_l4"), 3).otherwise(1) * F.when(F.col("same_l3"), 1.5).otherwise(1)
    return x.select("query_id", "reference_id", F.round(w, 9).alias("w"))


@query("p10_pps_sample", f"""with s as (select w, count(*) n, sum(w) sw from v_pool2 group by 1), r as (select *, sum(n) over (order by w desc) cn, sum(sw) over (order by w desc) cw, sum(sw) over () tw from s),
    c as (select max_by(c, w) c from (select w, (1500 - (cn-n))/(tw-(cw-sw)) c from r) where c*w <= 1)
    select query_id, reference_id, round(least(1.0::double, c*w), 8) sampling_probability from v_pool2 cross join c where {F01.format("query_id||'|'||reference_id||'|training'")} <= least(1.0::double, c*w)""", PPS_SQL)
def _p10(t):
    s = sampling.pps_sample(pps_pool(t), "w", 1500, ["query_id", "reference_id"], "training")
    return s.select("query_id", "reference_id", F.round("sampling_probability", 8).alias("sampling_probability"))


@query("p10b_pps_probabilities_reach_target", """select count(*) pool, 1500.0::double expected_size from v_pool2""", PPS_SQL)
def _p10b(t):
    p = pps_pool(t)
    x = attach_one_row(p, sampling.pps_scale(p, "w", 1500))
    return x.agg(F.count("*").alias("pool"), F.round(F.sum(F.least(F.lit(1.0), F.col("scale") * F.col("w"))), 6).alias("expected_size"))


def stage_sql(src, name, by, n, stage, null_ok):
    k = "||'|'||".join(f"{c}::varchar" for c in by)
    h = H60.format(f"'{stage}|'||{k}||'|'||query_id||'|'||reference_id")
    known = " and ".join(f"{c} is not null" for c in by)
    out = f"""select * exclude (rn, sz, hh), least(1.0::double, {n}.0::double/sz) p_{name} from (select *, row_number() over (partition by {", ".join(by)} order by hh, query_id, reference_id) rn, count(*) over (partition by {", ".join(by)}) sz
       from (select *, {h} hh from {src} where {known})) where rn <= {n}"""
    return out + (f" union all select *, 1.0::double from {src} where not ({known})" if null_ok else "")


HARD_SQL = {
    "v_hard": f"""select * exclude (flags), coalesce(nullif(flags, ''), '{sampling.NO_HARD_CASE}') flags from (select *, array_to_string([x for x in [case when same_l3 and not same_l4 then '{sampling.H1}' end, case when same_l4 and ek and not coalesce(same_exact, false) then '{sampling.H2}' end,
      case when qc >= 0.7 and tc >= 0.7 and ident >= 0.4 and dv then '{sampling.H3}' end, case when srank <= 10 and dv then '{sampling.H4}' end,
      case when same_l3 and dv then '{sampling.H5}' end, case when qc >= 0.7 and tc >= 0.7 and ident < 0.3 and ek and coalesce(same_exact, false) then '{sampling.H6}' end,
      case when same_exact and qs <> rs then '{sampling.H7}' end] if x is not null], '+') flags
      from (select s.*, v_refs.ref_name activity, case when component_id % 4 <> 0 then component_id % 12 end qs, case when s.cluster_id % 5 <> 0 then s.cluster_id % 12 end rs,
        same_exact is not null ek, not same_l4 or (same_exact is not null and not coalesce(same_exact, false)) dv, 1 - 5*disc qc, 1 - 5*tax tc, r.rk srank from v_scored s join v_refs using (reference_id)
        left join (select query_id, reference_id, row_number() over (partition by query_id order by qty desc, reference_id) rk from v_pairs where tax <= 0.06) r using (query_id, reference_id)))""",
    "v_b0": f"select query_id, reference_id, cluster_id, activity, exact, l4, family, flags, flags <> '{sampling.NO_HARD_CASE}' hard from v_hard",
}
HARD_SQL["v_b1"] = stage_sql("v_b0", "cluster", ["query_id", "cluster_id", "activity"], 1, "CLUSTER", False)
HARD_SQL["v_b2"] = stage_sql("v_b1", "exact", ["exact"], 8, "EXACT_CAP", True)
HARD_SQL["v_b3"] = stage_sql("v_b2", "label", ["l4"], 20, "LABEL_CAP", False)
HARD_SQL["v_quota"] = """select d, o, dq + least(d-dq, 400-dq-oq) dq, least(o, oq + greatest(0, 400 - oq - dq - least(d-dq, 400-dq-oq))) oq from (
    select d, o, case when d+o > 400 then least(d, 200) else d end dq, case when d+o > 400 then least(o, 400 - least(d, 200)) else o end oq from (select count(*) filter (where hard) d, count(*) filter (where not hard) o from v_b3))"""
HARD_SQL["v_b4"] = f"""select b.* exclude (rn, h), case when hard then 'DIFFICULT' else 'ORDINARY' end stratum, case when hard then dq::double/d else oq::double/o end p_target from (
    select *, row_number() over (partition by hard order by h, query_id, reference_id) rn from (select *, {H60.format("'TARGET|'||case when hard then 'DIFFICULT' else 'ORDINARY' end||'|'||query_id||'|'||reference_id")} h from v_b3)) b
    cross join v_quota where rn <= case when hard then dq else oq end"""


def hard_rows(t):
    st = ranked(t.pairs.where(F.col("tax") <= 0.06), ["query_id"], [("qty", "desc"), ("reference_id", "asc")], "srank").select("query_id", "reference_id", "srank")
    s = t.scored.join(st, ["query_id", "reference_id"], "left")
    c = F.col
    qs = F.when(c("component_id") % 4 != 0, c("component_id") % 12)  # some sides have no structure
    rs = F.when(c("cluster_id") % 5 != 0, c("cluster_id") % 12)
    flags = sampling.hard_case_flags(c("ident"), 1 - 5 * c("disc"), 1 - 5 * c("tax"), c("srank"), c("same_l3"), c("same_l4"), c("same_exact"),
                                     c("same_exact").isNotNull(), c("same_l3"), qs, rs)
    names = t.refs.select("reference_id", F.col("ref_name").alias("activity"))
    return s.withColumn("flags", flags).join(names, "reference_id")


@query("p13_hard_case_flags", "select query_id, reference_id, flags from v_hard", HARD_SQL)
def _p13(t):
    return hard_rows(t).select("query_id", "reference_id", "flags")


def balanced(t):
    rows = hard_rows(t).select("query_id", "reference_id", "cluster_id", "activity", "exact", "l4", "family",
                               (F.col("flags") != sampling.NO_HARD_CASE).alias("hard"))
    return sampling.balanced_sample(rows, ["query_id", "reference_id"], ["query_id", "cluster_id", "activity"], "exact", "l4", "hard", 400, 8, 20, minimum=100)


@query("p11_balanced_capped_sampler", "select query_id, reference_id, stratum, round(p_cluster*p_exact*p_label*p_target, 9) sampling_probability from v_b4", HARD_SQL)
def _p11(t):
    return balanced(t).select("query_id", "reference_id", "stratum", F.round("sampling_probability", 9).alias("sampling_probability"))


@query("w23_hash_priority_top_n", "select query_id, reference_id, exact, p_exact from v_b2", HARD_SQL)
def _w23(t):
    rows = hard_rows(t).select("query_id", "reference_id", "cluster_id", "activity", "exact")
    s = sampling.take_uniform(rows, ["query_id", "cluster_id", "activity"], 1, "CLUSTER", ["query_id", "reference_id"], "p_cluster")
    return sampling.take_uniform(s, ["exact"], 8, "EXACT_CAP", ["query_id", "reference_id"], "p_exact").select("query_id", "reference_id", "exact", "p_exact")


@query("p12_cube_root_balance_weight", """with w as (select query_id, reference_id, pow(1.0::double/count(*) over (partition by activity)/count(*) over (partition by family)/count(*) over (partition by cluster_id), 1.0::double/3) r from v_b4)
    select query_id, reference_id, round(r/avg(r) over (), 8) sample_weight from w""", HARD_SQL)
def _p12(t):
    w = sampling.cube_root_weights(balanced(t), ["activity", "family", "cluster_id"])
    return w.select("query_id", "reference_id", F.round("sample_weight", 8).alias("sample_weight"))


# Picks per query, for the first three per documented label.
AUGMENTATION = {"same_exact": 2, "same_l4": 1, "same_l3": 1, "same_family_divergent": 2, "matched_control": 2, "global_control": 2}
PICK_SEED = 20260819


def walk_sql(base: str) -> str:
    """SQL twin of `permuted_index`: `base` yields (id columns..., i, size, key) with size > 1; adds j."""
    steps = "select *, v >> half l0, v & ((1::bigint << half) - 1) r0 from w where step = 0 or v >= size"
    for t in range(6):
        steps = f"select *, r{t} l{t + 1}, xor(l{t}, {H60.format(f"key||'|{t}|'||r{t}")} & ((1::bigint << half) - 1)) r{t + 1} from ({steps})"
    return f"""with recursive b as ({base}), w as (select query_id, source, label, i, size, key, greatest(1, (length(bin(size - 1)) + 1)//2)::int half, i::bigint v, 0 step from b
      union all select query_id, source, label, i, size, key, half, (l6 << half) | r6, step + 1 from ({steps})) select query_id, source, label, i, size, v j from w where step > 0 and v < size"""


PICK_SQL = {
    "v_item": "select reference_id item, cluster_id node, exact, l4, l3, family, floor(ref_price/250)::int::varchar||'|'||family match from v_refs",
    "v_said": "select query_id, lower(endpoint) level, label from v_truth",
    "v_home": "select query_id, node, family, match from (select query_id, min(reference_id) item from v_hits where flag = 'R' group by 1) join v_item using (item)",
    "v_asked": """select query_id, 'same_'||level source, label, node from v_said join v_home using (query_id) union all
      select query_id, s source, case s when 'same_family_divergent' then family when 'matched_control' then match else '' end label, node from v_home cross join (select unnest(['same_family_divergent', 'matched_control', 'global_control']) s)"""}


def eligible_sql(sources: str) -> str:
    return f"""select a.query_id, a.source, a.label, i.item, row_number() over (partition by a.query_id, a.source, a.label order by i.l4, i.exact, i.node, i.item) - 1 r, count(*) over (partition by a.query_id, a.source, a.label) size
      from v_asked a join v_item i on a.label = case a.source when 'same_exact' then i.exact when 'same_l4' then i.l4 when 'same_l3' then i.l3 when 'same_family_divergent' then i.family when 'matched_control' then i.match else '' end
      left join v_said s4 on s4.query_id = a.query_id and s4.level = 'l4' and s4.label = i.l4 left join v_said se on se.query_id = a.query_id and se.level = 'exact' and se.label = i.exact
      where i.node <> a.node and (a.source in ('same_exact', 'same_l4', 'same_l3') or (s4.label is null and se.label is null)) and a.source in ({sources})"""


def picks_sql(sources: list[str]) -> dict[str, str]:
    k = "case e.source " + " ".join(f"when '{s}' then {n}" for s, n in AUGMENTATION.items()) + " end"
    base = f"""select * from (select query_id, source, label, size, unnest(range(least({k}, size))) i, '{PICK_SEED}|'||query_id||'|'||source||':'||label "key" from (select distinct query_id, source, label, size from v_el) e) where size > 1"""
    return {**PICK_SQL, "v_el": eligible_sql(", ".join(f"'{s}'" for s in sources)), "v_walk": walk_sql(base),
            "v_pick": f"""select e.query_id, e.source, e.label, e.item, e.size, least({k}, e.size)::double/e.size p from v_el e left join v_walk w on w.query_id = e.query_id and w.source = e.source and w.label = e.label and w.j = e.r where e.size = 1 or w.j is not null"""}


def augmentation_tables(t):
    items = t.refs.select(F.col("reference_id").alias("item"), F.col("cluster_id").alias("node"), "exact", "l4", "l3", "family",
                          F.concat_ws("|", F.floor(F.col("ref_price") / 250).cast("string"), "family").alias("match"))
    truth = t.truth.select("query_id", F.lower("endpoint").alias("level"), "label")
    home = t.hits.where(F.col("flag") == "R").groupBy("query_id").agg(F.min("reference_id").alias("item"))
    return home.join(items, "item").select("query_id", "node", "family", "match"), truth, items


@query("p14_augmentation_picks", """select query_id, item, string_agg(distinct m, '+' order by m) mechanisms, round(max(p), 9) inclusion_probability
    from (select *, case when source in ('same_exact', 'same_l4', 'same_l3') then source||':'||label else source end m from v_pick) group by 1, 2""", picks_sql(list(AUGMENTATION)))
def _p14(t):
    out = sampling.augmentation_picks(*augmentation_tables(t), AUGMENTATION, PICK_SEED)
    return out.withColumn("inclusion_probability", F.round("inclusion_probability", 9))


@query("p15_global_divergent_picks", "select query_id, item, size eligible, round(p, 9) inclusion_probability from v_pick", picks_sql(["global_control"]))
def _p15(t):
    queries, truth, items = augmentation_tables(t)
    every = F.lit("").alias("label")
    out = sampling.keyed_picks(queries.select("query_id", every, "node"), items.select(every, "l4", "exact", "node", "item"), AUGMENTATION["global_control"],
                               "global_control", PICK_SEED, truth)
    return out.select("query_id", "item", "eligible", F.round("inclusion_probability", 9).alias("inclusion_probability"))


@query("p16_domain_balanced_weights", """select query_id, reference_id, round(weight/sum(weight) over (partition by stratum) * count(*) over () / (select count(distinct stratum) from v_scored), 8) balanced_weight from v_scored""")
def _p16(t):
    x = sampling.domain_balanced_weights(t.scored.select("query_id", "reference_id", "stratum", "weight"), "weight", "stratum")
    return x.select("query_id", "reference_id", F.round("balanced_weight", 8).alias("balanced_weight"))


@query("p17_inverse_set_size_weight", "select query_id, round(1.0::double/greatest(count(distinct label), 1), 9) query_weight from v_votes group by 1")
def _p17(t):
    return t.votes.groupBy("query_id").agg(F.round(1 / F.greatest(F.count_distinct("label"), F.lit(1)), 9).alias("query_weight"))


@query("p18_stable_shard_id", f"""select shard, count(*) pairs from (select ({U.format("'20260819|sequence|'||query_id||'|'||reference_id")} % 64)::int shard from v_pairs) group by 1""")
def _p18(t):
    s = bucket64(key_text(20260819, "sequence", F.col("query_id"), F.col("reference_id")), 64)
    return t.pairs.groupBy(s.alias("shard")).agg(F.count("*").alias("pairs"))


SHARD_SQL = {"v_shards": """select "role", component_id, ((row_number() over (partition by "role" order by component_id) - 1)//40)::int shard from (select distinct "role", component_id from v_queries)"""}


@query("p19_contiguous_shards", """select "role", shard, count(*) items, min(component_id) first_id, max(component_id) last_id from v_shards group by 1, 2""", SHARD_SQL)
def _p19(t):
    s = sampling.contiguous_shards(t.queries, ["role"], "component_id", 40)
    return s.groupBy("role", "shard").agg(F.count("*").alias("items"), F.min("component_id").alias("first_id"), F.max("component_id").alias("last_id"))


@query("j22_cross_role_pair_coverage", """with s as (select "role", shard, count(*) n from v_shards group by 1, 2)
    select a."role" query_role, b."role" target_role, count(*) tasks, sum(a.n*b.n)::bigint directed_pairs from s a join s b on a."role" <> b."role" group by 1, 2""", SHARD_SQL)
def _j22(t):
    # Sums per role are enough: the pairs between two roles are the product of their sizes,
    # so no shard is paired with another.
    s = sampling.contiguous_shards(t.queries, ["role"], "component_id", 40)
    r = s.groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("shard").alias("shards"))
    a = r.select(F.col("role").alias("query_role"), F.col("n").alias("qn"), F.col("shards").alias("qs"))
    b = r.select(F.col("role").alias("target_role"), F.col("n").alias("tn"), F.col("shards").alias("ts"))
    j = a.join(F.broadcast(b), F.col("query_role") != F.col("target_role"))  # a handful of roles
    return j.select("query_role", "target_role", (F.col("qs") * F.col("ts")).alias("tasks"), (F.col("qn") * F.col("tn")).alias("directed_pairs"))


@query("p20_label_blind_panel", f"""select query_id, stratum, bin from (select *, row_number() over (partition by stratum, bin order by {H60.format("'panel|'||query_id")}, query_id) rn from (select query_id, stratum, (case when total < 125000 then 0 when total < 250000 then 1 when total < 375000 then 2 else 3 end) bin from v_queries)) where rn <= 10""")
def _p20(t):
    from labeltrail.functions.hashing import u60

    b = F.when(F.col("total") < 125000, 0).when(F.col("total") < 250000, 1).when(F.col("total") < 375000, 2).otherwise(3)
    q = t.queries.select("query_id", "stratum", b.alias("bin"), u60(key_text("panel", F.col("query_id"))).alias("h"))
    return top_k(q, ["stratum", "bin"], [("h", "asc"), ("query_id", "asc")], 10).select("query_id", "stratum", "bin")


@query("p21_role_tables_and_allowed_library", """with refs as (select distinct reference_id from v_scored where "role" = 'TRAIN'), lib as (select distinct l4 label from v_refs where reference_id in (select reference_id from refs))
    select q."role", count(*) queries, count(t.n) with_truth, coalesce(sum(t.covered), 0)::bigint covered_labels, coalesce(sum(t.n), 0)::bigint truth_labels from v_queries q
    left join (select query_id, count(*) n, count(*) filter (where label in (select label from lib)) covered from v_truth where endpoint = 'L4' group by 1) t using (query_id) where q."role" <> 'TRAIN' group by 1""")
def _p21(t):
    refs = t.scored.where(F.col("role") == "TRAIN").select("reference_id").distinct()
    lib = t.refs.join(refs, "reference_id", "left_semi").select(F.col("l4").alias("label"), F.lit(1).alias("_l")).distinct()
    tr = t.truth.where(F.col("endpoint") == "L4").join(lib, "label", "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("_l").alias("c"))
    q = t.queries.where(F.col("role") != "TRAIN").join(tr, "query_id", "left")
    z = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return q.groupBy("role").agg(F.count("*").alias("queries"), F.count("n").alias("with_truth"), z("c").alias("covered_labels"), z("n").alias("truth_labels"))


@query("p22_cluster_split_with_ratio_check", f"""with s as (select component_id, {split_sql(20260819, 'structure', 'component_id::varchar')} split from v_queries)
    select split, count(*) items, round(count(*)::double/sum(count(*)) over (), 9) share, (abs(count(*)::double/sum(count(*)) over () - case split when 'train' then 0.70 else 0.15 end) <= 0.05)::int ratio_ok, 0::bigint leaking_groups from s group by 1""")
def _p22(t):
    s = t.queries.select("component_id", stable_split(F.col("component_id").cast("string"), 20260819, "structure").alias("split"))
    leak = groups_spanning_splits(s, {"c": "component_id"}, "split").select(F.col("leaking").alias("leaking_groups"))
    g = s.groupBy("split").agg(F.count("*").alias("items"))
    g = attach_one_row(attach_one_row(g, g.agg(F.sum("items").alias("_n"))), leak)
    share = F.col("items") / F.col("_n")
    want = F.when(F.col("split") == "train", 0.70).otherwise(0.15)
    return g.select("split", "items", F.round(share, 9).alias("share"), (F.abs(share - want) <= 0.05).cast("int").alias("ratio_ok"), "leaking_groups")
