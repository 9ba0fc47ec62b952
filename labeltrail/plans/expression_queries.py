"""Scalar expressions (E rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labeltrail.functions import labels as lb
from labeltrail.functions.hashing import key_text, u64, unit_interval
from labeltrail.functions.measures import sigmoid
from labeltrail.plans.registry import query

DOT = "' EC: '||p_size||'. '||(p_partkey % 7)||'.'||(p_partkey % 5)||'.'||case when p_partkey % 9 = 0 then '-' else (p_partkey % 11)::varchar end"
CANON = "p_size||'.'||(p_partkey % 7)||'.'||(p_partkey % 5)||'.'||case when p_partkey % 9 = 0 then '-' else (p_partkey % 11)::varchar end"


def dotted(t):
    k = F.col("p_partkey")
    text = F.concat(F.lit(" EC: "), F.col("p_size"), F.lit(". "), k % 7, F.lit("."), k % 5, F.lit("."), F.when(k % 9 == 0, "-").otherwise((k % 11).cast("string")))
    return t.raw("part").select("p_partkey", text.alias("text"))


@query("e01_canonical_dotted_label", f"select p_partkey, {CANON} label from part")
def _e01(t):
    return dotted(t).select("p_partkey", lb.canonical_label("text").alias("label"))


@query("e02_canonical_prefixed_id", "select p_partkey, case when p_partkey % 4 = 0 then null else 'RHEA:'||p_partkey end id from part")
def _e02(t):
    k = F.col("p_partkey").cast("string")
    text = F.when(F.col("p_partkey") % 4 == 0, "  ").when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("rhea: "), k)).otherwise(F.concat(F.lit(" "), k, F.lit(" ")))
    return t.raw("part").select("p_partkey", lb.canonical_id(text).alias("id"))


@query("e03_ancestor_label", "select p_partkey, p_size||'.'||(p_partkey % 7)||'.'||(p_partkey % 5) l3, p_size||'.'||(p_partkey % 7) l2 from part")
def _e03(t):
    d = dotted(t).withColumn("label", lb.canonical_label("text", 4))
    return d.select("p_partkey", lb.ancestor("label").alias("l3"), lb.ancestor("label", 2).alias("l2"))


@query("e04_json_list_to_set", """select p_partkey, array_to_string(list_sort(list_distinct([p_brand, p_type])), ',') labels, 2 n from part where p_partkey % 3 <> 0 union all select p_partkey, '', 0 from part where p_partkey % 3 = 0""")
def _e04(t):
    q = F.concat(F.lit('["'), F.col("p_brand"), F.lit('", " '), F.col("p_type"), F.lit(' ", "", null, "'), F.col("p_brand"), F.lit('"]'))
    text = F.when(F.col("p_partkey") % 3 == 0, F.when(F.col("p_partkey") % 2 == 0, "not json")).otherwise(q)
    s = lb.json_set(text)
    return t.raw("part").select("p_partkey", F.array_join(s, ",").alias("labels"), F.size(s).alias("n"))


@query("e04b_json_objects_to_ids", "select p_partkey, array_to_string(list_sort(list_distinct(['PF'||p_size, 'PF'||(p_partkey % 50)])), ',') ids from part")
def _e04b(t):
    k = F.col("p_partkey") % 50
    text = F.concat(F.lit('[{"id":"PF'), F.col("p_size"), F.lit('"},{"id":"PF'), k, F.lit('"},{"id":""}]'))
    return t.raw("part").select("p_partkey", F.array_join(lb.json_object_ids(text), ",").alias("ids"))


@query("e05_structure_name_to_accession", "select p_partkey, case when p_partkey % 2 = 0 then 'P'||p_partkey else upper(split_part(p_name, ' ', 1)) end accession from part")
def _e05(t):
    n = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("af-p"), F.col("p_partkey"), F.lit("-F1-model_v4"))).otherwise(F.col("p_name"))
    return t.raw("part").select("p_partkey", lb.accession(n).alias("accession"))


@query("e06_leading_integer", "select o_orderkey, substr(o_orderpriority, 1, 1)::int lead from orders")
def _e06(t):
    return t.raw("orders").select("o_orderkey", lb.leading_integer("o_orderpriority").alias("lead"))


EQ = "'CHEBI:'||p_size||' + CHEBI:'||(p_partkey % 50)||' = CHEBI:'||(p_partkey % 30)"


def equations(t):
    k = F.col("p_partkey")
    text = F.concat(F.lit("CHEBI:"), F.col("p_size"), F.lit(" + CHEBI:"), k % 50, F.lit(" = CHEBI:"), k % 30)
    left, right = lb.equation_sides(text, "CHEBI:[0-9]+")
    return t.raw("part").select("p_partkey", left.alias("l"), right.alias("r"))


@query("e07_equation_sides", "select p_partkey, 'CHEBI:'||p_size||','||'CHEBI:'||(p_partkey % 50) left_side, 'CHEBI:'||(p_partkey % 30) right_side from part")
def _e07(t):
    return equations(t).select("p_partkey", F.array_join("l", ",").alias("left_side"), F.array_join("r", ",").alias("right_side"))


SIDES = "array_to_string(list_sort(['CHEBI:'||p_size, 'CHEBI:'||(p_partkey % 50)]), ',') a, 'CHEBI:'||(p_partkey % 30) b"


@query("e08_order_free_signature", f"select p_partkey, sha256(a||'>>'||b) directional, sha256(least(a, b)||'||'||greatest(a, b)) directionless from (select p_partkey, {SIDES} from part)")
def _e08(t):
    return equations(t).select("p_partkey", lb.signature("l", "r").alias("directional"), lb.signature("l", "r", False).alias("directionless"))


@query("e09_jaccard_of_sets", """select p.query_id, round(len(list_intersect(p.l, t.l))::double/len(list_distinct(list_concat(p.l, t.l))), 9) jaccard from (select query_id, list(distinct l4) l from v_pairs join v_refs using (reference_id) group by 1) p
    join (select query_id, list(label) l from v_truth where endpoint = 'L4' group by 1) t using (query_id)""")
def _e09(t):
    # one row per (query, label) with the side it is on; counts replace the sets
    p = t.pairs.join(t.refs.select("reference_id", "l4"), "reference_id").select("query_id", F.col("l4").alias("label"), F.lit(1).alias("p"), F.lit(0).alias("q"))
    q = t.truth.where(F.col("endpoint") == "L4").select("query_id", "label", F.lit(0).alias("p"), F.lit(1).alias("q"))
    each = p.unionByName(q).groupBy("query_id", "label").agg(F.max("p").alias("p"), F.max("q").alias("q"))
    n = each.groupBy("query_id").agg(F.max("p").alias("some_p"), F.max("q").alias("some_q"), F.sum(F.col("p") * F.col("q")).alias("both"), F.count("*").alias("any"))
    return n.where("some_p = 1 and some_q = 1").select("query_id", F.round(F.col("both") / F.col("any"), 9).alias("jaccard"))


@query("e10_cosine_of_vectors", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def _e10(t):
    e = t.raw("embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(lb.cosine("embedding", "other"), 6).alias("cosine"))


ALPHABET = "acdefghiklmnpqrstvwy"


@query("e11_symbol_composition", "select doc_id, round(coalesce(na::double/nullif(tot, 0), 0), 9) share_a, round(coalesce(ne::double/nullif(tot, 0), 0), 9) share_e, (tot > 0)::int has_symbols from (select doc_id, length(text) - length(replace(text, 'a', '')) na, length(text) - length(replace(text, 'e', '')) ne, "
       + " + ".join(f"length(text) - length(replace(text, '{s}', ''))" for s in ALPHABET) + " tot from documents)")
def _e11(t):
    v = t.raw("documents").select("doc_id", lb.composition("text", ALPHABET).alias("v"))
    at = lambda s: F.element_at("v", ALPHABET.index(s) + 1)
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return v.select("doc_id", F.round(at("a"), 9).alias("share_a"), F.round(at("e"), 9).alias("share_e"), (total > 0.5).cast("int").alias("has_symbols"))


@query("e12_length_ratio_and_log", "select query_id, reference_id, round(least(qty, cluster_id)/greatest(qty, cluster_id), 9) ratio, least(qty, cluster_id) shorter, round(ln(1 + greatest(price - 50000, 0)), 8) log_excess from v_pairs join v_refs using (reference_id)")
def _e12(t):
    p = t.pairs.join(t.refs.select("reference_id", "cluster_id"), "reference_id")
    return p.select("query_id", "reference_id", F.round(lb.length_ratio("qty", "cluster_id"), 9).alias("ratio"), F.least("qty", F.col("cluster_id").cast("double")).alias("shorter"),
                    F.round(lb.log1p_clip(F.col("price") - 50000), 8).alias("log_excess"))


@query("e13_length_bins", "select case when n_chars <= 150 then '0001-0150' when n_chars <= 250 then '0151-0250' when n_chars <= 400 then '0251-0400' when n_chars <= 600 then '0401-0600' when n_chars <= 1000 then '0601-1000' else '1001+' end bin, count(*) docs from documents group by 1")
def _e13(t):
    return t.raw("documents").groupBy(lb.length_bin("n_chars").alias("bin")).agg(F.count("*").alias("docs"))


@query("e14_strata", """select tax, fam, struct_, count(*) items from (select case when upper(p_name) like '%RED%' then 'RED' when upper(p_name) like '%BLUE%' then 'BLUE' else 'OTHER_OR_UNKNOWN' end tax,
    case when p_size % 5 = 0 then 'NO_FAMILY' when p_size % 3 = 0 then 'FAMILY_NO_CLAN' else 'FAMILY_WITH_CLAN' end fam, case when p_retailprice > 950 then 'EXPERIMENTAL' when p_size > 25 then 'PREDICTED_ONLY' else 'NO_STRUCTURE' end struct_ from part) group by 1, 2, 3""")
def _e14(t):
    p = t.raw("part").select(
        lb.taxonomy_stratum("p_name", ["RED", "BLUE"]).alias("tax"),
        lb.family_stratum(F.when(F.col("p_size") % 5 != 0, F.col("p_brand")), F.when(F.col("p_size") % 3 == 0, "no_clan").otherwise(F.col("p_type"))).alias("fam"),
        lb.structure_stratum(F.col("p_retailprice") > 950, F.col("p_size") > 25).alias("struct_"))
    return p.groupBy("tax", "fam", "struct_").agg(F.count("*").alias("items"))


@query("e15_evidence_tier", """select tier, count(*) queries from (select case when bool_or(flag = 'R') then 'GOLD' when bool_or(flag = 'A') then 'SILVER' when count(flag) > 0 then 'OTHER' else 'UNATTRIBUTED' end tier from v_queries left join v_hits using (query_id) group by query_id) group by 1""")
def _e15(t):
    codes = t.hits.select("query_id", "flag").distinct().groupBy("query_id").agg(F.collect_set("flag").alias("codes"))
    q = t.queries.select("query_id").join(codes, "query_id", "left")
    return q.groupBy(lb.evidence_tier("codes", ["R"], ["A"]).alias("tier")).agg(F.count("*").alias("queries"))


COF = """case when {x} like '%nad%' then 'NAD_OR_NADP' when {x} like '%flavin%' or {x} like '%fad%' or {x} like '%fmn%' then 'FLAVIN' when {x} like '%coenzyme a%' or {x} like '%coa%' then 'COENZYME_A'
    when {x} like '%atp%' or {x} like '%adenosine triphosphate%' then 'ATP' when regexp_matches({x}, 'iron|zinc|magnesium|manganese|copper|cobalt') then 'METAL' else 'NONE_OR_OTHER' end"""


@query("e16_keyword_class", f"select {COF.format(x='lower(text)')} class, count(*) docs from documents group by 1")
def _e16(t):
    return t.raw("documents").groupBy(lb.keyword_class("text", lb.COFACTORS, "NONE_OR_OTHER").alias("class")).agg(F.count("*").alias("docs"))


@query("e17_currency_share", "select query_id, round(avg((flag in ('R','N'))::int), 9) share from v_hits group by 1 union all select query_id, 0.0 from v_queries where query_id not in (select query_id from v_hits)")
def _e17(t):
    v = t.hits.groupBy("query_id").agg(F.avg(F.col("flag").isin("R", "N").cast("int")).alias("share"))
    q = t.queries.select("query_id").join(v, "query_id", "left")
    return q.select("query_id", F.round(F.coalesce("share", F.lit(0.0)), 9).alias("share"))


STATUS_SQL = {"v_entry": """select p_partkey raw_id, case when p_size % 6 = 0 then 'TRANSFERRED' when p_size % 7 = 0 then 'DELETED' else 'ACTIVE' end status, case when p_size % 6 = 0 and p_partkey % 2 = 0 then p_partkey + 1 when p_size % 6 <> 0 and p_size % 7 <> 0 then p_partkey end canonical from part where p_partkey % 10 <> 0"""}


@query("e18_label_status_and_replacement", """select coalesce(e.status, 'NOT_IN_CATALOGUE') mapping_status, (case when e.raw_id is null then p.reference_id else e.canonical end is not null)::int resolved, count(*) pairs from v_pairs p left join v_entry e on e.raw_id = p.reference_id group by 1, 2""", STATUS_SQL)
def _e18(t):
    from labeltrail.operators.labels_table import catalogue_status, resolve_labels

    p = t.raw("part").where(F.col("p_partkey") % 10 != 0)
    moved = F.concat(F.lit("Transferred entry: "), F.col("p_partkey") + 1, F.when(F.col("p_partkey") % 2 != 0, F.concat(F.lit(" and "), F.col("p_partkey") + 2)).otherwise(F.lit("")))
    text = F.when(F.col("p_size") % 6 == 0, moved).when(F.col("p_size") % 7 == 0, "Deleted entry.").otherwise(F.col("p_name"))
    cat = catalogue_status(p.select(F.col("p_partkey").cast("string").alias("raw_id"), text.alias("description")), r"\b[0-9]+\b")
    rows = t.pairs.select(F.col("reference_id").cast("string").alias("raw_id"))
    r = resolve_labels(rows, cat, r"^[0-9]+$")
    return r.groupBy("mapping_status", F.col("canonical").isNotNull().cast("int").alias("resolved")).agg(F.count("*").alias("pairs"))


@query("e19_multi_id_resolution", """with i as (select p.query_id, r.l4 master from v_pairs p left join v_refs r on r.reference_id = p.reference_id and r.exact is not null)
    select query_id, case when count(distinct master) = 1 then min(master) end canonical, case when count(distinct master) = 1 then 'CANONICALIZED' when count(distinct master) > 1 then 'MULTIPLE_MASTERS' when count(i.query_id) > 0 then 'UNMAPPED' else 'NO_RAW_ID' end status
    from v_queries q left join i using (query_id) group by 1""".replace("count(i.query_id)", "count(i.query_id)"))
def _e19(t):
    from labeltrail.operators.labels_table import resolve_multi

    ids = t.pairs.select("query_id", F.col("reference_id").alias("raw_id"))
    m = t.refs.where(F.col("exact").isNotNull()).select(F.col("reference_id").alias("raw_id"), F.col("l4").alias("master"))
    return resolve_multi(t.queries, ids, m)


@query("e20_hash_to_unit_interval", "select o_custkey, ('0x'||substr(sha256('seed|'||o_custkey),1,16))::ubigint::varchar u64, round(('0x'||substr(sha256('seed|'||o_custkey),1,16))::ubigint::double/18446744073709551616.0, 12) unit from orders group by 1")
def _e20(t):
    k = key_text("seed", F.col("o_custkey"))
    return t.raw("orders").select("o_custkey").distinct().select("o_custkey", u64(k).cast("string").alias("u64"), F.round(unit_interval(k), 12).alias("unit"))


@query("e21_key_text", "select query_id, reference_id, 'pair|'||query_id||'|'||reference_id||'|'||coalesce(exact, '') key from v_pairs join v_refs using (reference_id)")
def _e21(t):
    p = t.pairs.join(t.refs.select("reference_id", "exact"), "reference_id")
    return p.select("query_id", "reference_id", key_text("pair", F.col("query_id"), F.col("reference_id"), F.col("exact")).alias("key"))


@query("e22_sorted_json_array", "select query_id, to_json(list_sort(list(label)))::varchar labels from v_truth where endpoint = 'L4' group by 1")
def _e22(t):
    return t.truth.where(F.col("endpoint") == "L4").groupBy("query_id").agg(lb.sorted_json(F.collect_set("label")).alias("labels"))


@query("e23_stable_sigmoid", "select query_id, round(case when z >= 0 then 1/(1+exp(-z)) else exp(z)/(1+exp(z)) end, 9) p from (select query_id, (total - 250000)/20000 z from v_queries)")
def _e23(t):
    return t.queries.select("query_id", F.round(sigmoid((F.col("total") - 250000) / 20000), 9).alias("p"))


@query("e24_any_flag", "select query_id, reference_id, (same_l3 or same_l4 or coalesce(same_exact, false) or disc > 0.09)::int any_flag from v_scored")
def _e24(t):
    return t.scored.select("query_id", "reference_id", lb.any_flag("same_l3", "same_l4", "same_exact", F.col("disc") > 0.09).cast("int").alias("any_flag"))


@query("e25_primary_id", "select query_id, coalesce(min(label), 'UNASSIGNED') primary_id from v_queries left join (select query_id, label from v_truth where endpoint = 'EXACT') using (query_id) group by 1")
def _e25(t):
    ids = t.truth.where(F.col("endpoint") == "EXACT").groupBy("query_id").agg(F.collect_set("label").alias("ids"))
    return t.queries.select("query_id").join(ids, "query_id", "left").select("query_id", lb.first_id("ids").alias("primary_id"))


@query("e27_weighted_blend", """select query_id, reference_id, round((0.5*raw + 0.25*coalesce(a, 0) + 0.25*coalesce(b, 0)) / (0.5 + case when a is null then 0 else 0.25 end + case when b is null then 0 else 0.25 end)::double, 9) blend
    from (select *, case when disc <= 0.05 then ident end a, case when tax <= 0.04 then 1 - tax end b from v_scored)""")
def _e27(t):
    a, b = F.when(F.col("disc") <= 0.05, F.col("ident")), F.when(F.col("tax") <= 0.04, 1 - F.col("tax"))
    return t.scored.select("query_id", "reference_id", F.round(lb.blend([(F.col("raw"), 0.5), (a, 0.25), (b, 0.25)]), 9).alias("blend"))


@query("e28_non_increasing_probabilities", """select query_id, reference_id, ident p3, least(ident, coalesce(raw4, ident)) p4, least(ident, coalesce(raw4, ident), raw) px from (select *, case when disc <= 0.05 then raw * 2 end raw4 from v_scored)""")
def _e28(t):
    raw4 = F.when(F.col("disc") <= 0.05, F.col("raw") * 2)
    return t.scored.select("query_id", "reference_id", F.col("ident").alias("p3"), F.least("ident", raw4).alias("p4"), F.least("ident", raw4, "raw").alias("px"))
