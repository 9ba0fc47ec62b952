"""Joins with a stated multiplicity, coverage reports and release maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltrail.functions.measures import n_if
from labeltrail.operators.checks import duplicate_keys, require_empty
from labeltrail.operators.ranking import top_one


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join whose right side must hold each key once (checked)."""
    require_empty(duplicate_keys(right, keys), f"right side repeats {keys}")
    return left.join(right, keys, how)


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    require_empty(duplicate_keys(left, keys), f"left side repeats {keys}")
    return many_to_one(left, right, keys, how)


def bind_candidates(candidates: DataFrame, bundle: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Bind every candidate to one declared row and compare the labels both carry."""
    b = bundle.select(*keys, *[F.col(c).alias("bound_" + c) for c in labels], F.lit(True).alias("_hit"))
    j = many_to_one(candidates, b, keys)
    agree = None
    for c in labels:
        e = F.col(c).eqNullSafe(F.col("bound_" + c))
        agree = e if agree is None else agree & e
    bound = F.coalesce("_hit", F.lit(False))
    status = F.when(~bound, "UNBOUND").when(agree, "BOUND_AGREES").otherwise("BOUND_DISAGREES")
    return j.withColumn("binding", status).drop("_hit")


def unique_mapping(rows: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Target of a key when there is exactly one, with the basis of the decision.

    Minimum and maximum decide uniqueness, so no set of targets is collected.
    """
    g = rows.where(F.col(target).isNotNull()).groupBy(*keys).agg(F.min(target).alias("_lo"), F.max(target).alias("_hi"))
    one = F.col("_lo") == F.col("_hi")
    return g.select(*keys, F.when(one, F.col("_lo")).alias(target), F.when(one, "UNIQUE_MAPPING").otherwise("AMBIGUOUS_MAPPING").alias("basis"))


def reconcile(planned: DataFrame, received: DataFrame, keys: list[str], shard: str) -> DataFrame:
    """Missing, unexpected and wrong-shard keys of received work against the plan."""
    p = planned.select(*keys, F.col(shard).alias("planned_shard"), F.lit(1).alias("_p"))
    r = received.select(*keys, F.col(shard).alias("received_shard"), F.lit(1).alias("_r"))
    j = p.join(r, keys, "full_outer")
    problem = (F.when(F.col("_r").isNull(), "MISSING").when(F.col("_p").isNull(), "UNEXPECTED")
               .when(F.col("planned_shard") != F.col("received_shard"), "WRONG_SHARD"))
    return j.select(*keys, problem.alias("problem")).where(F.col("problem").isNotNull())


def audit_tasks(tasks: DataFrame, receipts: DataFrame, key: str) -> DataFrame:
    """Status of each planned task: received once and complete, or what went wrong."""
    r = receipts.groupBy(key).agg(F.count("*").alias("receipts"), F.max("rows").alias("rows"), F.max("truncated").alias("truncated"))
    j = tasks.join(r, key, "full_outer")
    n = F.coalesce("receipts", F.lit(0))
    status = (F.when(F.col("expected_rows").isNull(), "UNPLANNED").when(n == 0, "MISSING").when(n > 1, "DUPLICATE")
              .when(F.col("truncated"), "TRUNCATED").when(F.col("rows") != F.col("expected_rows"), "INCOMPLETE").otherwise("COMPLETE"))
    return j.select(key, status.alias("status"))


def union_with_origin(retrieval: DataFrame, augmentation: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Full outer union of two pair tables; shared payload must agree null-safely."""
    a = retrieval.select(*keys, *[F.col(c).alias("r_" + c) for c in payload], F.lit(1).alias("_r"))
    b = augmentation.select(*keys, *[F.col(c).alias("g_" + c) for c in payload], F.lit(1).alias("_g"))
    j = a.join(b, keys, "full_outer")
    r, g = F.col("_r").isNotNull(), F.col("_g").isNotNull()
    same = None
    for c in payload:
        e = F.col("r_" + c).eqNullSafe(F.col("g_" + c))
        same = e if same is None else same & e
    origin = F.when(r & g, "BOTH").when(r, "RETRIEVAL").otherwise("AUGMENTATION")
    return j.select(*keys, origin.alias("origin"), *[F.when(r, F.col("r_" + c)).otherwise(F.col("g_" + c)).alias(c) for c in payload],
                    (~(r & g) | same).cast("int").alias("payload_agrees"))


def resolve_aliases(aliases: DataFrame, names: DataFrame, alias_columns: list[str]) -> DataFrame:
    """Node of each name reached through any of its alias forms; ambiguous names are marked.

    aliases: (alias, node_id); names: (name, alias forms...).
    """
    forms = F.explode(F.array_distinct(F.array(*[F.col(c) for c in alias_columns]))).alias("alias")
    hits = names.select("name", forms).join(aliases.select("alias", "node_id").distinct(), "alias").groupBy("name").agg(
        F.min("node_id").alias("_lo"), F.max("node_id").alias("_hi"))
    out = names.select("name").distinct().join(hits, "name", "left")
    status = (F.when(F.col("_lo").isNull(), "UNKNOWN").when(F.col("_lo") == F.col("_hi"), "RESOLVED").otherwise("AMBIGUOUS"))
    return out.select("name", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("node_id"), status.alias("status"))


def group_representative(groups: DataFrame, members: DataFrame, key: str, order: list[tuple[str, str]]) -> DataFrame:
    """One deterministic member per group; groups without any are listed as unavailable."""
    best = top_one(members, [key], order)
    return groups.select(key).distinct().join(best, key, "left").withColumn(
        "status", F.when(F.col(order[0][0]).isNull(), "UNAVAILABLE").otherwise("SELECTED"))


#: The relations users compare between releases.
STABLE, REVISED, TURNED = "stable_id_stable_chemistry", "stable_id_chemistry_revision", "direction_change"
SPLIT, MERGED, RENAMED = "split", "merge", "chemistry_equivalent_id_change"
OBSOLETE, NOVEL = "obsolete_without_exact_replacement", "genuinely_novel_chemistry"


def release_map(source: DataFrame, target: DataFrame) -> DataFrame:
    """Relation of each source entity to the next release, and of each target entity without a source.

    Tables: (entity_id, hash_any, hash_directed); hash_any ignores direction.  Ids present
    in both releases are compared; the others are looked up by hash, where several targets
    mean a split and several sources of one hash a merge.  A target that no source led to is told by the sources of its
    hash: none makes it novel, one a change of id, more a merge; a null hash has none.
    """
    s = source.select(F.col("entity_id").alias("source_id"), F.col("hash_any").alias("s_any"), F.col("hash_directed").alias("s_dir"))
    t = target.select(F.col("entity_id").alias("target_id"), F.col("hash_any").alias("t_any"), F.col("hash_directed").alias("t_dir"))
    same = s.join(t, s.source_id == t.target_id, "left")
    by_id = same.where(F.col("target_id").isNotNull()).select(
        "source_id", "target_id", F.when(~F.col("s_any").eqNullSafe(F.col("t_any")), REVISED)
        .when(~F.col("s_dir").eqNullSafe(F.col("t_dir")), TURNED).otherwise(STABLE).alias("relation"))
    rest = same.where(F.col("target_id").isNull()).select("source_id", "s_any")
    n_src = s.where(F.col("s_any").isNotNull()).groupBy("s_any").agg(F.count("*").alias("n_sources"))
    n_tgt = t.where(F.col("t_any").isNotNull()).groupBy(F.col("t_any").alias("s_any")).agg(F.count("*").alias("n_targets"))
    found = rest.join(n_src, "s_any", "left").join(n_tgt, "s_any", "left")
    relation = (F.when(F.col("n_targets").isNull(), OBSOLETE).when(F.col("n_targets") > 1, SPLIT)
                .when(F.col("n_sources") > 1, MERGED).otherwise(RENAMED))
    found = found.withColumn("relation", relation)
    pairs = found.where(F.col("relation") != OBSOLETE).join(
        t.select(F.col("t_any").alias("s_any"), "target_id"), "s_any").select("source_id", "target_id", "relation")
    gone = found.where(F.col("relation") == OBSOLETE).select("source_id", F.lit(None).cast("bigint").alias("target_id"), "relation")
    old = by_id.unionByName(pairs).unionByName(gone)
    left = t.select("target_id", "t_any").join(old.select("target_id").where("target_id is not null").distinct(), "target_id", "left_anti")
    left = left.join(n_src.withColumnRenamed("s_any", "t_any"), "t_any", "left")
    new = left.select(F.lit(None).cast("bigint").alias("source_id"), "target_id",
                      F.when(F.col("n_sources").isNull(), NOVEL).when(F.col("n_sources") > 1, MERGED).otherwise(RENAMED).alias("relation"))
    return old.unionByName(new)


def release_lookup(cross: DataFrame, accepted: list[str]) -> DataFrame:
    """Target of a source id when it has exactly one by accepted relations, else why not."""
    g = cross.groupBy("source_id").agg(
        F.min("target_id").alias("_lo"), F.max("target_id").alias("_hi"),
        F.max((~F.col("relation").isin(accepted)).cast("int")).alias("_bad"),
        F.array_join(F.array_sort(F.collect_set("relation")), "+").alias("_rel"))  # a handful of relation names
    ok = F.col("_lo").isNotNull() & (F.col("_lo") == F.col("_hi")) & (F.col("_bad") == 0)
    return g.select("source_id", F.when(ok, F.col("_lo")).alias("target_id"),
                    F.when(ok, F.col("_rel")).otherwise(F.concat(F.lit("UNRESOLVED:"), F.col("_rel"))).alias("status"))


def release_membership(current: DataFrame, t0: DataFrame, t1: DataFrame, key: str, content: str) -> DataFrame:
    """Presence and content stability over two earlier releases."""
    j = current.select(key).join(t0.select(key, F.col(content).alias("_0")), key, "left").join(
        t1.select(key, F.col(content).alias("_1")), key, "left")
    a, b = F.col("_0").isNotNull(), F.col("_1").isNotNull()
    cls = (F.when(a & b & (F.col("_0") == F.col("_1")), "T0_T1_STABLE").when(a & b, "T0_T1_CHANGED").when(~a & b, "NEW_IN_T1")
           .when(a & ~b, "ABSENT_IN_T1").otherwise("NEW_AFTER_T1"))
    return j.select(key, cls.alias("membership"))


def library_miss(queries: DataFrame, top: DataFrame, references: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Why a query's nearest reference emitted no label, per level."""
    r = references.select("reference_id", *labels.values(), F.lit(True).alias("_known"))
    j = queries.select("query_id").join(top.select("query_id", "reference_id", F.lit(True).alias("_hit")), "query_id", "left").join(
        r, "reference_id", "left")
    items = F.inline(F.array(*[F.struct(F.lit(k).alias("endpoint"), F.col(c).alias("label")) for k, c in labels.items()]))
    j = j.select("query_id", "_hit", "_known", items)
    reason = (F.when(F.col("_hit").isNull(), "NO_HIT").when(F.col("_known").isNull(), "NO_REFERENCE_ACTIVITY")
              .when(F.col("label").isNull(), "NO_LEVEL_ANNOTATION").otherwise("EMITTED"))
    return j.select("query_id", "endpoint", "label", reason.alias("reason"))


def direct_pair_plan(pairs: DataFrame, first_keys: DataFrame, second_keys: DataFrame, shards: int) -> DataFrame:
    """Distinct pairs with row counts, keys of two search databases, availability and shard."""
    from labeltrail.functions.hashing import bucket, key_text
    from labeltrail.functions.states import availability_pair

    p = pairs.groupBy("query_id", "reference_id").agg(F.count("*").alias("activity_rows"))
    f, s = first_keys.select("node_id", F.col("db_key").alias("_k")), second_keys.select("node_id", F.col("db_key").alias("_k"))
    for keys, name in ((f, "first"), (s, "second")):
        for side in ("query", "reference"):
            p = p.join(keys.withColumnsRenamed({"node_id": f"{side}_id", "_k": f"{name}_{side}_key"}), f"{side}_id", "left")
    return p.withColumns({
        "second_state": availability_pair(F.col("second_query_key").isNotNull(), F.col("second_reference_key").isNotNull()),
        "shard": bucket(key_text("first", F.col("query_id"), F.col("reference_id")), shards)})


def position_map(alignments: DataFrame, sites: DataFrame) -> DataFrame:
    """Query position aligned to each wanted reference position.

    alignments: (pair_id, query_start, reference_start, query_alignment, reference_alignment),
    gaps as `-`; sites: (pair_id, position).  Positions count non-gap symbols, so the query
    position at alignment column i is start - 1 + non-gap symbols among the first i.
    """
    ok = (F.length("query_alignment") > 0) & (F.length("query_alignment") == F.length("reference_alignment"))
    columns = F.sequence(F.lit(1), F.length("reference_alignment"))
    symbols = F.filter(columns, lambda i: F.substring(F.col("reference_alignment"), i, F.lit(1)) != "-")  # columns that hold a reference position
    a = alignments.select("pair_id", "query_start", "reference_start", "query_alignment", "reference_alignment",
                          ok.alias("_ok"), F.when(ok, symbols).alias("_at"))
    # Looked up in the alignment's own row: the symbols of all alignments are never a table that a size estimate could broadcast.
    out = sites.join(a.hint("merge"), "pair_id", "left")
    back = F.col("position") - F.col("reference_start")
    out = out.withColumn("_i", F.when(back.between(0, F.size("_at") - 1), F.get("_at", back.cast("int"))))
    upto = F.length(F.replace(F.substring(F.col("query_alignment"), F.lit(1), F.col("_i")), F.lit("-"), F.lit("")))
    at = lambda c: F.substring(F.col(c), F.col("_i"), F.lit(1))
    out = out.withColumns({"_q": F.col("query_start") - 1 + upto, "query_symbol": at("query_alignment"), "reference_symbol": at("reference_alignment")})
    gap = F.col("query_symbol") == "-"
    status = (F.when(~F.coalesce("_ok", F.lit(False)), "NO_VALID_BACKTRACE").when(F.col("query_symbol").isNull(), "REFERENCE_SITE_OUTSIDE_ALIGNMENT")
              .when(gap, "REFERENCE_SITE_ALIGNS_TO_QUERY_GAP").otherwise("PASS"))
    return out.select("pair_id", "position", F.when(~gap, F.col("_q")).alias("query_position"), F.when(~gap, F.col("query_symbol")).alias("query_symbol"),
                      "reference_symbol", status.alias("status"))


def domains_per_query(queries: DataFrame, calls: DataFrame, clans: DataFrame, seen: DataFrame) -> DataFrame:
    """Sorted domain list of a query, its first domain and clan, and whether training saw them."""
    d = calls.select("query_id", "domain").distinct().groupBy("query_id").agg(
        F.array_sort(F.collect_set("domain")).alias("domains"), F.count("*").alias("domain_count"))
    out = queries.select("query_id").join(d, "query_id", "left").withColumn(
        "primary_domain", F.coalesce(F.array_min("domains"), F.lit("__MISSING__")))
    out = out.join(clans.select(F.col("domain").alias("primary_domain"), "clan"), "primary_domain", "left")
    out = out.join(seen.select(F.col("domain").alias("primary_domain"), F.lit(True).alias("_s")).distinct(), "primary_domain", "left")
    missing = F.col("primary_domain") == "__MISSING__"
    return out.select("query_id", F.array_join(F.coalesce("domains", F.array().cast("array<string>")), ";").alias("domains"),
                      F.coalesce("domain_count", F.lit(0)).alias("domain_count"), "primary_domain",
                      F.when(missing, "__MISSING__").otherwise(F.coalesce("clan", F.lit("UNASSIGNED"))).alias("clan"),
                      F.coalesce("_s", F.lit(False)).cast("int").alias("seen_in_fit"))
