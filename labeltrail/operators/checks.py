"""Table checks: each returns a small report; `require_empty` turns one into an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labeltrail.functions.measures import n_if


def require_columns(df: DataFrame, names: list[str], table: str = "table") -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{table} lacks columns {missing}")
    return df


def reject_columns(df: DataFrame, exact: list[str], parts: list[str] = (), table: str = "table") -> DataFrame:
    """Refuse columns that would leak documented outcomes into features."""
    low = {x.lower() for x in exact}
    bad = sorted(x for x in df.columns if x.lower() in low or any(p.lower() in x.lower() for p in parts))
    if bad:
        raise ValueError(f"{table} carries outcome columns {bad}")
    return df


def require_empty(report: DataFrame, message: str) -> None:
    """Raise with a few example rows unless the report is empty."""
    sample = report.take(3)
    if sample:
        raise ValueError(f"{message}: {[r.asDict() for r in sample]}")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def key_inventory(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Keys that are absent from at least one of the tables."""
    out = None
    for name, df in tables.items():
        k = df.select(*keys).distinct().withColumn("in_" + name, F.lit(1))
        out = k if out is None else out.join(k, keys, "full_outer")
    flags = ["in_" + n for n in tables]
    out = out.fillna(0, flags)
    total = sum((F.col(f) for f in flags), F.lit(0))
    return out.where(total < len(flags))


def range_report(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Nulls, non-finite and out-of-range counts per column, in one pass."""
    def bad(x):
        v = F.col(x).cast("double")
        finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
        return [F.count(F.when(F.col(x).isNull(), 1)), n_if(v.isNotNull() & ~finite), n_if(finite & ((v < low) | (v > high)))]

    row = df.agg(*[e.alias(f"{x}__{k}") for x in columns for k, e in zip(("nulls", "not_finite", "outside"), bad(x))])
    items = F.array(*[F.struct(F.lit(x).alias("column"), *[F.col(f"{x}__{k}").alias(k) for k in ("nulls", "not_finite", "outside")])
                      for x in columns])
    return row.select(F.inline(items))


def violations(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """(key, rule) rows for each rule that does not hold; null counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(broken).alias("rule"))


def alignment_rules(tolerance: float = 0.00101) -> dict[str, Column]:
    """Coordinates inside lengths, ratios in 0..1, coverages equal to their recomputation."""
    col = F.col
    qspan, tspan = col("qend") - col("qstart") + 1, col("tend") - col("tstart") + 1
    return {
        "identity_range": col("fident").between(0, 1), "qcov_range": col("qcov").between(0, 1),
        "tcov_range": col("tcov").between(0, 1),
        "query_coordinates": (col("qstart") >= 1) & (col("qend") >= col("qstart")) & (col("qend") <= col("qlen")),
        "target_coordinates": (col("tstart") >= 1) & (col("tend") >= col("tstart")) & (col("tend") <= col("tlen")),
        "alignment_length": col("alnlen") >= F.greatest(qspan, tspan),
        "qcov_recomputed": F.abs(col("qcov") - qspan / col("qlen")) <= tolerance,
        "tcov_recomputed": F.abs(col("tcov") - tspan / col("tlen")) <= tolerance}


def roles_per_component(df: DataFrame, component: str, role: str, roles: list[str]) -> DataFrame:
    """Components in several roles plus roles without any component."""
    multi = df.groupBy(component).agg(F.count_distinct(role).alias("n")).where(F.col("n") > 1).select(
        F.lit("component_in_several_roles").alias("problem"), F.col(component).cast("string").alias("item"))
    seen = df.select(F.col(role).alias("item")).distinct()
    want = df.sparkSession.createDataFrame([(r,) for r in roles], "item string")
    return multi.unionByName(want.join(seen, "item", "left_anti").select(F.lit("role_without_items").alias("problem"), "item"))


def groups_spanning_splits(df: DataFrame, groups: dict[str, str], split: str) -> DataFrame:
    """Per grouping: number of groups and how many of them sit in more than one split."""
    parts = None
    for kind, column in groups.items():
        p = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count_distinct(split).alias("n")).agg(
            F.count("*").alias("groups"), n_if(F.col("n") > 1).alias("leaking")).withColumn("kind", F.lit(kind))
        parts = p if parts is None else parts.unionByName(p)
    return parts.select("kind", "groups", "leaking")


def conservation(df: DataFrame, kept: Column, reasons: dict[str, Column]) -> DataFrame:
    """Rows in, kept and dropped per first matching reason; `balanced` says they add up."""
    reason = None
    for k, cond in reasons.items():
        reason = F.when(cond, k) if reason is None else reason.when(cond, k)
    named = df.select(kept.alias("_kept"), reason.otherwise("unexplained").alias("_why"))
    out = named.agg(F.count("*").alias("rows_in"), n_if("_kept").alias("kept"), *[
        n_if(~F.col("_kept") & (F.col("_why") == k)).alias("dropped_" + k) for k in reasons])
    total = sum((F.col("dropped_" + k) for k in reasons), F.col("kept"))
    return out.withColumn("balanced", (total == F.col("rows_in")).cast("int"))


def length_identity_filter(hits: DataFrame, ledger: DataFrame) -> DataFrame:
    """Keep hits whose two lengths equal the ledger's."""
    q = ledger.select(F.col("node_id").alias("query_node"), F.col("length").alias("qlen"))
    r = ledger.select(F.col("node_id").alias("reference_node"), F.col("length").alias("tlen"))
    return hits.join(q, ["query_node", "qlen"], "left_semi").join(r, ["reference_node", "tlen"], "left_semi")


def equal_in_equal_out(df: DataFrame, by: list[str], raw: str, cal: str) -> DataFrame:
    """Raw scores that map to several calibrated scores."""
    return df.groupBy(*by, raw).agg(F.count_distinct(cal).alias("outputs")).where(F.col("outputs") > 1)


def tolerant_difference(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], rtol: float = 1e-10,
                        atol: float = 1e-10) -> DataFrame:
    """Cells that differ beyond rtol/atol; NaN equals NaN and null equals null."""
    x = a.select(*keys, *[F.col(c).alias("a_" + c) for c in columns], F.lit(1).alias("_a"))
    y = b.select(*keys, *[F.col(c).alias("b_" + c) for c in columns], F.lit(1).alias("_b"))
    j = x.join(y, keys, "full_outer")
    clean = lambda v: F.when(~F.isnan(v.cast("double")), v.cast("double"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), clean(F.col("a_" + c)).alias("left"), clean(F.col("b_" + c)).alias("right"))
                      for c in columns])
    long = j.select(*keys, "_a", "_b", F.explode(cells).alias("c")).select(*keys, "_a", "_b", "c.*")
    close = F.abs(F.col("left") - F.col("right")) <= atol + rtol * F.abs(F.col("right"))
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (
        (F.col("left").isNull() & F.col("right").isNull()) | F.coalesce(close, F.lit(False)))
    return long.where(~same).drop("_a", "_b")


def monotonicity_violations(df: DataFrame, by: list[str], raw: str, cal: str) -> DataFrame:
    """Steps where the calibrated value falls although the raw value rises, per group."""
    from labeltrail.operators.ranking import previous_row

    steps = df.groupBy(*by, raw).agg(F.min(cal).alias("_lo"), F.max(cal).alias("_hi"))
    p = previous_row(steps, by, [(raw, "asc")], ["_hi"])
    return p.groupBy(*by).agg(n_if(F.col("_lo") < F.col("prev__hi")).alias("violations"))


def block_starts(df: DataFrame, group: str, order: list[tuple[str, str]]) -> DataFrame:
    """How many separate runs each group forms in input order (1 = grouped input)."""
    from labeltrail.operators.ranking import previous_row

    p = previous_row(df.select(group, *[c for c, _ in order if c != group]), [], order, [group])
    start = ~F.col(group).eqNullSafe(F.col("prev_" + group))
    return p.groupBy(group).agg(n_if(start).alias("blocks"), F.count("*").alias("rows"))


def block_order_violations(df: DataFrame, group: str, order: list[tuple[str, str]]) -> DataFrame:
    """Block starts whose group id does not exceed the one before."""
    from labeltrail.operators.ranking import previous_row

    p = previous_row(df.select(group, *[c for c, _ in order if c != group]), [], order, [group])
    return p.agg(n_if(F.col(group) != F.col("prev_" + group)).alias("block_changes"),
                 n_if(F.col(group) < F.col("prev_" + group)).alias("decreasing"))


def ranked_group_problems(df: DataFrame, by: str, rank: str, raw_rank: str, component: str) -> DataFrame:
    """Groups whose ranks are not 1..n, whose raw ranks do not increase, or that repeat a component."""
    from labeltrail.operators.ranking import previous_row

    n = df.groupBy(by).agg(F.count("*").alias("n"), F.max(rank).alias("top"), F.min(rank).alias("first"),
                           F.count_distinct(component).alias("components"))
    p = previous_row(df.select(by, rank, raw_rank), [by], [(rank, "asc")], [raw_rank])
    falls = p.groupBy(by).agg(n_if(F.col(raw_rank) <= F.col("prev_" + raw_rank)).alias("falls"))
    j = n.join(falls, by)
    return j.select(by, ((F.col("first") != 1) | (F.col("top") != F.col("n"))).cast("int").alias("rank_gap"),
                    (F.col("falls") > 0).cast("int").alias("raw_rank_order"),
                    (F.col("components") < F.col("n")).cast("int").alias("repeated_component"))


def role_guard(pairs: DataFrame, roles: DataFrame, key: str, query_roles: list[str], reference_role: str) -> DataFrame:
    """Counts of pairs whose query or reference sits in a role it must not be in."""
    q = roles.select(F.col(key).alias("query_id"), F.col("role").alias("query_role"))
    r = roles.select(F.col(key).alias("reference_id"), F.col("role").alias("reference_role"))
    j = pairs.join(q, "query_id", "left").join(r, "reference_id", "left")
    ok_q = F.coalesce(F.col("query_role").isin(query_roles), F.lit(False))
    ok_r = F.coalesce(F.col("reference_role") == reference_role, F.lit(False))
    return j.agg(F.count("*").alias("pairs"), n_if(~ok_q).alias("bad_query"), n_if(~ok_r).alias("bad_reference"))


def unit_normalised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Percent columns to fractions: divide a column by 100 when its maximum exceeds 1."""
    from labeltrail.operators.ranking import attach_one_row

    top = df.agg(*[F.max(c).alias("_max_" + c) for c in columns])
    x = attach_one_row(df, top)
    return x.withColumns({c: F.when(F.col("_max_" + c) > 1, F.col(c) / 100).otherwise(F.col(c)) for c in columns}).drop(
        *["_max_" + c for c in columns])


def member_census(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Node representative against its members: coverage both ways and equal content hashes.

    nodes: (node_id, content_hash); members: (node_id, member_id, content).
    """
    m = members.select("node_id", "member_id", F.sha2("content", 256).alias("member_hash"))
    j = nodes.join(m, "node_id", "full_outer")
    status = (F.when(F.col("content_hash").isNull(), "MEMBER_WITHOUT_NODE").when(F.col("member_id").isNull(), "NODE_WITHOUT_MEMBER")
              .when(F.col("content_hash") != F.col("member_hash"), "HASH_DIFFERS").otherwise("EXACT"))
    return j.groupBy(status.alias("status")).agg(F.count("*").alias("rows"), F.count_distinct("node_id").alias("nodes"))


def raw_hit_problems(text_rows: DataFrame, numeric: list[str], signed: list[str]) -> DataFrame:
    """Unparseable, non-finite or negative raw fields per modality; signed modalities may go below zero."""
    items = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in numeric]))
    x = text_rows.select("modality", items).withColumn("v", F.col("text").try_cast("double"))
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
    may_be_negative = (F.col("field") == "bits") & F.col("modality").isin(signed)
    return x.groupBy("modality", "field").agg(
        F.count("*").alias("rows"), n_if(~finite).alias("unparseable"), n_if(finite & (F.col("v") < 0) & ~may_be_negative).alias("negative"))
