"""Support traces: where along library, candidates, retention and selection a label is lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labeltrail.functions.states import BUDGET_STATES, SET_TRACE_STATES, TRACE_STATES, first_true
from labeltrail.operators.ranking import top_one

KEY = ["query_id", "endpoint"]


def _any(cond) -> F.Column:
    return F.coalesce(F.max(cond.cast("int")), F.lit(0)) == 1


def support_trace(queries: DataFrame, library: DataFrame, candidates: DataFrame, outputs: DataFrame) -> DataFrame:
    """First missing support stage per (query, endpoint).

    Candidates are reduced per (query, endpoint, label) first, so a query with very many
    candidates is combined on the map side and never lands in one task as rows.
    """
    truth = queries.select(*KEY, F.explode("truth_labels").alias("label")).distinct()
    in_library = truth.join(library.select("endpoint", "label").distinct(), ["endpoint", "label"], "left_semi")
    lib = in_library.groupBy(*KEY).agg(F.lit(True).alias("library_match"))
    chosen = outputs.where(F.col("selected_candidate_id").isNotNull()).select(
        *KEY, F.col("selected_candidate_id").alias("candidate_id"), F.lit(True).alias("_chosen"))
    rows = candidates.join(truth.withColumn("_true", F.lit(True)), [*KEY, "label"], "left")
    rows = rows.join(chosen, [*KEY, "candidate_id"], "left")
    kept = F.when(F.col("retained"), F.col("score"))
    chosen_kept = F.col("_chosen") & F.col("retained")
    per_label = rows.groupBy(*KEY, "label").agg(
        _any(F.col("_true")).alias("is_true"), F.max(kept).alias("best"),
        F.max(F.when(chosen_kept, F.col("score"))).alias("chosen_score"), _any(chosen_kept).alias("has_chosen"))
    per_score = per_label.groupBy(*KEY, "best").agg(
        F.count(F.lit(1)).alias("n_labels"), _any(F.col("is_true")).alias("union_match"),
        _any(F.col("has_chosen")).alias("has_chosen"), F.max("chosen_score").alias("chosen_score"),
        F.max(F.when(F.col("has_chosen"), F.col("label"))).alias("chosen_label"),
        _any(F.col("has_chosen") & F.col("is_true")).alias("concordant"))
    pool = per_score.groupBy(*KEY).agg(
        _any(F.col("union_match")).alias("union_match"),
        _any(F.col("union_match") & F.col("best").isNotNull()).alias("retained_match"),
        F.max("best").alias("top"), F.max(F.when(F.col("union_match"), F.col("best"))).alias("best_true"),
        F.max_by("n_labels", "best").alias("_top"),
        _any(F.col("has_chosen")).alias("has_chosen"), F.max("chosen_score").alias("chosen_score"),
        F.max("chosen_label").alias("selected_label"), _any(F.col("concordant")).alias("concordant"))
    out = queries.select(*KEY, (F.size("truth_labels") > 0).alias("evaluable")).join(lib, KEY, "left")
    out = out.join(pool, KEY, "left").join(outputs.select(*KEY, "selected_candidate_id", "accepted"), KEY, "left")
    no = F.lit(False)
    out = out.withColumns({k: F.coalesce(k, no) for k in (
        "library_match", "union_match", "retained_match", "has_chosen", "concordant")})
    names = TRACE_STATES
    state = first_true([
        (~F.col("evaluable"), names[0]), (~F.col("library_match"), names[1]), (~F.col("union_match"), names[2]),
        (~F.col("retained_match"), names[3]), (~F.col("has_chosen"), names[4]), (F.col("concordant"), names[5]),
        ((F.col("chosen_score") == F.col("top")) & (F.col("best_true") == F.col("top")), names[6]),
        (F.col("chosen_score") > F.col("best_true"), names[7])], names[8])
    as_int = lambda c: F.col(c).cast("int")
    return out.select(
        *KEY, state.alias("state"), as_int("evaluable").alias("evaluable"),
        as_int("library_match").alias("library_match"), as_int("union_match").alias("saved_union_match"),
        as_int("retained_match").alias("retained_match"), "selected_candidate_id",
        F.when(F.col("has_chosen"), F.col("selected_label")).alias("selected_label"),
        F.when(F.col("evaluable") & F.col("has_chosen"), as_int("concordant")).alias("selected_concordant"),
        F.coalesce("_top", F.lit(0)).alias("top_score_labels"), as_int("accepted").alias("accepted"))


def set_trace(
    truth: DataFrame, library: DataFrame, candidate_labels: DataFrame, output_labels: DataFrame,
    queries: DataFrame, retained_limit: int,
) -> DataFrame:
    """Set-valued trace: candidates and outputs may carry several labels each.

    candidate_labels has (query, endpoint, rank, label) rows, output_labels (query, endpoint, label).
    """
    t = truth.select(*KEY, "label").distinct()
    n_true = t.groupBy(*KEY).agg(F.count(F.lit(1)).alias("truth_count"))
    lib = t.join(library.select("endpoint", "label").distinct(), ["endpoint", "label"], "left_semi")
    lib = lib.groupBy(*KEY).agg(F.lit(1).alias("library_match"))
    first = candidate_labels.join(t, [*KEY, "label"], "left_semi").groupBy(*KEY).agg(
        F.min("rank").alias("first_matching_rank"))
    outs = output_labels.select(*KEY, "label").distinct().join(
        t.withColumn("_true", F.lit(1)), [*KEY, "label"], "left").groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("output_count"), F.count("_true").alias("matched_output_count"))
    out = queries.select(*KEY)
    for part in (n_true, lib, first, outs):
        out = out.join(part, KEY, "left")
    out = out.fillna(0, ["truth_count", "library_match", "output_count", "matched_output_count"])
    rank, names = F.col("first_matching_rank"), SET_TRACE_STATES
    state = first_true([
        (F.col("truth_count") == 0, names[0]), (F.col("library_match") == 0, names[1]), (rank.isNull(), names[2]),
        (rank > retained_limit, names[3]), (F.col("matched_output_count") > 0, names[4])], names[5])
    return out.select(
        *KEY, state.alias("state"), (F.col("truth_count") > 0).cast("int").alias("evaluable"), "library_match",
        rank.isNotNull().cast("int").alias("returned_match"),
        F.coalesce(rank <= retained_limit, F.lit(False)).cast("int").alias("retained_match"),
        "first_matching_rank", "output_count", "matched_output_count", "truth_count",
        F.when(F.col("truth_count") > 0, (F.col("matched_output_count") > 0).cast("int")).alias("hit"),
        (F.col("output_count") > 0).cast("int").alias("has_output"))


def budget_trace(rows: DataFrame, truth: DataFrame, library: DataFrame, endpoint: str, label: str,
                 score: str, rank: str, budget: int) -> DataFrame:
    """Six-state trace of the arg-max score among the first `budget` fused ranks.

    Only queries with documented labels and at least one candidate inside the budget
    are traced; `rows` carries query_id, reference_id, label, score and rank columns.
    """
    t = truth.where(F.col("endpoint") == endpoint).select("query_id", F.col("label").alias(label)).distinct()
    usable = rows.where(F.col(label).isNotNull()).join(t.withColumn("_true", F.lit(True)), ["query_id", label], "left")
    usable = usable.withColumn("_true", F.coalesce("_true", F.lit(False)))
    inside = F.col(rank) <= budget
    per_label = usable.groupBy("query_id", label, "_true").agg(
        F.max(F.when(inside, F.col(score))).alias("best"), F.min(rank).alias("first_rank"),
        F.count(F.when(inside, 1)).alias("n_rows"))
    stats = per_label.groupBy("query_id").agg(
        _any(F.col("_true")).alias("has_union"), _any(F.col("_true") & (F.col("n_rows") > 0)).alias("has_budget"),
        F.max(F.when(F.col("_true"), F.col("best"))).alias("best_matching_score"),
        F.min(F.when(F.col("_true"), F.col("first_rank"))).alias("first_matching_rank"),
        F.sum("n_rows").alias("budget_rows"))
    winner = top_one(usable.where(inside), ["query_id"], [(score, "desc"), ("reference_id", "asc")]).select(
        "query_id", F.col(label).alias("predicted_label"), F.col("reference_id").alias("winner_reference"),
        F.col(score).alias("winner_score"), F.col("_true").alias("correct"))
    lib = t.join(library.where(F.col("endpoint") == endpoint).select(F.col("label").alias(label)).distinct(),
                 label, "left_semi").groupBy("query_id").agg(F.lit(True).alias("has_library"))
    out = t.select("query_id").distinct().join(winner, "query_id").join(stats, "query_id").join(lib, "query_id", "left")
    out = out.withColumn("has_library", F.coalesce("has_library", F.lit(False)))
    tie = F.coalesce(F.col("best_matching_score") == F.col("winner_score"), F.lit(False))
    n = BUDGET_STATES
    state = first_true([
        (~F.col("has_library"), n[0]), (~F.col("has_union"), n[1]), (~F.col("has_budget"), n[2]),
        (F.col("correct"), n[5]), (tie, n[4])], n[3])
    return out.select(
        "query_id", F.lit(endpoint).alias("endpoint"), state.alias("state"), "predicted_label", "winner_reference",
        "winner_score", "best_matching_score", tie.cast("int").alias("top_score_has_matching_label"),
        "first_matching_rank", "budget_rows", F.col("correct").cast("int").alias("concordant"))


def audit_existing(existing: DataFrame, model: DataFrame) -> DataFrame:
    """Status of an existing annotation against model evidence, with its basis.

    existing: query_id, existing_level, e_l3, e_l4, e_exact.  model: query_id,
    final_decision, accepted_level, m_l3, m_l4, m_exact (model labels, nullable).
    """
    rank = {"L3": 1, "L4": 2, "EXACT": 3}
    level_rank = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    at = lambda prefix, level: first_true(
        [(level == k, F.col(f"{prefix}_{k.lower()}")) for k in rank], None)
    level, accepted_level = F.col("existing_level"), F.col("accepted_level")
    mine, theirs = at("e", level), at("m", level)
    accepted = F.coalesce((F.col("final_decision") == "ACCEPT") & accepted_level.isin(*rank), F.lit(False))
    shallower = level_rank[accepted_level] < level_rank[level]
    status = first_true([
        ((~accepted | shallower) & theirs.isNotNull(), "UNSUPPORTED"), (theirs.isNull(), "UNKNOWN"),
        (theirs == mine, "SUPPORTED")], "CONFLICT")
    basis = first_true([
        (~accepted & theirs.isNotNull(), "DEFERRED_CANDIDATE"), (~accepted, "NO_COMPARABLE_EVIDENCE"),
        (shallower & theirs.isNotNull(), "SHALLOWER_ACCEPTED_LEVEL"), (shallower, "NO_COMPARABLE_EVIDENCE"),
        (accepted_level == level, "SAME_RESOLUTION_ACCEPTED_EVIDENCE")], "DEEPER_ACCEPTED_LEVEL")
    return existing.join(model, "query_id", "left").select(
        "query_id", "existing_level", mine.alias("existing_label"), theirs.alias("model_label"),
        status.alias("status"), basis.alias("basis"))


def score_change(rows: DataFrame, key: list[str], budgets: dict[int, int], rank: str, raw: str, cal: str, label: str, ok: str,
                 row_id: str, carry: list[str], dealt: bool = False) -> DataFrame:
    """Raw-score winner against calibrated-score winner per key and budget, with both top sets.

    Ties inside a winner go to the smallest row id.  Ranks are row numbers, so a key has at most the largest budget's rows: rows are
    dealt by key once, and everything after that stays in place.  `dealt` says that rows are dealt by a part of the key already.
    """
    rows = rows.select(*key, *carry, rank, raw, cal, label, ok, row_id).where(F.col(rank) <= max(budgets.values()))
    rows = rows if dealt else rows.repartition(*key)
    grid = F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(k).alias("_k")) for b, k in budgets.items()])).alias("_b")
    pool = rows.select("*", grid).where(F.col(rank) <= F.col("_b._k")).withColumn("budget", F.col("_b.budget")).drop("_b")
    by = [*key, "budget"]
    whole = Window.partitionBy(*by)
    marked = pool.withColumns({"_mr": F.max(raw).over(whole), "_mc": F.max(cal).over(whole)})
    r_top, c_top = F.col(raw) == F.col("_mr"), F.col(cal) == F.col("_mc")
    row = F.struct(F.col(row_id).alias("id"), F.col(label).alias("label"), F.col(ok).alias("ok"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    flag = lambda c: F.max(c.cast("int"))
    distinct = lambda c, v: F.size(F.collect_set(F.when(c, v))).cast("bigint")  # noqa: E731  (at most the largest budget's values)
    stats = marked.groupBy(*by).agg(
        F.min(F.when(F.col(raw).eqNullSafe(F.col("_mr")), row)).alias("_w"), F.min(F.when(F.col(cal).eqNullSafe(F.col("_mc")), row)).alias("_v"),
        F.count("*").alias("candidate_rows"), distinct(F.lit(True), F.col(label)).alias("candidate_labels"), flag(F.col(ok)).alias("matching_candidate"),
        F.count(F.when(r_top, 1)).alias("raw_top_rows"), distinct(r_top, F.col(label)).alias("raw_top_labels"),
        F.count(F.when(c_top, 1)).alias("calibrated_top_rows"), distinct(c_top, F.col(label)).alias("calibrated_top_labels"),
        distinct(c_top, F.col(raw) + F.lit(0.0)).alias("raw_levels_in_calibrated_top"),
        flag(F.col(ok) & c_top).alias("_cm"), flag(F.col(ok) & r_top).alias("_rm"))
    out = stats.where("calibrated_top_rows > 0").select(
        "*", *[F.col(f"_w._c_{c}").alias(c) for c in carry], F.col("_w.id").alias("raw_winner"), F.col("_v.id").alias("calibrated_winner"),
        F.col("_w.label").alias("_raw_label"), F.col("_v.label").alias("_calibrated_label"), F.col("_w.ok").alias("_raw_ok"), F.col("_v.ok").alias("_calibrated_ok"))
    i = lambda cond: cond.cast("int")
    a, b = F.col("_raw_ok"), F.col("_calibrated_ok")
    return out.select(
        *by, *carry, "candidate_rows", "candidate_labels", "matching_candidate", "raw_top_rows", "raw_top_labels",
        "calibrated_top_rows", "calibrated_top_labels", "raw_levels_in_calibrated_top",
        i(F.col("calibrated_top_rows") > F.col("raw_top_rows")).alias("top_set_expanded"), "raw_winner", "calibrated_winner",
        i(F.col("raw_winner") != F.col("calibrated_winner")).alias("winner_row_changed"),
        i(F.col("_raw_label") != F.col("_calibrated_label")).alias("winner_label_changed"),
        i(a).alias("raw_concordant"), i(b).alias("calibrated_concordant"), i(a & ~b).alias("raw_only_concordant"),
        i(b & ~a).alias("calibrated_only_concordant"), i(~b & (F.col("_cm") == 1)).alias("calibrated_tie_loss"),
        i(~a & (F.col("_rm") == 1)).alias("raw_tie_loss"))
