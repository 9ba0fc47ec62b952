"""Ordered state expressions: the first matching condition names the state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# State names, in decision order.
TRACE_STATES = ["NO_RECORDED_ACTIVITY", "NO_LIBRARY_SUPPORT", "ABSENT_FROM_SAVED_UNION", "RETENTION_LOSS",
                "SCORED_NO_SELECTION", "CONCORDANT_TOP1", "TOP_SCORE_TIE_LOSS", "STRICT_SCORE_LOSS",
                "OTHER_SELECTION_LOSS"]
SET_TRACE_STATES = ["NO_RECORDED_ACTIVITY", "NO_LIBRARY_SUPPORT", "ABSENT_FROM_RETURNED_CANDIDATES",
                    "RETENTION_LOSS", "CONCORDANT_OUTPUT", "SELECTION_LOSS"]
BUDGET_STATES = ["NO_LIBRARY_SUPPORT", "ABSENT_FROM_SAVED_UNION", "OUTSIDE_TOP50", "STRICT_SCORE_LOSS",
                 "CALIBRATED_TIE_LOSS", "CONCORDANT_TOP1"]
SIX_STATES = ["CANDIDATE_ABSENT_REJECTED", "CANDIDATE_ABSENT_ACCEPTED_WRONG",
              "CANDIDATE_PRESENT_TOP1_WRONG_REJECTED", "CANDIDATE_PRESENT_TOP1_WRONG_ACCEPTED",
              "TOP1_CORRECT_REJECTED", "TOP1_CORRECT_ACCEPTED"]
LINEAGE_STATES = ["NO_DOCUMENTED_TRUTH", "NO_LIBRARY_SUPPORT", "NOT_RETRIEVED", "NOT_SCORED", "SCORED"]
PAIR_STATES = ["both_concordant", "rescued", "newly_discordant", "both_discordant"]


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def first_true(cases: list[tuple[Column, str | Column]], otherwise) -> Column:
    """CASE WHEN chain in list order."""
    out = None
    for cond, value in cases:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise)


def flag(value, optional: bool = False) -> Column:
    """Strict 0/1 text flag; blank is unknown only where allowed, anything else raises."""
    v = c(value)
    bad = F.raise_error(F.concat(F.lit("flag must be 0 or 1: "), F.coalesce(v, F.lit("null")))).cast("boolean")
    cases = [(v == "1", F.lit(True)), (v == "0", F.lit(False))]
    if optional:
        cases.append((v.isNull() | (v == ""), F.lit(None).cast("boolean")))
    return first_true(cases, bad)


def six_state(available, correct, accepted) -> Column:
    """Availability x top-1 correctness x acceptance; correct without available raises."""
    a, k, s = c(available), c(correct), c(accepted)
    bad = F.raise_error(F.lit("correct selection without an available candidate"))
    return first_true([
        (k & ~a, bad), (~a & ~s, SIX_STATES[0]), (~a & s, SIX_STATES[1]), (a & ~k & ~s, SIX_STATES[2]),
        (a & ~k & s, SIX_STATES[3]), (a & k & ~s, SIX_STATES[4]), (a & k & s, SIX_STATES[5])], None)


def seven_state(documented, available, correct, accepted) -> Column:
    d = c(documented)
    bad = F.raise_error(F.lit("evidence attached to an undocumented query"))
    return first_true([
        (~d & (c(available) | c(correct)), bad), (~d, "UNDOCUMENTED")], six_state(available, correct, accepted))


def lineage(truth, library, retrieved, scored) -> Column:
    """Five nested stages; a later stage without the earlier one raises."""
    t, lib, r, s = (c(x).cast("boolean") for x in (truth, library, retrieved, scored))
    bad = F.raise_error(F.lit("stages are not nested"))
    return first_true([
        ((s & ~r) | (r & ~lib) | (lib & ~t), bad), (~t, LINEAGE_STATES[0]), (~lib, LINEAGE_STATES[1]),
        (~r, LINEAGE_STATES[2]), (~s, LINEAGE_STATES[3])], LINEAGE_STATES[4])


def highest_supported_level(p: dict, label: dict, cut: dict[str, float], strict: bool = False) -> Column:
    """Deepest level whose probability reaches its cutoff, gated by L3.

    `strict` makes the exact level depend on L4 as well as L3.
    """
    ok3 = (c(p["L3"]) >= cut["L3"]) & c(label["L3"]).isNotNull()
    has4 = (c(p["L4"]) >= cut["L4"]) & c(label["L4"]).isNotNull()
    has_exact = (c(p["EXACT"]) >= cut["EXACT"]) & c(label["EXACT"]).isNotNull()
    gate3 = ok3 if strict else c(p["L3"]) >= cut["L3"]
    exact_gate = (gate3 & has4) if strict else gate3
    yes = lambda x: F.coalesce(x, F.lit(False))
    return first_true([(yes(exact_gate & has_exact), "EXACT"), (yes(gate3 & has4), "L4"), (yes(ok3), "L3")], "ABSTAIN")


def paired_outcome(before, after) -> Column:
    b, a = c(before), c(after)
    return first_true([(b & a, PAIR_STATES[0]), (~b & a, PAIR_STATES[1]), (b & ~a, PAIR_STATES[2])], PAIR_STATES[3])


def availability_pair(query_has, reference_has) -> Column:
    q, r = c(query_has), c(reference_has)
    return first_true([(q & r, "BOTH_AVAILABLE"), (q & ~r, "REFERENCE_UNAVAILABLE"), (~q & r, "QUERY_UNAVAILABLE")],
                      "BOTH_UNAVAILABLE")


def concordance_depth(l3, l4, exact) -> Column:
    f = lambda x: F.coalesce(c(x), F.lit(False))
    return first_true([(f(exact), F.lit(3)), (f(l4), F.lit(2)), (f(l3), F.lit(1))], F.lit(0))


def accept_or_defer(threshold_met, cohort_status) -> tuple[Column, Column]:
    """(decision, reason) of a row-level accept under a cohort-level veto."""
    ok, status = c(threshold_met), c(cohort_status)
    decision = F.when(ok & (status == "validated-similar"), "ACCEPT").otherwise("DEFER")
    reason = first_true([
        (ok & (status == "validated-similar"), "ROW_THRESHOLD_MET_AND_COHORT_VALIDATED_SIMILAR"),
        (~ok, "ROW_THRESHOLD_NOT_MET"), (status == "shifted", "COHORT_SHIFTED_REQUIRE_REVALIDATION")],
        "COHORT_APPLICABILITY_UNKNOWN_REQUIRE_AUDIT")
    return decision, reason


def veto(requested, automatic) -> Column:
    """An audit can only lower the requested cohort status to shifted."""
    return F.when(c(automatic) == "shifted", "shifted").otherwise(c(requested))


def open_world_behaviour(level, correct) -> Column:
    lv = c(level)
    return first_true([
        (lv == "ABSTAIN", "ABSTAIN"), (lv == "L3", "COARSE_L3"), (lv == "L4", "COARSE_L4"),
        ((lv == "EXACT") & c(correct), "EXACT_CORRECT")], "UNSUPPORTED_EXACT_TRANSFER")
