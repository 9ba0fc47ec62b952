"""Hand-made fixtures for the support traces and state expressions."""

import pytest
from pyspark.sql import functions as F

from labeltrail.functions import states as st
from labeltrail.operators import metrics
from labeltrail.operators.trace import set_trace, support_trace
from labeltrail.sources.readers import trace_input_problems

NAMES = {"q0": ([], "a"), "q1": (["9.9.9.9"], "a"), "q2": (["2.2.2.2"], "a"), "q3": (["2.2.2.2"], "a"), "q4": (["2.2.2.2"], "a"),
         "q5": (["2.2.2.2"], "a"), "q6": (["2.2.2.2"], "a"), "q7": (["2.2.2.2"], None), "q8": (["2.2.2.2"], "a"), "q9": (["2.2.2.2"], "a")}
ACCEPTED = [True, True, False, False, True, True, True, False, False, False]
A, B = "1.1.1.1", "2.2.2.2"
CANDS = [("q0", "a", A, True, 0.8), ("q1", "a", A, True, 0.8), ("q2", "a", A, True, 0.8), ("q3", "a", A, True, 0.8), ("q3", "b", B, False, 0.9),
         ("q4", "a", A, True, 0.8), ("q4", "b", B, True, 0.4), ("q5", "a", A, True, 0.8), ("q5", "b", B, True, 0.8), ("q6", "a", B, True, 0.9),
         ("q7", "a", B, True, 0.5), ("q8", "a", B, True, 0.3), ("q9", "a", A, True, 0.2), ("q9", "b", B, True, 0.9)]
EXPECTED = ["NO_RECORDED_ACTIVITY", "NO_LIBRARY_SUPPORT", "ABSENT_FROM_SAVED_UNION", "RETENTION_LOSS", "STRICT_SCORE_LOSS",
            "TOP_SCORE_TIE_LOSS", "CONCORDANT_TOP1", "SCORED_NO_SELECTION", "CONCORDANT_TOP1", "OTHER_SELECTION_LOSS"]


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "queries": spark.createDataFrame([(q, "L4", t) for q, (t, _) in NAMES.items()], "query_id string, endpoint string, truth_labels array<string>"),
        "library": spark.createDataFrame([("L4", A), ("L4", B)], "endpoint string, label string"),
        "candidates": spark.createDataFrame([(q, "L4", c, lb, r, s) for q, c, lb, r, s in CANDS],
                                            "query_id string, endpoint string, candidate_id string, label string, retained boolean, score double"),
        "outputs": spark.createDataFrame([(q, "L4", c, a) for (q, (_, c)), a in zip(NAMES.items(), ACCEPTED)],
                                         "query_id string, endpoint string, selected_candidate_id string, accepted boolean")}


def test_ten_query_states_and_denominators(tables):
    tr = support_trace(*(tables[k] for k in ("queries", "library", "candidates", "outputs")))
    got = {r.query_id: r.state for r in tr.collect()}
    assert [got[f"q{i}"] for i in range(10)] == EXPECTED
    s = metrics.output_summary(tr).first()
    assert (s.queries, s.evaluable_queries, s.selected_queries) == (10, 9, 9)
    assert (s.accepted_queries, s.evaluable_accepted, s.accepted_concordant, s.accepted_disagreements) == (5, 4, 1, 3)


def test_input_rules(tables):
    assert trace_input_problems(tables).count() == 0
    bad = dict(tables, candidates=tables["candidates"].withColumn("score", F.lit(None).cast("double")))
    assert {r.problem for r in trace_input_problems(bad).collect()} == {"RETAINED_WITHOUT_SCORE"}


def test_set_trace(spark):
    q = spark.createDataFrame([(str(i), "L") for i in range(7)], "query_id string, endpoint string")
    truth = spark.createDataFrame([("1", "L", "z"), ("2", "L", "a"), ("3", "L", "a"), ("4", "L", "a"), ("5", "L", "a"), ("6", "L", "a")], "query_id string, endpoint string, label string")
    lib = spark.createDataFrame([("L", "a"), ("L", "b")], "endpoint string, label string")
    cand = spark.createDataFrame([("0", 1, "a"), ("1", 1, "a"), ("2", 1, "b"), ("3", 1, "b"), ("3", 3, "a"), ("4", 1, "a"), ("4", 1, "b"), ("5", 1, "b"), ("5", 2, "a")],
                                 "query_id string, rank int, label string").withColumn("endpoint", F.lit("L"))
    outs = spark.createDataFrame([("4", "a"), ("4", "b"), ("5", "b")], "query_id string, label string").withColumn("endpoint", F.lit("L"))
    r = {x.query_id: x for x in set_trace(truth, lib, cand, outs, q, 2).collect()}
    assert [r[str(i)].state for i in range(7)] == ["NO_RECORDED_ACTIVITY", "NO_LIBRARY_SUPPORT", "ABSENT_FROM_RETURNED_CANDIDATES", "RETENTION_LOSS",
                                                   "CONCORDANT_OUTPUT", "SELECTION_LOSS", "ABSENT_FROM_RETURNED_CANDIDATES"]
    assert r["0"].hit is None and (r["4"].hit, r["4"].output_count, r["4"].matched_output_count) == (1, 2, 1)


def test_flags_and_nesting_raise(spark):
    one = spark.range(1)
    assert one.select(st.flag(F.lit(""), optional=True).alias("f")).first().f is None
    for expr in (st.flag(F.lit("yes")), st.flag(F.lit("")), st.lineage(F.lit(0), F.lit(1), F.lit(0), F.lit(0)),
                 st.lineage(F.lit(1), F.lit(0), F.lit(1), F.lit(1)), st.lineage(F.lit(1), F.lit(1), F.lit(0), F.lit(1)),
                 st.six_state(F.lit(False), F.lit(True), F.lit(True))):
        with pytest.raises(Exception):
            one.select(expr.alias("x")).collect()


def test_two_hierarchy_rules_differ(spark):
    row = spark.createDataFrame([(0.9, 0.1, 0.9, "a", "b", "c")], "p3 double, p4 double, px double, l3 string, l4 string, lx string")
    args = ({"L3": "p3", "L4": "p4", "EXACT": "px"}, {"L3": "l3", "L4": "l4", "EXACT": "lx"}, {"L3": 0.5, "L4": 0.5, "EXACT": 0.5})
    r = row.select(st.highest_supported_level(*args).alias("a"), st.highest_supported_level(*args, strict=True).alias("b")).first()
    assert (r.a, r.b) == ("EXACT", "L3")
