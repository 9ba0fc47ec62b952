"""A spread of registered queries against their SQL oracles on the smallest tables.

`python check_oracle.py SF_DIR` compares every query.
"""

import threading
from pathlib import Path

import pytest

import __spark_entry__ as entry_module
import check_oracle

SF = "/root/testdata/sf0.001"
PICKS = ["m03_budget_trace", "a06_three_rate_metrics", "a31_risk_coverage", "a33_safe_cutoff", "r09_cluster_precision_bound",
         "w20_maximum_separation_cutoff", "j17_cross_release_map", "j29_aligned_position_map", "p11_balanced_capped_sampler",
         "p15_global_divergent_picks", "v18_ordered_groups", "e08_order_free_signature", "s11_fasta_records", "s20_bundle_parity", "l01_isotonic_fit"]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables absent")


def test_registry_is_consistent():
    q, o = entry_module.queries(), entry_module.oracle_sql()
    assert set(o) <= set(q) and len(q) > 280


@pytest.mark.parametrize("name", PICKS)
def test_query_equals_oracle(spark, name):
    ok, line = check_oracle.compare(spark, SF, name, entry_module.queries()[name], entry_module.oracle_sql()[name], threading.Lock())
    assert ok, line


def test_entry(spark):
    assert entry_module.entry(spark).count() == 2
