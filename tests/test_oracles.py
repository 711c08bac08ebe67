"""Registered queries against their DuckDB oracles (the driver's gate)."""
import pytest

from oracle_check import compare, duck

from detecteval.plans.catalog import CATALOG

SF = "/root/testdata/sf0.001"
FAST = ["corpus_profile", "corpus_prepared", "fold_assignment", "validation_sides",
        "threshold_transfer", "metrics_at_05", "pr_curve", "thresholds", "cost_table",
        "budget_recall", "drift", "hard_balance", "random_split", "calibration_draw",
        "logit_diagnostics", "losses", "tfidf", "risk_zones"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, con, name):
    fn, sql = CATALOG[name]
    ok, exact, msg = compare(fn(spark, SF), con, sql)
    assert ok, msg


def test_every_query_has_builder():
    import __spark_entry__ as e
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 40
