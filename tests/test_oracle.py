"""Registered queries against their SQL twins on the smallest tables. ``check.py`` runs them
all at any scale factor; here one of each kind of plan."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [
    "trial_summary", "attach_partner", "label_decisions", "context_weights", "context_probability", "propensity_fit",
    "memory_since_reset", "transition_probs", "decision_shares_by_condition", "condition_rollup", "trial_response_grid",
    "response_coordination", "response_code", "score_pair", "claims_with_authors", "claim_counts_filled", "complete",
    "fdr_by_condition", "binom_test_exact", "hurdle_gaussian", "alignment_welch", "narrative_alignment", "mean_abs_gap",
    "select_alpha", "ring_schedule", "schedule_coverage", "validate_response", "stream_sessions",
]


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("test tables are absent")
    from check import TABLES
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    from check import compare
    assert compare(spark, con, name, SF, entry.oracle_sql()[name])[0] == "ok"


def test_registry():
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(queries) and len(sqls) > 120


def test_entry(spark):
    if not os.path.isdir(SF):
        pytest.skip("test tables are absent")
    assert entry.entry(spark).count() > 0
