"""Registered queries against their SQL twins on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from parlance.plans import registry

SF = "/root/testdata/sf0.001"
#: A spread of modules; the driver compares all of them at a larger size.
NAMES = ["layer_edges", "feature_matrix", "active_speakers", "gini_lorenz", "kwic_windows", "concept_edges", "term_doc_freq", "signed_knn_graph", "axis_loo", "placebo_null", "correlation_table", "fleiss_kappa", "segment_turns", "stage_windows", "interpolate_linear", "crisis_threshold_sensitivity", "resolve_speaker", "merge_split_lines", "directed_mentions", "stage_snapshot", "policy_rate_union", "axis_validation", "bootstrap_metric_diff", "roster_index", "monthly_speech_panel", "layer_feature_panel", "lead_sensitivity", "event_topic_shocks", "delta_matrices"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    want = db.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in got.select(*columns).collect())
    assert rows == sorted(tuple(plain(v) for v in r) for r in want.fetchall()) and rows
