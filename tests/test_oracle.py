"""Registered queries against their SQL oracles (a cross-section by default).

MOSAIQ_FULL=1 runs every query; MOSAIQ_SF picks the data folder.
"""

import os

import pytest

import __spark_entry__ as entry_point
from tools.check_oracle import duck, rows_of

SF = os.environ.get("MOSAIQ_SF", "/root/testdata/sf0.001")
CROSS_SECTION = [
    "delta_report", "aggregate_repeats", "quality_decision", "verify_clusters", "mode_release", "analyzer_release_gate",
    "select_best", "pareto_frontier", "route_mode", "artifact_gate", "retention_plan", "active_sessions", "attempt_windows",
    "union_shards", "explode_pixels", "color_metrics", "ink_metrics", "ssim", "edge_mask", "region_adjacency",
    "classify_micro_regions", "euler_check", "taubin_smooth", "snap_axis_groups", "stream_attempts", "markup_structure",
    "mode_release", "retry_audit", "verify_chain", "dedupe_points", "corner_intersections", "weak_components", "smooth_flat_zone",
    "stream_agreement", "stream_job_state", "write_content_addressed", "export_report",
]
NAMES = sorted(entry_point.oracle_sql()) if os.environ.get("MOSAIQ_FULL") else CROSS_SECTION


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    df = entry_point.queries()[name](spark, SF)
    cur = con.execute(entry_point.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
