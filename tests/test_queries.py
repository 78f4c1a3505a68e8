"""Registered queries against their SQL twins. VESTIGO_ALL=1 runs every one of them."""

from __future__ import annotations

import os

import compare
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
HEADLINE = [
    "prioritize_detections", "nms", "merge_detections", "fuse_reads", "consensus", "plate_analyses", "validate_reads", "detection_ocr_join",
    "video_candidates", "track_vehicles", "partial_candidates", "provider_consensus", "event_upsert", "plate_history", "match_model",
    "vehicle_search", "knn_search", "web_confirmation", "final_candidate_rank", "conclusion", "chain_build", "chain_verify",
    "latency_summary", "regression_gate", "split_dataset", "event_upsert_stream", "minute_windows",
]
NAMES = sorted(entry.queries()) if os.environ.get("VESTIGO_ALL") else HEADLINE


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).columns[0] == "evidence_id"


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    got = compare.spark_rows(entry.queries()[name](spark, SF))
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    assert compare.mismatch(got, compare.duck_rows(compare.duck(SF), sql)) is None
