"""Registered queries against their DuckDB statements at the smallest scale.

By default a cross-section runs; VERSELINE_ALL=1 runs every query (``tests/oracle_check.py`` does so at any scale).
"""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "parse_lrc apply_lrc_offset parse_srt parse_ass_karaoke parse_dictionary write_srt lrc_round_trip section_ids lyric_sections paragraph_flags "
    "page_plan display_windows qa_summary in_activity active_line_at upcoming_line attach_word_durations merge_windows overlap_counts "
    "exact_percentiles robust_mean activity_regions detect_cuts estimate_lag dedupe_near word_offset rank_candidates quota_interleave "
    "annotation_digest stream_step_state stream_sessions"
).split()
NAMES = list(entry.oracle_sql()) if os.environ.get("VERSELINE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["track_id", "ok", "warn", "bad", "lines"]
    assert df.count() > 0


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["active_line_at", "visible_lines_at", "words_in_window", "upcoming_line", "dedupe_near", "match_lines_fuzzy", "word_offset", "in_activity"])
def test_no_nested_loops(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
