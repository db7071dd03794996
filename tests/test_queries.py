"""The entry contract, and every query against its SQL twin."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from check import compare, oracle
from shoalspark.plans.catalog import QUERIES
from shoalspark.plans.oracle import ORACLE

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
#: those that are cheap on both sides at the large scale, where group sizes and means differ from the small one
AT_LARGE = ["cue_share_by_part", "cue_share_crossed", "cue_share_untracked", "duplicate_frame_rows", "speed_fish_minute",
            "real_minute_lookup", "median_interval", "lmm_coef_tests", "lmm_share_anova", "gamma_glm", "cohort_folders",
            "hmm_em_three", "hmm_additive_step", "hmm_transition_interval"]


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    flagship = entry.entry(spark)
    assert flagship.columns == ["part", "treatment", "avg", "sd", "n", "se"] and flagship.count() == 6


@pytest.fixture(scope="module")
def twins():
    return {sf: oracle(sf) for sf in (SMALL, LARGE)}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, twins, name):
    rows, verdict = compare(spark, twins[SMALL], name, SMALL)
    assert verdict == "ok" and rows > 0


@pytest.mark.parametrize("name", AT_LARGE)
def test_against_sql_at_scale(spark, twins, name):
    rows, verdict = compare(spark, twins[LARGE], name, LARGE)
    assert verdict == "ok" and rows > 0


def test_no_staged_tables_are_left_behind(tmp_path):
    """The run folder goes with the application."""
    import subprocess
    import sys

    code = ("import sys; sys.path.insert(0, sys.argv[1]); from pyspark.sql import SparkSession; from shoalspark.staging import stage; "
            "s = SparkSession.builder.master('local[1]').config('spark.checkpoint.dir', sys.argv[2]).config('spark.ui.enabled', 'false').getOrCreate(); "
            "assert stage(s.range(5)).count() == 5; s.stop()")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code, root, f"file://{tmp_path}"], check=True, timeout=180)
    assert [p for p in tmp_path.rglob("*.parquet")] == []
