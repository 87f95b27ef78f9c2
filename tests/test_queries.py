"""Every registered query against its SQL on the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    fn = entry.queries()[name]
    if name in SQL:
        assert compare(spark, con, SF, fn, SQL[name]) is None
    else:
        assert fn(spark, SF).count() > 0


@pytest.mark.parametrize(
    "name",
    ["b2_merge_intervals", "b5_kept_samples", "b9_snap_to_kept", "b10_intervals_from_marks",
     "c3_asof_sample", "c4_thin_min_gap", "f2_best_predecessor", "h12_nearest", "j4_latest_pending"],
)
def test_query_with_split_keys(spark, con, tiny_chunks, name):
    assert compare(spark, con, SF, entry.queries()[name], SQL[name]) is None


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["asset_id", "sample_id", "t_us", "out_us"]
    assert out.count() > 0
