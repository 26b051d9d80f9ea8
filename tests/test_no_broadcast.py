"""Rows that a plan makes from few others must not be sent to the driver because the few are small."""

import pytest

import __spark_entry__


@pytest.mark.parametrize("name", ["ink_alignment", "evidence_bundle"])
def test_joins_of_exploded_rows_do_not_broadcast(spark, name):
    df = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
