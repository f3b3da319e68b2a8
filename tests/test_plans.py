"""What the physical plans must and must not contain."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from workloads.common import Ctx, F


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pending_top", "pending_metrics", "trend_series", "queue_age",
                                  "lag_histogram", "source_stats", "pending_critical", "emerging_list",
                                  "radar_view", "mention_dedup", "scan_epss_csv", "audit_references"])
def test_no_nested_loops_or_row_python(spark, sf_dir, name):
    plan = plan_of(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    from advisorylake.operators.predicates import operational_candidate
    from workloads.common import P

    plan = plan_of(c.candidates.where(operational_candidate(P)).select("id"))
    assert "GreaterThanOrEqual(o_orderdate" in plan
    assert "o_totalprice" not in plan and "o_custkey" not in plan


def test_group_limits_prune_before_the_shuffle(spark, sf_dir):
    for name in ("timeline_last_500", "osv_cap_topn", "mention_dedup", "candidate_updates", "snippets_topk"):
        assert "WindowGroupLimit" in plan_of(entry.queries()[name](spark, sf_dir)), name


def test_null_keys_are_spread(spark):
    from advisorylake.operators.predicates import spread_nulls

    df = spark.range(100).select("id", F.lit(None).cast("string").alias("k"))
    assert df.select(spread_nulls(F.col("k"), F.col("id")).alias("s")).distinct().count() == 100
