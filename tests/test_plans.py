"""What the plans of the main queries must and must not have."""

import re

import pytest

from shoal.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["radius_scan_pairs", "radius_scan_count", "nearest_neighbour", "uncovered_anti_join", "clusters_world_z8", "cluster_cube", "tile_features", "live_devices", "verify_separation", "verify_radius"])
def test_no_cross_joins(name, spark, small):
    text = plan(registry.QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_reads_push_zoom_and_columns_down(spark, small):
    text = plan(registry.QUERIES["clusters_world_z8"](spark, small))
    assert "LessThanOrEqual(low,8)" in text and "GreaterThanOrEqual(high,8)" in text
    scan = text[text.index("ReadSchema") :].split("\n")[0]
    assert "cat" not in scan


def test_category_is_filtered_before_grouping(spark, small):
    text = plan(registry.QUERIES["clusters_filtered"](spark, small))
    assert re.search(r"Filter .*cat#\d+ = 2", text[text.rindex("HashAggregate") :])
