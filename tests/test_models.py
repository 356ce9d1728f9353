"""Training on tables whose windows are all of one class, or hold a value that isn't known."""

import math

import pytest

from vigil.config import QUERY_STRIDE, QUERY_WINDOW
from vigil.plans.queries import queries

KINDS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, folder, value):
    """Four recordings of 700 events, one every 5 seconds: less than the horizon in all."""
    rows = spark.range(2800).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + 5 * id) AS ts", "id AS user_id", "string(id % 4) AS event_type", f"double({value}) AS value", "'' AS props")
    rows.write.parquet(f"{folder}/events.parquet")
    return str(folder)


NOISE = "pmod(hash(id), 100)"
WINDOWS = (700 - QUERY_WINDOW) // QUERY_STRIDE + 1


@pytest.mark.parametrize("name", ["rf_health", "gbt_health"])
@pytest.mark.parametrize("value, low, high", [(f"if(id >= 2796, 150, {NOISE})", 0.0, 0.1), (NOISE, 0.9, 1.0)], ids=["all faults", "all healthy"])
def test_one_class_alone(spark, tmp_path, name, value, low, high):
    rows = queries()[name](spark, events(spark, tmp_path, value)).collect()
    assert len(rows) == 4 * WINDOWS
    assert {r["label"] > 0 for r in rows} == {high < 0.5}
    assert all(low <= r["health"] <= high for r in rows)


@pytest.mark.parametrize("name", ["rf_health", "gbt_health"])
def test_one_healthy_row_and_an_unknown_one(spark, tmp_path, name):
    # recording 0 ends with one window after its last onset; recording 1 has a value that is no number
    value = f"CASE WHEN id % 4 > 0 AND id >= 2796 OR id = 4 * 679 THEN 150 WHEN id = 1 THEN double('NaN') ELSE {NOISE} END"
    rows = queries()[name](spark, events(spark, tmp_path, value)).collect()
    assert len(rows) == 4 * WINDOWS and sum(r["label"] == 0 for r in rows) == 1
    unknown = [r for r in rows if r["health"] is None]
    assert len(unknown) == 1
    assert all(0 <= r["health"] <= 1 and math.isfinite(r["health"]) for r in rows if r["health"] is not None)


@pytest.mark.parametrize("name", ["rf_health", "gbt_health"])
def test_no_window_at_all(spark, tmp_path, name):
    rows = spark.createDataFrame([], KINDS)
    rows.write.parquet(f"{tmp_path}/events.parquet")
    out = queries()[name](spark, str(tmp_path))
    assert out.count() == 0 and dict(out.dtypes)["health"] == "double"
