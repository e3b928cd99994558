"""The physical plans that keep the jobs sound on large, skewed ledgers."""

import re

import pytest
from pyspark.sql import functions as F

from shelfwatch import fixed_values as V
from shelfwatch.operators import criticality, rolling, tails
from shelfwatch.operators.usage import slice_ledger, with_average_usage
from shelfwatch.plans import history, latest
from shelfwatch.schema import RULES, SERIES_KEY
from shelfwatch.sources import ledger as files
from shelfwatch.sources import star
from shelfwatch.staging import drop_staged, shared_folder, staged


@pytest.fixture
def stored(spark, random_ledger, tmp_path):
    path = str(tmp_path / "ledger")
    files.write_ledger(random_ledger, path)
    return files.read_ledger(spark, path)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_series_are_limited_before_each_shuffle(stored):
    plan = plan_of(latest.stock_analytics(stored, F.lit(None)))
    limits = re.findall(r"WindowGroupLimit.*row_number\(\), (\d+), (Partial|Final)", plan)
    assert limits == [("30", "Final"), ("30", "Partial")] * 2
    assert plan.count("Exchange hashpartitioning") == 2


def test_rolling_frames_never_sort_a_whole_series(stored):
    plan = plan_of(rolling.rolling_figures(stored))
    windows = re.findall(r"windowspecdefinition\(([^)]*)", plan)
    assert windows and all("frame" in w for w in windows)


def test_dates_and_states_reach_the_orders_before_lines_are_summed(spark):
    folder = "/root/testdata/sf0.001"
    plan = plan_of(star.orders_tracking(spark, folder, F.col("o_orderstatus").isin("O", "P")))
    lines = plan[plan.index("lineitem") - 4000 : plan.index("lineitem")] if "lineitem" in plan else plan
    assert "LeftSemi" in plan and plan.count("In(o_orderstatus, [O,P])") == 2, lines


def test_latest_tables_read_the_ledger_once(spark, stored):
    plan = plan_of(latest.stock_analytics(stored))
    assert "ledger" not in plan.split("figures")[0] or plan.count("FileScan") <= 2


def test_mean_usage_needs_no_window_and_no_ledger_shuffle(stored):
    plan = plan_of(with_average_usage(stored))
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan
    assert "BroadcastHashJoin" in plan


def test_mean_usage_beyond_the_broadcast_limit(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(with_average_usage(stored))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_slices_and_columns_reach_the_scan(stored):
    plan = plan_of(tails.tail_figures(slice_ledger(stored, organization="Org 1")))
    assert "EqualTo(organization,Org 1)" in plan
    heat = plan_of(history.stock_heat(stored))
    assert "ReadSchema: struct<location:string,item:string,closing_stock:bigint>" in heat


def test_no_plan_compares_all_pairs(spark, stored):
    rules = spark.createDataFrame([("location", "Site", 9), ("item", "Item 1", 4)], RULES)
    ordered = stored.select(*SERIES_KEY).limit(1)
    for df in (
        history.latest_snapshot(stored),
        history.overview(stored),
        history.top_actions(stored, V.FALLBACK_RULES, ordered),
        criticality.location_scores(stored, rules),
    ):
        plan = plan_of(df)
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_short_lists_are_taken_without_a_full_sort(stored):
    plan = plan_of(latest.riskiest(latest.stock_analytics(stored, F.lit(None))))
    assert "TakeOrderedAndProject" in plan


def test_staged_tables_live_in_the_shared_folder(spark, random_ledger):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    table = staged(random_ledger, "copy")
    assert table.inputFiles() and all("/shared/shelfwatch/" in f for f in table.inputFiles())
    assert table.count() == random_ledger.count()
    drop_staged(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(table.inputFiles()[0].rsplit("/", 1)[0])
