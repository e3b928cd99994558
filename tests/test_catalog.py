"""The SQL functions against the column formulas, and their plans."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwatch.functions import catalog, formulas as f
from shelfwatch.plans import oplog
from shelfwatch.schema import RUN_LOG

c = F.col


def pairs():
    """SQL call -> the same by columns."""
    return {
        "days_left(stock, usage)": f.days_left(c("stock"), c("usage")),
        "days_left_latest(stock, usage)": f.days_left_latest(c("stock"), c("usage")),
        "risk_status(days, lead)": f.risk_status(c("days"), c("lead")),
        "risk_status_latest(stock, usage, lead)": f.risk_status_latest(c("stock"), c("usage"), c("lead")),
        "urgency3(days, lead)": f.urgency3(c("days"), c("lead")),
        "urgency4(days, lead)": f.urgency4(c("days"), c("lead")),
        "urgency_rank(level)": f.urgency_rank(c("level")),
        "reorder_qty(lead, usage, stock)": f.reorder_qty(c("lead"), c("usage"), c("stock")),
        "reorder_qty_latest(lead, usage, stock)": f.reorder_qty_latest(c("lead"), c("usage"), c("stock")),
        "reorder_qty_with_safety(lead, usage, stock)": f.reorder_qty_with_safety(c("lead"), c("usage"), c("stock")),
        "priority_score(lead, usage, stock)": f.priority_score(c("lead"), c("usage"), c("stock")),
        "priority_score(lead, usage, stock, days)": f.priority_score(c("lead"), c("usage"), c("stock"), c("days")),
        "trend_direction(usage, days)": f.trend_direction(c("usage"), c("days")),
        "volatility_pct(days, usage)": f.volatility_pct(c("days"), c("usage")),
        "demand_pattern(days)": f.demand_pattern(c("days")),
        "alert_type(days, risk, level)": f.alert_type(c("days"), c("risk"), c("level")),
        "default_order_qty(usage, CAST(stock AS BIGINT))": f.default_order_qty(c("usage"), c("stock")),
        "projected_days(stock, usage)": f.projected_days(c("stock"), c("usage")),
        "cover_level(days, lead)": f.cover_level(c("days"), c("lead")),
        "coverage_qty(60, usage, stock)": f.coverage_qty(60, c("usage"), c("stock")),
    }


@pytest.fixture
def values(spark):
    rng = random.Random(3)
    numbers = [None, 0.0, -3.0, 0.5, 2.5, 7.0, 10.5, 26.0, 99.995]
    rows = list(itertools.product(numbers, numbers, [None, 0, 3, 7]))
    rows = [(s, u, d, rng.choice(numbers), rng.choice([None, "HIGH", "NORMAL"]), rng.choice([None, "CRITICAL", "LOW", "x"])) for s, u, d in rows]
    return spark.createDataFrame(rows, "stock double, usage double, lead bigint, days double, risk string, level string")


def test_every_formula_equals_its_column(spark, values):
    names, known = catalog.register_formulas(spark), pairs()
    assert {call.split("(")[0] for call in known} == set(names) == set(catalog.FORMULAS)
    values.createOrReplaceTempView("cases")
    calls = ", ".join(f"{call} AS sql{i}" for i, call in enumerate(known))
    mine = spark.sql(f"SELECT *, {calls} FROM cases")
    both = mine.select(*[mine[f"sql{i}"].eqNullSafe(column).alias(call) for i, (call, column) in enumerate(known.items())])
    wrong = both.agg(*[F.count_if(~F.col(f"`{call}`")).alias(call) for call in known]).first().asDict()
    assert wrong == dict.fromkeys(known, 0)


def test_functions_are_inlined(spark, values):
    catalog.register_formulas(spark)
    values.createOrReplaceTempView("cases")
    rows = spark.sql("SELECT urgency4(days_left(stock, usage), lead) AS u FROM cases WHERE risk_status(days, lead) = 'HIGH'")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan and "urgency4" not in plan and "days_left" not in plan and "risk_status" not in plan


def test_permanent_functions(spark, values):
    spark.sql("CREATE DATABASE IF NOT EXISTS stockforms")
    try:
        names = catalog.register_formulas(spark, "stockforms")
        values.createOrReplaceTempView("cases")
        found = spark.newSession().sql("SELECT stockforms.reorder_qty(7, 2D, 4D) AS q, stockforms.urgency3(1D, 7) AS u").first()
        assert (found.q, found.u) == (10.0, "CRITICAL") and all(n.startswith("stockforms.") for n in names)
    finally:
        spark.sql("DROP DATABASE stockforms CASCADE")


def test_run_lookups(spark):
    start = datetime(2024, 5, 1)
    rows = [
        (i, f"T{i % 3}", start + timedelta(minutes=i // 2), "FAILED" if i % 5 == 0 else "SUCCESS", i, None, i / 7) for i in range(600)
    ]
    runs = spark.createDataFrame(rows, RUN_LOG)
    as_of = start + timedelta(hours=4)
    catalog.register_run_lookups(spark, runs)
    moment = f"TIMESTAMP'{as_of}'"
    for hours in (1, 24):
        mine = spark.sql(f"SELECT * FROM task_history('T1', {moment}, {hours}) ORDER BY execution_time DESC, log_id DESC").collect()
        assert mine == oplog.run_history(runs, "T1", F.lit(as_of), hours).collect() and mine
    assert spark.sql(f"SELECT * FROM task_history(NULL, {moment}, 48)").count() == catalog.HISTORY_ROWS
    every = sorted(spark.sql("SELECT * FROM refresh_status()").collect())
    assert every == sorted(oplog.last_refreshes(runs).collect()) and len(every) == 3
    assert spark.sql("SELECT state FROM refresh_status('T2')").count() == 1
    assert spark.sql("SELECT * FROM refresh_status('none')").count() == 0
    # a lookup joins like any table
    joined = spark.sql("SELECT w.t, s.state FROM VALUES ('T0'), ('T1') AS w(t), LATERAL refresh_status(w.t) AS s")
    assert sorted(r.t for r in joined.collect()) == ["T0", "T1"]
