from pyspark.sql import functions as F

from shelfwatch.functions import formulas as f
from shelfwatch.functions.numeric import fixed_point, minute_boundaries, round_half_up
from shelfwatch.operators.usage import plain_average, with_risk
from shelfwatch.plans import history, latest, orders


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_golden_series(spark, series):
    ledger = series([10, 15, 12, 8, 20])
    assert plain_average(ledger).first()["avg_daily_usage"] == 13.0
    row = with_risk(ledger).first()
    assert abs(row["days"] - 50 / 13) < 1e-12
    assert row["risk_status"] == "HIGH"
    reorder = history.reorder_list(ledger).first()
    assert (reorder["reorder_qty"], reorder["urgency_level"], reorder["days_left"]) == (41.0, "HIGH", 3.85)
    advice = latest.reorder_recommendations(latest.stock_analytics(ledger)).first()
    assert (advice["reorder_qty"], advice["reorder_qty_with_safety"]) == (41.0, 431.0)


def test_golden_score(spark):
    assert value(spark, f.priority_score(F.lit(10), F.lit(20.0), F.lit(15), F.lit(10))) == 52.5


def test_rounding_uses_decimal_digits(spark):
    assert value(spark, round_half_up(F.lit(1.005), 2)) == 1.01
    assert value(spark, round_half_up(F.lit(-2.5), 0)) == -3.0
    assert value(spark, fixed_point(F.lit(12.35), 1)) == "12.4"
    assert value(spark, fixed_point(F.lit(3.0), 1)) == "3.0"


def test_days_left_without_usage(spark):
    assert value(spark, f.days_left(F.lit(5), F.lit(0.0))) == 9999.0
    assert value(spark, f.days_left(F.lit(5), F.lit(None).cast("double"))) is None
    assert value(spark, f.days_left_latest(F.lit(5), F.lit(None).cast("double"))) == 9999.0


def test_urgency_levels(spark):
    lead = F.lit(10)
    assert [value(spark, f.urgency4(F.lit(d), lead)) for d in (0.0, 5.0, 10.0, 15.0, 15.1)] == [
        "CRITICAL",
        "CRITICAL",
        "HIGH",
        "MEDIUM",
        "LOW",
    ]
    assert value(spark, f.urgency3(F.lit(15.1), lead)) == "MEDIUM"
    ranks = [value(spark, f.urgency_rank(F.lit(x))) for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]
    assert ranks == sorted(ranks)


def test_alert_types(spark):
    def kind(days, risk, urgency):
        return value(spark, f.alert_type(F.lit(days), F.lit(risk), F.lit(urgency)))

    assert kind(0.0, "HIGH", "CRITICAL") == "CRITICAL_RISK"
    assert kind(1.0, "HIGH", "HIGH") == "HIGH_RISK"
    assert kind(1.0, "NORMAL", "CRITICAL") == "CRITICAL_RISK"
    assert kind(2.0, "NORMAL", None) == "REORDER_NEEDED"


def test_pattern_of_missing_volatility(spark):
    assert value(spark, f.demand_pattern(F.lit(None).cast("double"))) == "STABLE"
    assert value(spark, f.volatility_pct(F.lit(3.0), F.lit(0.0))) == 0.0


def test_minutes_count_boundaries(spark):
    def between(a, b):
        return value(spark, minute_boundaries(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp")))

    assert between("2024-01-01 00:00:59", "2024-01-01 00:01:00") == 1
    assert between("2024-01-01 00:00:00", "2024-01-01 00:00:59") == 0
    assert between("2024-01-01 23:59:30", "2024-01-02 00:01:00") == 2


def test_what_if_levels(spark):
    rows = spark.createDataFrame(
        [("o", "l", f"i{q}", 25, 10.0, 5) for q in (0, 60, 100)],
        "organization string, location string, item string, closing_stock long, avg_daily_usage double, lead_time_days long",
    )
    wanted = spark.createDataFrame(
        [("o", "l", f"i{q}", q) for q in (0, 60, 100)],
        "organization string, location string, item string, order_qty long",
    )
    found = {r["order_qty"]: (r["projected_days"], r["cover_level"]) for r in orders.what_if(rows, wanted).collect()}
    assert found == {0: (2.5, "HIGH"), 60: (8.5, "MODERATE"), 100: (12.5, "SAFE")}
    default = orders.what_if(rows).first()
    assert default["order_qty"] == 275 and default["days_gained"] == 27.5
    assert orders.with_coverage(rows).first()["qty_90_days"] == 875.0


def test_what_if_flags_quantities_out_of_range(spark):
    rows = spark.createDataFrame(
        [("o", "l", "a", 100, 1000.0, 5), ("o", "l", "b", 7, 0.0, 5), ("o", "l", "c", 7, 1.0, 5)],
        "organization string, location string, item string, closing_stock long, avg_daily_usage double, lead_time_days long",
    )
    found = {r["item"]: r for r in orders.what_if(rows).collect()}
    # the default has no range
    assert (found["a"]["order_qty"], found["a"]["projected_days"], found["a"]["cover_level"]) == (29900, 30.0, "SAFE")
    assert (found["b"]["order_qty"], found["b"]["projected_days"], found["b"]["days_gained"]) == (10, 9999.0, 0.0)
    wanted = spark.createDataFrame(
        [("o", "l", "a", 10001), ("o", "l", "b", -1), ("o", "l", "c", 10000)],
        "organization string, location string, item string, order_qty long",
    )
    found = {r["item"]: (r["order_qty"], r["qty_out_of_range"]) for r in orders.what_if(rows, wanted).collect()}
    assert found == {"a": (10001, True), "b": (-1, True), "c": (10000, False)}


def test_numbers_are_rounded_once(spark):
    assert value(spark, round_half_up(F.lit(0.0049999996), 2)) == 0.0
    assert value(spark, round_half_up(F.lit(2.4999999), 0)) == 2.0
    assert value(spark, round_half_up(F.lit(2.5), 0)) == 3.0
