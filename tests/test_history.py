from collections import defaultdict

from pyspark.sql import functions as F

from shelfwatch import fixed_values as V
from shelfwatch.operators import criticality
from shelfwatch.operators.usage import slice_ledger
from shelfwatch.plans import history, orders
from shelfwatch.schema import RULES, SERIES_KEY


def judged(ledger):
    """Brute force: ledger rows with usage and days."""
    rows = ledger.collect()
    issued = defaultdict(list)
    for r in rows:
        issued[r[1:4]].append(r["issued"])
    for r in rows:
        usage = sum(issued[r[1:4]]) / len(issued[r[1:4]])
        yield r, usage, (r["closing_stock"] / usage if usage else 9999.0)


def test_overview_counts_rows(random_ledger):
    rows = list(judged(random_ledger))
    found = history.overview(random_ledger).first()
    assert found["total_organizations"] == 3 and found["total_items"] == 7
    assert found["high_risk_count"] == sum(days <= r["lead_time_days"] for r, _, days in rows)


def test_alerts_match_brute_force(random_ledger):
    wanted = sorted(
        repr((r[1:4], r["closing_stock"], days < 9999)) for r, _, days in judged(random_ledger) if days <= r["lead_time_days"]
    )
    found = history.alerts(random_ledger).collect()
    assert wanted == sorted(repr((r[0:3], r["closing_stock"], True)) for r in found)
    assert [r["days_left"] for r in found] == sorted(r["days_left"] for r in found)


def test_series_without_a_name_keep_their_rows(random_ledger):
    nameless = history.high_risk_series(random_ledger).filter(F.col("location").isNull())
    wanted = [r for r, _, days in judged(random_ledger) if r["location"] is None and days <= r["lead_time_days"]]
    assert nameless.first()["high_rows"] == len(wanted)


def test_reorders_sort_by_name_or_by_meaning(random_ledger):
    literal = [r["urgency_level"] for r in history.reorder_list(random_ledger).collect()]
    assert literal == sorted(literal, reverse=True) and literal[-1] == "CRITICAL"
    assert history.reorder_list(random_ledger, semantic_order=True).first()["urgency_level"] == "CRITICAL"
    summary = {r["urgency_level"]: r["number_of_items"] for r in history.urgency_summary(history.reorder_list(random_ledger)).collect()}
    assert sum(summary.values()) == len(literal)


def test_ordered_items_leave_the_actions(spark, make_ledger):
    ledger = make_ledger([(0, "o", "l", f"i{n}", 0, 10 + n, 5, 9) for n in range(6)])
    ordered = spark.createDataFrame([("o", "l", "i5"), ("o", "l", "i5")], "organization string, location string, item string")
    found = history.top_actions(ledger, V.FALLBACK_RULES, ordered).collect()
    assert [r["item"] for r in found] == ["i4", "i3", "i2"]
    flags = {r["item"]: r["ordered"] for r in history.scored_alerts(ledger, V.FALLBACK_RULES, ordered).collect()}
    assert flags["i5"] and not flags["i4"] and len(flags) == 6
    assert [r["item"] for r in history.ordered_alerts(ledger, V.FALLBACK_RULES, ordered).collect()] == ["i5"]


def test_action_table_is_ranked_text(spark, make_ledger, tmp_path):
    ledger = make_ledger([(0, "o", "l", f"Kit, {n}", 0, 10 + n, 5, 9) for n in range(5)])
    scored = history.score_rows(history.alerts(ledger), V.FALLBACK_RULES)
    orders.export_actions(scored, str(tmp_path / "actions"))
    rows = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "actions")).collect()
    assert [tuple(r)[:2] for r in rows] == [("1", "Kit, 4"), ("2", "Kit, 3"), ("3", "Kit, 2")]
    assert rows[0]["days_left"] == "0.4"


def test_slice_matches_names_with_quotes(make_ledger):
    ledger = make_ledger([(0, "O'Neil Clinic", "l", "i", 0, 1, 1, 1), (0, "Other", "l", "i", 0, 1, 1, 1)])
    assert slice_ledger(ledger, organization="O'Neil Clinic", location="All").count() == 1
    assert slice_ledger(ledger).count() == 2


def test_explanation_wording(make_ledger):
    ledger = make_ledger([(0, "City", "ER", "Masks", 0, 4, 5, 3)])
    text = history.explain_rows(history.alerts(ledger)).first()["explanation"]
    assert text.startswith("Masks at City – ER is at high risk of stock-out. Average daily usage is 4.0 units")
    assert "lead time of 3 days. Current stock will last approximately 1.3 days," in text


def test_snapshot_grid_and_lists(make_ledger):
    ledger = make_ledger(
        [(0, "o", "a", "i", 0, 1, 5, 1), (1, "o", "a", "i", 0, 1, 7, 1), (1, "o", "b", "j", 0, 1, 2, 1)]
    )
    assert {(r["location"], r["closing_stock"]) for r in history.latest_snapshot(ledger).collect()} == {("a", 7), ("b", 2)}
    grid = {r["item"]: (r["a"], r["b"]) for r in history.stock_grid(history.stock_heat(ledger), ["a", "b"]).collect()}
    assert grid == {"i": (12, 0), "j": (0, 2)}
    assert [r[0] for r in history.name_list(ledger, "location").collect()] == ["a", "b"]


def test_criticality_takes_the_highest_rule(spark):
    rules = {
        "location_rules": [{"pattern": "ER", "score": 12}, {"pattern": "Ward", "score": 4}],
        "item_rules": [{"items": ["Rice", "Masks"], "score": 5}],
        "default_score": 3,
    }
    table = spark.createDataFrame(
        [("location", "ER", 12), ("location", "Ward", 4), ("item", "Rice", 5), ("item", "Masks", 5)], RULES
    )
    places = ["ER 1", "North ER", "er", "Ward", "ERWard", "W", "", None]
    rows = spark.createDataFrame(
        [("o", p, i) for p in places for i in ("Rice", "Brown Rice", None)], ", ".join(f"{k} string" for k in SERIES_KEY)
    )
    both = criticality.with_criticality(rows.withColumn("expr", criticality.criticality(rules)), table, 3).collect()
    assert len(both) == 24 and all(r["expr"] == r["criticality"] for r in both)
    points = {(r["location"], r["item"]): r["criticality"] for r in both}
    assert points[("North ER", "Rice")] == 12 and points[("er", "Rice")] == 5
    assert points[("Ward", "Brown Rice")] == 4 and points[("W", None)] == 3


def test_empty_pattern_matches_every_location(spark):
    table = spark.createDataFrame([("location", "", 9)], RULES)
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "location string, item string")
    assert [r["criticality"] for r in criticality.with_criticality(rows, table, 3).collect()] == [9, 9]


def test_shuffled_joins_give_the_same_rows(spark, random_ledger):
    """Beyond the broadcast limit both sides are shuffled; one series holds most rows."""
    small = sorted(map(tuple, history.alerts(random_ledger).collect()), key=repr)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = sorted(map(tuple, history.alerts(random_ledger.repartition(9)).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert large == small and any(r[1] is None for r in large)
