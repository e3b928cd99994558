from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwatch.plans import latest, oplog, retention
from shelfwatch.schema import ACTIONS, ALERTS, ORDERS, RUN_LOG, SERIES_KEY

NOW = datetime(2024, 3, 1, 12, 0)
KEYS = ", ".join(f"{k} string" for k in SERIES_KEY)


@pytest.fixture
def log(spark):
    rows = [
        ("s1", "ann", "ITEM_REVIEWED", 50, "Data"),
        ("s1", "ann", "ORDER_PLACED", 30, "Dashboard"),
        ("s1", "ann", "ORDER_PLACED", 30, "Dashboard"),
        ("s2", "bob", "PDF_EXPORTED", 200, "Dashboard"),
        ("s2", "bob", "DATA_UPLOADED", 60 * 30, "Data"),
    ]
    return spark.createDataFrame(
        [(i, t, NOW - timedelta(minutes=m), u, s, p, m) for i, (s, u, t, m, p) in enumerate(rows)],
        "action_id long, action_type string, action_timestamp timestamp, user_name string, session_id string, "
        "source_page string, response_time_ms long",
    )


def test_sessions(spark, log):
    found = {r["session_id"]: r for r in oplog.sessions(log).collect()}
    assert found["s1"]["actions_count"] == 3 and found["s1"]["items_ordered"] == 2
    assert found["s1"]["pages_visited"] == ["Dashboard", "Data"]
    assert found["s2"]["pdfs_exported"] == 1 and found["s2"]["data_uploads"] == 1


def test_closing_and_active_sessions(spark, log):
    closings = spark.createDataFrame([("s2", NOW)], "session_id string, closed_at timestamp")
    closed = oplog.close_sessions(oplog.sessions(log), closings)
    ended = closed.filter("session_id = 's2'").first()
    assert (ended["is_active"], ended["session_duration_minutes"]) == (False, 1800)
    active = oplog.active_sessions(closed, F.lit(NOW)).collect()
    assert [(r["session_id"], r["minutes_active"]) for r in active] == [("s1", 20)]


def test_time_limits(log):
    now = F.lit(NOW)
    assert [r["action_id"] for r in oplog.recent_actions(log, now, hours=1).collect()] == [2, 1, 0]
    assert oplog.response_times(log, now).first()["total_actions"] == 3
    assert oplog.action_users(log, now).first()["action_count"] == 2
    assert oplog.highest_id(log, "action_id").first()[0] == 4


def test_orders_come_with_log_rows(spark):
    requests = spark.createDataFrame(
        [("o", "l", "i", 5.0, "ann", None), ("o", "l", "j", 2.5, "bob", "HIGH")],
        f"{KEYS}, ordered_qty double, user_name string, priority string",
    )
    orders, actions = oplog.place_orders(requests, F.lit(NOW))
    again, _ = oplog.place_orders(requests, F.lit(NOW))
    rows = {r["item"]: r for r in orders.collect()}
    assert rows["i"]["priority_level"] == "MEDIUM" and rows["j"]["status"] == "PENDING"
    assert {r["order_id"] for r in again.collect()} == {r["order_id"] for r in rows.values()}
    details = {r["item"]: r["action_details"] for r in actions.collect()}
    assert details["j"] == f'{{"order_id":{rows["j"]["order_id"]},"quantity":2.5}}'


def test_equal_requests_get_ids_of_their_own(spark, tmp_path):
    asked = [("o", None, "i", 5.0, "ann", "HIGH")] * 3 + [(None, "o", "i", 5.0, "ann", "HIGH")]
    requests = spark.createDataFrame(asked, f"{KEYS}, ordered_qty double, user_name string, priority string")
    first, actions = oplog.place_orders(requests, F.lit(NOW))
    again, _ = oplog.place_orders(requests, F.lit(NOW))
    other, _ = oplog.place_orders(requests, F.lit(NOW), F.lit("another batch"))
    ids = [{r["order_id"] for r in df.collect()} for df in (first, again, other)]
    assert len(ids[0]) == 4 and ids[0] == ids[1] and not ids[0] & ids[2]
    path = str(tmp_path / "orders")
    oplog.append_orders(first, path)
    stored = oplog.read_orders(spark, path)
    assert {r["order_id"] for r in stored.collect()} == ids[0] and stored.columns == ORDERS.fieldNames()
    log = str(tmp_path / "log")
    same = actions.withColumn("action_details", F.lit("{}"))
    oplog.append_actions(same, log, F.lit(NOW))
    assert spark.read.parquet(log).select("action_id").distinct().count() == 4


def test_unknown_times_are_kept(spark):
    rows = spark.createDataFrame([(NOW,), (NOW - timedelta(days=40),), (None,)], "t timestamp")
    assert retention.retain(rows, "t", 30, F.lit(NOW)).count() == 2
    assert retention.expired_count(rows, "t", 30, F.lit(NOW)).first()[0] == 1


def test_expired_partitions_of_two_levels(spark):
    days = [NOW - timedelta(days=d, hours=h) for d in (29, 30, 31) for h in (0, 2)] + [None]
    rows = spark.createDataFrame([(t, str(t)) for t in days], "execution_time timestamp, name string")
    rows = rows.withColumn("day", F.to_date("execution_time")).withColumn("batch_id", F.lit(1))
    rows.write.partitionBy("day", "batch_id").saveAsTable("deep_rows")
    assert retention.expire_table(spark, "deep_rows", "execution_time", 30, NOW, "day") == 3
    kept = {r["name"] for r in spark.table("deep_rows").collect()}
    assert kept == {str(t) for t in days if t is None or t >= NOW - timedelta(days=30)}


def test_appended_actions_get_defaults(spark, tmp_path):
    path = str(tmp_path / "actions")
    requests = spark.createDataFrame([("DATA_UPLOADED", "ann", None), ("PDF_EXPORTED", "bob", "Data")], "action_type string, user_name string, source_page string")
    oplog.append_actions(requests, path, F.lit(NOW))
    rows = {r["user_name"]: r for r in spark.read.schema(ACTIONS).parquet(path).collect()}
    assert (rows["ann"]["source_page"], rows["ann"]["status"]) == ("Dashboard", "SUCCESS")
    assert rows["bob"]["source_page"] == "Data" and rows["bob"]["action_timestamp"] == NOW
    assert len({r["action_id"] for r in rows.values()}) == 2


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert oplog.run_logged(spark, "good", lambda: 7, path) == "SUCCESS"
    assert oplog.run_logged(spark, "bad", lambda: 1 // 0, path) == "FAILED"
    rows = {r["task_name"]: r for r in spark.read.schema(RUN_LOG).parquet(path).collect()}
    assert rows["good"]["records_processed"] == 7 and rows["good"]["error_message"] is None
    assert "division" in rows["bad"]["error_message"] and rows["bad"]["records_processed"] == 0


def test_alert_modes(spark, series, make_ledger):
    # HIGH, and NORMAL but nearly out: usage 10, stock 20, lead 1
    ledger = series([10] * 3, closing=20, lead=7).unionByName(
        make_ledger([(0, "o", "l", "near", 0, 10, 20, 1), (0, "o", "l", "calm", 0, 1, 99, 1)])
    )
    stock = latest.stock_analytics(ledger, F.lit(NOW))
    advice = latest.reorder_recommendations(stock)
    nothing = spark.createDataFrame([], ALERTS)
    first = latest.new_alerts(stock, advice, nothing, F.lit(NOW))
    found = {r["item"]: r for r in first.collect()}
    assert {k: r["alert_type"] for k, r in found.items()} == {"Rice": "HIGH_RISK", "near": "REORDER_NEEDED"}
    assert (found["near"]["reorder_qty"], found["near"]["priority_score"]) == (0.0, 0.0)
    assert latest.new_alerts(stock, advice, first, F.lit(NOW)).isEmpty()
    literal = latest.new_alerts(stock, advice, first, F.lit(NOW), dedupe="literal")
    assert [r["item"] for r in literal.collect()] == ["Rice"]
    tomorrow = F.lit(NOW + timedelta(days=1))
    assert latest.new_alerts(stock, advice, first, tomorrow).count() == 2


def test_expired_partitions_are_dropped(spark):
    days = [(NOW - timedelta(days=d, hours=h), f"r{d}.{h}") for d in (0, 29, 30, 31, 90) for h in (0, 2)]
    rows = spark.createDataFrame(days, "execution_time timestamp, name string").withColumn("day", F.to_date("execution_time"))
    rows.write.partitionBy("day").saveAsTable("run_rows")
    count = retention.expire_table(spark, "run_rows", "execution_time", 30, NOW, "day")
    kept = {r["name"] for r in spark.table("run_rows").collect()}
    assert kept == {"r0.0", "r0.2", "r29.0", "r29.2", "r30.0"} and count == 5
    assert retention.expire_table(spark, "run_rows", "execution_time", 30, NOW, "day") == 0
    kept_rows = retention.retain(rows, "execution_time", 30, F.lit(NOW))
    assert {r["name"] for r in kept_rows.collect()} == kept
    assert retention.expired_count(rows, "execution_time", 30, F.lit(NOW)).first()[0] == 5
