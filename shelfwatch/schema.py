"""Table schemas and the names shared by every operator."""

from pyspark.sql import types as T

SERIES_KEY = ["organization", "location", "item"]
DAY_KEY = ["date"] + SERIES_KEY
QUANTITIES = ["opening_stock", "received", "issued", "closing_stock", "lead_time_days"]

LEDGER = T.StructType(
    [T.StructField("date", T.DateType())]
    + [T.StructField(c, T.StringType()) for c in SERIES_KEY]
    + [T.StructField(c, T.LongType()) for c in QUANTITIES]
)
LEDGER_COLUMNS = LEDGER.fieldNames()

PROFILE = T.StructType(
    [
        T.StructField("organization", T.StringType()),
        T.StructField("sector", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("goods_type", T.StringType()),
        T.StructField("contact_email", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

RULES = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("score", T.IntegerType()),
    ]
)

SUMMARY = T.StructType(
    [
        T.StructField("summary_id", T.LongType()),
        T.StructField("summary_date", T.DateType()),
        T.StructField("summary_hour", T.IntegerType()),
        T.StructField("total_organizations", T.LongType()),
        T.StructField("total_items", T.LongType()),
        T.StructField("high_risk_count", T.LongType()),
        T.StructField("critical_risk_count", T.LongType()),
        T.StructField("total_reorder_qty", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

ALERTS = T.StructType(
    [T.StructField("alert_id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in SERIES_KEY]
    + [
        T.StructField("alert_type", T.StringType()),
        T.StructField("days_left", T.DoubleType()),
        T.StructField("closing_stock", T.LongType()),
        T.StructField("reorder_qty", T.DoubleType()),
        T.StructField("priority_score", T.DoubleType()),
        T.StructField("alert_date", T.DateType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

RUN_LOG = T.StructType(
    [
        T.StructField("log_id", T.LongType()),
        T.StructField("task_name", T.StringType()),
        T.StructField("execution_time", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("records_processed", T.LongType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("execution_duration_seconds", T.DoubleType()),
    ]
)

ORDERS = T.StructType(
    [T.StructField("order_id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in SERIES_KEY]
    + [
        T.StructField("order_date", T.DateType()),
        T.StructField("order_timestamp", T.TimestampType()),
        T.StructField("ordered_by", T.StringType()),
        T.StructField("current_stock", T.LongType()),
        T.StructField("recommended_qty", T.DoubleType()),
        T.StructField("ordered_qty", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("priority_level", T.StringType()),
        T.StructField("expected_delivery_date", T.DateType()),
        T.StructField("actual_delivery_date", T.DateType()),
        T.StructField("supplier", T.StringType()),
        T.StructField("unit_cost", T.DoubleType()),
        T.StructField("total_cost", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("modified_at", T.TimestampType()),
        T.StructField("modified_by", T.StringType()),
        T.StructField("notes", T.StringType()),
    ]
)

ACTIONS = T.StructType(
    [
        T.StructField("action_id", T.LongType()),
        T.StructField("action_type", T.StringType()),
        T.StructField("action_timestamp", T.TimestampType()),
        T.StructField("user_name", T.StringType()),
        T.StructField("user_email", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("organization", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("item", T.StringType()),
        T.StructField("action_details", T.StringType()),
        T.StructField("response_time_ms", T.LongType()),
        T.StructField("source_page", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
    ]
)
