"""Operational tables: actions, sessions, orders and task runs."""

import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwatch import fixed_values as V
from shelfwatch.functions.ids import hashed_id, with_request_ids
from shelfwatch.functions.numeric import minute_boundaries, round_half_up
from shelfwatch.operators.changes import pending_changes
from shelfwatch.schema import ACTIONS, ORDERS, RUN_LOG, SERIES_KEY


def newest(df: DataFrame, column: str) -> Column:
    """The newest value of a time column as a scalar, the default clock of a log."""
    return df.agg(F.max(column)).scalar()


def since(df: DataFrame, column: str, as_of: Column, hours: int) -> DataFrame:
    """Rows of the last ``hours`` before ``as_of``."""
    return df.filter(F.col(column) >= as_of - F.expr(f"INTERVAL {hours} HOURS"))


# --- actions -----------------------------------------------------------------


def recent_actions(actions: DataFrame, as_of: Column, hours: int = 24, limit: int | None = 100) -> DataFrame:
    """Newest actions of the last hours."""
    rows = since(actions, "action_timestamp", as_of, hours)
    rows = rows.orderBy(F.col("action_timestamp").desc(), F.col("action_id").desc())
    return rows if limit is None else rows.limit(limit)


def action_stats(actions: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Count and mean response time per action type."""
    return since(actions, "action_timestamp", as_of, hours).groupBy("action_type").agg(
        F.count(F.lit(1)).alias("count"), F.avg("response_time_ms").alias("avg_response_ms")
    )


def action_users(actions: DataFrame, as_of: Column, hours: int = 7 * 24) -> DataFrame:
    """Count and distinct users per action type, the most frequent first."""
    return (
        since(actions, "action_timestamp", as_of, hours)
        .groupBy("action_type")
        .agg(F.count(F.lit(1)).alias("action_count"), F.countDistinct("user_name").alias("unique_users"))
        .orderBy(F.col("action_count").desc(), "action_type")
    )


def response_times(actions: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    """Mean, shortest and longest response of the last hours, one row."""
    return since(actions, "action_timestamp", as_of, hours).agg(
        F.avg("response_time_ms").alias("avg_response_ms"),
        F.min("response_time_ms").alias("min_response_ms"),
        F.max("response_time_ms").alias("max_response_ms"),
        F.count(F.lit(1)).alias("total_actions"),
    )


def highest_id(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).alias("last_id"))


def complete_actions(requests: DataFrame, as_of: Column, batch: Column | None = None) -> DataFrame:
    """Action requests as full log rows with defaults and ids.

    The id hashes all fields, ``batch`` and the number of the action among equal ones,
    so a repeated write of one batch gives the same ids and equal actions differ.
    """
    defaults = {
        "action_timestamp": as_of,
        "status": F.lit("SUCCESS"),
        "source_page": F.lit(V.DEFAULT_ACTION_PAGE),
    }
    for field in ACTIONS.fields:
        if field.name == "action_id":
            continue
        default = defaults.get(field.name, F.lit(None))
        if field.name in requests.columns:
            value = F.coalesce(F.col(field.name), default)
        else:
            value = default
        requests = requests.withColumn(field.name, value.cast(field.dataType))
    if "action_id" not in requests.columns:
        given = [c for c in ACTIONS.fieldNames() if c != "action_id"]
        requests = with_request_ids(requests, "action_id", given, as_of if batch is None else batch)
    return requests.select(*ACTIONS.fieldNames())


def detail(name: str, kind: str) -> Column:
    """One value of the JSON details of an action, NULL where it is absent."""
    parsed = F.try_parse_json(F.col("action_details"))
    return F.try_variant_get(parsed, f"$.{name}", kind)


def append_actions(requests: DataFrame, path: str, as_of: Column, batch: Column | None = None) -> None:
    """Append a batch of actions; ``batch`` names it, by default its time."""
    rows = complete_actions(requests, as_of, batch)
    rows.withColumn("action_date", F.to_date("action_timestamp")).write.mode("append").partitionBy(
        "action_date"
    ).parquet(path)


# --- sessions ----------------------------------------------------------------


def sessions(actions: DataFrame) -> DataFrame:
    """Sessions derived from the action log; counts combine map-side."""

    def of_type(name: str) -> Column:
        return F.count_if(F.col("action_type") == name)

    return actions.groupBy("session_id").agg(
        F.max("user_name").alias("user_name"),
        F.min("action_timestamp").alias("session_start"),
        F.max("action_timestamp").alias("last_activity"),
        F.count(F.lit(1)).alias("actions_count"),
        F.sort_array(F.collect_set("source_page")).alias("pages_visited"),
        of_type("ITEM_REVIEWED").alias("items_reviewed"),
        of_type("ORDER_PLACED").alias("items_ordered"),
        of_type("PDF_EXPORTED").alias("pdfs_exported"),
        of_type("DATA_UPLOADED").alias("data_uploads"),
    )


def close_sessions(opened: DataFrame, closings: DataFrame) -> DataFrame:
    """Add end, length in minutes and active flag; closings are (session_id, closed_at)."""
    ends = closings.groupBy("session_id").agg(F.max("closed_at").alias("session_end"))
    return (
        opened.join(ends, "session_id", "left")
        .withColumn("is_active", F.col("session_end").isNull())
        .withColumn("session_duration_minutes", minute_boundaries(F.col("session_start"), F.col("session_end")))
    )


def active_sessions(closed: DataFrame, as_of: Column) -> DataFrame:
    """Open sessions with the minutes they have lasted, the most recent first."""
    until = F.coalesce(F.col("last_activity"), as_of)
    return (
        closed.filter(F.col("is_active"))
        .select(
            "session_id",
            "user_name",
            "session_start",
            "last_activity",
            minute_boundaries(F.col("session_start"), until).alias("minutes_active"),
            "pages_visited",
            "actions_count",
            "items_ordered",
        )
        .orderBy(F.col("last_activity").desc(), "session_id")
    )


# --- orders ------------------------------------------------------------------


def place_orders(requests: DataFrame, as_of: Column, batch: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Turn order requests into order rows and the matching log rows.

    Requests carry the series, ordered_qty, user_name and priority, and may carry
    an order_id and any other field of an order. Without an order_id it hashes the
    request, ``batch`` (by default ``as_of``) and its number among equal requests.
    """
    now = as_of.cast("timestamp")
    if "order_id" not in requests.columns:
        asked = [*SERIES_KEY, "ordered_qty", "user_name", "priority"]
        requests = with_request_ids(requests, "order_id", asked, now if batch is None else batch)
    made = {
        "order_date": now.cast("date"),
        "order_timestamp": now,
        "ordered_by": F.col("user_name"),
        "status": F.lit("PENDING"),
        "priority_level": F.coalesce("priority", F.lit("MEDIUM")),
        "created_at": now,
    }
    fields = []
    for field in ORDERS.fields:
        value = F.col(field.name) if field.name in requests.columns else F.lit(None)
        fields.append(made.get(field.name, value).cast(field.dataType).alias(field.name))
    orders = requests.select(*fields)
    details = F.to_json(F.struct("order_id", F.col("ordered_qty").cast("double").alias("quantity")))
    actions = requests.select(
        F.lit("ORDER_PLACED").alias("action_type"),
        "user_name",
        *SERIES_KEY,
        details.alias("action_details"),
    )
    return orders, actions


def append_orders(orders: DataFrame, path: str) -> None:
    """Append order rows to a table partitioned by order date."""
    rows = orders.select(*ORDERS.fieldNames())
    rows.write.mode("append").partitionBy("order_date").parquet(path)


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ORDERS).parquet(path).select(*ORDERS.fieldNames())


def pending_orders(orders: DataFrame, as_of: Column) -> DataFrame:
    """Open orders with days until delivery; priority sorts by name, descending."""
    return (
        orders.filter(F.col("status").isin(V.OPEN_ORDER_STATES))
        .select(
            "order_id",
            *SERIES_KEY,
            "order_date",
            "ordered_qty",
            "priority_level",
            "expected_delivery_date",
            F.datediff("expected_delivery_date", as_of.cast("date")).alias("days_until_delivery"),
        )
        .orderBy(F.col("priority_level").desc(), "expected_delivery_date", "order_id")
    )


# --- task runs ---------------------------------------------------------------


def run_row(task_name: str, begun: float, ended: float, rows: int = 0, error: str | None = None) -> tuple:
    """A run as a RUN_LOG row without id; times are seconds since 1970."""
    started = datetime.fromtimestamp(begun, timezone.utc)
    return (None, task_name, started, "SUCCESS" if error is None else "FAILED", rows, error, ended - begun)


def save_runs(spark: SparkSession, path: str, label: str, runs: list[tuple]) -> None:
    """Write run rows below the day of the first, in a folder named ``label``, in place of earlier ones there.

    The id hashes the task, its time and the label, so equal tasks of one moment differ.
    """
    rows = spark.createDataFrame(runs, RUN_LOG).withColumn("_label", F.lit(label))
    rows = rows.withColumn("log_id", hashed_id(["task_name", "execution_time", "_label"])).drop("_label")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/day={runs[0][2].date()}/batch_id={label}")


def run_logged(spark: SparkSession, task_name: str, work: Callable[[], int], path: str, raising: bool = False) -> str:
    """Run ``work`` and add one run row: rows processed, or the error.

    An error is recorded, and raised again only if ``raising``; the return value is the
    run's status.
    """
    begun = time.time()
    try:
        rows, failure = work(), None
    except Exception as caught:  # every failure of a task is a FAILED row
        rows, failure = 0, caught
    run = run_row(task_name, begun, time.time(), rows, None if failure is None else str(failure))
    save_runs(spark, path, uuid.uuid4().hex, [run])
    if failure is not None and raising:
        raise failure
    return run[3]


def _successes() -> Column:
    return F.sum(F.when(F.col("status") == "SUCCESS", 1).otherwise(0))


def run_performance(runs: DataFrame, as_of: Column, hours: int = 7 * 24) -> DataFrame:
    """Mean and longest run per task, with runs and successes."""
    return since(runs, "execution_time", as_of, hours).groupBy("task_name").agg(
        F.avg("execution_duration_seconds").alias("avg_duration"),
        F.max("execution_duration_seconds").alias("max_duration"),
        F.count(F.lit(1)).alias("executions"),
        _successes().alias("successful"),
    )


def run_rates(runs: DataFrame, as_of: Column, hours: int = 7 * 24) -> DataFrame:
    """Runs, successes and failures per task with the rounded mean duration."""
    return since(runs, "execution_time", as_of, hours).groupBy("task_name").agg(
        F.count(F.lit(1)).alias("total_executions"),
        _successes().alias("successful"),
        F.sum(F.when(F.col("status") == "FAILED", 1).otherwise(0)).alias("failed"),
        round_half_up(F.avg("execution_duration_seconds"), 2).alias("avg_duration_sec"),
    )


def run_history(runs: DataFrame, task_name: str, as_of: Column, hours: int = 24, limit: int = 100) -> DataFrame:
    """Newest runs of one task."""
    rows = since(runs.filter(F.col("task_name") == task_name), "execution_time", as_of, hours)
    return rows.orderBy(F.col("execution_time").desc(), F.col("log_id").desc()).limit(limit)


def log_tail(rows: DataFrame, time_column: str, id_column: str, limit: int = V.TOP_LIST, status: str | None = None) -> DataFrame:
    """Newest rows of a log, optionally of one status."""
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    return rows.orderBy(F.col(time_column).desc(), F.col(id_column).desc()).limit(limit)


def last_refreshes(runs: DataFrame) -> DataFrame:
    """State, start and end of every task's newest run; combines map-side."""
    newest_run = F.max(
        F.struct("execution_time", "log_id", "status", "execution_duration_seconds")
    ).alias("r")
    seconds = F.col("r.execution_duration_seconds")
    length = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return runs.groupBy("task_name").agg(newest_run).select(
        "task_name",
        F.col("r.status").alias("state"),
        F.col("r.execution_time").alias("last_refresh_start"),
        (F.col("r.execution_time") + length).alias("last_refresh_end"),
    )


def system_health(runs: DataFrame, feeds: dict[str, DataFrame], tables: list[str]) -> DataFrame:
    """One row per task, change feed and table with its state and a healthy flag.

    A run named like a table counts as that table's refresh.
    """
    last = last_refreshes(runs).select("task_name", "state")
    is_table = F.col("task_name").isin(tables)
    health = last.select(
        F.when(is_table, F.lit("table")).otherwise(F.lit("task")).alias("kind"),
        F.col("task_name").alias("component"),
        "state",
        F.lit(0).cast("long").alias("pending_changes"),
        (F.col("state") == "SUCCESS").alias("healthy"),
    )
    for name, changes in feeds.items():
        # a feed is healthy whenever it can be read
        health = health.unionByName(
            pending_changes(changes).select(
                F.lit("feed").alias("kind"),
                F.lit(name).alias("component"),
                F.when(F.col("pending_changes") > 0, F.lit("HAS_DATA")).otherwise(F.lit("EMPTY")).alias("state"),
                "pending_changes",
                F.lit(True).alias("healthy"),
            )
        )
    return health
