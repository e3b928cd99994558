"""The formulas and the run-log lookups as SQL functions of the session catalog.

SQL functions are macros: the analyzer puts their bodies in place, so a query that
calls them is planned and compiled like one that spells the formulas out.
"""

from pyspark.sql import DataFrame, SparkSession

from shelfwatch import fixed_values as V
from shelfwatch.functions.numeric import EXACT

DAYS = "CASE WHEN usage = 0 THEN {none}D ELSE try_divide(stock, usage) END".format(none=V.NO_USAGE_DAYS)
NEED = "lead * usage - stock"
STOCK = "stock DOUBLE, usage DOUBLE"
PLAN = "lead BIGINT, usage DOUBLE, stock DOUBLE"


def _rounded(value: str, places: int = 0) -> str:
    return f"CAST(round(CAST({value} AS {EXACT}), {places}) AS DOUBLE)"


def _levels(*bounds: tuple[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for test, name in bounds) + f" ELSE '{other}' END"


_CRITICAL = (f"days <= 0 OR days <= lead * {V.CRITICAL_LEAD_SHARE}D", "CRITICAL")
_HIGH = ("days <= lead", "HIGH")

# name -> (parameters, type, body)
FORMULAS: dict[str, tuple[str, str, str]] = {
    "days_left": (STOCK, "DOUBLE", DAYS),
    "days_left_latest": (
        STOCK, "DOUBLE", f"CASE WHEN usage IS NULL THEN {V.NO_USAGE_DAYS}D ELSE {_rounded(DAYS, 2)} END"
    ),
    "risk_status": ("days DOUBLE, lead BIGINT", "STRING", _levels(_HIGH, other="NORMAL")),
    "risk_status_latest": (
        "stock DOUBLE, usage DOUBLE, lead BIGINT", "STRING",
        _levels(("usage <> 0 AND try_divide(stock, usage) <= lead", "HIGH"), other="NORMAL"),
    ),
    "urgency3": ("days DOUBLE, lead BIGINT", "STRING", _levels(_CRITICAL, _HIGH, other="MEDIUM")),
    "urgency4": (
        "days DOUBLE, lead BIGINT", "STRING",
        _levels(_CRITICAL, _HIGH, (f"days <= lead * {V.MEDIUM_LEAD_SHARE}D", "MEDIUM"), other="LOW"),
    ),
    "urgency_rank": (
        "level STRING", "BIGINT", "array_position(array('CRITICAL', 'HIGH', 'MEDIUM', 'LOW'), level)"
    ),
    "reorder_qty": (PLAN, "DOUBLE", f"greatest(0D, {NEED})"),
    "reorder_qty_latest": (PLAN, "DOUBLE", f"greatest(0D, {_rounded(NEED)})"),
    "reorder_qty_with_safety": (
        PLAN, "DOUBLE", f"greatest(0D, {_rounded(f'(lead + {V.SAFETY_DAYS}) * usage - stock')})"
    ),
    "priority_score": (
        f"{PLAN}, criticality DOUBLE DEFAULT 0", "DOUBLE",
        _rounded(
            f"lead * {V.SCORE_PER_LEAD_DAY}D + usage * {V.SCORE_PER_USED_UNIT}D + criticality"
            f" - stock * {V.SCORE_PER_STOCK_UNIT}D", 2
        ),
    ),
    "trend_direction": (
        "short_avg DOUBLE, long_avg DOUBLE", "STRING",
        _levels(
            (f"short_avg > long_avg * {V.TREND_UP}D", "INCREASING"),
            (f"short_avg < long_avg * {V.TREND_DOWN}D", "DECREASING"), other="STABLE",
        ),
    ),
    "volatility_pct": (
        "deviation DOUBLE, mean DOUBLE", "DOUBLE",
        f"CASE WHEN mean = 0 THEN 0D ELSE {_rounded('try_divide(deviation, mean) * 100', 2)} END",
    ),
    "demand_pattern": (
        "volatility DOUBLE", "STRING",
        _levels(
            (f"volatility > {V.HIGHLY_VARIABLE_PCT}", "HIGHLY_VARIABLE"),
            (f"volatility > {V.VARIABLE_PCT}", "VARIABLE"), other="STABLE",
        ),
    ),
    "alert_type": (
        "days DOUBLE, risk STRING, urgency STRING", "STRING",
        _levels(
            ("days <= 0", "CRITICAL_RISK"), ("risk = 'HIGH'", "HIGH_RISK"),
            ("urgency = 'CRITICAL'", "CRITICAL_RISK"), other="REORDER_NEEDED",
        ),
    ),
    "default_order_qty": (
        "usage DOUBLE, stock BIGINT", "BIGINT",
        f"greatest(BIGINT({V.DEFAULT_ORDER_MIN}), CAST(usage * {V.DEFAULT_ORDER_DAYS} AS BIGINT) - stock)",
    ),
    "projected_days": (STOCK, "DOUBLE", f"CASE WHEN usage > 0 THEN try_divide(stock, usage) ELSE {V.NO_USAGE_DAYS}D END"),
    "cover_level": (
        "days DOUBLE, lead BIGINT", "STRING",
        _levels((f"days > lead * {V.SAFE_LEAD_SHARE}", "SAFE"), ("days > lead", "MODERATE"), other="HIGH"),
    ),
    "coverage_qty": ("days INT, usage DOUBLE, stock DOUBLE", "DOUBLE", "greatest(0D, usage * days - stock)"),
}

RUN_COLUMNS = (
    "log_id BIGINT, task_name STRING, execution_time TIMESTAMP, status STRING, records_processed BIGINT, "
    "error_message STRING, execution_duration_seconds DOUBLE"
)
HISTORY_ROWS = 100


def register_formulas(spark: SparkSession, database: str | None = None) -> list[str]:
    """Make every formula a SQL function: of the session, or a permanent one of ``database``."""
    kind = "TEMPORARY FUNCTION" if database is None else "FUNCTION"
    names = []
    for name, (parameters, result, body) in FORMULAS.items():
        names.append(name if database is None else f"{database}.{name}")
        spark.sql(f"CREATE OR REPLACE {kind} {names[-1]}({parameters}) RETURNS {result} RETURN {body}")
    return names


def register_run_lookups(spark: SparkSession, runs: DataFrame, view: str = "task_runs") -> None:
    """``task_history(task, as_of, hours)`` and ``refresh_status(task)`` as table functions over a run log.

    ``runs`` becomes the view ``view``. A null or missing task means every task.
    """
    runs.createOrReplaceTempView(view)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION task_history(
              task STRING, as_of TIMESTAMP DEFAULT current_timestamp(), hours INT DEFAULT 24)
            RETURNS TABLE ({RUN_COLUMNS})
            RETURN SELECT log_id, task_name, execution_time, status, records_processed, error_message,
                          execution_duration_seconds
                   FROM {view}
                   WHERE (task IS NULL OR task_name = task)
                     AND execution_time >= as_of - make_interval(0, 0, 0, 0, hours)
                   ORDER BY execution_time DESC, log_id DESC LIMIT {HISTORY_ROWS}"""
    )
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION refresh_status(task STRING DEFAULT NULL)
            RETURNS TABLE (task_name STRING, state STRING, last_refresh_start TIMESTAMP, last_refresh_end TIMESTAMP)
            RETURN SELECT task_name, r.status, r.execution_time,
                          r.execution_time + make_dt_interval(0, 0, 0, CAST(r.execution_duration_seconds AS DECIMAL(18, 6)))
                   FROM (SELECT task_name,
                                max(struct(execution_time, log_id, status, execution_duration_seconds)) AS r
                         FROM {view} WHERE task IS NULL OR task_name = task GROUP BY task_name)"""
    )
