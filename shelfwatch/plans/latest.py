"""Latest-row tables: stock analytics, reorder recommendations, usage statistics."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from shelfwatch import fixed_values as V
from shelfwatch.functions import formulas as f
from shelfwatch.functions.names import closing, lead_days
from shelfwatch.functions.ids import hashed_id
from shelfwatch.functions.numeric import round_half_up
from shelfwatch.operators.joins import add_by_key, same_key, without_keys
from shelfwatch.operators.tails import tail_figures
from shelfwatch.schema import SERIES_KEY
from shelfwatch.staging import staged


def newest_date(ledger: DataFrame) -> Column:
    """The ledger's newest date as a scalar, the default clock of these tables."""
    return ledger.agg(F.max("date")).scalar()


def as_time(moment: Column | datetime) -> Column:
    moment = moment if isinstance(moment, Column) else F.lit(moment)
    return moment.cast("timestamp")


def stock_from_tails(tails: DataFrame, as_of: Column | datetime) -> DataFrame:
    """Stock analytics from :func:`tail_figures`, one row per series."""
    usage = F.col("avg_short")
    return tails.select(
        *SERIES_KEY,
        "closing_stock",
        "lead_time_days",
        round_half_up(usage, 2).alias("avg_daily_usage"),
        f.days_left_latest(closing(), usage).alias("days_left"),
        f.risk_status_latest(closing(), usage, lead_days()).alias("risk_status"),
        as_time(as_of).alias("last_updated"),
    )


def stock_analytics(ledger: DataFrame, as_of: Column | datetime | None = None) -> DataFrame:
    """Newest stock, 7-row usage, days left and risk of every series."""
    return stock_from_tails(*_timed_figures(ledger, as_of))


def _timed_figures(ledger: DataFrame, as_of: Column | datetime | None) -> tuple[DataFrame, Column | datetime]:
    """Figures of all series and the clock: by default the newest date among the figures.

    The figures, one row per series, are stored once and read for both.
    """
    figures = tail_figures(ledger)
    if as_of is not None:
        return figures, as_of
    figures = staged(figures, "figures")
    return figures, newest_date(figures)


def advice_columns() -> dict[str, Column]:
    """Reorder quantities, urgency and score from the rounded stock analytics."""
    usage = F.col("avg_daily_usage")
    return {
        "reorder_qty": f.reorder_qty_latest(lead_days(), usage, closing()),
        "reorder_qty_with_safety": f.reorder_qty_with_safety(lead_days(), usage, closing()),
        "urgency_level": f.urgency4(F.col("days_left"), lead_days()),
        "priority_score": f.priority_score(lead_days(), usage, closing()),
    }


def classify_reorders(stock: DataFrame) -> DataFrame:
    """Reorder quantities, urgency and score of every series, unfiltered."""
    return stock.select(
        *SERIES_KEY,
        "closing_stock",
        "avg_daily_usage",
        "days_left",
        "lead_time_days",
        *[value.alias(name) for name, value in advice_columns().items()],
        "last_updated",
    )


def reorder_recommendations(stock: DataFrame) -> DataFrame:
    """Series that need stock; built from the rounded stock analytics."""
    return classify_reorders(stock).filter(F.col("reorder_qty") > 0)


def sorted_recommendations(recommendations: DataFrame) -> DataFrame:
    """Highest score first, then shortest supply."""
    return recommendations.orderBy(F.col("priority_score").desc(), "days_left", *SERIES_KEY)


def usage_from_tails(tails: DataFrame, as_of: Column | datetime) -> DataFrame:
    """Usage statistics from :func:`tail_figures`, one row per series."""
    short, long, spread = F.col("avg_short"), F.col("avg_long"), F.col("stddev_short")
    volatility = f.volatility_pct(spread, short)
    return tails.select(
        *SERIES_KEY,
        F.col("date").alias("last_data_date"),
        round_half_up(short, 2).alias("avg_daily_usage_7d"),
        round_half_up(long, 2).alias("avg_daily_usage_30d"),
        F.col("min_short").alias("min_usage_7d"),
        F.col("max_short").alias("max_usage_7d"),
        round_half_up(spread, 2).alias("usage_stddev_7d"),
        f.trend_direction(short, long).alias("trend_direction"),
        volatility.alias("usage_volatility_pct"),
        f.demand_pattern(volatility).alias("demand_pattern"),
        as_time(as_of).alias("last_updated"),
    )


def usage_stats(ledger: DataFrame, as_of: Column | datetime | None = None) -> DataFrame:
    """Rolling usage, trend and demand pattern of every series' newest row."""
    return usage_from_tails(*_timed_figures(ledger, as_of))


def riskiest(stock: DataFrame, k: int = V.TOP_LIST) -> DataFrame:
    """HIGH series with the shortest supply."""
    rows = stock.filter(F.col("risk_status") == "HIGH")
    return rows.select(*SERIES_KEY, "closing_stock", "days_left", "risk_status").orderBy(
        "days_left", *SERIES_KEY
    ).limit(k)


def top_recommendations(recommendations: DataFrame, k: int = V.TOP_LIST) -> DataFrame:
    """CRITICAL and HIGH recommendations with the highest score."""
    rows = recommendations.filter(F.col("urgency_level").isin("CRITICAL", "HIGH"))
    return rows.select(*SERIES_KEY, "reorder_qty", "urgency_level", "priority_score").orderBy(
        F.col("priority_score").desc(), *SERIES_KEY
    ).limit(k)


def rising_usage(usage: DataFrame, k: int = V.TOP_LIST) -> DataFrame:
    """Series with rising usage, the most used first."""
    rows = usage.filter(F.col("trend_direction") == "INCREASING")
    return rows.orderBy(F.col("avg_daily_usage_7d").desc(), *SERIES_KEY).select(
        "organization", "item", "avg_daily_usage_7d", "avg_daily_usage_30d", "trend_direction", "demand_pattern"
    ).limit(k)


def stock_with_recommendations(stock: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Every series of the stock table with its recommendation, if it has one."""
    extra = recommendations.select(
        *SERIES_KEY, "reorder_qty", "reorder_qty_with_safety", "urgency_level", "priority_score"
    )
    return add_by_key(stock, extra, SERIES_KEY, "left")


def with_advice(stock: DataFrame) -> DataFrame:
    """:func:`stock_with_recommendations` without a join.

    A recommendation is a function of its stock row, so it is computed beside it and
    NULL where there is none.
    """
    columns = advice_columns()
    needed = columns["reorder_qty"] > 0
    return stock.withColumns({name: F.when(needed, value) for name, value in columns.items()})


def summary_of_stock(stock: DataFrame, as_of: Column | datetime) -> DataFrame:
    """:func:`analytics_summary` of a stock table and its own recommendations, in one scan."""
    return _summary(with_advice(stock), as_of)


def analytics_summary(stock: DataFrame, recommendations: DataFrame, as_of: Column | datetime) -> DataFrame:
    """One row of totals for the hour of ``as_of``."""
    return _summary(stock_with_recommendations(stock, recommendations), as_of)


def summary_sums() -> list[Column]:
    """The totals of :func:`with_advice` rows that add up over parts of the stock."""
    return [
        F.sum(F.when(F.col("risk_status") == "HIGH", 1).otherwise(0)).alias("high_risk_count"),
        F.sum(F.when(F.col("days_left") <= 0, 1).otherwise(0)).alias("critical_risk_count"),
        F.coalesce(F.sum("reorder_qty"), F.lit(0.0)).alias("total_reorder_qty"),
    ]


def _summary(rows: DataFrame, as_of: Column | datetime) -> DataFrame:
    now = as_time(as_of)
    totals = rows.agg(
        F.countDistinct("organization").alias("total_organizations"),
        F.countDistinct("item").alias("total_items"),
        *summary_sums(),
    )
    return totals.select(
        now.cast("date").alias("summary_date"), F.hour(now).alias("summary_hour"), *totals.columns
    )


def alert_candidates(stock: DataFrame, recommendations: DataFrame | None, as_of: Column | datetime) -> DataFrame:
    """Series that are HIGH or nearly out of stock, typed as alerts of the day.

    Without ``recommendations`` the stock's own are computed in place.
    """
    rows = with_advice(stock) if recommendations is None else stock_with_recommendations(stock, recommendations)
    rows = rows.filter((F.col("risk_status") == "HIGH") | (F.col("days_left") <= V.ALERT_DAYS))
    kind = f.alert_type(F.col("days_left"), F.col("risk_status"), F.col("urgency_level"))
    return rows.select(
        *SERIES_KEY,
        kind.alias("alert_type"),
        "days_left",
        "closing_stock",
        F.coalesce("reorder_qty", F.lit(0.0)).alias("reorder_qty"),
        F.coalesce("priority_score", F.lit(0.0)).alias("priority_score"),
        as_time(as_of).cast("date").alias("alert_date"),
        "risk_status",
    )


def new_alerts(
    stock: DataFrame,
    recommendations: DataFrame | None,
    history: DataFrame,
    as_of: Column | datetime,
    dedupe: str = "all",
) -> DataFrame:
    """Alerts to append for the day of ``as_of``.

    ``dedupe="all"`` skips every series already alerted that day;
    ``dedupe="literal"`` skips only those that are not HIGH, so HIGH rows repeat.
    """
    rows = alert_candidates(stock, recommendations, as_of)
    today = history.filter(F.col("alert_date") == as_time(as_of).cast("date")).select(*SERIES_KEY)
    if dedupe == "all":
        fresh = without_keys(rows, today, SERIES_KEY)
    elif dedupe == "literal":
        repeated = same_key(SERIES_KEY, "l", "r") & (F.col("l.risk_status") != "HIGH")
        fresh = rows.alias("l").join(today.alias("r"), repeated, "left_anti")
    else:
        raise ValueError(f"unknown dedupe mode {dedupe!r}")
    return fresh.drop("risk_status")


def with_alert_ids(alerts: DataFrame, as_of: Column | datetime) -> DataFrame:
    """Add the id (a hash of series and day, NULLs included) and creation time of alert rows."""
    return alerts.withColumn("alert_id", hashed_id([*SERIES_KEY, "alert_date"])).withColumn(
        "created_at", as_time(as_of)
    )
