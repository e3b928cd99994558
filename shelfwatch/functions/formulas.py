"""Stock formulas and classes as native Column expressions."""

from pyspark.sql import Column, functions as F

from shelfwatch import fixed_values as V
from shelfwatch.functions.numeric import round_half_up


def days_left(stock: Column, usage: Column) -> Column:
    """Days until stock runs out; no usage gives the sentinel, unknown usage NULL."""
    return F.when(usage == 0, F.lit(V.NO_USAGE_DAYS)).otherwise(F.try_divide(stock, usage))


def days_left_latest(stock: Column, usage: Column) -> Column:
    """Rounded days left of a latest row; unknown usage also gives the sentinel."""
    exact = days_left(stock, usage)
    return F.when(usage.isNull(), F.lit(V.NO_USAGE_DAYS)).otherwise(round_half_up(exact, 2))


def risk_status(days: Column, lead: Column) -> Column:
    return F.when(days <= lead, F.lit("HIGH")).otherwise(F.lit("NORMAL"))


def risk_status_latest(stock: Column, usage: Column, lead: Column) -> Column:
    """Risk of a latest row, judged on unrounded days; no usage is never HIGH."""
    return F.when(
        (usage != 0) & (F.try_divide(stock, usage) <= lead), F.lit("HIGH")
    ).otherwise(F.lit("NORMAL"))


def urgency3(days: Column, lead: Column) -> Column:
    """CRITICAL / HIGH / MEDIUM."""
    return (
        F.when((days <= 0) | (days <= lead * V.CRITICAL_LEAD_SHARE), F.lit("CRITICAL"))
        .when(days <= lead, F.lit("HIGH"))
        .otherwise(F.lit("MEDIUM"))
    )


def urgency4(days: Column, lead: Column) -> Column:
    """CRITICAL / HIGH / MEDIUM / LOW."""
    return (
        F.when((days <= 0) | (days <= lead * V.CRITICAL_LEAD_SHARE), F.lit("CRITICAL"))
        .when(days <= lead, F.lit("HIGH"))
        .when(days <= lead * V.MEDIUM_LEAD_SHARE, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def urgency_rank(level: Column) -> Column:
    """Sort rank, most urgent first."""
    return F.array_position(F.array(*[F.lit(x) for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]), level)


def reorder_qty(lead: Column, usage: Column, stock: Column) -> Column:
    return F.greatest(F.lit(0.0), lead * usage - stock)


def reorder_qty_latest(lead: Column, usage: Column, stock: Column) -> Column:
    return F.greatest(F.lit(0.0), round_half_up(lead * usage - stock))


def reorder_qty_with_safety(lead: Column, usage: Column, stock: Column) -> Column:
    return F.greatest(F.lit(0.0), round_half_up((lead + V.SAFETY_DAYS) * usage - stock))


def priority_score(lead: Column, usage: Column, stock: Column, criticality: Column | None = None) -> Column:
    """Weighted score, higher is more urgent; criticality points are optional."""
    points = lead * V.SCORE_PER_LEAD_DAY + usage * V.SCORE_PER_USED_UNIT
    if criticality is not None:
        points = points + criticality
    return round_half_up(points - stock * V.SCORE_PER_STOCK_UNIT, 2)


def trend_direction(short_avg: Column, long_avg: Column) -> Column:
    return (
        F.when(short_avg > long_avg * V.TREND_UP, F.lit("INCREASING"))
        .when(short_avg < long_avg * V.TREND_DOWN, F.lit("DECREASING"))
        .otherwise(F.lit("STABLE"))
    )


def volatility_pct(stddev: Column, mean: Column) -> Column:
    """Coefficient of variation in percent; zero usage gives 0."""
    share = F.try_divide(stddev, mean) * 100
    return F.when(mean == 0, F.lit(0.0)).otherwise(round_half_up(share, 2))


def demand_pattern(volatility: Column) -> Column:
    return (
        F.when(volatility > V.HIGHLY_VARIABLE_PCT, F.lit("HIGHLY_VARIABLE"))
        .when(volatility > V.VARIABLE_PCT, F.lit("VARIABLE"))
        .otherwise(F.lit("STABLE"))
    )


def alert_type(days: Column, risk: Column, urgency: Column) -> Column:
    return (
        F.when(days <= 0, F.lit("CRITICAL_RISK"))
        .when(risk == "HIGH", F.lit("HIGH_RISK"))
        .when(urgency == "CRITICAL", F.lit("CRITICAL_RISK"))
        .otherwise(F.lit("REORDER_NEEDED"))
    )


def default_order_qty(usage: Column, stock: Column) -> Column:
    """Order suggested when none is given: a month of usage less the stock."""
    month = (usage * V.DEFAULT_ORDER_DAYS).cast("long")
    return F.greatest(F.lit(V.DEFAULT_ORDER_MIN).cast("long"), month - stock.cast("long"))


def projected_days(stock: Column, usage: Column) -> Column:
    return F.when(usage > 0, F.try_divide(stock, usage)).otherwise(F.lit(V.NO_USAGE_DAYS))


def cover_level(days: Column, lead: Column) -> Column:
    """SAFE / MODERATE / HIGH after an order."""
    return (
        F.when(days > lead * V.SAFE_LEAD_SHARE, F.lit("SAFE"))
        .when(days > lead, F.lit("MODERATE"))
        .otherwise(F.lit("HIGH"))
    )


def coverage_qty(days: int, usage: Column, stock: Column) -> Column:
    return F.greatest(F.lit(0.0), usage * days - stock)
