"""Order planning: what-if projection, coverage and the exported action table."""

from pyspark.sql import DataFrame, Window, functions as F

from shelfwatch import fixed_values as V
from shelfwatch.functions import formulas as f
from shelfwatch.functions.numeric import fixed_point, round_half_up
from shelfwatch.operators.joins import add_by_key
from shelfwatch.plans.history import top_rows
from shelfwatch.schema import SERIES_KEY


def what_if(rows: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """Project every row's stock after an order.

    ``rows`` carry closing_stock, avg_daily_usage and lead_time_days. ``orders``
    (series key, order_qty) may leave series out; those get the default quantity.
    Given quantities outside the input range are kept and flagged ``qty_out_of_range``;
    the default has no range.
    """
    stock, usage, lead = F.col("closing_stock"), F.col("avg_daily_usage"), F.col("lead_time_days")
    default = f.default_order_qty(usage, stock)
    if orders is None:
        rows = rows.withColumn("order_qty", default).withColumn("qty_out_of_range", F.lit(False))
    else:
        wanted = orders.groupBy(*SERIES_KEY).agg(F.sum("order_qty").alias("order_qty"))
        rows = add_by_key(rows, wanted, SERIES_KEY, "left")
        inside = F.col("order_qty").between(V.ORDER_QTY_MIN, V.ORDER_QTY_MAX)
        rows = rows.withColumn("qty_out_of_range", F.coalesce(~inside, F.lit(False)))
        rows = rows.withColumn("order_qty", F.coalesce(F.col("order_qty").cast("long"), default))
    current = f.projected_days(stock, usage)
    projected = f.projected_days(stock + F.col("order_qty"), usage)
    return rows.withColumns(
        {
            "projected_stock": stock + F.col("order_qty"),
            "current_days": round_half_up(current, 2),
            "projected_days": round_half_up(projected, 2),
            "days_gained": round_half_up(projected - current, 2),
            "cover_level": f.cover_level(projected, lead),
        }
    )


def with_coverage(rows: DataFrame, days: tuple[int, ...] = V.COVERAGE_DAYS) -> DataFrame:
    """Add the quantity that covers each number of days, ``qty_<n>_days``."""
    stock, usage = F.col("closing_stock"), F.col("avg_daily_usage")
    return rows.withColumns(
        {f"qty_{n}_days": round_half_up(f.coverage_qty(n, usage, stock), 2) for n in days}
    )


def action_table(rows: DataFrame, k: int = V.TOP_ACTIONS) -> DataFrame:
    """The ``k`` best scored rows as ranked text, ready for export."""
    best = top_rows(rows, k)
    # at most k rows are left, so ranking them in one task is cheap
    rank = F.row_number().over(Window.orderBy(F.col("priority_score").desc(), *SERIES_KEY, "closing_stock"))
    return best.select(
        rank.alias("priority"),
        "item",
        "organization",
        "location",
        fixed_point(F.col("days_left"), 1).alias("days_left"),
        fixed_point(F.col("priority_score"), 1).alias("score"),
    )


def export_actions(rows: DataFrame, path: str, k: int = V.TOP_ACTIONS) -> None:
    """Write the ranked action table as one CSV file with a header."""
    table = action_table(rows, k).coalesce(1)
    table.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
