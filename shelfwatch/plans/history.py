"""All-history queries: every ledger row is judged by its series' mean usage."""

from pyspark.sql import DataFrame, functions as F

from shelfwatch import fixed_values as V
from shelfwatch.functions import formulas as f
from shelfwatch.functions.names import closing, lead_days
from shelfwatch.functions.numeric import round_half_up
from shelfwatch.functions.text import action_sentence, alert_sentence
from shelfwatch.operators.criticality import criticality
from shelfwatch.operators.joins import add_by_key, flag_keys, with_keys, without_keys
from shelfwatch.operators.usage import average_usage, with_risk
from shelfwatch.schema import DAY_KEY, LEDGER_COLUMNS, SERIES_KEY
from shelfwatch.staging import staged


def overview(ledger: DataFrame) -> DataFrame:
    """Distinct organizations and items, and the number of HIGH ledger rows.

    The distinct counts run over the one-row-per-series table, not the ledger.
    """
    usage = staged(average_usage(ledger), "usage")
    days = f.days_left(closing(), F.col("avg_usage"))
    is_high = f.risk_status(days, lead_days()) == "HIGH"
    high = add_by_key(ledger, usage, SERIES_KEY).agg(F.sum(F.when(is_high, 1).otherwise(0)))
    return usage.agg(
        F.countDistinct("organization").alias("total_organizations"),
        F.countDistinct("item").alias("total_items"),
    ).withColumn("high_risk_count", high.scalar())


def high_risk_series(ledger: DataFrame) -> DataFrame:
    """Series with at least one HIGH row, and how many such rows each has."""
    high = with_risk(ledger).filter(F.col("risk_status") == "HIGH")
    return high.groupBy(*SERIES_KEY).agg(F.count(F.lit(1)).alias("high_rows"))


# Further columns of a total sort. Without them, rows that tie on the report's own
# order would all land in one sort task.
TIES = ["closing_stock", "date", "issued", "received", "opening_stock"]


def _rounded(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(
        *DAY_KEY,
        "opening_stock",
        "received",
        "issued",
        "closing_stock",
        round_half_up(F.col("avg_usage"), 2).alias("avg_daily_usage"),
        round_half_up(F.col("days"), 2).alias("days_left"),
        "lead_time_days",
        *more,
    )


def _report(rows: DataFrame, *order) -> DataFrame:
    """Sorted rows without the ledger columns a report leaves out."""
    if order:
        rows = rows.orderBy(*order, *SERIES_KEY, *TIES)
    return rows.drop("date", "opening_stock", "received", "issued")


def _high_rows(ledger: DataFrame) -> DataFrame:
    return _rounded(with_risk(ledger).filter(F.col("risk_status") == "HIGH"), "risk_status")


def alerts(ledger: DataFrame, ordered: bool = True) -> DataFrame:
    """All HIGH ledger rows with rounded figures, shortest supply first."""
    return _report(_high_rows(ledger), *(["days_left"] if ordered else []))


def score_rows(rows: DataFrame, rules: dict) -> DataFrame:
    """Add the priority score with criticality, from the rounded usage."""
    score = f.priority_score(lead_days(), F.col("avg_daily_usage"), closing(), criticality(rules))
    return rows.withColumn("priority_score", score)


def scored_alerts(ledger: DataFrame, rules: dict, ordered_items: DataFrame) -> DataFrame:
    """HIGH rows with score and ordered flag, most urgent first."""
    flagged = flag_keys(score_rows(_high_rows(ledger), rules), ordered_items, SERIES_KEY, "ordered")
    return _report(flagged, F.col("priority_score").desc())


def ordered_alerts(ledger: DataFrame, rules: dict, ordered_items: DataFrame) -> DataFrame:
    """HIGH rows of items that were ordered."""
    rows = with_keys(_high_rows(ledger), ordered_items, SERIES_KEY)
    return score_rows(rows, rules).select(
        *SERIES_KEY, "closing_stock", "avg_daily_usage", "priority_score"
    )


def top_rows(rows: DataFrame, k: int, score: str = "priority_score") -> DataFrame:
    """The ``k`` best rows by score; ties go by series and stock."""
    return rows.orderBy(F.col(score).desc(), *SERIES_KEY, "closing_stock").limit(k)


def top_actions(ledger: DataFrame, rules: dict, ordered_items: DataFrame, k: int = V.TOP_ACTIONS) -> DataFrame:
    """The ``k`` most urgent HIGH rows that nobody ordered yet, with a sentence."""
    rows = without_keys(alerts(ledger, ordered=False).drop("risk_status"), ordered_items, SERIES_KEY)
    sentence = action_sentence(F.col("item"), F.col("organization"), F.col("location"))
    return top_rows(score_rows(rows, rules), k).withColumn("action", sentence)


def explain_rows(rows: DataFrame) -> DataFrame:
    """Add the alert sentence to rows with rounded figures."""
    sentence = alert_sentence(
        F.col("item"),
        F.col("organization"),
        F.col("location"),
        F.col("avg_daily_usage"),
        lead_days(),
        F.col("days_left"),
    )
    return rows.withColumn("explanation", sentence)


def reorder_list(ledger: DataFrame, semantic_order: bool = False, ordered: bool = True) -> DataFrame:
    """Ledger rows that need stock, with quantity and three-level urgency.

    Levels sort by name, descending; ``semantic_order`` puts CRITICAL first.
    """
    quantity = f.reorder_qty(lead_days(), F.col("avg_usage"), closing())
    rows = with_risk(ledger).withColumn("quantity", quantity).filter(F.col("quantity") > 0)
    rows = rows.withColumn("urgency_level", f.urgency3(F.col("days"), lead_days())).withColumn(
        "reorder_qty", round_half_up(F.col("quantity"))
    )
    result = _rounded(rows, "reorder_qty", "urgency_level")
    if not ordered:
        return _report(result)
    level = f.urgency_rank(F.col("urgency_level")) if semantic_order else F.col("urgency_level").desc()
    return _report(result, level, F.col("days_left"))


def urgency_summary(reorders: DataFrame) -> DataFrame:
    """Quantity and row count per urgency level."""
    return reorders.groupBy("urgency_level").agg(
        F.sum("reorder_qty").alias("total_reorder_qty"), F.count("item").alias("number_of_items")
    )


def calculator_rows(ledger: DataFrame, ordered: bool = True) -> DataFrame:
    """Rows whose stock ends within the lead time, shortest supply first."""
    rows = _rounded(with_risk(ledger).filter(F.col("days") <= lead_days()))
    return _report(rows, *(["days_left"] if ordered else []))


def stock_heat(ledger: DataFrame) -> DataFrame:
    """Closing stock per item and location."""
    return (
        ledger.groupBy("item", "location")
        .agg(F.sum("closing_stock").alias("total_closing_stock"))
        .orderBy("item", "location")
    )


GRID_COLUMNS = 1000


def stock_grid(heat: DataFrame, locations: list[str]) -> DataFrame:
    """Heat rows as an item by location grid of the named locations; missing cells are 0.

    A grid has a column per location and takes at most ``GRID_COLUMNS``; the heat rows
    are the form for more.
    """
    if len(locations) > GRID_COLUMNS:
        raise ValueError(f"{len(locations)} locations; a grid takes {GRID_COLUMNS} columns at most")
    grid = heat.groupBy("item").pivot("location", locations).agg(F.sum("total_closing_stock"))
    return grid.na.fill(0)


def latest_snapshot(ledger: DataFrame) -> DataFrame:
    """Rows of the newest date in the whole ledger."""
    newest = ledger.agg(F.max("date")).scalar()
    return ledger.filter(F.col("date") == newest).select(*LEDGER_COLUMNS).orderBy(*SERIES_KEY)


def name_list(ledger: DataFrame, column: str) -> DataFrame:
    """Sorted distinct names of one key column."""
    return ledger.select(column).distinct().orderBy(column)


def name_lists(ledger: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct names (name_of, name) of several columns, sorted, from one pass over the ledger."""
    keys = ledger.select(*columns).distinct()
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name_of"), F.col(c).alias("name")) for c in columns]))
    return keys.select(each.alias("n")).select("n.*").distinct().orderBy("name_of", "name")


def preview(ledger: DataFrame, rows: int = V.PREVIEW_ROWS) -> DataFrame:
    """The first rows in date and series order."""
    return ledger.orderBy("date", *SERIES_KEY, "closing_stock").limit(rows)
