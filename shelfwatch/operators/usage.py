"""Average usage of a series, attached to its ledger rows."""

from pyspark.sql import DataFrame, functions as F

from shelfwatch.functions import formulas as f
from shelfwatch.operators.joins import add_by_key
from shelfwatch.schema import SERIES_KEY
from shelfwatch.staging import staged


def slice_ledger(
    ledger: DataFrame,
    organization: str | None = None,
    location: str | None = None,
    item: str | None = None,
) -> DataFrame:
    """Keep the rows of the chosen names; None or 'All' leaves a column open."""
    for column, wanted in zip(SERIES_KEY, (organization, location, item)):
        if wanted is not None and wanted != "All":
            ledger = ledger.filter(F.col(column) == F.lit(wanted))
    return ledger


def average_usage(ledger: DataFrame) -> DataFrame:
    """One row per series with the mean of issued units; map-side combined."""
    return ledger.groupBy(*SERIES_KEY).agg(F.avg("issued").alias("avg_usage"))


def plain_average(ledger: DataFrame) -> DataFrame:
    """Mean usage per series, 0.0 where a series has no counted value."""
    return ledger.groupBy(*SERIES_KEY).agg(
        F.coalesce(F.avg("issued"), F.lit(0.0)).alias("avg_daily_usage")
    )


def with_average_usage(ledger: DataFrame) -> DataFrame:
    """Every ledger row with its series' all-history mean usage, ``avg_usage``.

    A window over the series would sort a hot series in one task. Here the mean
    is combined map-side and joined back to the rows.
    """
    return add_by_key(ledger, staged(average_usage(ledger), "usage"), SERIES_KEY)


def with_risk(ledger: DataFrame) -> DataFrame:
    """Ledger rows with unrounded ``avg_usage``, ``days`` and ``risk_status``."""
    days = f.days_left(F.col("closing_stock"), F.col("avg_usage"))
    return (
        with_average_usage(ledger)
        .withColumn("days", days)
        .withColumn("risk_status", f.risk_status(F.col("days"), F.col("lead_time_days")))
    )
