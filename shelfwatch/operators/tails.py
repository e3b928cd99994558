"""Latest rows of each series and rolling figures over them."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfwatch import fixed_values as V
from shelfwatch.schema import SERIES_KEY

# Newest first; the quantities settle rows that share a date.
TIE_BREAK = ["date", "closing_stock", "issued", "received", "opening_stock"]
SALTS = 64


def newest_first() -> list[Column]:
    return [F.col(c).desc() for c in TIE_BREAK]


def oldest_first() -> list[Column]:
    return [F.col(c).asc() for c in TIE_BREAK]


def latest_rows(ledger: DataFrame, rows: int, salts: int = SALTS) -> DataFrame:
    """The newest ``rows`` of each series with their ``recency`` (1 = newest).

    Every input partition keeps at most ``rows`` of a series before the first
    shuffle. A series found in very many partitions is then ranked in ``salts``
    groups of partitions, whose winners (``salts * rows`` at most) meet in the
    second step.
    """
    salted = ledger.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    within = Window.partitionBy(*SERIES_KEY, "salt").orderBy(*newest_first())
    winners = (
        salted.withColumn("recency", F.row_number().over(within))
        .filter(F.col("recency") <= rows)
        .drop("recency", "salt")
    )
    across = Window.partitionBy(*SERIES_KEY).orderBy(*newest_first())
    return winners.withColumn("recency", F.row_number().over(across)).filter(F.col("recency") <= rows)


def figures_of(tail: DataFrame) -> DataFrame:
    """One row per series from its newest 30 rows with their ``recency``."""
    short = F.when(F.col("recency") <= V.SHORT_FRAME_ROWS, F.col("issued"))

    def newest(column: str) -> Column:
        return F.max(F.when(F.col("recency") == 1, F.col(column))).alias(column)

    return tail.groupBy(*SERIES_KEY).agg(
        newest("date"),
        newest("closing_stock"),
        newest("lead_time_days"),
        F.avg(short).alias("avg_short"),
        F.avg("issued").alias("avg_long"),
        F.min(short).alias("min_short"),
        F.max(short).alias("max_short"),
        F.stddev_samp(short).alias("stddev_short"),
    )


def tail_figures(ledger: DataFrame) -> DataFrame:
    """One row per series: its newest row and figures over its last 7 and 30 rows.

    Equals the newest row of sliding row frames, without computing the frames of
    older rows.
    """
    return figures_of(latest_rows(ledger, V.LONG_FRAME_ROWS))


def stock_points(ledger: DataFrame, points: int = V.SHORT_FRAME_ROWS) -> DataFrame:
    """The last closing stocks of each series, oldest first, for two points or more."""
    tail = latest_rows(ledger, points)
    # recency falls with age, so sorting by its negative gives time order
    point = F.struct((-F.col("recency")).alias("age"), F.col("date"), F.col("closing_stock"))
    return (
        tail.groupBy(*SERIES_KEY)
        .agg(F.sort_array(F.collect_list(point)).alias("p"))
        .filter(F.size("p") >= 2)
        .select(
            *SERIES_KEY,
            F.col("p.date").alias("dates"),
            F.col("p.closing_stock").alias("closing_stocks"),
        )
    )
