"""The ledger columns the formulas read most, as Column expressions."""

from pyspark.sql import Column, functions as F


def lead_days() -> Column:
    return F.col("lead_time_days")


def closing() -> Column:
    return F.col("closing_stock")
