"""Ids from the content of a row."""

from pyspark.sql import Column, DataFrame, Window, functions as F


def content_hash(columns: list[str]) -> Column:
    """SHA-256 of the named values as JSON; NULLs keep their place."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)


def hashed_id(columns: list[str]) -> Column:
    """A positive 63-bit id from the content hash."""

    def digits(start: int) -> Column:
        return F.conv(F.substring(content_hash(columns), start, 8), 16, 10).cast("long")

    return F.shiftleft(digits(1).bitwiseAND(F.lit(0x7FFFFFFF)), 32) + digits(9)


def with_request_ids(requests: DataFrame, name: str, columns: list[str], batch: Column) -> DataFrame:
    """Add an id per request: equal requests of one batch differ, a replay gives the same ids.

    The hash covers the values, the batch and the number of the request among its
    equals; only equal requests are numbered together.
    """
    rows = requests.withColumn("_batch", batch.cast("string")).withColumn("_same", content_hash(columns))
    nth = F.row_number().over(Window.partitionBy("_same").orderBy(F.lit(0)))
    rows = rows.withColumn("_nth", nth).withColumn(name, hashed_id(["_same", "_batch", "_nth"]))
    return rows.drop("_batch", "_same", "_nth")
