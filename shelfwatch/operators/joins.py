"""Joins on the series key that treat NULL names as one group, like a window does."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def same_key(key: list[str], left: str, right: str) -> Column:
    """Null-safe equality of ``key`` between two aliases."""
    pairs = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in key]
    return reduce(lambda a, b: a & b, pairs)


def add_by_key(df: DataFrame, per_key: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Attach the columns of ``per_key`` (one row per key) to every row of ``df``.

    No hint is given: a staged ``per_key`` is broadcast while its files are small,
    otherwise both sides shuffle and AQE splits a hot key's partition.
    """
    extra = [c for c in per_key.columns if c not in key]
    joined = df.alias("l").join(per_key.alias("r"), same_key(key, "l", "r"), how)
    return joined.select("l.*", *[F.col(f"r.{c}") for c in extra])


def without_keys(df: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is not listed in ``keys``."""
    return df.alias("l").join(keys.select(*key).alias("r"), same_key(key, "l", "r"), "left_anti")


def with_keys(df: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is listed in ``keys``."""
    return df.alias("l").join(keys.select(*key).alias("r"), same_key(key, "l", "r"), "left_semi")


def flag_keys(df: DataFrame, keys: DataFrame, key: list[str], flag: str) -> DataFrame:
    """Add a boolean ``flag`` telling whether the row's key is listed in ``keys``."""
    listed = keys.select(*key).distinct().withColumn(flag, F.lit(True))
    return add_by_key(df, listed, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
