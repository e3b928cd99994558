"""Organization profiles: append and enrichment."""

from pyspark.sql import Column, DataFrame, functions as F

from shelfwatch import fixed_values as V
from shelfwatch.operators.joins import add_by_key
from shelfwatch.schema import PROFILE

REQUIRED = ["organization", "sector", "region", "goods_type"]


def _judged(profiles: DataFrame, as_of: Column) -> DataFrame:
    """Profiles with defaults and the ``reason`` why one is not complete, NULL where it is."""
    if "created_at" not in profiles.columns:
        profiles = profiles.withColumn("created_at", F.lit(None).cast("timestamp"))
    if "contact_email" not in profiles.columns:
        profiles = profiles.withColumn("contact_email", F.lit(""))
    reason = F.lit(None).cast("string")
    reason = F.when(~F.coalesce(F.col("sector").isin(V.SECTORS), F.lit(False)), "unknown sector").otherwise(reason)
    for c in reversed(REQUIRED):
        reason = F.when(F.coalesce(F.col(c), F.lit("")) == "", f"no {c}").otherwise(reason)
    return (
        profiles.withColumn("reason", reason)
        .withColumn("contact_email", F.coalesce("contact_email", F.lit("")))
        .withColumn("created_at", F.coalesce("created_at", as_of.cast("timestamp")))
        .select(*PROFILE.fieldNames(), "reason")
    )


def complete_profiles(profiles: DataFrame, as_of: Column) -> DataFrame:
    """Profiles with every required field and a known sector; created_at defaults to ``as_of``."""
    return _judged(profiles, as_of).filter("reason IS NULL").drop("reason")


def rejected_profiles(profiles: DataFrame, as_of: Column) -> DataFrame:
    """The other profiles, each with the ``reason``."""
    return _judged(profiles, as_of).filter("reason IS NOT NULL")


def append_profiles(profiles: DataFrame, path: str, as_of: Column) -> DataFrame:
    """Append the complete profiles; the rejected ones are returned with their reason."""
    complete_profiles(profiles, as_of).write.mode("append").parquet(path)
    return rejected_profiles(profiles, as_of)


def newest_profiles(profiles: DataFrame) -> DataFrame:
    """The last profile saved for each organization."""
    last = F.max(F.struct("created_at", "sector", "region", "goods_type", "contact_email")).alias("p")
    return profiles.groupBy("organization").agg(last).select("organization", "p.*")


def with_profile(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rows with the profile of their organization, where one is saved."""
    return add_by_key(df, newest_profiles(profiles).drop("created_at"), ["organization"], "left")
