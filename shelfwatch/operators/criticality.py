"""Criticality points of a row from location and item rules."""

from pyspark.sql import Column, DataFrame, functions as F

from shelfwatch.operators.joins import add_by_key
from shelfwatch.staging import staged


def criticality(rules: dict, location: Column | None = None, item: Column | None = None) -> Column:
    """Points as one expression for a rule set held in configuration.

    Location rules match a case-sensitive part of the name, item rules a listed
    item; the highest matching score or the default counts.
    """
    location = F.col("location") if location is None else location
    item = F.col("item") if item is None else item
    default = F.lit(rules["default_score"])
    scores = [default]
    for rule in rules["location_rules"]:
        scores.append(F.when(location.contains(rule["pattern"]), F.lit(rule["score"])))
    for rule in rules["item_rules"]:
        scores.append(F.when(item.isin(rule["items"]), F.lit(rule["score"])))
    # greatest skips the NULL of a rule that does not match
    return F.greatest(*scores) if len(scores) > 1 else default


def location_scores(locations: DataFrame, rules: DataFrame) -> DataFrame:
    """Highest matching score per distinct location, for a rule table of any size.

    A pattern of length n matches if it equals one of the location's substrings of
    length n, so the substrings of the pattern lengths in use are joined by
    equality instead of comparing every location with every rule.
    """
    patterns = rules.filter(F.col("kind") == "location").select(
        F.col("value").alias("part"), F.col("score").alias("location_score")
    )
    # the set of pattern lengths is one row, at most as many values as a name has letters
    lengths = patterns.agg(F.collect_set(F.length("part")).alias("lengths"))
    names = locations.select("location").where(F.col("location").isNotNull()).distinct()
    each = names.withColumn("n", F.explode(lengths.scalar()))
    each = each.filter(F.col("n") <= F.length("location"))
    starts = F.sequence(F.lit(1), F.length("location") - F.col("n") + 1)
    parts = each.select(
        "location",
        F.explode(
            F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("location"), i, F.col("n"))))
        ).alias("part"),
    )
    return parts.join(patterns, "part").groupBy("location").agg(F.max("location_score").alias("location_score"))


def item_scores(rules: DataFrame) -> DataFrame:
    """Highest score per listed item."""
    return (
        rules.filter(F.col("kind") == "item")
        .groupBy(F.col("value").alias("item"))
        .agg(F.max("score").alias("item_score"))
    )


def with_criticality(df: DataFrame, rules: DataFrame, default: int) -> DataFrame:
    """Add ``criticality`` from a rule table (kind, value, score)."""
    by_location = staged(location_scores(df, rules), "location-scores")
    by_item = staged(item_scores(rules), "item-scores")
    scored = add_by_key(add_by_key(df, by_location, ["location"], "left"), by_item, ["item"], "left")
    points = F.greatest(F.lit(default), F.col("location_score"), F.col("item_score"))
    return scored.withColumn("criticality", points).drop("location_score", "item_score")
