"""Criticality rules from a JSON file."""

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from shelfwatch import fixed_values as V

RULE_FILE = T.StructType(
    [
        T.StructField(
            "location_rules",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("pattern", T.StringType()),
                        T.StructField("score", T.IntegerType()),
                        T.StructField("description", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "item_rules",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("items", T.ArrayType(T.StringType())),
                        T.StructField("score", T.IntegerType()),
                        T.StructField("description", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("default_score", T.IntegerType()),
    ]
)


def _all_rules(file: DataFrame) -> DataFrame:
    """Rows (kind, value, score) of every rule and the default, from all documents."""
    locations = file.select(F.inline("location_rules")).select(
        F.lit("location").alias("kind"), F.col("pattern").alias("value"), "score"
    )
    items = (
        file.select(F.inline("item_rules"))
        .select(F.explode("items").alias("value"), "score")
        .select(F.lit("item").alias("kind"), "value", "score")
    )
    default = file.filter("default_score IS NOT NULL").select(
        F.lit("default").alias("kind"), F.lit("").alias("value"), F.col("default_score").alias("score")
    )
    return locations.unionByName(items).unionByName(default)


def _in_bounds() -> Column:
    """Whether a rule row can be used; an unknown value or score cannot."""
    rule = F.col("score").between(*V.RULE_SCORE_RANGE)
    default = F.col("score").between(*V.DEFAULT_SCORE_RANGE)
    return F.coalesce(F.when(F.col("kind") == "default", default).otherwise(rule) & F.col("value").isNotNull(), F.lit(False))


def rule_rows(file: DataFrame) -> DataFrame:
    """Rules (kind, value, score) that can be used; see :func:`rejected_rules` for the others."""
    return _all_rules(file).filter((F.col("kind") != "default") & _in_bounds())


def rejected_rules(file: DataFrame) -> DataFrame:
    """Rules and defaults without a value or with a score out of bounds."""
    return _all_rules(file).filter(~_in_bounds())


def read_rule_file(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a JSON rule file, or of a folder of them."""
    return spark.read.schema(RULE_FILE).option("multiLine", True).json(path)


def read_rule_rows(spark: SparkSession, path: str) -> DataFrame:
    return rule_rows(read_rule_file(spark, path))


def load_rules(spark: SparkSession, path: str | None) -> dict:
    """Rule set of a JSON file as configuration: the usable rules of all its documents.

    Rules out of bounds are listed under ``rejected`` and warned of. The fallback set
    is returned, with a warning, if there is no file or no readable default. A rule set
    is configuration; use :func:`read_rule_rows` for one too large for the driver.
    """
    if path is None:
        return V.FALLBACK_RULES
    try:
        file = read_rule_file(spark, path)
        found = _all_rules(file).withColumn("usable", _in_bounds()).collect()
    except AnalysisException as error:
        warnings.warn(f"rules at {path} cannot be read ({error.getCondition()}); using the fallback rules", stacklevel=2)
        return V.FALLBACK_RULES
    usable = [r for r in found if r["usable"]]
    rejected = [{"kind": r["kind"], "value": r["value"], "score": r["score"]} for r in found if not r["usable"]]
    if rejected:
        warnings.warn(f"{len(rejected)} rules at {path} are out of bounds and left out", stacklevel=2)
    defaults = sorted(r["score"] for r in usable if r["kind"] == "default")
    if not defaults:
        warnings.warn(f"rules at {path} have no usable default score; using the fallback rules", stacklevel=2)
        return {**V.FALLBACK_RULES, "rejected": rejected} if rejected else V.FALLBACK_RULES
    return {
        "location_rules": [{"pattern": r["value"], "score": r["score"]} for r in usable if r["kind"] == "location"],
        "item_rules": [{"items": [r["value"]], "score": r["score"]} for r in usable if r["kind"] == "item"],
        "default_score": defaults[0],
        "rejected": rejected,
    }
