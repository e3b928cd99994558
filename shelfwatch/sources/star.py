"""Inventory tables derived from a retail star schema (lineitem, orders, events ...)."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwatch.schema import LEDGER_COLUMNS, SERIES_KEY

# Rules used with the derived ledger: (kind, value, score).
STAR_RULES = [("location", "NATION_1", 12), ("item", "PROMO", 7), ("item", "ECONOMY", 5)]
STAR_DEFAULT_SCORE = 3


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def star_rules() -> dict:
    """The rule set as configuration."""
    return {
        "location_rules": [{"pattern": v, "score": s} for k, v, s in STAR_RULES if k == "location"],
        "item_rules": [{"items": [v], "score": s} for k, v, s in STAR_RULES if k == "item"],
        "default_score": STAR_DEFAULT_SCORE,
    }


def rule_file(spark: SparkSession, folder: str) -> DataFrame:
    """A rule set as one document: a rule for every nation and for every part name and brand.

    That makes more than a thousand rules, some with scores out of bounds.
    """
    places = table(spark, folder, "nation").agg(
        F.collect_list(
            F.struct(
                F.col("n_name").alias("pattern"), (F.col("n_nationkey") % 17).cast("int").alias("score"),
                F.lit("nation").alias("description"),
            )
        ).alias("location_rules")
    )
    names = table(spark, folder, "part").groupBy("p_name", "p_brand").agg(
        F.collect_set("p_type").alias("items"), F.min("p_partkey").alias("p_key")
    )
    items = names.agg(
        F.collect_list(
            F.struct("items", (F.col("p_key") % 20).cast("int").alias("score"), F.col("p_name").alias("description"))
        ).alias("item_rules")
    )
    # one row each, paired by a constant
    both = places.withColumn("one", F.lit(1)).join(items.withColumn("one", F.lit(1)), "one").drop("one")
    return both.withColumn("default_score", F.lit(STAR_DEFAULT_SCORE))


def star_rule_rows(spark: SparkSession) -> DataFrame:
    """The rule set as rows, small enough for the optimizer to know it."""
    rows = [F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value"), F.lit(s).alias("score")) for k, v, s in STAR_RULES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def with_place(spark: SparkSession, folder: str, df: DataFrame, nation_key: str) -> DataFrame:
    """Add organization (region) and location (nation) by nation key.

    The two dimensions are joined one after the other, so each is small enough to
    broadcast by its own file size.
    """
    return (
        df.join(table(spark, folder, "nation"), F.col(nation_key) == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumnsRenamed({"r_name": "organization", "n_name": "location"})
    )


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Daily ledger: one row per ship date, region, nation and part type.

    Lines are summed per nation key before the names are joined.
    """
    part = table(spark, folder, "part").select("p_partkey", "p_type")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    quantity, flag = F.col("l_quantity"), F.col("l_returnflag")
    lead = 1 + (F.col("s_nationkey") * 7 + F.length("p_type")) % 14
    days = (
        table(spark, folder, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("l_shipdate").cast("date").alias("date"), "s_nationkey", F.col("p_type").alias("item"))
        .agg(
            F.sum(F.when(flag == "R", quantity).otherwise(0)).cast("long").alias("received"),
            F.sum(F.when(flag != "R", quantity).otherwise(0)).cast("long").alias("issued"),
            (F.sum("l_orderkey") % 400).cast("long").alias("closing_stock"),
            F.min(lead).cast("long").alias("lead_time_days"),
        )
    )
    opening = F.col("closing_stock") - F.col("received") + F.col("issued")
    return with_place(spark, folder, days, "s_nationkey").withColumn("opening_stock", opening).select(
        *LEDGER_COLUMNS
    )


def ledger_text(rows: DataFrame) -> DataFrame:
    """The ledger as text cells with planted faults, like an unchecked upload."""
    stock, got = F.col("closing_stock"), F.col("received")
    return rows.select(
        F.when(stock % 101 == 0, F.lit("2001-13-45")).otherwise(F.col("date").cast("string")).alias("date"),
        "organization",
        F.when(stock % 103 != 0, F.col("location")).alias("location"),
        F.concat_ws(", ", "item", F.lit("boxed")).alias("item"),
        F.col("opening_stock").cast("string").alias("opening_stock"),
        F.when(got % 89 == 7, F.lit("abc")).otherwise(got.cast("string")).alias("received"),
        F.when(stock % 97 == 5, F.lit("-1")).otherwise(F.col("issued").cast("string")).alias("issued"),
        F.when(stock % 50 == 0, (stock + 1).cast("string")).otherwise(stock.cast("string")).alias("closing_stock"),
        F.concat(F.col("lead_time_days").cast("string"), F.lit(".0")).alias("lead_time_days"),
    )


def ledger_versions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An older and a newer version of the ledger, for change feeds."""
    stock = F.col("closing_stock")
    previous = rows.filter((F.col("date") < F.lit("2001-06-01").cast("date")) | (stock % 97 == 0))
    current = rows.filter(stock % 97 != 0).withColumn(
        "issued", F.col("issued") + F.when(stock % 53 == 0, 1).otherwise(0)
    )
    return previous, current.select(*LEDGER_COLUMNS)


def newest_order_date(spark: SparkSession, folder: str) -> Column:
    """The newest order date as a scalar."""
    return table(spark, folder, "orders").agg(F.max(F.col("o_orderdate").cast("date"))).scalar()


def orders_tracking(spark: SparkSession, folder: str, chosen: Column | None = None) -> DataFrame:
    """Order rows with the smallest part type and the quantity of their lines.

    ``chosen`` is a condition on the orders table; lines of other orders are dropped
    before they are summed.
    """
    part = table(spark, folder, "part").select("p_partkey", "p_type")
    orders, lineitem = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    if chosen is not None:
        orders = orders.filter(chosen)
        lineitem = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    lines = (
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_orderkey")
        .agg(F.min("p_type").alias("item"), F.sum("l_quantity").alias("ordered_qty"))
    )
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    state, urgency = F.col("o_orderstatus"), F.col("o_orderpriority")
    ordered_on = F.col("o_orderdate").cast("date")
    placed = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    )
    return (
        with_place(spark, folder, placed, "c_nationkey")
        .select(
            F.col("o_orderkey").alias("order_id"),
            *SERIES_KEY,
            ordered_on.alias("order_date"),
            "ordered_qty",
            F.when(state == "O", "PENDING").when(state == "P", "SHIPPED").otherwise("RECEIVED").alias("status"),
            F.when(urgency == "1-URGENT", "CRITICAL")
            .when(urgency == "2-HIGH", "HIGH")
            .when(urgency == "3-MEDIUM", "MEDIUM")
            .otherwise("LOW")
            .alias("priority_level"),
            F.date_add(ordered_on, (1 + F.col("o_orderkey") % 14).cast("int")).alias("expected_delivery_date"),
        )
    )


def actions(spark: SparkSession, folder: str) -> DataFrame:
    """Action log rows from the event stream."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("action_id"),
        F.when(kind == "purchase", "ORDER_PLACED")
        .when(kind == "view", "ITEM_REVIEWED")
        .when(kind == "click", "PDF_EXPORTED")
        .when(kind == "signup", "DATA_UPLOADED")
        .otherwise("CONFIG_CHANGED")
        .alias("action_type"),
        F.col("ts").alias("action_timestamp"),
        F.concat(F.lit("user_"), user).alias("user_name"),
        F.concat(F.lit("s_"), user, F.lit("_"), F.col("ts").cast("date").cast("string")).alias("session_id"),
        F.floor(F.col("value") * 10).cast("long").alias("response_time_ms"),
        F.col("props").alias("action_details"),
        F.when(F.col("event_id") % 4 == 0, "Dashboard").otherwise("Data").alias("source_page"),
        F.when(kind == "error", "FAILED").otherwise("SUCCESS").alias("status"),
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Task run rows from the event stream."""
    failed: Column = F.col("event_id") % 10 == 0
    return table(spark, folder, "events").select(
        F.col("event_id").alias("log_id"),
        F.concat(F.lit("TASK_"), F.upper("event_type")).alias("task_name"),
        F.col("ts").alias("execution_time"),
        F.when(failed, "FAILED").otherwise("SUCCESS").alias("status"),
        F.col("user_id").alias("records_processed"),
        F.when(failed, "synthetic failure").alias("error_message"),
        F.col("value").alias("execution_duration_seconds"),
    )
