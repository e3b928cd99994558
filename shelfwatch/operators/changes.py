"""Row changes between two versions of a table."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfwatch.operators.joins import add_by_key, same_key
from shelfwatch.staging import staged


def _net(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of which one version has more: ``net`` is positive for added, negative for removed ones.

    Equal rows combine map-side, and unchanged ones drop out here.
    """
    columns = current.columns
    signed = previous.select(*columns, F.lit(-1).alias("sign")).unionByName(
        current.select(*columns, F.lit(1).alias("sign"))
    )
    return signed.groupBy(*columns).agg(F.sum("sign").alias("net")).filter(F.col("net") != 0)


def row_changes(previous: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """INSERT, UPDATE and DELETE rows between two versions; keys may repeat.

    Equal rows cancel first. What is left of a key is numbered in the order of its
    values on each side, and removed and added rows of one number are an UPDATE.
    Result: ``op``, the key, and every other column as ``old_*`` and ``new_*``.
    """
    values = [c for c in current.columns if c not in key]
    net = _net(previous, current)
    times = F.sequence(F.lit(1).cast("long"), F.abs(F.col("net")))
    each = net.withColumn("added", F.col("net") > 0).withColumn("copy", F.explode(times)).drop("net")
    nth = F.row_number().over(Window.partitionBy(*key, "added").orderBy(*values, "copy"))
    each = each.withColumn("nth", nth)
    before = each.filter(~F.col("added")).alias("o")
    after = each.filter("added").alias("n")
    both = before.join(after, same_key([*key, "nth"], "o", "n"), "full_outer")
    op = (
        F.when(F.col("o.nth").isNull(), F.lit("INSERT"))
        .when(F.col("n.nth").isNull(), F.lit("DELETE"))
        .otherwise(F.lit("UPDATE"))
    )
    keys = [F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in key]
    olds = [F.col(f"o.{c}").alias(f"old_{c}") for c in values]
    news = [F.col(f"n.{c}").alias(f"new_{c}") for c in values]
    return both.select(op.alias("op"), *keys, *olds, *news)


def change_feed(previous: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Rows removed (DELETE) and added (INSERT) as bags, so keys may repeat.

    ``rows`` counts equal rows; ``is_update`` marks keys with both removed and
    added rows. Equal rows combine map-side, unchanged ones drop out before the
    keys are compared.
    """
    net = _net(previous, current)
    per_key = net.groupBy(*key).agg(((F.min("net") < 0) & (F.max("net") > 0)).alias("is_update"))
    action = F.when(F.col("net") > 0, F.lit("INSERT")).otherwise(F.lit("DELETE"))
    return add_by_key(net, per_key, key).select(
        action.alias("action"), "is_update", F.abs(F.col("net")).alias("rows"), *current.columns
    )


def hash_tree(rows: DataFrame, month: Column, series: list[str], buckets: int = 64) -> DataFrame:
    """(month, bucket, rows, h1, h2): order-free hashes of what a month holds of a bucket of series.

    The hashes are sums of two 64-bit row hashes, so equal rows count, and a node above,
    a month or the whole table, is the sum of its leaves. Rows combine map-side into at
    most ``buckets`` leaves a month. Keep the leaves of a version beside it, and the next
    comparison need not read it.
    """
    row = [F.xxhash64(F.lit(seed), *rows.columns).cast("decimal(38,0)") for seed in (1, 2)]
    leaf = rows.select(*_leaf(month, series, buckets), *[h.alias(f"r{i}") for i, h in enumerate(row)])
    return leaf.groupBy("month", "bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("r0").alias("h1"), F.sum("r1").alias("h2")
    )


def _leaf(month: Column, series: list[str], buckets: int) -> list[Column]:
    return [month.alias("month"), F.pmod(F.xxhash64(*series), F.lit(buckets)).alias("bucket")]


def changed_leaves(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(month, bucket) of the leaves that differ, downwards: only the buckets of differing months are compared."""
    signed = previous.withColumn("sign", F.lit(-1)).unionByName(current.withColumn("sign", F.lit(1)))
    sums = [F.sum(F.col("sign") * F.col(c).cast("decimal(38,0)")).alias(c) for c in ("rows", "h1", "h2")]
    differs = "rows <> 0 OR h1 <> 0 OR h2 <> 0"
    leaves = signed.groupBy("month", "bucket").agg(*sums).filter(differs)
    months = signed.groupBy("month").agg(*sums).filter(differs).select(F.col("month").alias("m"))
    return leaves.join(months, F.col("month").eqNullSafe(F.col("m")), "left_semi").select("month", "bucket")


def rows_of_leaves(rows: DataFrame, leaves: DataFrame, month: Column, series: list[str], buckets: int = 64) -> DataFrame:
    """The rows of some leaves. ``leaves`` should be stored: a small table is broadcast, and no row is shuffled."""
    found = leaves.select(F.col("month").alias("_m"), F.col("bucket").alias("_b"))
    m, b = _leaf(month, series, buckets)
    return rows.join(found, m.eqNullSafe(F.col("_m")) & (b == F.col("_b")), "left_semi")


def changes_by_leaves(previous: DataFrame, current: DataFrame, key: list[str], month: Column, series: list[str], buckets: int = 64) -> DataFrame:
    """:func:`change_feed` of two versions that differ in few places: rows of unchanged leaves are not shuffled."""
    trees = [hash_tree(rows, month, series, buckets) for rows in (previous, current)]
    leaves = staged(changed_leaves(*trees), "changed-leaves")
    return change_feed(*[rows_of_leaves(rows, leaves, month, series, buckets) for rows in (previous, current)], key)


def pending_changes(changes: DataFrame) -> DataFrame:
    """Number of changes waiting in a feed, as one row."""
    return changes.agg(F.count(F.lit(1)).alias("pending_changes"))
