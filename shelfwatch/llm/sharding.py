"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts are one group and stay together. Groups larger than a
thousandth of a shard are packed one by one; the others are first bundled by hash.
The number of packed items is therefore at most ``shards * (FINE + 1024)`` whatever
the size of the table, and one task packs them: sizes fall, and each item enters
the open bin with the least room that fits, found in a balanced tree. For a given
number of shards the smallest capacity is searched for which that many bins suffice.
With a capacity the table's size decides how many shards there are; the items of each
``PACKED_SHARDS`` of them, dealt by hash, are then packed by a task of their own.

Slots number the rows of a shard without gaps. They are counted in slices of each
shard by hash of doc_id, so no task sorts a whole shard or a whole group of copies.

Defined results: a null text counts as empty (size 1); rows that repeat a doc_id get
slots of their own; a null doc_id is numbered like any other; an empty table gives
no rows.
"""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from shelfwatch.llm.common import narrowed, staged, text_of
from shelfwatch.llm.packing import best_fit, pack_into

SHARDS = 16
FINE = 1000
BUNDLES_PER_SHARD = 1024
PACKED_SHARDS = 256  # shards of a capacity that one task packs
SLICES = 1024


def _measured(docs: DataFrame) -> DataFrame:
    raw = text_of().cast("binary")
    return narrowed(docs, "doc_id", "text").select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.sha2(raw, 256).alias("group_key"),
    )


def _placed(groups: DataFrame, shards: int, capacity: int | None) -> DataFrame:
    """(group_key, shard) of every group."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    mean = capacity or total / shards
    expected = max(1, -(-total // capacity)) if capacity else shards
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("group_key"), F.lit(expected * BUNDLES_PER_SHARD)).cast("string"))
    items = groups.withColumn("item", F.when(F.col("bytes") > mean / FINE, F.col("group_key")).otherwise(bundle))
    items = staged(items, "items")
    parts = -(-expected // PACKED_SHARDS) if capacity else 1

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "item"], ascending=[False, True])
        sizes = [int(x) for x in rows["bytes"]]
        bins = best_fit(sizes, capacity) if capacity else pack_into(sizes, shards)
        return pd.DataFrame({"part": rows["part"], "item": rows["item"], "shard": bins})

    summed = items.groupBy("item").agg(F.sum("bytes").alias("bytes"))
    dealt = summed.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int"))
    placed = staged(dealt.groupBy("part").applyInPandas(pack, "part int, item string, shard int"), "packed")
    # The shards of a part follow those of the parts before it.
    opened = placed.groupBy("part").agg((F.max("shard") + 1).alias("opened"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = opened.select("part", F.coalesce(F.sum("opened").over(before), F.lit(0)).alias("start"))
    placed = placed.join(starts, "part").select("item", (F.col("start") + F.col("shard")).cast("int").alias("shard"))
    return items.join(placed, "item").select("group_key", "shard")


def with_slots(rows: DataFrame, slices: int = SLICES) -> DataFrame:
    """Number the rows of each shard from 0 in ``slot``."""
    rows = staged(rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(slices)).cast("int")), "sliced")
    counts = rows.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = staged(counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "starts")
    within = W.partitionBy("shard", "slice").orderBy("doc_id", "group_key")
    numbered = rows.withColumn("nth", F.row_number().over(within))
    return numbered.join(starts, ["shard", "slice"]).withColumn(
        "slot", (F.col("start") + F.col("nth") - 1).cast("long")
    )


def shard(docs: DataFrame, shards: int = SHARDS, capacity: int | None = None) -> DataFrame:
    """Pack the rows of ``docs`` into ``shards`` shards of nearly equal bytes.

    With ``capacity`` the shards have that many bytes at most, ``shards`` is only the
    expected number, and as few as best fit needs are opened. Returns doc_id, size,
    text_crc32, group_key, shard, slot.
    """
    rows = staged(_measured(docs), "sizes")
    groups = staged(rows.groupBy("group_key").agg(F.sum("size").alias("bytes")), "groups")
    placed = staged(_placed(groups, shards, capacity), "placed")
    return with_slots(rows.join(placed, "group_key"))


def contract_rows(docs: DataFrame) -> DataFrame:
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
