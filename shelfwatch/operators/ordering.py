"""Total orders over tables of any size: range partitions, numbered from their counts."""

from pyspark.sql import Column, DataFrame, functions as F

from shelfwatch.staging import staged

# monotonically_increasing_id keeps the partition above this bit and the row below it
ROW_BITS = 33


def in_sequence(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """``rows`` stored in ascending ``order``, with ``part`` and ``pos``.

    Spark samples the order columns for the ranges, so a part holds about as many rows
    as any other, whatever values repeat; rows that tie on all columns are told apart by
    their number and may be split as well. ``pos`` rises with the order, by one within
    a part.
    """
    names = [f"_order{i}" for i in range(len(order))]
    keyed = rows.withColumns(dict(zip(names, order))).withColumn("_tie", F.monotonically_increasing_id())
    by = [*names, "_tie"]
    ordered = keyed.repartitionByRange(*by).sortWithinPartitions(*by).drop(*by)
    ordered = ordered.withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id()})
    return staged(ordered, "sequence")


def row_of(pos: Column) -> Column:
    """The number of a row within its part, from 0."""
    return pos.bitwiseAND((1 << ROW_BITS) - 1)


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``rows`` with their place in the order, from 1, sorted by it.

    The driver sees one count per range; the counts before a range are its offset.
    """
    ordered = in_sequence(rows, order)
    counts = sorted(ordered.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).collect())
    offsets, total = [], 0
    for part, count in counts:
        offsets.append((part, total))
        total += count
    # stored, so that its size is known and it is broadcast
    offsets = staged(rows.sparkSession.createDataFrame(offsets, "part int, offset long").coalesce(1), "offsets")
    place = F.col("offset") + row_of(F.col("pos")) + 1
    return ordered.join(offsets, "part").withColumn(name, place).drop("part", "pos", "offset").orderBy(name)
