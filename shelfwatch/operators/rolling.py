"""Rolling 7- and 30-row figures on every ledger row."""

from pyspark.sql import DataFrame, Window, functions as F

from shelfwatch import fixed_values as V
from shelfwatch.operators.joins import same_key
from shelfwatch.operators.ordering import in_sequence
from shelfwatch.operators.tails import TIE_BREAK
from shelfwatch.schema import SERIES_KEY

HALO = V.LONG_FRAME_ROWS - 1
PIECE = SERIES_KEY + ["part"]


def handovers(ordered: DataFrame) -> DataFrame:
    """(series, part, last, target, need): how many newest rows of a piece a later piece's frames reach.

    A piece is what one part of the sequence holds of a series; ``last`` is its newest
    row. Few series lie in more than one part, one for each border of parts at most, and
    a piece is followed by at most ``HALO + 1`` pieces that need it.
    """
    pieces = ordered.groupBy(*PIECE).agg(F.count(F.lit(1)).alias("rows"), F.max("pos").alias("last"))
    split = pieces.groupBy(*SERIES_KEY).agg(F.sort_array(F.collect_list(F.struct("part", "rows", "last"))).alias("p"))
    each = split.filter(F.size("p") > 1).select(*SERIES_KEY, "p", F.posexplode("p").alias("at", "source"))
    later = F.slice(F.col("p"), F.col("at") + 2, HALO + 1)
    # rows of the pieces between this one and each later one
    between = F.transform(
        later, lambda x, i: F.aggregate(F.slice(later, F.lit(1), i), F.lit(0).cast("long"), lambda total, y: total + y["rows"])
    )
    needs = F.arrays_zip(F.transform(later, lambda x: x["part"]).alias("target"), between.alias("between"))
    found = each.select(
        *SERIES_KEY, F.col("source.part").alias("part"), F.col("source.last").alias("last"), F.explode(needs).alias("n")
    )
    need = F.lit(HALO) - F.col("n.between")
    return found.select(*PIECE, "last", F.col("n.target").alias("target"), need.alias("need")).filter("need > 0")


def with_halo(ledger: DataFrame) -> DataFrame:
    """Every row in its part of the sequence (``own``) and the copies that later parts' frames need."""
    ordered = in_sequence(ledger, [F.col(c) for c in [*SERIES_KEY, *TIE_BREAK]])
    copies = ordered.alias("l").join(
        handovers(ordered).alias("r"), same_key(PIECE, "l", "r") & (F.col("l.pos") > F.col("r.last") - F.col("r.need"))
    ).select("l.*", F.col("r.target").alias("frame"))
    return ordered.withColumn("frame", F.col("part")).withColumn("own", F.lit(True)).unionByName(
        copies.withColumn("own", F.lit(False))
    )


def rolling_figures(ledger: DataFrame) -> DataFrame:
    """Rolling figures on every ledger row, in time order of its series.

    The ledger is sorted once by series and time, into parts of about one size; a long
    series is cut wherever a part ends, also within a date, and its piece gets copies of
    the last rows before it. No task sorts more than a part, however the rows are
    spread over series and dates. When only the newest row of a series matters, use
    ``tails.tail_figures``.
    """
    ordered = Window.partitionBy(*SERIES_KEY, "frame").orderBy("pos")
    short = ordered.rowsBetween(-(V.SHORT_FRAME_ROWS - 1), 0)
    long = ordered.rowsBetween(-HALO, 0)
    figures = with_halo(ledger).withColumns(
        {
            "avg_short": F.avg("issued").over(short),
            "avg_long": F.avg("issued").over(long),
            "min_short": F.min("issued").over(short),
            "max_short": F.max("issued").over(short),
            "stddev_short": F.stddev_samp("issued").over(short),
        }
    )
    return figures.filter("own").drop("part", "pos", "frame", "own")
