"""Quality rules of a ledger upload, checked in one pass, and result comparison."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from shelfwatch import fixed_values as V
from shelfwatch.schema import LEDGER_COLUMNS, QUANTITIES, SERIES_KEY
from shelfwatch.staging import staged

CORRUPT = "_corrupt_record"
FINDINGS = "rule string, severity string, column string, count long"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


class LedgerFormatError(ValueError):
    """The upload has no usable rows: columns are missing or it is empty."""


@dataclass
class LedgerReport:
    """Valid and rejected rows of an upload and the findings per rule."""

    valid: DataFrame
    rejected: DataFrame
    findings: DataFrame


def missing_columns(df: DataFrame) -> list[str]:
    present = {c.strip().lower() for c in df.columns}
    return [c for c in LEDGER_COLUMNS if c not in present]


def number(column: str) -> Column:
    """Text as a double, NULL where it is not a plain number."""
    text = F.col(column).cast("string")
    return F.when(text.rlike(NUMBER), F.expr(f"try_cast(`{column}` AS DOUBLE)"))


def day(column: str = "date") -> Column:
    return F.expr(f"try_cast(`{column}` AS DATE)")


def _num(column: str) -> Column:
    return F.col(f"{column}_number")


def with_values(df: DataFrame) -> DataFrame:
    """Text rows with their parsed ``<column>_number`` and ``day``, parsed once for all rules."""
    return df.withColumns({f"{c}_number": number(c) for c in QUANTITIES} | {"day": day()})


def wrong_closing() -> Column:
    """True where closing is not opening + received - issued; unknowns count."""
    expected = _num("opening_stock") + _num("received") - _num("issued")
    return F.coalesce(_num("closing_stock") != expected, F.lit(True))


def rules(df: DataFrame) -> list[tuple[str, str, str, Column]]:
    """Rules on :func:`with_values` rows as (name, severity, column, condition for a broken row)."""
    checks = [
        ("bad_date", "error", "date", F.col("date").isNotNull() & F.col("day").isNull()),
        ("empty_date", "warning", "date", F.col("date").isNull()),
    ]
    for c in QUANTITIES:
        checks.append(("not_numeric", "error", c, _num(c).isNull()))
        checks.append(("negative", "error", c, F.coalesce(_num(c) < 0, F.lit(False))))
        checks.append(("fraction", "warning", c, F.coalesce(_num(c) != F.floor(_num(c)), F.lit(False))))
    for c in SERIES_KEY:
        checks.append(("empty_name", "error", c, F.col(c).isNull()))
    checks.append(("closing_mismatch", "warning", "closing_stock", wrong_closing()))
    if CORRUPT in df.columns:
        checks.append(("bad_line", "error", CORRUPT, F.col(CORRUPT).isNotNull()))
    return checks


def find_problems(df: DataFrame) -> DataFrame:
    """Number of broken rows per rule and column, rules without any left out.

    All rules are counted by one aggregation over the rows.
    """
    checks = rules(df)
    return _findings(_count_rules(with_values(df), checks), checks)


def _count_rules(rows: DataFrame, checks: list[tuple[str, str, str, Column]]) -> DataFrame:
    counts = [F.sum(F.when(broken, 1).otherwise(0)).alias(f"n{i}") for i, (*_, broken) in enumerate(checks)]
    return rows.agg(F.count(F.lit(1)).alias("_rows"), *counts)


def _findings(counts: DataFrame, checks: list[tuple[str, str, str, Column]]) -> DataFrame:
    cells = [
        F.struct(
            F.lit(name).alias("rule"),
            F.lit(severity).alias("severity"),
            F.lit(column).alias("column"),
            F.col(f"n{i}").alias("count"),
        )
        for i, (name, severity, column, _) in enumerate(checks)
    ]
    return counts.select(F.inline(F.array(*cells))).filter(F.col("count") > 0)


def shape_problems(df: DataFrame) -> DataFrame:
    """What keeps an upload from being checked row by row, as findings: missing columns, or no row at all."""
    found = [("missing_column", "error", c, 1) for c in missing_columns(df)]
    if not found and df.isEmpty():
        found = [("no_rows", "error", "", 1)]
    return df.sparkSession.createDataFrame(found, FINDINGS)


def check_ledger(df: DataFrame) -> LedgerReport:
    """Split uploaded text rows into valid and rejected ones and count findings.

    The cells are parsed once, as the judged rows are stored; the counts of all rules
    are observed on that one write, so nothing is read again to count.
    """
    missing = missing_columns(df)
    if missing:
        raise LedgerFormatError(f"ledger upload has columns {df.columns}; not among them: {', '.join(missing)}")
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    checks = rules(df)
    broken = F.lit(False)
    for _, severity, _, condition in checks:
        if severity == "error":
            broken = broken | condition
    flags = {f"_rule{i}": condition for i, (*_, condition) in enumerate(checks)}
    seen = Observation("ledger rules")
    counts = [F.count_if(name).alias(name) for name in flags]
    judged = with_values(df).withColumns(flags | {"_broken": broken}).observe(seen, F.count(F.lit(1)).alias("_rows"), *counts)
    judged = staged(judged.select(*df.columns, "_broken"), "judged")
    met = seen.get
    if met["_rows"] == 0:
        raise LedgerFormatError("ledger upload has a header but no rows below it")
    valid, rejected = (judged.filter(c).select(*df.columns) for c in (~F.col("_broken"), F.col("_broken")))
    found = [(*check[:3], met[f"_rule{i}"]) for i, check in enumerate(checks) if met[f"_rule{i}"]]
    return LedgerReport(valid, rejected, df.sparkSession.createDataFrame(found, FINDINGS))


def negative_closing(df: DataFrame) -> DataFrame:
    """Count of rows with negative closing stock; a load warns and goes on."""
    return df.agg(F.count_if(F.col("closing_stock") < 0).alias("negative_closing"))


def compare_results(
    left: DataFrame,
    right: DataFrame,
    key: list[str],
    values: list[str],
    tolerance: float = V.PARITY_TOLERANCE,
) -> DataFrame:
    """Compare two keyed results; one row per value column. Keys may repeat.

    The values that a key has on each side are matched as bags, per column: in rising
    order, each with the smallest value of the other side that is within the tolerance
    and not taken. Two NULLs match, one NULL does not, infinity matches infinity only. A
    row beyond those of the other side compares as NULL, so there are as many
    comparisons as the side with more rows has.
    """

    def side(df: DataFrame, mine: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in values])
        # equal values of a key combine map-side, so a key that repeats a few values is few rows
        each = df.select(*key, F.explode(cells).alias("c")).groupBy(*key, "c.column", "c.value")
        counts = each.agg(F.count(F.lit(1)).alias("n"))
        other = "right" if mine == "left" else "left"
        return counts.select(*key, "column", "value", F.col("n").alias(mine), F.lit(0).cast("long").alias(other))

    both = side(left, "left").unionByName(side(right, "right")).groupBy(*key, "column", "value")
    both = both.agg(F.sum("left").alias("left"), F.sum("right").alias("right"))
    # NULLs, infinities and NaN meet their like only
    special = F.col("value").isNull() | (F.abs("value") == float("inf")) | F.isnan("value")
    is_null = F.col("value").isNull()
    alike = both.filter(special).select(
        *key, "column", "left", "right", F.when(is_null, 0).otherwise(F.least("left", "right")).alias("matching"),
        F.when(is_null, F.col("left")).otherwise(0).alias("left_nulls"), F.when(is_null, F.col("right")).otherwise(0).alias("right_nulls"),
    )
    # values further apart than the tolerance never meet: a key is matched run by run
    rising = Window.partitionBy(*key, "column").orderBy("value")
    far = F.coalesce(F.col("value") - F.lag("value").over(rising) > tolerance, F.lit(True))
    runs = both.filter(~special).withColumn("far", far.cast("int")).withColumn("run", F.sum("far").over(rising))
    runs = runs.groupBy(*key, "column", "run").agg(
        F.sum("left").alias("left"), F.sum("right").alias("right"),
        F.sort_array(F.collect_list(F.struct("value", F.col("left").alias("l"), F.col("right").alias("r")))).alias("bag"),
    )
    nothing = F.lit(0).cast("long")
    near = runs.select(*key, "column", "left", "right", _matched(F.col("bag"), tolerance).alias("matching"),
                       nothing.alias("left_nulls"), nothing.alias("right_nulls"))
    sums = {c: F.sum(c) for c in ("left", "right", "matching", "left_nulls", "right_nulls")}
    bags = near.unionByName(alike).groupBy(*key, "column").agg(*[v.alias(c) for c, v in sums.items()])
    rows = F.greatest("left", "right")
    # the shorter side is filled up with NULLs
    nulls = F.least(F.col("left_nulls") + rows - F.col("left"), F.col("right_nulls") + rows - F.col("right"))
    bags = bags.select("column", rows.alias("rows"), (F.col("matching") + nulls).alias("matching"))
    totals = bags.groupBy("column").agg(F.sum("matching").alias("matching"), F.sum(F.col("rows") - F.col("matching")).alias("mismatching"))
    # columns without any row are listed too
    names = left.sparkSession.createDataFrame([(c,) for c in values], "column string")
    return names.join(totals, "column", "left").withColumns({c: F.coalesce(c, nothing) for c in ("matching", "mismatching")})


def _matched(bag: Column, tolerance: float) -> Column:
    """How many pairs within the tolerance a rising bag of (value, l, r) holds at most.

    A value takes the oldest open ones of the other side in its reach, then its equals;
    what is left of it stays open. So only one side is ever open, in one queue.
    """
    queue = "array<struct<value: double, n: bigint>>"
    none, zero = F.array().cast(queue), F.lit(0).cast("long")
    start = F.struct(zero.alias("found"), F.lit(True).alias("of_left"), none.alias("open"))

    def without(taken: Column, entries: Column) -> Column:
        """The queue after its oldest ``taken`` values have gone."""
        first = F.struct(taken.alias("left"), none.alias("open"))
        return F.aggregate(
            entries,
            first,
            lambda s, o: F.struct(
                F.greatest(s["left"] - o["n"], zero).alias("left"),
                F.when(s["left"] >= o["n"], s["open"])
                .otherwise(F.concat(s["open"], F.array(F.struct(o["value"].alias("value"), (o["n"] - s["left"]).alias("n")))))
                .alias("open"),
            ),
        )["open"]

    def step(state: Column, x: Column) -> Column:
        near = F.filter(state["open"], lambda o: x["value"] - o["value"] <= tolerance)
        waiting = F.aggregate(near, zero, lambda s, o: s + o["n"])
        facing = F.when(state["of_left"], x["r"]).otherwise(x["l"])
        beside = F.when(state["of_left"], x["l"]).otherwise(x["r"])
        taken = F.least(facing, waiting)
        same = F.least(facing - taken, beside)
        more_facing, more_beside = facing - taken - same, beside - same
        more = more_facing + more_beside  # one of them is none; facing ones are left only if the queue is used up
        added = F.when(more > 0, F.array(F.struct(x["value"].alias("value"), more.alias("n")))).otherwise(none)
        return F.struct(
            (state["found"] + taken + same).alias("found"),
            F.when(more_facing > 0, ~state["of_left"]).otherwise(state["of_left"]).alias("of_left"),
            F.concat(without(taken, near), added).alias("open"),
        )

    return F.aggregate(bag, start, step, lambda s: s["found"])
