"""Sequences cut by size, frames across the cuts and ranks by range counts."""

import contextlib
import random

import pytest
from pyspark.sql import Window, functions as F

from shelfwatch.functions.formulas import urgency_rank
from shelfwatch.operators import ordering, rolling
from shelfwatch.operators.tails import TIE_BREAK
from shelfwatch.schema import SERIES_KEY
from test_tails import plain_figures, rounded, rows_of


@pytest.fixture
def many_parts(spark):
    """Sequences of 16 parts, however few rows there are."""
    wanted = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    with contextlib.ExitStack() as undo:
        for key, value in wanted.items():
            before = spark.conf.get(key)
            undo.callback(spark.conf.set, key, before)
            spark.conf.set(key, value)
        yield


def same_figures(ledger):
    found = rolling.rolling_figures(ledger)
    assert found.columns[: len(ledger.columns)] == ledger.columns
    assert rows_of(rounded(found, *ledger.columns)) == rows_of(rounded(plain_figures(ledger), *ledger.columns))


def test_frames_across_parts_equal_whole_series(many_parts, random_ledger):
    undated = random_ledger.withColumn("date", F.when(F.col("issued") != 7, F.col("date")))
    for ledger in (random_ledger, undated, random_ledger.limit(1), random_ledger.limit(0)):
        same_figures(ledger)


@pytest.mark.parametrize("kind", ["one date", "equal rows", "long series"])
def test_a_hot_series_is_spread(many_parts, make_ledger, kind):
    rng = random.Random(6)
    day = {"one date": lambda n: 0, "equal rows": lambda n: 0, "long series": lambda n: n}[kind]
    used = (lambda: 4) if kind == "equal rows" else (lambda: rng.randint(0, 90))
    rows = [(day(n), "o", "l", "busy", 0, used(), 9 if kind == "equal rows" else rng.randint(0, 50), 5) for n in range(2400)]
    rows += [(d, "o", "l", f"calm{d % 4}", 0, d % 7, 9, 5) for d in range(100)]
    ledger = make_ledger(rows)
    same_figures(ledger)
    held = rolling.with_halo(ledger).groupBy(*SERIES_KEY, "frame").agg(F.count_if("own").alias("own"), F.count_if(~F.col("own")).alias("copies"))
    busiest = held.filter("item = 'busy'").collect()
    assert len(busiest) >= 12 and max(r.own for r in busiest) <= 2 * 2500 / 16
    assert max(r.copies for r in held.collect()) <= rolling.HALO


def test_short_parts_hand_over_through_several(many_parts, make_ledger):
    # 50 rows in 16 parts: a frame of 30 rows reaches over about ten of them
    same_figures(make_ledger([(d, "o", "l", "i", 0, d * d % 13, d % 5, 5) for d in range(50)]))


def test_numbers_follow_the_order(many_parts, random_ledger):
    order = [F.col(c) for c in [*SERIES_KEY, *TIE_BREAK]]
    rows = random_ledger.unionByName(random_ledger)
    found = ordering.numbered(rows, order, "place")
    literal = rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    assert rows_of(found) == rows_of(literal)
    places = [r.place for r in found.collect()]
    assert places == list(range(1, rows.count() + 1))
    assert ordering.numbered(rows.limit(0), order, "place").count() == 0


def test_ranking_needs_no_single_task(spark, random_ledger):
    level = F.when(F.col("issued") > 9, "CRITICAL").otherwise("HIGH")
    ranked = ordering.numbered(random_ledger.withColumn("u", level), [urgency_rank(F.col("u")), F.col("date")], "place")
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
