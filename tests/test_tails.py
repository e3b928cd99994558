import pytest
from pyspark.sql import Window, functions as F

from shelfwatch.operators import rolling, tails
from shelfwatch.plans import latest
from shelfwatch.schema import SERIES_KEY


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


FIGURES = ["avg_short", "avg_long", "min_short", "max_short", "stddev_short"]


def rounded(df, *keep):
    return df.select(*keep, *[F.round(c, 9).alias(c) for c in FIGURES])


def test_tail_form_equals_window_form(random_ledger):
    newest = Window.partitionBy(*SERIES_KEY).orderBy(*tails.newest_first())
    literal = (
        rolling.rolling_figures(random_ledger)
        .withColumn("n", F.row_number().over(newest))
        .filter("n = 1")
    )
    tail = tails.tail_figures(random_ledger)
    keep = SERIES_KEY + ["date", "closing_stock", "lead_time_days"]
    assert rows_of(rounded(tail, *keep)) == rows_of(rounded(literal, *keep))


@pytest.mark.parametrize("salts", [1, 3, 64])
def test_salts_do_not_change_the_latest_rows(random_ledger, salts):
    assert rows_of(tails.latest_rows(random_ledger, 5, salts)) == rows_of(tails.latest_rows(random_ledger, 5))


def test_partitioning_does_not_change_results(random_ledger):
    shuffled = random_ledger.repartition(7).orderBy(F.xxhash64("issued", "date"))
    assert rows_of(latest.usage_stats(shuffled)) == rows_of(latest.usage_stats(random_ledger))


def plain_figures(ledger):
    """The frames over whole series, as a check of the cuts."""
    ordered = Window.partitionBy(*SERIES_KEY).orderBy(*tails.oldest_first())
    short, long = ordered.rowsBetween(-6, 0), ordered.rowsBetween(-29, 0)
    return ledger.withColumns({
        "avg_short": F.avg("issued").over(short), "avg_long": F.avg("issued").over(long), "min_short": F.min("issued").over(short),
        "max_short": F.max("issued").over(short), "stddev_short": F.stddev_samp("issued").over(short),
    })


def test_cut_frames_equal_whole_series(random_ledger):
    undated = random_ledger.withColumn("date", F.when(F.col("issued") != 7, F.col("date")))
    for ledger in (random_ledger, undated):
        found = rolling.rolling_figures(ledger)
        assert rows_of(rounded(found, *ledger.columns)) == rows_of(rounded(plain_figures(ledger), *ledger.columns))


def test_one_series_with_most_rows(make_ledger):
    rows = [(d // 3, "o", "l", "busy", 0, d % 11, d % 17, 5) for d in range(1800)]
    rows += [(40 * d, "o", "l", f"calm{d % 5}", 0, d % 7, 9, 5) for d in range(200)]
    ledger = make_ledger(rows)
    found = rolling.rolling_figures(ledger)
    assert rows_of(rounded(found, *ledger.columns)) == rows_of(rounded(plain_figures(ledger), *ledger.columns))


def test_frames_hold_seven_and_thirty_rows(series):
    figures = rolling.rolling_figures(series(list(range(31)))).orderBy("date").collect()
    assert figures[30]["min_short"] == 24 and figures[30]["avg_short"] == 27.0
    assert figures[30]["avg_long"] == sum(range(1, 31)) / 30
    assert figures[7]["min_short"] == 1 and figures[7]["avg_long"] == 3.5


def test_frames_count_rows_not_days(make_ledger):
    ledger = make_ledger([(30 * d, "o", "l", "i", 0, d, 9, 5) for d in range(7)])
    assert tails.tail_figures(ledger).first()["avg_short"] == 3.0


def test_single_row_has_no_spread(series):
    row = latest.usage_stats(series([4])).first()
    assert row["usage_stddev_7d"] is None and row["usage_volatility_pct"] is None
    assert (row["demand_pattern"], row["trend_direction"]) == ("STABLE", "STABLE")


def test_zero_usage(series):
    ledger = series([0] * 9)
    stock = latest.stock_analytics(ledger).first()
    assert (stock["days_left"], stock["risk_status"]) == (9999.0, "NORMAL")
    stats = latest.usage_stats(ledger).first()
    assert (stats["usage_volatility_pct"], stats["trend_direction"]) == (0.0, "STABLE")


def test_risk_bound_is_inclusive(series):
    assert latest.stock_analytics(series([10], closing=70, lead=7)).first()["risk_status"] == "HIGH"
    assert latest.stock_analytics(series([10], closing=71, lead=7)).first()["risk_status"] == "NORMAL"


def test_same_day_rows_have_a_fixed_order(make_ledger):
    ledger = make_ledger([(0, "o", "l", "i", 0, u, c, 5) for u, c in ((1, 8), (3, 8), (2, 5))])
    newest = tails.latest_rows(ledger, 1).first()
    assert (newest["closing_stock"], newest["issued"]) == (8, 3)


def test_stock_points(make_ledger):
    rows = [(d, "o", "l", "i", 0, 1, 100 - d, 5) for d in range(9)] + [(0, "o", "l", "j", 0, 1, 5, 5)]
    found = tails.stock_points(make_ledger(rows)).collect()
    assert [r["item"] for r in found] == ["i"]
    assert found[0]["closing_stocks"] == [98, 97, 96, 95, 94, 93, 92]
    assert found[0]["dates"] == sorted(found[0]["dates"])
