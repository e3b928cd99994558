import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators.changes import change_feed
from shelfwatch.plans import latest, retention
from shelfwatch.schema import ALERTS, DAY_KEY, RUN_LOG, SUMMARY
from shelfwatch.streaming import refresh


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def stream(spark, tmp_path):
    """Drop ledger rows as files and run the refresh over what is there."""

    class Stream:
        source, root = str(tmp_path / "source"), str(tmp_path / "tables")
        tables = refresh.RefreshTables(str(tmp_path / "tables"))

        def add(self, rows):
            rows.coalesce(1).write.mode("append").parquet(self.source)

        def run(self, **options):
            arriving = refresh.ledger_stream(spark, self.source, files_per_batch=1)
            query = refresh.start_refresh(arriving, self.root, str(tmp_path / "checkpoint"), once=True, **options)
            query.awaitTermination()
            return refresh.last_batch(query)

    return Stream()


def test_stream_equals_batch(spark, random_ledger, stream):
    parts = [random_ledger.filter(F.pmod(F.xxhash64("date", "issued"), F.lit(3)) == n) for n in range(3)]
    for part in parts:
        stream.add(part)
    last = stream.run()
    assert last == 2
    day = random_ledger.agg(F.max("date")).first()[0]
    as_of = datetime(day.year, day.month, day.day)
    stock = latest.stock_analytics(random_ledger, as_of)
    tables = stream.tables
    assert rows_of(tables.stock(spark, last)) == rows_of(stock)
    assert rows_of(tables.recommendations(spark, last)) == rows_of(latest.reorder_recommendations(stock))
    assert rows_of(tables.usage(spark, last)) == rows_of(latest.usage_stats(random_ledger, as_of))
    summaries = tables.summaries(spark).orderBy("summary_id").collect()
    assert [r["summary_id"] for r in summaries] == [0, 1, 2]
    wanted = latest.analytics_summary(stock, latest.reorder_recommendations(stock), as_of).first()
    assert summaries[2]["high_risk_count"] == wanted["high_risk_count"]
    alerts = tables.alerts(spark)
    assert alerts.count() == alerts.select("organization", "location", "item", "alert_date").distinct().count() > 0


def test_gate_and_rerun(spark, series, stream):
    ledger = series([10] * 4, closing=5)
    stream.add(ledger)
    assert stream.run() == 0
    assert stream.tables.alerts(spark).count() == 1
    # no new file, no batch
    stream.run()
    assert stream.tables.summaries(spark).count() == 1
    # an older row outside the tail's values leaves the stock table as it was: no alert run
    stream.add(series([10], closing=5).withColumn("date", F.date_add("date", -9)))
    assert stream.run() == 1
    tasks = [r["task_name"] for r in stream.tables.runs(spark).collect()]
    assert sorted(tasks) == ["generate_alerts", "refresh_summary", "refresh_summary"]
    # changed stock the same day: still alerted only once
    stream.add(series([10] * 4, closing=6).filter(F.col("date") == "2024-01-04"))
    assert stream.run() == 2
    assert stream.tables.alerts(spark).count() == 1


def test_replayed_batch_changes_nothing(spark, random_ledger, tmp_path):
    tables = refresh.RefreshTables(str(tmp_path / "tables"))
    early, late = random_ledger.filter("date < '2024-03-01'"), random_ledger.filter("date >= '2024-03-01'")
    refresh.refresh(early, 0, tables)
    refresh.refresh(late, 1, tables)

    def state():
        return [
            rows_of(tables.stock(spark, 1)),
            rows_of(tables.usage(spark, 1)),
            rows_of(tables.alerts(spark)),
            rows_of(tables.summaries(spark)),
            tables.runs(spark).count(),
        ]

    before = state()
    refresh.refresh(late, 1, tables)
    assert state() == before


def test_restated_history(spark, random_ledger):
    current = random_ledger.filter("item <> 'Item 1'").withColumn(
        "issued", F.when(F.col("item") == "Item 5", F.col("issued") + 3).otherwise(F.col("issued"))
    )
    as_of = datetime(2024, 6, 1)
    moved = change_feed(random_ledger, current, DAY_KEY)
    mended = refresh.recompute_series(current, moved, latest.stock_analytics(random_ledger, as_of), as_of)
    assert rows_of(mended) == rows_of(latest.stock_analytics(current, as_of))


def test_failed_runs_leave_a_row(spark, series, stream, monkeypatch):
    stream.add(series([10] * 4, closing=5))
    real = refresh._append_alerts
    monkeypatch.setattr(refresh, "_append_alerts", lambda *a: 1 // 0)
    with pytest.raises(Exception, match="division"):
        stream.run()
    monkeypatch.setattr(refresh, "_append_alerts", real)
    assert stream.run() == 0
    rows = {(r["task_name"], r["status"]) for r in stream.tables.runs(spark).collect()}
    assert rows == {("generate_alerts", "FAILED"), ("refresh_summary", "SUCCESS"), ("generate_alerts", "SUCCESS")}
    assert stream.tables.alerts(spark).count() == 1


def test_untouched_buckets_keep_their_files(spark, make_ledger, tmp_path):
    tables = refresh.RefreshTables(str(tmp_path / "tables"))
    everyone = make_ledger([(d, "o", "l", f"i{n}", 0, 5, 9, 7) for d in range(3) for n in range(40)])
    refresh.refresh(everyone, 0, tables)
    before = tables.tails.manifest(spark, 0)
    refresh.refresh(make_ledger([(4, "o", "l", "i7", 0, 5, 1, 7)]), 1, tables)
    after = tables.tails.manifest(spark, 1)
    assert set(after) == set(before) and sum(after[b] != before[b] for b in before) == 1
    assert tables.stock(spark, 1).filter("closing_stock = 1").count() == 1 and tables.stock(spark, 1).count() == 40
    # the older version stays whole until the next batch
    assert tables.stock_rows.read(spark, 0).filter("closing_stock = 1").isEmpty()
    refresh.refresh(make_ledger([(5, "o", "l", "i8", 0, 5, 1, 7)]), 2, tables)
    assert tables.stock(spark, 2).filter("closing_stock = 1").count() == 2
    assert tables.stock(spark, 2).count() == 40 and tables.tails.manifest(spark, 0) == {}


LAGS = {"stock": 5, "recommendations": 10, "usage": 15}


def test_tables_are_refreshed_by_their_own_lags(spark, random_ledger, tmp_path):
    tables = refresh.RefreshTables(str(tmp_path / "tables"), 4)
    parts = [random_ledger.filter(F.pmod(F.xxhash64("date", "issued"), F.lit(5)) == n) for n in range(5)]
    counts = []
    for n, part in enumerate(parts):  # a batch every five minutes
        refresh.refresh(part, n, tables, lags=LAGS, now=300.0 * n)
        counts.append({name: held["refreshes"] for name, held in tables.freshness(spark, n).items()})
    assert [c["stock"] for c in counts] == [1, 2, 3, 4, 5]
    assert [c["recommendations"] for c in counts] == [1, 1, 2, 2, 3]
    assert [c["usage"] for c in counts] == [1, 1, 1, 2, 2]

    def day_of(rows):
        newest = rows.agg(F.max("date")).first()[0]
        return datetime(newest.year, newest.month, newest.day)

    def upto(n):
        rows = parts[0]
        for part in parts[1 : n + 1]:
            rows = rows.unionByName(part)
        return rows

    as_of = day_of(random_ledger)
    stock = latest.stock_analytics(random_ledger, as_of)
    assert rows_of(tables.stock(spark, 4)) == rows_of(stock)
    assert rows_of(tables.recommendations(spark, 4)) == rows_of(latest.reorder_recommendations(stock))
    # the usage is that of the fourth batch until it is due again, then takes the fifth too
    third = upto(3)
    assert rows_of(tables.usage(spark, 4)) == rows_of(latest.usage_stats(third, day_of(third)))
    refresh.catch_up(spark, tables, 4, lags=LAGS, now=300.0 * 5)
    assert tables.freshness(spark, 4)["usage"]["batch"] == 3
    refresh.catch_up(spark, tables, 4, lags=LAGS, now=300.0 * 6)
    assert tables.freshness(spark, 4)["usage"] == {"batch": 4, "at": 1800.0, "newest": as_of.date().isoformat(), "refreshes": 3}
    assert rows_of(tables.usage(spark, 4)) == rows_of(latest.usage_stats(random_ledger, as_of))
    # nothing is behind now, and the next batch goes on from there
    before = tables.freshness(spark, 4)
    refresh.catch_up(spark, tables, 4)
    assert tables.freshness(spark, 4) == before
    refresh.refresh(parts[0], 5, tables)
    assert [r["batch"] for r in tables.freshness(spark, 5).values()] == [5, 5, 5]


def test_stock_that_lags_brings_summary_and_alerts_later(spark, make_ledger, tmp_path):
    tables = refresh.RefreshTables(str(tmp_path / "tables"), 4)
    for n in range(3):
        refresh.refresh(make_ledger([(n, "o", "l", f"i{n}", 0, 5, 1, 7)]), n, tables, lags={"stock": 60}, now=60.0 * n)
    assert [r["summary_id"] for r in tables.summaries(spark).collect()] == [0]
    assert tables.stock(spark, 2).count() == tables.alerts(spark).count() == 1
    refresh.catch_up(spark, tables, 2)
    assert tables.stock(spark, 2).count() == tables.recommendations(spark, 2).count() == 3
    latest_row = tables.summaries(spark).filter("summary_id = 2").first()
    assert (latest_row["total_items"], latest_row["high_risk_count"]) == (3, 3)
    assert tables.alerts(spark).filter("alert_date = '2024-01-03'").count() == 3


def test_summary_reads_only_touched_buckets(spark, make_ledger, tmp_path, monkeypatch):
    tables = refresh.RefreshTables(str(tmp_path / "tables"))
    everyone = make_ledger([(d, f"o{n % 3}", "l", f"i{n}", 0, 5, 9, 7) for d in range(3) for n in range(40)] + [(0, None, "l", None, 0, 5, 9, 7)])
    refresh.refresh(everyone, 0, tables)
    read, whole = [], refresh.BucketedTable.read

    def watched(table, session, batch_id, buckets=None):
        read.append((table.path.split("/")[-1], buckets))
        return whole(table, session, batch_id, buckets)

    monkeypatch.setattr(refresh.BucketedTable, "read", watched)
    monkeypatch.setattr(refresh, "_append_alerts", lambda *a: 0)  # a new day's alerts look at all stock
    refresh.refresh(make_ledger([(4, "o1", "l", "i7", 0, 5, 1, 7), (4, "o9", "l", "i7", 0, 5, 1, 7)]), 1, tables)
    monkeypatch.undo()
    assert {"stock", "names"} <= {name for name, _ in read}
    assert all(buckets is not None and len(buckets) <= 2 for _, buckets in read)
    day = datetime(2024, 1, 5)
    wanted = latest.summary_of_stock(tables.stock(spark, 1), day).first()
    got = tables.summaries(spark).filter("summary_id = 1").first()
    assert {c: got[c] for c in wanted.asDict()} == wanted.asDict()
    assert (got["total_organizations"], got["total_items"]) == (4, 40)


def test_names_that_leave_the_stock_are_not_counted(spark, make_ledger, tmp_path):
    tables = refresh.RefreshTables(str(tmp_path / "tables"), 2)
    refresh.refresh(make_ledger([(0, "o", "l", "i", 0, 5, 1, 7), (0, "p", "l", "i", 0, 5, 1, 7)]), 0, tables)
    rows = tables.stock_rows.read(spark, 0)
    tables.stock_rows.write(rows.filter("organization = 'o'"), 1, [0, 1])
    tables.names.carry(spark, 1)
    refresh._count_stock(spark, tables, 1, [0, 1])
    assert tables.noted(spark, "totals", 1)["distinct"] == {"organization": 1, "item": 1}


def test_idle_query_catches_up(spark, make_ledger, tmp_path):
    source, tables = str(tmp_path / "source"), refresh.RefreshTables(str(tmp_path / "tables"), 2)
    ticks = iter(range(10**6))
    options = {"minutes": 1 / 60, "buckets": 2, "lags": {"usage": 3 / 60}, "clock": lambda: float(next(ticks))}

    def add(n):
        make_ledger([(n, "o", "l", f"i{n}", 0, 5, 1, 7)]).coalesce(1).write.mode("append").parquet(source)

    def wait_for(done):
        end = time.time() + 90
        while not done() and time.time() < end:
            time.sleep(0.5)
        assert done()

    add(0)
    query = refresh.start_refresh(refresh.ledger_stream(spark, source), tables.root, str(tmp_path / "cp"), **options)
    try:
        wait_for(lambda: tables.freshness(spark, 0)["usage"]["batch"] == 0)
        add(1)
        wait_for(lambda: tables.freshness(spark, 1)["stock"]["batch"] == 1)
        wait_for(lambda: tables.freshness(spark, 1)["usage"]["batch"] == 1)
        assert tables.usage(spark, 1).count() == 2
    finally:
        query.stop()


def test_retention_of_the_engines_own_tables(spark, make_ledger, tmp_path):
    tables = refresh.RefreshTables(str(tmp_path / "tables"))
    for n, day in enumerate((0, 100, 200, 400)):
        refresh.refresh(make_ledger([(day, "o", "l", f"i{n}", 0, 5, 1, 7)]), n, tables)
    schemas = {"summaries": SUMMARY, "alerts": ALERTS, "runs": RUN_LOG}
    as_of = datetime(2024, 1, 1) + timedelta(days=400)
    deleted = retention.expire_tables(spark, tables.root, schemas, as_of)
    assert deleted["summaries"] == 3 and deleted["runs"] == 0
    assert {r["summary_id"] for r in tables.summaries(spark).collect()} == {3}
    assert tables.alerts(spark).select("alert_date").distinct().count() == 1
    assert retention.expire_tables(spark, tables.root, schemas, as_of) == {"summaries": 0, "alerts": 0, "runs": 0}
    later = datetime.now() + timedelta(days=31)
    # with the two clean-ups' own rows
    assert retention.expire_tables(spark, tables.root, schemas, later)["runs"] == 8 + 2
    assert [(r.task_name, r.status) for r in tables.runs(spark).collect()] == [("daily_cleanup", "SUCCESS")]


def test_edge_day_and_unknown_days_of_a_folder(spark, tmp_path):
    now = datetime(2024, 3, 1, 12, 0)
    times = [now - timedelta(days=d, hours=h) for d in (29, 30, 31) for h in (0, 2)] + [None]
    rows = spark.createDataFrame([(t, str(t)) for t in times], "execution_time timestamp, name string")
    rows = rows.withColumn("day", F.to_date("execution_time")).withColumn("batch_id", F.lit(1))
    path = str(tmp_path / "runs")
    rows.write.partitionBy("day", "batch_id").parquet(path)
    schema = spark.createDataFrame([], "execution_time timestamp, name string").schema
    assert retention.expire_folder(spark, path, schema, "execution_time", "day", 30, now) == 3
    kept = {r["name"] for r in spark.read.schema(schema).parquet(path).collect()}
    assert kept == {str(t) for t in times if t is None or t >= now - timedelta(days=30)}
