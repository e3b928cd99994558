"""Retention that is killed at any step loses no row and is ended by the next run."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwatch.plans import retention

NOW = datetime(2024, 3, 1, 12, 0)
SCHEMA = "execution_time timestamp, name string"
EDGE = "day=2024-01-31"


@pytest.fixture
def table(spark, tmp_path):
    """Days 29 to 31 before NOW in two batches; batch 2 of the edge day expires as a whole."""
    times = [(NOW - timedelta(days=d, hours=h), 1) for d in (29, 30, 31) for h in (-1, 0, 2)]
    times += [(NOW - timedelta(days=30, hours=3), 2), (NOW - timedelta(days=29), 2), (None, 1)]
    rows = spark.createDataFrame([(t, f"{t}/{b}", b) for t, b in times], f"{SCHEMA}, batch_id int")
    path = str(tmp_path / "runs")
    rows.withColumn("day", F.to_date("execution_time")).write.partitionBy("day", "batch_id").parquet(path)
    keep = {f"{t}/{b}" for t, b in times if t is None or t >= NOW - timedelta(days=30)}
    return path, keep, len(times)


def names(spark, path):
    return {r.name for r in spark.read.schema(SCHEMA).parquet(path).collect()}


def expire(spark, path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return retention.expire_folder(spark, path, schema, "execution_time", "day", 30, NOW)


def test_rows_and_partitions(spark, table):
    path, keep, count = table
    assert expire(spark, path) == count - len(keep) and names(spark, path) == keep
    assert retention.folders(spark, f"{path}/{EDGE}") == ["batch_id=1"]
    assert expire(spark, path) == 0 and names(spark, path) == keep


STEPS = ["_replace_partitions", "write_text", "remove"]


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("nth", [1, 2, 3, 4])
def test_killed_at_any_step(spark, table, monkeypatch, step, nth):
    path, keep, _ = table
    real, calls = getattr(retention, step), []

    def dies(*args):
        calls.append(args)
        if len(calls) == nth:
            raise KeyboardInterrupt
        return real(*args)

    with monkeypatch.context() as m:
        m.setattr(retention, step, dies)
        try:
            expire(spark, path)
        except KeyboardInterrupt:
            pass
    assert keep <= names(spark, path)  # these steps never take a row that stays
    expire(spark, path)
    assert names(spark, path) == keep


def test_killed_within_the_overwrite(spark, table, monkeypatch):
    """As if the job committing the overwrite was lost after it had deleted the old partition."""
    path, keep, _ = table

    def deletes_and_dies(spark_, path_, kept, columns):
        retention.remove(spark_, f"{path_}/{EDGE}/batch_id=1")
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(retention, "_replace_partitions", deletes_and_dies)
        with pytest.raises(KeyboardInterrupt):
            expire(spark, path)
    assert not keep <= names(spark, path)
    expire(spark, path)
    assert names(spark, path) == keep


def test_catalog_table_drops_in_one_statement(spark, monkeypatch):
    days = [(NOW - timedelta(days=d, hours=h), f"r{d}.{h}", None if d == 29 else b)
            for d in (0, 29, 30, 31, 90) for h, b in ((0, "x"), (2, "y"), (3, "x"))]
    rows = spark.createDataFrame(days, f"{SCHEMA}, kind string").withColumn("day", F.to_date("execution_time"))
    rows.write.partitionBy("day", "kind").mode("overwrite").saveAsTable("retained_rows")
    said = []
    real = type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **k: said.append(text) or real(self, text, *a, **k))
    assert retention.expire_table(spark, "retained_rows", "execution_time", 30, NOW, "day") == 8
    assert {r.name for r in spark.table("retained_rows").collect()} == {f"r{d}.{h}" for d in (0, 29) for h in (0, 2, 3)} | {"r30.0"}
    assert len(said) == 1 and said[0].startswith("ALTER TABLE") and "SHOW" not in said[0]
    assert retention.expire_table(spark, "retained_rows", "execution_time", 30, NOW, "day") == 0
