"""Streamed sessions against a plain one-pass split of each session's actions."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwatch.schema import RUN_LOG
from shelfwatch.streaming import refresh, sessions
from shelfwatch.streaming.runs import RunLogListener

START = datetime(2024, 1, 1)
SCHEMA = "session_id string, user_name string, action_timestamp timestamp, action_type string"
TYPES = ["ORDER_PLACED", "ITEM_REVIEWED", "PDF_EXPORTED", "DATA_UPLOADED", "OTHER", "BYE", None]


def plain(rows, gap=30):
    """(session, user, start, last, end, actions, orders) of every visit."""
    out = []
    for session in {r[0] for r in rows if r[0] is not None}:
        mine = sorted([r for r in rows if r[0] == session and r[2] is not None], key=lambda r: r[2])
        visit = []
        for r in [*mine, None]:
            if visit and (r is None or r[2] - visit[-1][2] > timedelta(minutes=gap)):
                ends = [v[2] for v in visit if v[3] == "BYE"]
                users = [v[1] for v in visit if v[1] is not None]
                out.append((session, max(users, default=None), visit[0][2], visit[-1][2], max(ends, default=None), len(visit),
                            sum(v[3] == "ORDER_PLACED" for v in visit)))
                visit = []
            visit.append(r)
    return sorted(out, key=repr)


def found(table, spark, batch):
    rows = table.read(spark, batch).collect()
    return sorted([(r.session_id, r.user_name, r.session_start, r.last_activity, r.session_end, r.actions_count, r.items_ordered)
                   for r in rows], key=repr)


class Stream:
    def __init__(self, spark, folder):
        self.spark, self.source, self.checkpoint = spark, str(folder / "actions"), str(folder / "checkpoint")
        self.table = sessions.SessionsTable(str(folder / "sessions"))

    def arrive(self, rows):
        """Add a file of actions, run what there is to run and return the finished query."""
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.source)
        arriving = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.source)
        query = sessions.start_sessions(arriving, self.table.path, self.checkpoint, once=True, closing="BYE")
        query.awaitTermination()
        return query


@pytest.fixture
def stream(spark, tmp_path):
    return Stream(spark, tmp_path)


def test_actions_in_any_order(stream, spark):
    rng = random.Random(5)
    rows = [(rng.choice("abcde"), rng.choice([None, "ann", "bob"]), START + timedelta(minutes=rng.randrange(2000)), rng.choice(TYPES))
            for _ in range(160)]
    # 30 minutes after each other, then one more second; a late action joins two visits
    rows += [("z", "z", START + timedelta(minutes=30 * k), "OTHER") for k in range(3)]
    rows += [("z", "z", START + timedelta(minutes=90, seconds=1), "OTHER")]
    rows += [(None, "x", START, "OTHER"), ("n", "x", None, "OTHER")]
    rng.shuffle(rows)
    for k in range(3):
        last = refresh.last_batch(stream.arrive(rows[k::3]))
        assert found(stream.table, spark, last) == plain([r for j in range(k + 1) for r in rows[j::3]])
    closed = sessions.closed_sessions(stream.table.read(spark, last)).collect()
    assert len(closed) == sum(r[4] is not None for r in plain(rows)) > 0 and not any(r.is_active for r in closed)
    opened = sessions.open_sessions(stream.table.read(spark, last), F.lit(START + timedelta(minutes=2000))).filter("is_open")
    assert all(r.last_activity >= START + timedelta(minutes=1970) for r in opened.collect())


def test_a_batch_writes_only_its_sessions(stream, spark):
    stream.arrive([(f"s{n}", "ann", START + timedelta(minutes=n), "OTHER") for n in range(300)])
    query = stream.arrive([("s7", "ann", START + timedelta(minutes=9), "ORDER_PLACED")])
    last = refresh.last_batch(query)
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsUpdated"] == 1 and query.lastProgress["numInputRows"] == 1
    changed = spark.read.parquet(f"{stream.table.path}/changes/batch_id={last}").collect()
    assert [(r.session_id, r.actions_count) for r in changed] == [("s7", 2)]
    assert stream.table.read(spark, last).count() == 300 and stream.table.read(spark, last - 1).count() == 300
    assert stream.table.read(spark, last).agg(F.sum("actions_count")).first()[0] == 301


def test_bases_take_changes_in(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sessions, "COMPACT", 3)
    table = sessions.SessionsTable(str(tmp_path / "sessions"))
    expected = {}
    for n in range(10):
        rows = [(f"s{k}", json.dumps([["u", n, n, None, n + 1, 0, 0, 0, 0]])) for k in {n, n // 2, 0}]
        for _ in ("once", "replayed"):
            table.add(spark.createDataFrame(rows, "session_id string, visits string"), n)
        expected |= {r[0]: n + 1 for r in rows}
        assert {r.session_id: r.actions_count for r in table.read(spark, n).collect()} == expected
    assert table._numbers(spark, "base") == [5, 8] and table._numbers(spark, "changes") == [6, 7, 8, 9]
    assert table.read(spark, 7).count() == 8


def test_a_busy_session_is_few_rows(spark):
    rows = [("busy", "u", START + timedelta(seconds=k % 5000), "OTHER") for k in range(6000)]
    visits = sessions.combined(sessions.single_actions(spark.createDataFrame(rows, SCHEMA).coalesce(2)), sessions.micros("30 minutes"))
    found = [json.loads(r.visit) for r in visits.collect()]
    assert len(found) <= 4 and sum(v[sessions.VISIT.index("actions_count")] for v in found) == 6000
    assert sessions.micros("2 days") == 172_800_000_000


def test_a_long_session_writes_only_the_cell_of_an_action(stream, spark):
    # a visit over many cells of half an hour, before and after 1970; an action in the middle, later
    rows = [("s", 'a"]b', datetime(1969, 12, 31) + timedelta(minutes=30 * k), "OTHER") for k in range(96) if k != 50]
    stream.arrive(rows)
    late = [("s", None, rows[0][2] + timedelta(minutes=1500), "BYE")]
    query = stream.arrive(late)
    last = refresh.last_batch(query)
    assert query.lastProgress["stateOperators"][0]["numRowsUpdated"] == 1
    assert [r.actions_count for r in spark.read.parquet(f"{stream.table.path}/changes/batch_id={last}").collect()] == [1]
    assert len(plain(rows)) == 2 and len(plain(rows + late)) == 1
    assert found(stream.table, spark, last - 1) == plain(rows) and found(stream.table, spark, last) == plain(rows + late)


def test_no_row_leaves_the_engine(spark):
    actions = spark.createDataFrame([("s", "u", START, "OTHER")], SCHEMA)
    plan = sessions.combined(sessions.single_actions(actions), 1)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in plan and "Pandas" not in plan and "Python" not in plan


def test_run_rows_come_from_events(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "runs")
    for n in (3, 4):
        spark.range(n).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)

    def run(listener, name, work):
        query = stream.writeStream.queryName(name).foreachBatch(work).trigger(availableNow=True).start()
        listener.wait(query)

    with RunLogListener(spark, path) as listener:
        run(listener, "good", lambda batch, n: batch.write.format("noop").mode("overwrite").save())
        run(listener, "bad", lambda batch, n: 1 // 0)
    rows = spark.read.schema(RUN_LOG).parquet(path).collect()
    good = sorted((r.status, r.records_processed) for r in rows if r.task_name == "good")
    assert good == [("SUCCESS", 3), ("SUCCESS", 4)]
    bad = [r for r in rows if r.task_name == "bad"]
    assert [(r.status, r.records_processed) for r in bad] == [("FAILED", 0)] and "division" in bad[0].error_message
    assert len({r.log_id for r in rows}) == 3 and all(r.execution_duration_seconds > 0 for r in rows if r.status == "SUCCESS")
