"""Change-driven refresh of the latest-row tables, the summary and the alerts.

Each table may lag behind the ledger by minutes of its own. A batch brings the newest rows
of its series into the state and notes their keys; a table that isn't due yet keeps its
rows, and when it is due it takes all series noted since its last refresh.
"""

import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from shelfwatch import fixed_values as V
from shelfwatch.operators.changes import row_changes
from shelfwatch.operators.joins import with_keys, without_keys
from shelfwatch.operators.tails import figures_of, latest_rows
from shelfwatch.plans.latest import (
    new_alerts,
    reorder_recommendations,
    stock_from_tails,
    summary_sums,
    usage_from_tails,
    with_advice,
    with_alert_ids,
)
from shelfwatch.plans.oplog import run_row, save_runs
from shelfwatch.schema import ALERTS, LEDGER, RUN_LOG, SERIES_KEY, SUMMARY
from shelfwatch.staging import read_text, write_text
from shelfwatch.streaming.state import BUCKETS, BucketedTable, bucket_of, folders, remove

TAILS = T.StructType(LEDGER.fields + [T.StructField("recency", T.IntegerType())])
_KEY_FIELDS = [T.StructField(c, T.StringType()) for c in SERIES_KEY]
STOCK = T.StructType(
    _KEY_FIELDS
    + [
        T.StructField("closing_stock", T.LongType()),
        T.StructField("lead_time_days", T.LongType()),
        T.StructField("avg_daily_usage", T.DoubleType()),
        T.StructField("days_left", T.DoubleType()),
        T.StructField("risk_status", T.StringType()),
    ]
)
USAGE = T.StructType(
    _KEY_FIELDS
    + [
        T.StructField("last_data_date", T.DateType()),
        T.StructField("avg_daily_usage_7d", T.DoubleType()),
        T.StructField("avg_daily_usage_30d", T.DoubleType()),
        T.StructField("min_usage_7d", T.LongType()),
        T.StructField("max_usage_7d", T.LongType()),
        T.StructField("usage_stddev_7d", T.DoubleType()),
        T.StructField("trend_direction", T.StringType()),
        T.StructField("usage_volatility_pct", T.DoubleType()),
        T.StructField("demand_pattern", T.StringType()),
    ]
)
RECOMMENDATIONS = T.StructType(
    _KEY_FIELDS
    + [
        T.StructField("closing_stock", T.LongType()),
        T.StructField("avg_daily_usage", T.DoubleType()),
        T.StructField("days_left", T.DoubleType()),
        T.StructField("lead_time_days", T.LongType()),
        T.StructField("reorder_qty", T.DoubleType()),
        T.StructField("reorder_qty_with_safety", T.DoubleType()),
        T.StructField("urgency_level", T.StringType()),
        T.StructField("priority_score", T.DoubleType()),
    ]
)
NAMES = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("n", T.LongType())]
)
_COUNTED = {"organization": "total_organizations", "item": "total_items"}
_SUMS = ["high_risk_count", "critical_risk_count", "total_reorder_qty"]
_NEVER = {"batch": -1, "at": None, "newest": None, "refreshes": 0}
BATCHED_ALERTS = T.StructType(
    [x for x in ALERTS.fields if x.name != "alert_date"] + [T.StructField("batch_id", T.LongType())]
)


def ledger_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Ledger files appended to a folder, as a stream."""
    reader = spark.readStream.schema(LEDGER)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _read(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A table that may not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _save(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class RefreshTables:
    """Tables of the refresh below ``root``.

    The newest rows of each series (``tails``), ``stock``, ``recommendations`` and ``usage``
    are bucketed by series: a batch rewrites the buckets of the series that it touches.
    ``names`` counts the series of each organization and item, for the summary's distinct
    counts. Summaries, alerts and runs get one folder per batch, which a replay replaces; a
    failed attempt keeps its run row in a folder of its own. ``last_updated`` is the newest
    date that had arrived at a table's last refresh, one value per table.
    """

    root: str
    buckets: int = BUCKETS

    def _bucketed(self, name: str, schema: T.StructType) -> BucketedTable:
        return BucketedTable(f"{self.root}/{name}", schema, tuple(SERIES_KEY), self.buckets)

    @property
    def tails(self) -> BucketedTable:
        return self._bucketed("tails", TAILS)

    @property
    def stock_rows(self) -> BucketedTable:
        return self._bucketed("stock", STOCK)

    @property
    def usage_rows(self) -> BucketedTable:
        return self._bucketed("usage", USAGE)

    @property
    def recommendation_rows(self) -> BucketedTable:
        return self._bucketed("recommendations", RECOMMENDATIONS)

    @property
    def names(self) -> BucketedTable:
        return BucketedTable(f"{self.root}/names", NAMES, ("kind", "name"), self.buckets)

    def _note(self, name: str, batch_id: int) -> str:
        return f"{self.root}/{name}/{batch_id}.json"

    def noted(self, spark: SparkSession, name: str, batch_id: int) -> dict:
        """A small note of a batch: ``freshness`` by table, or the summary's ``totals``."""
        text = read_text(spark, self._note(name, batch_id)) if batch_id >= 0 else None
        return json.loads(text) if text else {}

    def note(self, spark: SparkSession, name: str, batch_id: int, value: dict) -> None:
        write_text(spark, self._note(name, batch_id), json.dumps(value))
        remove(spark, self._note(name, batch_id - 2))

    def freshness(self, spark: SparkSession, batch_id: int) -> dict[str, dict]:
        """For each lagging table: the last batch it took in, when, the newest date then, and how often."""
        held = self.noted(spark, "freshness", batch_id)
        return {name: held.get(name, _NEVER) for name in V.TABLE_LAGS}

    def touched(self, batch_id: int) -> str:
        return f"{self.root}/touched/batch={batch_id}"

    def keys_between(self, spark: SparkSession, after: int, upto: int) -> DataFrame:
        """Series touched after one batch, up to another; a series may be listed once per batch."""
        places = [self.touched(n) for n in self._touched_in(spark, after, upto)]
        schema = T.StructType(_KEY_FIELDS)
        return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)

    def buckets_between(self, spark: SparkSession, after: int, upto: int) -> list[int]:
        """Buckets of these series, as noted beside them; no job."""
        notes = [read_text(spark, f"{self.touched(n)}/_buckets.json") for n in self._touched_in(spark, after, upto)]
        return sorted({bucket for text in notes for bucket in json.loads(text)})

    def _touched_in(self, spark: SparkSession, after: int, upto: int) -> list[int]:
        held = [int(f.split("=")[1]) for f in folders(spark, f"{self.root}/touched")]
        return [n for n in held if after < n <= upto]

    def log(self, name: str, column: str, day: date | None, batch_id: int | str) -> str:
        return f"{self.root}/{name}/{column}={day or '__HIVE_DEFAULT_PARTITION__'}/batch_id={batch_id}"

    def newest(self, spark: SparkSession, batch_id: int) -> date | None:
        """The newest date in the ledger after a batch."""
        text = read_text(spark, self._clock(batch_id)) if batch_id >= 0 else None
        return date.fromisoformat(text) if text else None

    def _clock(self, batch_id: int) -> str:
        return f"{self.root}/clock/{batch_id}.txt"

    def set_newest(self, spark: SparkSession, batch_id: int, day: date | None) -> None:
        write_text(spark, self._clock(batch_id), day.isoformat() if day else "")
        remove(spark, self._clock(batch_id - 2))

    def _timed(self, spark: SparkSession, name: str, rows: DataFrame, batch_id: int) -> DataFrame:
        day = self.freshness(spark, batch_id)[name]["newest"]
        return rows.withColumn("last_updated", F.lit(day).cast("date").cast("timestamp"))

    def stock(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return self._timed(spark, "stock", self.stock_rows.read(spark, batch_id), batch_id)

    def recommendations(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return self._timed(spark, "recommendations", self.recommendation_rows.read(spark, batch_id), batch_id)

    def usage(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return self._timed(spark, "usage", self.usage_rows.read(spark, batch_id), batch_id)

    def summaries(self, spark: SparkSession) -> DataFrame:
        return _read(spark, f"{self.root}/summaries", SUMMARY).select(*SUMMARY.fieldNames())

    def alerts(self, spark: SparkSession) -> DataFrame:
        return _read(spark, f"{self.root}/alerts", ALERTS).select(*ALERTS.fieldNames())

    def runs(self, spark: SparkSession) -> DataFrame:
        return _read(spark, f"{self.root}/runs", RUN_LOG).select(*RUN_LOG.fieldNames())


def _save_runs(spark: SparkSession, tables: RefreshTables, label: str, runs: list[tuple]) -> None:
    """Write the run rows of a batch under the day it ran on; a replay on another day replaces them too."""
    place = f"{tables.root}/runs"
    for day in folders(spark, place):
        remove(spark, f"{place}/{day}/batch_id={label}")
    save_runs(spark, place, label, runs)


def _touched_buckets(keys: DataFrame, tables: RefreshTables) -> list[int]:
    found = keys.select(bucket_of(SERIES_KEY, tables.buckets).alias("bucket")).distinct().collect()
    return sorted(r["bucket"] for r in found)  # at most ``buckets``


def _arrive(batch: DataFrame, batch_id: int, tables: RefreshTables) -> None:
    """Bring the newest rows of the touched series up to date and note their keys.

    Only buckets with touched series are read and written, and only touched series
    are ranked again; the other rows of these buckets are copied.
    """
    spark = batch.sparkSession
    rows = _save(batch.select(*LEDGER.fieldNames()), f"{tables.root}/arrived/batch={batch_id}")
    touched = _save(rows.select(*SERIES_KEY).distinct(), tables.touched(batch_id))
    buckets = _touched_buckets(touched, tables)
    write_text(spark, f"{tables.touched(batch_id)}/_buckets.json", json.dumps(buckets))
    old = tables.tails.read(spark, batch_id - 1, buckets)
    merged = rows.unionByName(with_keys(old, touched, SERIES_KEY).drop("recency"))
    fresh = latest_rows(merged, V.LONG_FRAME_ROWS).select(*TAILS.fieldNames())
    tables.tails.write(fresh.unionByName(without_keys(old, touched, SERIES_KEY)), batch_id, buckets)
    days = [d for d in (rows.agg(F.max("date")).first()[0], tables.newest(spark, batch_id - 1)) if d is not None]
    tables.set_newest(spark, batch_id, max(days, default=None))
    remove(spark, f"{tables.root}/arrived/batch={batch_id - 2}")


def _replace(table: BucketedTable, rows: DataFrame, keys: DataFrame, batch_id: int, buckets: list[int]) -> None:
    """Put ``rows`` in place of the rows of the ``keys``, all of which are in ``buckets``."""
    others = without_keys(table.read(keys.sparkSession, batch_id - 1, buckets), keys, SERIES_KEY)
    table.write(rows.select(*table.schema.fieldNames()).unionByName(others), batch_id, buckets)


def _is_due(held: dict, upto: int, lag: float, now: float) -> bool:
    """Whether a table is behind and its last refresh ``lag`` minutes ago."""
    return held["batch"] < upto and (held["at"] is None or now - held["at"] >= lag * 60)


def _refresh_due(
    spark: SparkSession, tables: RefreshTables, batch_id: int, before: dict[str, dict], lags: dict[str, float], now: float
) -> dict[str, dict]:
    """Refresh the tables that are due and return the new freshness of all.

    ``before`` is the freshness to go on from. Figures are taken once, for the series
    that any due table lacks. The recommendations follow the stock, so they are behind
    only by batches that the stock has taken.
    """
    day = tables.newest(spark, batch_id)

    def fresh(name: str, batch: int) -> dict:
        newest = day.isoformat() if day else None
        return {"batch": batch, "at": now, "newest": newest, "refreshes": before[name]["refreshes"] + 1}

    after = dict(before)
    builders = {"stock": (tables.stock_rows, stock_from_tails), "usage": (tables.usage_rows, usage_from_tails)}
    due = [n for n in builders if _is_due(before[n], batch_id, lags.get(n, 0), now)]
    if due:
        since = min(before[n]["batch"] for n in due)
        wanted = tables.keys_between(spark, since, batch_id)
        tails = tables.tails.read(spark, batch_id, tables.buckets_between(spark, since, batch_id))
        figures = _save(figures_of(with_keys(tails, wanted, SERIES_KEY)), f"{tables.root}/figures")
    for name in due:
        table, build = builders[name]
        keys = tables.keys_between(spark, before[name]["batch"], batch_id)
        buckets = tables.buckets_between(spark, before[name]["batch"], batch_id)
        _replace(table, build(with_keys(figures, keys, SERIES_KEY), F.lit(None)), keys, batch_id, buckets)
        if name == "stock":
            _count_stock(spark, tables, batch_id, buckets)
        after[name] = fresh(name, batch_id)
    name, upto = "recommendations", after["stock"]["batch"]
    if _is_due(before[name], upto, lags.get(name, 0), now):
        keys = tables.keys_between(spark, before[name]["batch"], upto)
        buckets = tables.buckets_between(spark, before[name]["batch"], upto)
        stock = with_keys(tables.stock_rows.read(spark, batch_id, buckets), keys, SERIES_KEY)
        advised = reorder_recommendations(stock.withColumn("last_updated", F.lit(None)))
        _replace(tables.recommendation_rows, advised, keys, batch_id, buckets)
        after[name] = {**fresh(name, upto), "newest": after["stock"]["newest"]}
    return after


def _carry(spark: SparkSession, tables: RefreshTables, batch_id: int) -> None:
    """Start a batch with the rows of the batch before, for the tables that it may not refresh."""
    for table in (tables.stock_rows, tables.usage_rows, tables.recommendation_rows, tables.names):
        table.carry(spark, batch_id)
    tables.note(spark, "totals", batch_id, tables.noted(spark, "totals", batch_id - 1))


def _names(stock: DataFrame, sign: int) -> DataFrame:
    """Number of series by organization and by item, times ``sign``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in _COUNTED]))
    named = stock.select(pairs.alias("p")).select("p.*").filter(F.col("name").isNotNull())
    return named.groupBy("kind", "name").agg((F.count(F.lit(1)) * sign).alias("n"))


def _per_kind(names: DataFrame) -> dict[str, int]:
    return {r["kind"]: r["count"] for r in names.groupBy("kind").count().collect()}  # two rows


def _count_stock(spark: SparkSession, tables: RefreshTables, batch_id: int, buckets: list[int]) -> None:
    """Change the summary's totals by what has changed in some buckets of the stock.

    Sums are kept by bucket, so those of the rewritten buckets are replaced. The distinct
    organizations and items are told by the number of series of each, which changes by
    the difference between the buckets as they are and as they were.
    """
    totals = tables.noted(spark, "totals", batch_id - 1)
    old, new = (tables.stock_rows.read(spark, n, buckets) for n in (batch_id - 1, batch_id))
    per_bucket = with_advice(new).groupBy(bucket_of(SERIES_KEY, tables.buckets).alias("bucket")).agg(*summary_sums())
    sums = totals.get("sums", {}) | {str(r["bucket"]): [r[c] for c in _SUMS] for r in per_bucket.collect()}

    moved = _names(new, 1).unionByName(_names(old, -1)).groupBy("kind", "name").agg(F.sum("n").alias("n"))
    moved = _save(moved.filter("n <> 0"), f"{tables.root}/moved")
    touched = moved.select(bucket_of(["kind", "name"], tables.buckets).alias("bucket")).distinct().collect()
    touched = sorted(r["bucket"] for r in touched)  # at most ``buckets``
    distinct = totals.get("distinct", dict.fromkeys(_COUNTED, 0))
    if touched:
        held = tables.names.read(spark, batch_id - 1, touched)
        counted = held.unionByName(moved).groupBy("kind", "name").agg(F.sum("n").alias("n")).filter("n > 0")
        was, now = _per_kind(held), _per_kind(tables.names.write(counted, batch_id, touched))
        distinct = {k: distinct[k] + now.get(k, 0) - was.get(k, 0) for k in _COUNTED}
    tables.note(spark, "totals", batch_id, {"sums": sums, "distinct": distinct})


def _logged(spark: SparkSession, tables: RefreshTables, batch_id: int, task: str, work: Callable[[], int]) -> tuple:
    """Run a task and return its run row; a failure is recorded, then raised, so the batch is replayed."""
    begun = time.time()
    try:
        rows = work()
        return run_row(task, begun, time.time(), rows)
    except Exception as failure:
        attempt = f"{batch_id}.failed-{uuid.uuid4().hex}"
        _save_runs(spark, tables, attempt, [run_row(task, begun, time.time(), 0, str(failure))])
        raise


def refresh(
    batch: DataFrame,
    batch_id: int,
    tables: RefreshTables,
    dedupe: str = "all",
    lags: dict[str, float] | None = None,
    now: float | None = None,
) -> None:
    """Take one batch of new ledger rows through all tables, in dependency order.

    The only state is the newest 30 rows of each series and the tables themselves; old
    ledger rows are not read again. ``lags`` are minutes by table, none by default;
    ``now`` is the time in seconds. The summary and the alerts follow the stock.
    """
    spark = batch.sparkSession

    def arrive() -> None:
        _arrive(batch, batch_id, tables)
        _carry(spark, tables, batch_id)

    _follow(spark, tables, batch_id, dedupe, lags or {}, time.time() if now is None else now, arrive)


def catch_up(
    spark: SparkSession,
    tables: RefreshTables,
    batch_id: int,
    dedupe: str = "all",
    lags: dict[str, float] | None = None,
    now: float | None = None,
) -> None:
    """Refresh the tables that are behind and due after ``batch_id``, the last batch.

    For times without new rows; without ``lags`` every table is brought up to date. Not to
    be run beside a batch.
    """
    _follow(spark, tables, batch_id, dedupe, lags or {}, time.time() if now is None else now)


def _follow(
    spark: SparkSession,
    tables: RefreshTables,
    batch_id: int,
    dedupe: str,
    lags: dict[str, float],
    now: float,
    arrive: Callable[[], None] | None = None,
) -> None:
    def summarize() -> int:
        if arrive:
            arrive()
        before = tables.freshness(spark, batch_id - 1 if arrive else batch_id)
        after = _refresh_due(spark, tables, batch_id, before, lags, now)
        tables.note(spark, "freshness", batch_id, after)
        _drop_touched(spark, tables, batch_id, before)
        day = tables.newest(spark, batch_id)
        if day is None or after["stock"] == before["stock"]:
            return 0
        as_of = datetime(day.year, day.month, day.day)
        _save(_summary_row(spark, tables, batch_id, as_of), tables.log("summaries", "summary_date", day, batch_id))
        changed = _stock_changed(spark, tables, batch_id, before["stock"]["batch"])
        state.update(changed=changed, day=day, as_of=as_of)
        return 1

    def alert() -> int:
        return _append_alerts(spark, tables, batch_id, state["day"], state["as_of"], dedupe)

    state: dict = {"changed": False}
    runs = [_logged(spark, tables, batch_id, "refresh_summary", summarize)]
    if "day" not in state:
        return
    if state["changed"]:
        runs.append(_logged(spark, tables, batch_id, "generate_alerts", alert))
    _save_runs(spark, tables, str(batch_id), runs)


def _drop_touched(spark: SparkSession, tables: RefreshTables, batch_id: int, before: dict[str, dict]) -> None:
    """Drop the notes of touched series that every table had taken before, so that a replay doesn't need them."""
    taken = min(held["batch"] for held in before.values())
    for folder in folders(spark, f"{tables.root}/touched"):
        if int(folder.split("=")[1]) <= min(taken, batch_id - 2):
            remove(spark, f"{tables.root}/touched/{folder}")


def _summary_row(spark: SparkSession, tables: RefreshTables, batch_id: int, as_of: datetime) -> DataFrame:
    """The summary from its totals, without its date; no stock is read."""
    totals = tables.noted(spark, "totals", batch_id)
    sums = [sum(column) for column in zip(*totals["sums"].values())] or [0, 0, 0.0]
    row = {"summary_id": batch_id, "summary_hour": as_of.hour, "created_at": as_of}
    row |= dict(zip(_SUMS, sums)) | {column: totals["distinct"][kind] for kind, column in _COUNTED.items()}
    schema = T.StructType([x for x in SUMMARY.fields if x.name != "summary_date"])
    return spark.createDataFrame([tuple(row[c] for c in schema.fieldNames())], schema)


def _stock_changed(spark: SparkSession, tables: RefreshTables, batch_id: int, after: int) -> bool:
    """Whether the stock of the series touched since the batch ``after`` differs from what it was."""
    touched, buckets = tables.keys_between(spark, after, batch_id), tables.buckets_between(spark, after, batch_id)
    old, new = (with_keys(tables.stock_rows.read(spark, n, buckets), touched, SERIES_KEY) for n in (batch_id - 1, batch_id))
    return not row_changes(old, new, SERIES_KEY).isEmpty()


def _append_alerts(
    spark: SparkSession, tables: RefreshTables, batch_id: int, day: date, as_of: datetime, dedupe: str
) -> int:
    # only the day's own folder can hold alerts that count as repeats
    same_day = _read(spark, f"{tables.root}/alerts/alert_date={day}", BATCHED_ALERTS)
    earlier = same_day.filter(F.col("batch_id") < batch_id).withColumn("alert_date", F.lit(day))
    fresh = new_alerts(tables.stock(spark, batch_id), None, earlier, as_of, dedupe)
    fresh = with_alert_ids(fresh, as_of).select(*ALERTS.fieldNames()).drop("alert_date")
    return _save(fresh, tables.log("alerts", "alert_date", day, batch_id)).count()


class _Refresher(StreamingQueryListener):
    """Runs the batches of one query, and between them catches up when it is idle."""

    def __init__(self, tables: RefreshTables, dedupe: str, lags: dict[str, float], clock: Callable[[], float]):
        self.tables, self.dedupe, self.lags, self.clock = tables, dedupe, lags, clock
        self.query_id: str | None = None
        self.last: tuple[SparkSession, int] | None = None
        self.busy = threading.Lock()

    def take(self, batch: DataFrame, batch_id: int) -> None:
        with self.busy:
            self.last = None  # a batch that fails leaves nothing to catch up with
            refresh(batch, batch_id, self.tables, self.dedupe, self.lags, self.clock())
            self.last = batch.sparkSession, batch_id

    def onQueryIdle(self, event) -> None:
        if str(event.id) == self.query_id and self.busy.acquire(blocking=False):
            try:
                if self.last:
                    catch_up(self.last[0], self.tables, self.last[1], self.dedupe, self.lags, self.clock())
            finally:
                self.busy.release()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def start_refresh(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    dedupe: str = "all",
    once: bool = False,
    minutes: float = V.REFRESH_MINUTES,
    buckets: int = BUCKETS,
    lags: dict[str, float] | None = None,
    clock: Callable[[], float] = time.time,
) -> StreamingQuery:
    """Start the refresh over a ledger stream.

    A trigger without new files runs no batch. ``once`` processes what is there
    and stops; otherwise a batch starts every ``minutes``. ``buckets`` is fixed for
    the life of the tables; take about one per core of the cluster.

    ``lags`` are minutes that tables may be behind: by default none with ``once``,
    otherwise ``TABLE_LAGS``, less half of ``minutes`` as triggers aren't quite regular. A
    query without new files catches up once a lag is over; after ``once`` with lags call
    :func:`catch_up`. ``clock`` gives the seconds.
    """
    if lags is None:
        lags = {} if once else {name: lag - minutes / 2 for name, lag in V.TABLE_LAGS.items()}
    refresher = _Refresher(RefreshTables(root, buckets), dedupe, lags, clock)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(refresher.take)
    if once:
        return writer.trigger(availableNow=True).start()
    stream.sparkSession.streams.addListener(refresher)
    query = writer.trigger(processingTime=f"{round(minutes * 60)} seconds").start()
    refresher.query_id = query.id
    return query


def last_batch(query: StreamingQuery) -> int:
    """Id of the last batch a query has finished, -1 if none."""
    progress = query.lastProgress
    return -1 if progress is None else progress["batchId"]


def recompute_series(ledger: DataFrame, changes: DataFrame, stock: DataFrame, as_of: datetime) -> DataFrame:
    """Stock table after history was restated: changed series anew, others as they were.

    ``changes`` may be any change result with the series key. Series whose rows
    are all gone disappear.
    """
    touched = changes.select(*SERIES_KEY)
    fresh = figures_of(latest_rows(with_keys(ledger, touched, SERIES_KEY), V.LONG_FRAME_ROWS))
    return without_keys(stock, touched, SERIES_KEY).unionByName(stock_from_tails(fresh, as_of))
