"""Continuous session counters from the action stream, kept as keyed state."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfwatch.functions.numeric import minute_boundaries
from shelfwatch.streaming.state import folders, remove

GAP = "30 minutes"
COMPACT = 32  # batches of changes that one base replaces
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
COUNTERS = {
    "items_reviewed": "ITEM_REVIEWED",
    "items_ordered": "ORDER_PLACED",
    "pdfs_exported": "PDF_EXPORTED",
    "data_uploads": "DATA_UPLOADED",
}
SESSIONS = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("user_name", T.StringType()),
        T.StructField("session_start", T.TimestampType()),
        T.StructField("last_activity", T.TimestampType()),
        T.StructField("session_end", T.TimestampType()),
        T.StructField("actions_count", T.LongType()),
    ]
    + [T.StructField(c, T.LongType()) for c in COUNTERS]
)
# A part of a visit as stored: the cell in which it begins, the gap, both in microseconds, and the batch that wrote it.
CELLS = T.StructType([*SESSIONS.fields, *[T.StructField(c, T.LongType()) for c in ("_cell", "_gap", "_batch")]])
TIMES = ["session_start", "last_activity", "session_end"]
COUNTS = ["actions_count", *COUNTERS]
# A visit: the same with times in microseconds, without the session.
VISIT = ["user_name", *TIMES, *COUNTS]
# How two visits that meet become one; nulls give way.
JOIN = {"user_name": "max", "session_start": "min", "last_activity": "max", "session_end": "max"} | dict.fromkeys(COUNTS, "sum")


def single_actions(actions: DataFrame, closing: str | None = None) -> DataFrame:
    """Every action with a time and a session as a visit of its own; one of type ``closing`` ends it."""
    at = F.unix_micros(F.col("action_timestamp").cast("timestamp"))
    kind = F.col("action_type")
    ends = F.when(kind == F.lit(closing), at)
    rows = actions.select(
        "session_id", "user_name", at.alias("session_start"), at.alias("last_activity"), ends.alias("session_end"),
        F.lit(1).cast("long").alias("actions_count"),
        *[F.coalesce((kind == name).cast("long"), F.lit(0)).alias(c) for c, name in COUNTERS.items()],
    )
    return rows.filter("session_start IS NOT NULL AND session_id IS NOT NULL")


def _cell(gap: Column) -> Column:
    """Start of the cell of time, ``gap`` wide, in which a visit begins; in microseconds, as the gap."""
    return F.col("session_start") - F.pmod("session_start", gap)


def combined(visits: DataFrame, gap: int) -> DataFrame:
    """(session_id, visit): the visits of a session that begin in one cell of time as one, a JSON array.

    Cells are as wide as the gap, so single actions of a cell always belong together and
    a busy session is few rows. On a stream this is the keyed state.
    """
    cells = visits.groupBy("session_id", _cell(F.lit(gap)).alias("_cell")).agg(*[F.expr(f"{how}({c})").alias(c) for c, how in JOIN.items()])
    user, numbers = F.to_json(F.array("user_name")), F.to_json(F.array(*TIMES, *COUNTS))
    return cells.select("session_id", F.concat(F.regexp_replace(user, r"\]$", ","), F.substr(numbers, F.lit(2))).alias("visit"))


def joined(cells: DataFrame) -> DataFrame:
    """Visits of single cells, at most one of a session and cell, that lie no more than the gap apart become one."""
    in_order = Window.partitionBy("session_id").orderBy("_cell")
    until = F.lag("last_activity").over(in_order)
    apart = until.isNull() | (F.unix_micros("session_start") > F.unix_micros(until) + F.col("_gap"))
    visits = cells.withColumn("_visit", apart.cast("long")).withColumn("_visit", F.sum("_visit").over(in_order))
    rows = visits.groupBy("session_id", "_visit").agg(*[F.expr(f"{how}({c})").alias(c) for c, how in JOIN.items()])
    return rows.select(*SESSIONS.fieldNames())


class SessionsTable:
    """Sessions below ``path``: a base and the changes of the batches after it.

    Rows are the parts of visits that begin in one cell of time (see ``combined``). A batch
    adds those that had actions in it, in a folder of its own that a replay replaces; after
    COMPACT batches a new base takes them in. Readers join the parts of a visit.
    """

    def __init__(self, path: str, gap: str = GAP):
        """``gap`` is that of the rows which are added; readers take it from the rows."""
        self.path, self.gap = path, micros(gap)

    def _numbers(self, spark: SparkSession, kind: str) -> list[int]:
        return sorted(int(f.split("=")[1]) for f in folders(spark, f"{self.path}/{kind}") if f.startswith("batch_id="))

    def _cells(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The rows after a batch: of each session and cell the newest."""
        bases = [n for n in self._numbers(spark, "base") if n <= batch_id]
        since = bases[-1] if bases else -1
        places = [f"{self.path}/changes/batch_id={n}" for n in self._numbers(spark, "changes") if since < n <= batch_id]
        places += [f"{self.path}/base/batch_id={since}"] if bases else []
        if not places:
            return spark.createDataFrame([], CELLS)
        newest = Window.partitionBy("session_id").orderBy("_cell", F.desc("_batch"))
        rows = spark.read.schema(CELLS).parquet(*places).withColumn("_before", F.lag("_cell").over(newest))
        return rows.filter("_before IS NULL OR _before <> _cell").drop("_before")

    def read(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The sessions after a batch."""
        return joined(self._cells(spark, batch_id))

    def add(self, changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        each = F.explode(F.from_json("visits", "array<array<string>>"))
        rows = changed.select("session_id", each.alias("v"))
        values = {c: F.col("v")[i] if c == "user_name" else F.col("v")[i].cast("long") for i, c in enumerate(VISIT)}
        rows = rows.select("session_id", *[v.alias(c) for c, v in values.items()])
        gap, batch = F.lit(self.gap).cast("long"), F.lit(batch_id).cast("long")
        rows = rows.withColumns({"_cell": _cell(gap), "_gap": gap, "_batch": batch})
        rows = rows.withColumns({c: F.timestamp_micros(F.col(c)) for c in TIMES}).select(*CELLS.fieldNames())
        rows.write.mode("overwrite").parquet(f"{self.path}/changes/batch_id={batch_id}")
        if (batch_id + 1) % COMPACT == 0:
            self._compact(spark, batch_id)

    def _compact(self, spark: SparkSession, batch_id: int) -> None:
        """Write a base; then the bases and changes that the base before it had taken in go."""
        older = [n for n in self._numbers(spark, "base") if n < batch_id]
        rows = self._cells(spark, batch_id).withColumn("_batch", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").parquet(f"{self.path}/base/batch_id={batch_id}")
        for kind in ("base", "changes"):
            for n in self._numbers(spark, kind):
                if older and (n < older[-1] or n == older[-1] and kind == "changes"):
                    remove(spark, f"{self.path}/{kind}/batch_id={n}")


def micros(gap: str) -> int:
    """An interval such as ``30 minutes`` in microseconds."""
    number, unit = gap.split()
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.removesuffix("s")]
    return int(number) * seconds * 1_000_000


def open_sessions(sessions: DataFrame, as_of: Column, gap: str = GAP) -> DataFrame:
    """Sessions with ``is_open``: whether an action at ``as_of`` would still belong to them."""
    return sessions.withColumn("is_open", F.col("last_activity") + F.expr(f"INTERVAL {gap}") >= as_of)


def closed_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions that a closing action ended, with their length in minutes."""
    minutes = minute_boundaries(F.col("session_start"), F.col("session_end"))
    ended = sessions.filter("session_end IS NOT NULL").withColumn("is_active", F.lit(False))
    return ended.withColumn("session_duration_minutes", minutes)


def start_sessions(
    actions: DataFrame, path: str, checkpoint: str, once: bool = False, gap: str = GAP, closing: str | None = None
) -> StreamingQuery:
    """Keep the sessions of an action stream below ``path``; read them with ``SessionsTable``.

    Sessions of one id are split where nothing happens for longer than ``gap``. An action
    counts whenever it arrives: one that is late may open a session in the past, lengthen
    one or join two. Actions without a time or session have none. An action of type
    ``closing`` ends its session; the newest one counts. State is an aggregation by session
    and cell of time in RocksDB with a changelog: a batch reads and writes only the cells
    that it has actions in. The session's number of shuffle partitions at the first start is that of the state for
    good.
    """
    spark, table = actions.sparkSession, SessionsTable(path, gap)
    cells = combined(single_actions(actions, closing), micros(gap))
    changed = cells.select("session_id", F.concat(F.lit("["), "visit", F.lit("]")).alias("visits"))
    writer = changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(table.add)
    before = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    try:  # the query takes its settings as it starts
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
