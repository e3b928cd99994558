"""Retention of summaries, alerts and run rows."""

import json
import uuid
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from shelfwatch import fixed_values as V
from shelfwatch.plans.oplog import run_logged
from shelfwatch.staging import read_text, staged, write_text
from shelfwatch.streaming.state import folders, remove

# Table kind -> (time column, days kept)
RETENTION = {
    "summaries": ("summary_date", V.KEEP_SUMMARIES_DAYS),
    "alerts": ("alert_date", V.KEEP_ALERTS_DAYS),
    "runs": ("execution_time", V.KEEP_RUNS_DAYS),
}
CLEANUP = "daily_cleanup"
# Table kind -> partition column that holds the day
DAY_FOLDERS = {"summaries": "summary_date", "alerts": "alert_date", "runs": "day"}


def _old(column: str, days: int, as_of: Column) -> Column:
    """Whether a row is past its days; an unknown time never is."""
    return F.coalesce(F.col(column) < as_of - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))


def retain(df: DataFrame, column: str, days: int, as_of: Column) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``; rows without a time stay."""
    return df.filter(~_old(column, days, as_of))


def expired_count(df: DataFrame, column: str, days: int, as_of: Column) -> DataFrame:
    """Number of rows that :func:`retain` drops, as one row."""
    return df.agg(F.count_if(_old(column, days, as_of)).alias("expired"))


def expired_by_kind(df: DataFrame, column: str, as_of: Column) -> DataFrame:
    """Rows past the days of each table kind, counted in one pass."""
    counts = [F.count_if(_old(column, days, as_of)).alias(kind) for kind, (_, days) in RETENTION.items()]
    cells = [F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("expired")) for kind in RETENTION]
    return df.agg(*counts).select(F.inline(F.array(*cells)))


def _day_of(folder: str) -> date | None:
    """Day of a ``column=value`` folder; None for the folder of unknown days."""
    try:
        return date.fromisoformat(folder.split("=", 1)[1])
    except (IndexError, ValueError):
        return None


def _levels(spark: SparkSession, place: str) -> list[str]:
    """Names of the partition columns below a folder, outermost first."""
    names: list[str] = []
    while found := [f for f in folders(spark, place) if "=" in f]:
        names.append(found[0].split("=", 1)[0])
        place = f"{place}/{found[0]}"
    return names


# Below a table, hidden from its readers: rows that are to replace partitions, and a note that they are complete.
_WORK = "_retention"
_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def _replace_partitions(spark: SparkSession, path: str, kept: str, columns: list[str]) -> None:
    """Overwrite the partitions that the rows in ``kept`` have, and no others."""
    spark.read.parquet(kept).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def finish_replacing(spark: SparkSession, path: str) -> bool:
    """Do again what a run that was killed had begun to replace; True if there was something.

    Such a run has left a note and all rows that stay; replacing once more gives the same.
    """
    note = read_text(spark, f"{path}/{_WORK}/note.json")
    try:
        found = json.loads(note or "")
    except ValueError:  # no note, or killed while writing it, before anything was replaced
        found = None
    if found:
        _replace_partitions(spark, path, f"{path}/{_WORK}/{found['kept']}", found["columns"])
    remove(spark, f"{path}/{_WORK}")
    return found is not None


def _expire_edge(spark: SparkSession, path: str, schema: T.StructType, column: str, day_column: str, name: str, limit: datetime) -> int:
    """Take the expired rows out of the folder of the limit's own day and return how many there were."""
    inner = _levels(spark, f"{path}/{name}")
    wide = T.StructType([f for f in schema.fields if f.name not in (day_column, *inner)])
    for level in inner:
        wide = wide.add(level, T.StringType())
    rows = spark.read.schema(wide).parquet(f"{path}/{name}")
    late = F.coalesce(F.col(column) < F.lit(limit), F.lit(False))
    # per partition of this one day: how many rows go and how many stay
    counts = rows.groupBy(*inner).agg(F.count_if(late).alias("_old"), F.count_if(~late).alias("_kept")).collect()
    mixed = [r for r in counts if r["_old"] and r["_kept"]]
    if mixed:
        kept = f"kept-{uuid.uuid4().hex}"
        stay = rows.filter(~late)
        for level in inner:
            stay = stay.filter(F.col(level).isin([r[level] for r in mixed]))
        # all rows of a partition that is replaced are there; a level's value may bring others along
        stay = stay.withColumn(day_column, F.lit(name.split("=", 1)[1]))
        columns = [day_column, *inner]
        stay.write.parquet(f"{path}/{_WORK}/{kept}")
        write_text(spark, f"{path}/{_WORK}/note.json", json.dumps({"kept": kept, "columns": columns}))
        finish_replacing(spark, path)
    for r in counts:
        if r["_old"] and not r["_kept"]:
            remove(spark, "/".join([f"{path}/{name}", *[f"{level}={r[level]}" for level in inner]]))
    return sum(r["_old"] for r in counts)


def expire_folder(
    spark: SparkSession, path: str, schema: T.StructType, column: str, day_column: str, days: int, as_of: datetime
) -> int:
    """Delete the expired rows of a table of day folders and return how many there were.

    ``path`` holds folders ``day_column=<day>``, with any partition folders below.
    Folders of days wholly past the limit are removed; of them only the rows are counted.
    In the folder of the limit's own day the partitions that hold expired and other rows
    are replaced by dynamic overwrite: the rows that stay are stored first and noted, so
    a run that is killed at any step loses none, and the next run ends its work. Rows
    without a day stay. Only expired days are read.
    """
    finish_replacing(spark, path)
    limit = as_of - timedelta(days=days)
    named = [(d, name) for name in folders(spark, path) if (d := _day_of(name)) is not None]
    past = [name for d, name in named if d < limit.date()]
    expired = 0
    if past:
        held = spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{name}" for name in past])
        expired += held.count()
        for name in past:
            remove(spark, f"{path}/{name}")
    by_time = {f.name: f.dataType for f in schema.fields}.get(column) == T.TimestampType()
    for name in [name for d, name in named if d == limit.date() and by_time]:
        expired += _expire_edge(spark, path, schema, column, day_column, name, limit)
    return expired


def expire_tables(spark: SparkSession, root: str, schemas: dict[str, T.StructType], as_of: datetime) -> dict[str, int]:
    """Apply the retention of every kind to the tables of a refresh below ``root``: kind -> rows deleted.

    The clean-up leaves a run row of its own in the run table, with the rows of all kinds.
    """
    deleted: dict[str, int] = {}

    def work() -> int:
        for kind, (column, days) in RETENTION.items():
            deleted[kind] = expire_folder(spark, f"{root}/{kind}", schemas[kind], column, DAY_FOLDERS[kind], days, as_of)
        return sum(deleted.values())

    run_logged(spark, CLEANUP, work, f"{root}/runs", raising=True)
    return deleted


def expire_table(
    spark: SparkSession,
    table: str,
    column: str,
    days: int,
    as_of: datetime,
    partition: str | None = None,
) -> int:
    """Delete a catalog table's expired rows and return how many there were.

    The table's first partition column is the day of ``column`` (``column`` itself when
    that is a date); further ones are fine. Partitions of whole expired days are dropped
    in one statement without reading their columns; those of the limit's day that also
    hold other rows are overwritten by these in one dynamic insert. Only expired
    partitions reach the driver. Rows without a day stay.
    """
    partition = partition or column
    limit = as_of - timedelta(days=days)
    first_day: date = limit.date()
    rows = spark.table(table)
    bound = F.lit(first_day) if dict(rows.dtypes)[column] == "date" else F.lit(limit)
    old = F.coalesce(F.col(column) < bound, F.lit(False))
    levels = _partition_columns(spark, table)
    due = rows.filter(F.col(partition) <= F.lit(first_day))
    counts = due.groupBy(*levels).agg(F.count_if(old).alias("_old"), F.count_if(~old).alias("_kept"))
    counts = counts.filter("_old > 0").collect()
    if not counts:
        return 0
    mixed = [r for r in counts if r["_kept"]]
    if mixed:
        edge = rows.filter((F.col(partition) == F.lit(first_day)) & ~old)
        for level in levels[1:]:
            held = [r[level] for r in mixed]
            among = F.col(level).isin([v for v in held if v is not None])
            edge = edge.filter(among | F.col(level).isNull() if None in held else among)
        kept = staged(edge.select(*rows.columns), "retained")
        # an insert heeds the session's mode, not an option of the writer
        before = spark.conf.get(_OVERWRITE)
        spark.conf.set(_OVERWRITE, "dynamic")
        try:
            kept.write.insertInto(table, overwrite=True)
        finally:
            spark.conf.set(_OVERWRITE, before)
    whole = [r for r in counts if not r["_kept"]]
    if whole:
        parts = ", ".join("PARTITION (" + ", ".join(_literal(c, r[c]) for c in levels) + ")" for r in whole)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {parts}")
    return sum(r["_old"] for r in counts)


def _literal(name: str, value: object) -> str:
    """One level of a partition as SQL."""
    return f"`{name}`=NULL" if value is None else f"`{name}`='{value}'"


def _partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
