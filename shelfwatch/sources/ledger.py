"""Ledger sources and sinks: tables, headered CSV, full load."""

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from shelfwatch.operators.quality import CORRUPT, LedgerReport, check_ledger
from shelfwatch.schema import LEDGER, LEDGER_COLUMNS, QUANTITIES, SERIES_KEY
from shelfwatch.staging import file_system, read_text, staged, write_text

CURRENT = "current.txt"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Typed ledger from a folder that :func:`write_ledger` made, or from plain Parquet files."""
    version = _current(spark, path)
    return spark.read.schema(LEDGER).parquet(f"{path}/{version}" if version else path).select(*LEDGER_COLUMNS)


def _current(spark: SparkSession, path: str) -> str | None:
    """Name of the version that a ledger folder points to."""
    return read_text(spark, f"{path}/{CURRENT}")


def ledger_table(spark: SparkSession, name: str) -> DataFrame:
    """Typed ledger from a catalog table."""
    return spark.table(name).select(*LEDGER_COLUMNS)


def normalize_names(df: DataFrame) -> DataFrame:
    """Column names lowercased and without outer blanks."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def read_ledger_csv(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """All cells of headered CSV files as text, under normalized names.

    Empty cells are NULL. A line with too few or too many cells keeps its text in
    ``_corrupt_record``. The header of the first file names the columns; a file
    with another header stops the read. ``line_breaks`` allows line breaks inside
    quotes; such files cannot be split, so each is read by one task.
    """
    options = {"header": True, "escape": '"', "encoding": "UTF-8", "multiLine": line_breaks}
    names = spark.read.options(**options).csv(path).columns
    cells = T.StructType([T.StructField(n, T.StringType()) for n in names + [CORRUPT]])
    raw = (
        spark.read.options(**options)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False)
        .option("enforceSchema", False)
        .schema(cells)
        .csv(path)
    )
    return normalize_names(raw)


def to_ledger(raw: DataFrame) -> DataFrame:
    """Checked text rows as a typed ledger; fractions are cut off like ``int()``."""
    quantities = [F.expr(f"try_cast(try_cast(`{c}` AS DOUBLE) AS BIGINT)").alias(c) for c in QUANTITIES]
    day = F.expr("try_cast(`date` AS DATE)").alias("date")
    return raw.select(day, *SERIES_KEY, *quantities)


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Replace the whole ledger table, partitioned by month and clustered by date.

    The rows go to a new version folder, and then one small file is replaced to point to
    it. Until then readers see the old version, also if the job fails; afterwards
    versions before the last two are deleted.
    """
    spark = ledger.sparkSession
    before = _current(spark, path)
    version = f"version-{uuid.uuid4().hex}"
    rows = ledger.select(*LEDGER_COLUMNS).withColumn("month", F.date_format("date", "yyyy-MM"))
    rows.repartitionByRange(*LEDGER_COLUMNS).sortWithinPartitions("date", *SERIES_KEY).write.partitionBy("month").parquet(
        f"{path}/{version}"
    )
    write_text(spark, f"{path}/{CURRENT}", version)
    system, place = file_system(spark, path)
    for status in system.listStatus(place):
        name = status.getPath().getName()
        if name.startswith("version-") and name not in (version, before):
            system.delete(status.getPath(), True)


@dataclass
class LoadResult:
    """Outcome of a CSV load: the rule findings, whether rows were written, and the rejected rows."""

    findings: DataFrame
    loaded: bool
    rejected: DataFrame
    rejected_path: str | None = None


def load_ledger_csv(
    spark: SparkSession,
    csv_path: str,
    table_path: str,
    quarantine_path: str | None = None,
    on_error: str = "stop",
    line_breaks: bool = False,
) -> LoadResult:
    """Check CSV files and replace the ledger with their rows.

    ``on_error="stop"`` writes nothing if any row breaks a rule. ``"continue"``
    loads the valid rows and writes the others to ``quarantine_path``, by default
    ``<table_path>-rejected``.
    """
    if on_error not in ("stop", "continue"):
        raise ValueError(f"unknown on_error {on_error!r}")
    # the text is parsed once; checking and loading read the staged columns
    report: LedgerReport = check_ledger(read_ledger_csv(spark, csv_path, line_breaks))
    findings = staged(report.findings, "findings")
    if on_error == "stop" and not findings.filter(F.col("severity") == "error").isEmpty():
        return LoadResult(findings, False, report.rejected)
    if on_error == "continue":
        quarantine_path = quarantine_path or f"{table_path}-rejected"
        report.rejected.write.mode("overwrite").parquet(quarantine_path)
    write_ledger(to_ledger(report.valid), table_path)
    return LoadResult(findings, True, report.rejected, quarantine_path)
