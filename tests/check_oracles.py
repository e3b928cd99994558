"""Run registered queries next to their SQL and print every difference.

Usage: python tests/check_oracles.py [table folder] [query ...]
"""

import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = """region nation customer supplier part orders lineitem events
documents embeddings pages benchmark labels conversations""".split()


def session(name: str = "check") -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="oracles-"))
        .getOrCreate()
    )


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db


def compare(spark: SparkSession, db, folder: str, name: str) -> tuple[int, list[str]]:
    """Row count and the differences between query and SQL; values compare exactly."""
    result = queries()[name](spark, folder)
    columns = sorted(result.columns)
    mine = [tuple(r) for r in result.select(*[f"`{c}`" for c in columns]).collect()]
    cursor = db.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return len(mine), [f"columns {columns} vs {sorted(names)}"]
    order = [names.index(c) for c in columns]
    theirs = [tuple(row[i] for i in order) for row in cursor.fetchall()]
    mine.sort(key=repr)
    theirs.sort(key=repr)
    if mine == theirs:
        return len(mine), []
    problems = [f"rows {len(mine)} vs {len(theirs)}"]
    only_mine, only_theirs = set(mine) - set(theirs), set(theirs) - set(mine)
    problems += [f"columns {columns}"]
    problems += [f"spark {row}" for row in sorted(only_mine, key=repr)[:3]]
    problems += [f"sql   {row}" for row in sorted(only_theirs, key=repr)[:3]]
    return len(mine), problems


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(oracle_sql())
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    failed = []
    for name in chosen:
        begun = time.time()
        try:
            rows, problems = compare(spark, db, folder, name)
        except Exception as error:
            rows, problems = -1, [f"{type(error).__name__}: {str(error)[:600]}"]
        print(f"{name:16} {rows:8} {time.time() - begun:6.2f}s {'ok' if not problems else 'DIFFERENT'}", flush=True)
        for p in problems:
            print("    ", p)
        if problems:
            failed.append(name)
    print("failed:", failed)
    sys.exit(bool(failed))
