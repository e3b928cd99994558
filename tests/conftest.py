import sys
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfwatch.schema import LEDGER  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    home = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(home / "shared"))
        .config("spark.sql.warehouse.dir", str(home / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DAY = date(2024, 1, 1)


@pytest.fixture
def make_ledger(spark):
    """Build a ledger from (day, org, location, item, received, issued, closing, lead)."""

    def build(rows):
        full = [
            (DAY + timedelta(days=d), o, l, i, c - r + u, r, u, c, lead)
            for d, o, l, i, r, u, c, lead in rows
        ]
        return spark.createDataFrame(full, LEDGER)

    return build


@pytest.fixture
def series(make_ledger):
    """One series from its issued values; closing stock and lead time are fixed."""

    def build(issued, closing=50, lead=7, name=("Org", "Main", "Rice")):
        return make_ledger([(d, *name, 0, u, closing, lead) for d, u in enumerate(issued)])

    return build


@pytest.fixture
def random_ledger(make_ledger):
    """Several series of uneven length, with gaps, repeated days and zero usage."""
    import random

    rng = random.Random(5)
    rows = []
    for s in range(7):
        name = (f"Org {s % 3}", f"Site {s % 2}" if s != 4 else None, f"Item {s}")
        day = 0
        for _ in range([1, 2, 7, 8, 31, 90, 400][s]):
            day += rng.choice([0, 1, 1, 1, 30])
            issued = 0 if s == 3 else rng.randint(0, 20)
            rows.append((day, *name, rng.randint(0, 9), issued, rng.randint(0, 60), 3 + s))
    return make_ledger(rows)
