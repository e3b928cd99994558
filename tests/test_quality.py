import random

import pytest

from shelfwatch.operators import quality
from shelfwatch.schema import LEDGER_COLUMNS
from shelfwatch.sources import ledger as files

HEADER = " Date ,ORGANIZATION,location,Item,opening_stock,received,issued,closing_stock,Lead_Time_Days"
GOOD = '2024-01-01,City,ER,"Kit (Soap, Paste)",10,5,3,12,7'
BAD = [
    "2024-13-01,City,ER,bad date,10,5,3,12,7",
    "2024-01-02,City,ER,text,abc,5,3,12,7",
    "2024-01-02,City,ER,suffix,10d,5,3,12,7",
    "2024-01-02,City,ER,negative,10,5,-1,16,7",
    "2024-01-02,,ER,no name,10,5,3,12,7",
    "2024-01-02,City,ER,no number,10,5,,12,7",
    "2024-01-02,City,ER,short line,10",
]
ODD = [
    ",City,ER,no date,10,5,3,12,7",
    "2024-01-02,City,ER,fraction,10.7,5,3,12.7,7",
    "2024-01-02,City,ER,mismatch,10,5,3,99,7",
    "2024-01-02,City, ,blank place,10,5,3,12,7",
]


@pytest.fixture
def upload(tmp_path):
    def write(lines, header=HEADER, name="upload.csv"):
        path = tmp_path / name
        path.write_text("\n".join([header, *lines]) + "\n", encoding="utf-8")
        return str(path)

    return write


def problems(report):
    return {(r["rule"], r["column"]): r["count"] for r in report.findings.collect()}


def test_clean_file_loads(spark, upload, tmp_path):
    path = str(tmp_path / "table")
    result = files.load_ledger_csv(spark, upload([GOOD]), path)
    assert result.loaded and result.findings.isEmpty()
    row = files.read_ledger(spark, path).first()
    assert row["item"] == "Kit (Soap, Paste)" and row["closing_stock"] == 12


def test_every_rule_counts(spark, upload):
    report = quality.check_ledger(files.read_ledger_csv(spark, upload([GOOD, *BAD, *ODD])))
    found = problems(report)
    assert found[("bad_date", "date")] == 1
    assert found[("empty_date", "date")] == 1
    assert found[("not_numeric", "opening_stock")] == 2
    assert found[("not_numeric", "issued")] == 2
    assert found[("negative", "issued")] == 1
    assert found[("empty_name", "organization")] == 1
    assert ("empty_name", "location") not in found
    assert found[("fraction", "opening_stock")] == 1
    assert found[("bad_line", "_corrupt_record")] == 1
    # the mismatch itself, and every row with an unknown number
    assert found[("closing_mismatch", "closing_stock")] == 1 + 4
    assert report.valid.count() == 1 + len(ODD) and report.rejected.count() == len(BAD)


def test_errors_stop_a_load(spark, upload, tmp_path):
    path = str(tmp_path / "table")
    assert files.load_ledger_csv(spark, upload([GOOD]), path).loaded
    assert not files.load_ledger_csv(spark, upload([GOOD, *BAD], name="b.csv"), path).loaded
    assert files.read_ledger(spark, path).count() == 1


def test_continue_loads_valid_rows_and_keeps_the_rest(spark, upload, tmp_path):
    path, aside = str(tmp_path / "table"), str(tmp_path / "quarantine")
    result = files.load_ledger_csv(spark, upload([GOOD, *BAD, *ODD]), path, aside, on_error="continue")
    loaded = {r["item"]: r for r in files.read_ledger(spark, path).collect()}
    assert result.loaded and len(loaded) == 5
    assert (loaded["fraction"]["opening_stock"], loaded["fraction"]["closing_stock"]) == (10, 12)
    assert loaded["no date"]["date"] is None
    assert spark.read.parquet(aside).count() == len(BAD) == result.rejected.count()


def test_rejected_rows_are_always_kept(spark, upload, tmp_path):
    path = str(tmp_path / "table")
    result = files.load_ledger_csv(spark, upload([GOOD, *BAD]), path, on_error="continue")
    assert result.rejected_path == f"{path}-rejected" and spark.read.parquet(result.rejected_path).count() == len(BAD)


def test_line_breaks_inside_quotes(spark, upload):
    path = upload(['2024-01-01,City,ER,"two\nlines",10,5,3,12,7', GOOD])
    report = quality.check_ledger(files.read_ledger_csv(spark, path, line_breaks=True))
    assert {r["item"] for r in report.valid.collect()} == {"two\nlines", "Kit (Soap, Paste)"}


def test_missing_columns_and_empty_files_stop(spark, upload):
    with pytest.raises(quality.LedgerFormatError, match="received, lead_time_days"):
        quality.check_ledger(files.read_ledger_csv(spark, upload(["a"], "date,organization,location,item,opening_stock,issued,closing_stock")))
    with pytest.raises(quality.LedgerFormatError, match="no rows"):
        quality.check_ledger(files.read_ledger_csv(spark, upload([], name="e.csv")))


def test_normalized_names(spark, upload):
    assert files.read_ledger_csv(spark, upload([GOOD])).columns[:9] == LEDGER_COLUMNS


def test_negative_closing(make_ledger):
    ledger = make_ledger([(0, "o", "l", "i", 0, 1, c, 1) for c in (-1, 0, -5)])
    assert quality.negative_closing(ledger).first()[0] == 2


def test_compare_results(spark):
    inf = float("inf")
    schema = "k string, v double"
    a = spark.createDataFrame([("same", 1.0), ("near", 2.0), ("far", 3.0), ("nulls", None), ("half", None), ("inf", inf), ("one", inf), ("left", 1.0)], schema)
    b = spark.createDataFrame([("same", 1.0), ("near", 2.01), ("far", 3.02), ("nulls", None), ("half", 1.0), ("inf", inf), ("one", 9.0)], schema)
    # 2.01 - 2.0 is a little under the tolerance in binary
    row = quality.compare_results(a, b, ["k"], ["v"], tolerance=0.0101).first()
    assert (row["matching"], row["mismatching"]) == (4, 4)


def most_pairs(left, right, tolerance):
    """Size of a largest matching, by trying all partners (augmenting paths)."""
    partner = {}

    def found(i, seen):
        for j, y in enumerate(right):
            if j not in seen and abs(left[i] - y) <= tolerance:
                seen.add(j)
                if j not in partner or found(partner[j], seen):
                    partner[j] = i
                    return True
        return False

    return sum(found(i, set()) for i in range(len(left)))


def test_repeated_keys_are_matched_as_bags(spark):
    rng = random.Random(11)
    schema, tolerance, expected, a, b = "k string, v double", 0.25, [0, 0], [], []
    for k in range(40):
        values = [float("inf"), None, None] + [x / 8 for x in range(rng.choice([3, 12, 30]))]
        left, right = ([rng.choice(values) for _ in range(rng.randrange(9))] for _ in range(2))
        rows = max(len(left), len(right))
        filled = [side + [None] * (rows - len(side)) for side in (left, right)]
        plain = [[v for v in side if v is not None and v != float("inf")] for side in filled]
        hits = most_pairs(*plain, tolerance) + sum(min(filled[0].count(x), filled[1].count(x)) for x in (None, float("inf")))
        expected = [expected[0] + hits, expected[1] + rows - hits]
        name = None if k == 7 else f"k{k}"
        a += [(name, v) for v in left]
        b += [(name, v) for v in right]
    row = quality.compare_results(*(spark.createDataFrame(x, schema) for x in (a, b)), ["k"], ["v"], tolerance).first()
    assert [row["matching"], row["mismatching"]] == expected
    none = spark.createDataFrame([], schema)
    assert [tuple(r) for r in quality.compare_results(none, none, ["k"], ["v"]).collect()] == [("v", 0, 0)]


def test_a_load_reads_its_upload_once(spark, monkeypatch):
    rows = spark.createDataFrame([("2024-01-01", "o", "l", "i", "1", "2", "1", "2", "5"), ("x", "o", "l", "i", "1", "a", "-1", "2", "5")], LEDGER_COLUMNS)
    writes = []
    real = quality.staged
    monkeypatch.setattr(quality, "staged", lambda df, label: writes.append(label) or real(df, label))
    report = quality.check_ledger(rows)
    assert writes == ["judged"]
    # counts come from that write: the findings are rows, not a plan over the upload
    plan = report.findings._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Aggregate" not in plan
    assert sorted(map(tuple, report.findings.collect())) == sorted(map(tuple, quality.find_problems(rows).collect()))
    assert (report.valid.count(), report.rejected.count()) == (1, 1)


def test_shape_of_an_upload(spark):
    full = spark.createDataFrame([], ", ".join(f"{c} string" for c in LEDGER_COLUMNS))
    assert [tuple(r) for r in quality.shape_problems(full).collect()] == [("no_rows", "error", "", 1)]
    short = full.drop("issued", "item").withColumnRenamed("date", " DATE ")
    assert sorted(r["column"] for r in quality.shape_problems(short).collect()) == ["issued", "item"]
