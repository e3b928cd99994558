import json

import pytest
from pyspark.sql import functions as F

from shelfwatch import fixed_values as V
from shelfwatch.sources import ledger as files
from shelfwatch.sources import profiles, rules

RULE_FILE = {
    "location_rules": [{"pattern": "ICU", "score": 11, "description": "x"}, {"pattern": "Far", "score": 15, "description": ""}],
    "item_rules": [{"items": ["A", "B"], "score": 6, "description": "y"}],
    "default_score": 2,
}


def test_rules_from_json(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(RULE_FILE, indent=2))
    loaded = rules.load_rules(spark, str(path))
    assert loaded["default_score"] == 2 and loaded["rejected"] == []
    assert sorted(r["items"] for r in loaded["item_rules"]) == [["A"], ["B"]]
    rows = {tuple(r) for r in rules.read_rule_rows(spark, str(path)).collect()}
    assert rows == {("location", "ICU", 11), ("location", "Far", 15), ("item", "A", 6), ("item", "B", 6)}


def test_unreadable_rules_fall_back(spark, tmp_path):
    broken = tmp_path / "broken.json"
    broken.write_text("{not json")
    with pytest.warns(UserWarning, match="no usable default"):
        assert rules.load_rules(spark, str(broken)) == V.FALLBACK_RULES
    with pytest.warns(UserWarning, match="cannot be read"):
        assert rules.load_rules(spark, str(tmp_path / "absent.json")) == V.FALLBACK_RULES
    assert rules.load_rules(spark, None)["default_score"] == 3


def test_scores_out_of_bounds(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({**RULE_FILE, "location_rules": [{"pattern": "p", "score": 16}, {"pattern": "q", "score": 15}]}))
    # both readers leave the rule out and tell of it
    with pytest.warns(UserWarning, match="out of bounds"):
        loaded = rules.load_rules(spark, str(path))
    assert loaded["rejected"] == [{"kind": "location", "value": "p", "score": 16}]
    assert [r["pattern"] for r in loaded["location_rules"]] == ["q"]
    assert [r["value"] for r in rules.read_rule_rows(spark, str(path)).filter("kind = 'location'").collect()] == ["q"]
    assert [tuple(r) for r in rules.rejected_rules(rules.read_rule_file(spark, str(path))).collect()] == [("location", "p", 16)]


def test_rules_of_several_files_are_joined(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RULE_FILE))
    (tmp_path / "b.json").write_text(json.dumps({"item_rules": [{"items": ["Z"], "score": 4}]}))
    assert {r["items"][0] for r in rules.load_rules(spark, str(tmp_path))["item_rules"]} == {"A", "B", "Z"}


def test_full_load_replaces_the_table(spark, make_ledger, tmp_path):
    path = str(tmp_path / "ledger")
    files.write_ledger(make_ledger([(d, "o", "l", "i", 0, 1, 5, 1) for d in range(5)]), path)
    files.write_ledger(make_ledger([(0, "o", "l", "i", 0, 1, 9, 1)]), path)
    assert [r["closing_stock"] for r in files.read_ledger(spark, path).collect()] == [9]
    files.write_ledger(make_ledger([(40, "o", "l", "i", 0, 1, 7, 1)]), path)
    files.write_ledger(make_ledger([(0, "o", "l", "i", 0, 1, 9, 1), (40, "o", "l", "i", 0, 1, 9, 1)]), path)
    kept = files.read_ledger(spark, path)
    assert kept.count() == 2 and len({f.split("/")[-2] for f in kept.inputFiles()}) == 2  # a folder per month
    files.read_ledger(spark, path).filter("date = '2024-01-01'").write.saveAsTable("stored_ledger")
    assert files.ledger_table(spark, "stored_ledger").count() == 1


def test_a_failing_load_leaves_the_old_ledger(spark, make_ledger, tmp_path):
    path = str(tmp_path / "ledger")
    files.write_ledger(make_ledger([(0, "o", "l", "i", 0, 1, 9, 1)]), path)
    broken = make_ledger([(0, "o", "l", "i", 0, 1, 5, 1)]).withColumn("issued", F.expr("CAST(raise_error('lost') AS BIGINT)"))
    with pytest.raises(Exception, match="lost"):
        files.write_ledger(broken, path)
    assert [r["closing_stock"] for r in files.read_ledger(spark, path).collect()] == [9]


def test_profiles(spark, make_ledger, tmp_path):
    path = str(tmp_path / "profiles")
    schema = "organization string, sector string, region string, goods_type string, contact_email string"
    first = [("A", "NGO", "North", "Food", None), ("B", "", "x", "y", None), ("C", "Club", "x", "y", None), ("D", "NGO", None, "y", "m")]
    rejected = profiles.append_profiles(spark.createDataFrame(first, schema), path, F.lit("2024-01-01 00:00:00"))
    assert {r["organization"]: r["reason"] for r in rejected.collect()} == {"B": "no sector", "C": "unknown sector", "D": "no region"}
    profiles.append_profiles(spark.createDataFrame([("A", "Private", "North", "Food", "a@b")], schema), path, F.lit("2024-02-01 00:00:00"))
    saved = spark.read.parquet(path)
    assert sorted(r["sector"] for r in saved.collect()) == ["NGO", "Private"]
    ledger = make_ledger([(0, "A", "l", "i", 0, 1, 5, 1), (0, "Z", "l", "i", 0, 1, 5, 1)])
    found = {r["organization"]: r["sector"] for r in profiles.with_profile(ledger, saved).collect()}
    assert found == {"A": "Private", "Z": None}
