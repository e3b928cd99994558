from pyspark.sql import functions as F

from shelfwatch.operators import changes
from shelfwatch.operators.changes import change_feed, pending_changes, row_changes
from shelfwatch.schema import DAY_KEY, SERIES_KEY

OLD = [(0, "o", "l", "same", 0, 1, 5, 1), (0, "o", "l", "moved", 0, 1, 5, 1), (0, "o", None, "gone", 0, 1, 5, 1)]
NEW = [(0, "o", "l", "same", 0, 1, 5, 1), (0, "o", "l", "moved", 0, 1, 6, 1), (0, "o", None, "new", 0, 1, 5, 1)]


def test_row_changes(make_ledger):
    changes = row_changes(make_ledger(OLD), make_ledger(NEW), DAY_KEY)
    found = {r["item"]: (r["op"], r["old_closing_stock"], r["new_closing_stock"]) for r in changes.collect()}
    assert found == {"moved": ("UPDATE", 5, 6), "gone": ("DELETE", 5, None), "new": ("INSERT", None, 5)}
    assert pending_changes(changes).first()[0] == 3


def test_repeated_keys_pair_what_is_left(make_ledger):
    """Equal rows cancel; the others of a key are paired by number, never multiplied."""
    row = lambda closing: (0, "o", "l", "i", 0, 1, closing, 1)
    old, new = make_ledger([row(1), row(2), row(2), row(3)]), make_ledger([row(2), row(4), row(5), row(5), row(6)])
    found = sorted((r["op"], r["old_closing_stock"], r["new_closing_stock"]) for r in row_changes(old, new, DAY_KEY).collect() if r["op"] == "UPDATE")
    assert found == [("UPDATE", 1, 4), ("UPDATE", 2, 5), ("UPDATE", 3, 5)]
    assert row_changes(old, new, DAY_KEY).filter("op = 'INSERT'").first()["new_closing_stock"] == 6
    assert row_changes(old, old, DAY_KEY).isEmpty()


def test_no_change_gives_no_rows(make_ledger):
    assert row_changes(make_ledger(OLD), make_ledger(OLD), DAY_KEY).isEmpty()
    assert change_feed(make_ledger(OLD), make_ledger(OLD), DAY_KEY).isEmpty()


def test_change_feed_pairs_updates(make_ledger):
    feed = change_feed(make_ledger(OLD), make_ledger(NEW), DAY_KEY).collect()
    found = {(r["item"], r["action"], r["is_update"], r["rows"]) for r in feed}
    assert found == {
        ("moved", "DELETE", True, 1),
        ("moved", "INSERT", True, 1),
        ("gone", "DELETE", False, 1),
        ("new", "INSERT", False, 1),
    }


def test_change_feed_counts_repeated_rows(make_ledger):
    old = make_ledger([OLD[0]] * 5 + [OLD[1]])
    new = make_ledger([OLD[0]] * 2 + [OLD[1]] * 2)
    feed = change_feed(old, new, DAY_KEY).select("item", "action", "is_update", "rows").collect()
    assert sorted(map(tuple, feed)) == [("moved", "INSERT", False, 1), ("same", "DELETE", False, 3)]


def test_numbers_that_turn_null_are_updates(make_ledger):
    old = make_ledger([OLD[0]])
    new = old.withColumn("issued", F.lit(None).cast("long"))
    assert row_changes(old, new, DAY_KEY).first()["op"] == "UPDATE"
    assert change_feed(old, new, DAY_KEY).count() == 2


def test_only_changed_leaves_are_compared(spark, random_ledger, tmp_path):
    path = str(tmp_path / "ledger")
    random_ledger.withColumn("date", F.when(F.col("issued") != 7, F.col("date"))).write.parquet(path)
    old = spark.read.parquet(path)
    month = F.trunc("date", "month")
    touched = (F.col("item") == "Item 6") & (F.col("date") == old.filter("item = 'Item 6'").agg(F.max("date")).first()[0])
    new = old.withColumn("closing_stock", F.col("closing_stock") + F.when(touched, 5).otherwise(0)).unionByName(old.filter("item = 'Item 3'").limit(1))
    new = new.filter(~((F.col("item") == "Item 4") & F.col("date").isNull()))
    key = ["date", *SERIES_KEY]
    trees = [changes.hash_tree(rows, month, SERIES_KEY) for rows in (old, new)]
    leaves = changes.changed_leaves(*trees).collect()
    assert 2 <= len(leaves) <= 3 < trees[0].count()
    assert changes.changed_leaves(trees[0], trees[0]).count() == 0
    # the order of rows and their partitions do not matter, repeated rows do
    assert changes.changed_leaves(trees[0], changes.hash_tree(old.repartition(5), month, SERIES_KEY)).count() == 0
    assert changes.changed_leaves(trees[0], changes.hash_tree(old.unionByName(old), month, SERIES_KEY)).count() == trees[0].count()
    found = changes.changes_by_leaves(old, new, key, month, SERIES_KEY)
    same = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert same(found) == same(changes.change_feed(old, new, key)) and found.count() >= 3
    read = changes.rows_of_leaves(old, spark.createDataFrame(leaves), month, SERIES_KEY)
    assert read.count() < old.count() / 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2  # rows of other leaves end there, before any exchange of rows
