"""Exact dedup of incoming batches against immutable snapshots.

A snapshot holds one row per distinct normalised text (digest, smallest doc_id,
number of rows) and, per digest bucket, a static binary-fuse filter. The texts of
an incoming batch are grouped by digest among themselves; one digest per group is
screened by the filter of its bucket, and only positives are joined with the exact
buckets and compared byte by byte. A digest whose texts differ stays two groups.

Nothing but digests is shuffled, apart from the texts of one row per side for each
positive. Buckets hold distinct digests only, so copies never meet in one task,
and their number follows the number of digests.

Defined results: a null text counts as empty, and empty texts are equal; rows that
repeat a doc_id share its decision; a null doc_id is larger than any other, and such
a row stays only where its whole group has none; empty tables give no rows.
"""

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwatch.llm import binary_fuse
from shelfwatch.llm.bitmap import bitmap_of, may_contain
from shelfwatch.llm.common import SPACE, narrowed, new_folder, staged, text_of

BUCKET_KEYS = 50_000  # digests a filter is built for, on average

_FILTER = "bucket long, seed decimal(20,0), segment long, segments long, slots binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def with_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row; the digest is SHA-256 over the normalised text in UTF-8."""
    rows = narrowed(docs, "doc_id", "text")
    return rows.select("doc_id", F.sha2(normalised(text_of()).cast("binary"), 256).alias("digest"))


def grouped(digests: DataFrame) -> DataFrame:
    """One row per digest: the smallest doc_id and the number of rows."""
    return digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(buckets)).alias("bucket")


def _keys(digests: pd.Series) -> np.ndarray:
    """64 bits of each digest that the bucket does not use."""
    raw = b"".join(bytes.fromhex(d[16:32]) for d in digests)
    return np.frombuffer(raw, ">u8").astype(np.uint64)


@dataclass(frozen=True)
class Snapshot:
    """An immutable set of distinct texts: folders of its exact buckets and its filters."""

    entries: str
    filters: str
    buckets: int


def write_snapshot(classes: DataFrame, folder: str | None = None) -> Snapshot:
    """Write ``classes`` (digest, first_id, n_rows; digests distinct) and their filters."""
    spark = classes.sparkSession
    folder = folder or new_folder(spark, "snapshot")
    classes = staged(classes, "classes")
    buckets = classes.count() // BUCKET_KEYS + 1

    def fuse(group: pd.DataFrame) -> pd.DataFrame:
        seed, segment, count, slots = binary_fuse.build(np.unique(_keys(group["digest"])))
        return pd.DataFrame({"bucket": group["bucket"].iloc[:1].to_list(), "seed": [Decimal(seed)], "segment": [segment],
                             "segments": [count], "slots": [slots]})

    bucketed = classes.select(_bucket(buckets), "digest", "first_id", "n_rows")
    bucketed.write.parquet(f"{folder}/entries")
    bucketed.select("bucket", "digest").groupBy("bucket").applyInPandas(fuse, _FILTER).write.parquet(f"{folder}/filters")
    return Snapshot(f"{folder}/entries", f"{folder}/filters", buckets)


def screen(spark: SparkSession, snapshot: Snapshot, classes: DataFrame) -> DataFrame:
    """Rows of ``classes`` whose digest may be in the snapshot."""

    def passed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty or left.empty:
            return left.iloc[:0].drop(columns="bucket")
        row = right.iloc[0]
        made = (int(row["seed"]), row["segment"], row["segments"], row["slots"])
        return left[binary_fuse.contains(made, _keys(left["digest"]))].drop(columns="bucket")

    incoming = classes.select(_bucket(snapshot.buckets), "digest", "first_id", "n_rows")
    filters = spark.read.parquet(snapshot.filters)
    return incoming.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(
        passed, "digest string, first_id long, n_rows long"
    )


def confirmed(spark: SparkSession, snapshot: Snapshot, classes: DataFrame, old_docs: DataFrame,
              new_docs: DataFrame) -> DataFrame:
    """Incoming digests found in the snapshot, with the snapshot's row, after a byte check.

    Returns digest, old_id, old_rows. The texts compared are those of one document
    per side; a null doc_id has no text to fetch, so the digest alone decides.
    """
    entries = spark.read.parquet(snapshot.entries).select(
        "digest", F.col("first_id").alias("old_id"), F.col("n_rows").alias("old_rows")
    )
    found = staged(screen(spark, snapshot, classes).join(entries, "digest"), "positives")

    def texts(docs: DataFrame, which: str) -> DataFrame:
        wanted = staged(found.select("digest", F.col(which).alias("doc_id")), "wanted")
        named = bitmap_of(wanted.select(F.xxhash64("doc_id").alias("key")), "key")
        rows = narrowed(docs, "doc_id", "text").filter(may_contain(named, F.xxhash64("doc_id"))).join(wanted, "doc_id")
        rows = rows.select("digest", normalised(text_of()).alias("norm"))
        # A doc_id may repeat with other texts; the one with this digest counts.
        return rows.filter(F.sha2(F.col("norm").cast("binary"), 256) == F.col("digest"))

    both = texts(old_docs, "old_id").unionByName(texts(new_docs, "first_id"))
    differing = both.groupBy("digest").agg((F.min("norm") != F.max("norm")).alias("differs")).filter("differs")
    return found.join(differing, "digest", "left_anti").select("digest", "old_id", "old_rows")


def dedup(old_docs: DataFrame, new_docs: DataFrame) -> DataFrame:
    """Decide every row of a stored part and of an incoming batch.

    Returns doc_id, keep_id, group_size, kept, text_sha256, in_snapshot (whether the
    row was in the stored part).
    """
    spark = old_docs.sparkSession
    both = with_digest(old_docs).withColumn("in_snapshot", F.lit(True)).unionByName(
        with_digest(new_docs).withColumn("in_snapshot", F.lit(False))
    )
    both = staged(both, "digests")
    snapshot = write_snapshot(grouped(both.filter("in_snapshot")))
    incoming = staged(grouped(both.filter(~F.col("in_snapshot"))), "incoming")
    shared = confirmed(spark, snapshot, incoming, old_docs, new_docs).select("digest", F.lit(True).alias("shared"))
    old = spark.read.parquet(snapshot.entries).select("digest", "first_id", "n_rows", F.lit(True).alias("in_snapshot"))
    classes = old.unionByName(incoming.withColumn("in_snapshot", F.lit(False))).join(shared, "digest", "left")
    # Both sides of a confirmed digest are one group, any other side is its own.
    side = F.when(F.col("shared"), F.lit(None).cast("boolean")).otherwise(F.col("in_snapshot"))
    merged = classes.groupBy("digest", side.alias("side")).agg(
        F.min("first_id").alias("keep_id"), F.sum("n_rows").alias("group_size"),
        F.collect_list("in_snapshot").alias("sides"),
    )
    merged = staged(merged.select("digest", "keep_id", "group_size", F.explode("sides").alias("in_snapshot")), "groups")
    return both.join(merged, ["digest", "in_snapshot"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"), "in_snapshot",
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the others: half the ids are the snapshot, half the incoming batch."""
    docs = narrowed(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    stored = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return dedup(docs.filter(stored), docs.filter(~stored)).drop("in_snapshot")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""
