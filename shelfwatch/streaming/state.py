"""Keyed tables in buckets, of which a batch rewrites only those that it touches.

A batch writes the buckets it has changed below its own folder and a manifest that
names, for every bucket, the batch that wrote it last. Readers follow a manifest, so
they see one version whole; a replayed batch starts from the manifest before it and
replaces its own output. Files that neither of the two newest manifests names are
deleted.
"""

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from shelfwatch.staging import file_system, read_text, write_text

BUCKETS = 64


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, none if it does not exist."""
    system, place = file_system(spark, path)
    if not system.exists(place):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(place) if s.isDirectory())


def remove(spark: SparkSession, path: str) -> None:
    system, place = file_system(spark, path)
    system.delete(place, True)


def bucket_of(key: list[str], buckets: int = BUCKETS) -> Column:
    """Bucket by hash of the key; NULLs count, whichever part they stand in."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in key]
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class BucketedTable:
    """A table below ``path`` with at most one version of each bucket per batch."""

    path: str
    schema: T.StructType
    key: tuple[str, ...]
    buckets: int = BUCKETS

    def manifest(self, spark: SparkSession, batch_id: int) -> dict[int, int]:
        """Bucket -> batch, as of ``batch_id``; at most ``buckets`` entries."""
        text = read_text(spark, self._manifest(batch_id)) if batch_id >= 0 else None
        return {int(bucket): batch for bucket, batch in json.loads(text or "{}").items()}

    def _manifest(self, batch_id: int) -> str:
        return f"{self.path}/manifest/{batch_id}.json"

    def _place(self, bucket: int, batch_id: int) -> str:
        return f"{self.path}/data/batch={batch_id}/bucket={bucket}"

    def read(self, spark: SparkSession, batch_id: int, buckets: list[int] | None = None) -> DataFrame:
        """The table after ``batch_id``, or some of its buckets."""
        held = self.manifest(spark, batch_id)
        places = [self._place(b, n) for b, n in held.items() if buckets is None or b in buckets]
        if not places:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*places)

    def write(self, rows: DataFrame, batch_id: int, touched: list[int]) -> DataFrame:
        """Replace the ``touched`` buckets by ``rows`` (all of their rows) and return these."""
        spark = rows.sparkSession
        place = f"{self.path}/data/batch={batch_id}"
        held = self.manifest(spark, batch_id - 1)
        placed = rows.select(*self.schema.fieldNames()).withColumn("bucket", bucket_of(list(self.key), self.buckets))
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)
        written = [int(f.split("=")[1]) for f in folders(spark, place) if f.startswith("bucket=")]
        held = {b: n for b, n in held.items() if b not in touched} | dict.fromkeys(written, batch_id)
        write_text(spark, self._manifest(batch_id), json.dumps(held))
        self._clean(spark, batch_id, held)
        return self.read(spark, batch_id, written)

    def carry(self, spark: SparkSession, batch_id: int) -> None:
        """Name the rows of the batch before as those of ``batch_id``; nothing is read or written anew."""
        held = self.manifest(spark, batch_id - 1)
        write_text(spark, self._manifest(batch_id), json.dumps(held))
        self._clean(spark, batch_id, held)

    def _clean(self, spark: SparkSession, batch_id: int, held: dict[int, int]) -> None:
        """Drop what only manifests before the last one name."""
        last, older = self.manifest(spark, batch_id - 1), self.manifest(spark, batch_id - 2)
        for bucket, batch in older.items():
            if last.get(bucket) != batch and held.get(bucket) != batch:
                remove(spark, self._place(bucket, batch))
        remove(spark, self._manifest(batch_id - 2))
