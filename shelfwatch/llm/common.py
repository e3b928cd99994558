"""What the corpus operators share: columns, words, staging."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwatch import staging

__all__ = ["DOCUMENT", "SPACE", "WORD", "documents", "table", "text_of", "words_of", "word_hashes", "staged",
           "new_folder", "shuffle_partitions", "narrowed", "text_pieces"]

# The six white-space characters that part words, and a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

PIECE_BYTES = 2 << 20  # of text that a task turns into Python objects at a time

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the session's shared folder and read back; local sessions may name none."""
    staging.use_local_folder(df.sparkSession)
    return staging.staged(df, label)


def new_folder(spark: SparkSession, label: str) -> str:
    staging.use_local_folder(spark)
    return staging.new_folder(spark, label)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_of(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def narrowed(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns of any name cannot clash."""
    return docs.select(*names)


def words_of(text: Column) -> Column:
    """The words in order; an empty array where there are none."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    """The words as 64-bit hashes."""
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_pieces(batches: Iterator[pa.RecordBatch], *columns: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds at most ``most`` bytes of the text ``columns``, or one row."""
    for batch in batches:
        ends = np.zeros(batch.num_rows, np.int64)
        for name in columns:
            ends += pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(ends), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
