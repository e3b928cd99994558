"""What the embedding operators share: usable vectors, matrices of a batch, distributed matrix sums."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

ROWS = 1024  # vectors held as one numpy matrix at a time
FAN_IN = 64  # partial matrices that one task adds up


def is_finite(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components; null for a null vector."""
    return ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def common_dimension(rows: DataFrame, column: str) -> int:
    """The most frequent number of components, the larger of equally frequent ones; 0 without rows."""
    sizes = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d"))
    found = sizes.first()
    return found.d if found else 0


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists of numbers as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ROWS rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``part`` over all slices of ``rows``.

    A task returns one matrix; two rounds of tasks add FAN_IN of them each, and the
    driver adds what is left, one matrix for 4,096 input partitions.
    """

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in slices(batches):
            total += part(batch)
        place = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"place": [place], "m": [total.tobytes()]})

    def added(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(m) for m in found["m"])
        return pd.DataFrame({"place": [key[0]], "m": [total.tobytes()]})

    sums = rows.mapInArrow(of_task, "place long, m binary")
    for _ in range(2):
        sums = sums.groupBy((F.col("place") / FAN_IN).cast("long").alias("place")).applyInPandas(added, "place long, m binary")
    return sum((np.frombuffer(r.m).reshape(shape) for r in sums.collect()), np.zeros(shape))
