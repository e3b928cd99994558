"""Intermediate tables in the cluster's shared folder."""

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FOLDER_SETTING = "spark.checkpoint.dir"
CLEAN_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_chosen: dict[str, str] = {}
_staging: list[list[str]] = []  # folders of the running functions that are ``only_last``, innermost last


def use_local_folder(spark: SparkSession) -> None:
    """Choose a temporary folder for a local session that names none, as in tests."""
    if spark.conf.get(FOLDER_SETTING, None) or not spark.sparkContext.master.startswith("local["):
        return
    app = spark.sparkContext.applicationId
    if app not in _chosen:
        _chosen[app] = tempfile.mkdtemp(prefix="shelfwatch-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for intermediate tables."""
    folder = spark.conf.get(FOLDER_SETTING, None) or _chosen.get(spark.sparkContext.applicationId)
    if not folder:
        raise RuntimeError(f"set {FOLDER_SETTING} to a folder every executor can reach")
    return folder


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file in the shared folder, None if there is none; no Spark job."""
    system, place = file_system(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small text file."""
    system, place = file_system(spark, path)
    stream = system.create(place, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/shelfwatch/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder of this application below the shared one."""
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what is written here as soon as it is written.

    Nothing reads them again: the written table is the new beginning. Else they stay until
    the driver happens to collect the plan.
    """
    before = spark.conf.get(CLEAN_SETTING, None)
    spark.conf.set(CLEAN_SETTING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SETTING)
        else:
            spark.conf.set(CLEAN_SETTING, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The table outlives lost executors and cuts the lineage. Its file size is
    known to the optimizer, so a join with it is broadcast only while it is under
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffled otherwise.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    if _staging:
        _staging[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def only_last(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions that return the last table they stage: the others are deleted when it is written.

    Nothing else may read these, neither what the function returns nor what it was given.
    """

    @functools.wraps(make)
    def made(*args, **named) -> DataFrame:
        _staging.append([])
        try:
            result = make(*args, **named)
        finally:
            folders = _staging.pop()
        for folder in folders[:-1]:
            system, path = file_system(result.sparkSession, folder)
            system.delete(path, True)
        if _staging:
            _staging[-1].extend(folders[-1:])
        return result

    return made


def drop_staged(spark: SparkSession) -> None:
    """Delete all folders this application has staged; results read from them are gone."""
    system, path = file_system(spark, _own_folder(spark))
    system.delete(path, True)
