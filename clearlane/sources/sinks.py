"""Writers. None of them replaces an existing target.

A result is written beside its target and takes the target's name when it is
whole. Of several jobs that write to one target at once, one wins and the others
leave nothing behind; readers see no half-written result. On stores that rename
by copying (object stores), only one job may write to a target at a time.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def _path(spark: SparkSession, path: str):
    """A path with its file system's name in front, and the file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.makeQualified(target), files


def target_exists(spark: SparkSession, path: str) -> bool:
    target, files = _path(spark, path)
    return files.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder."""
    target, files = _path(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(target))


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Fails where the target exists."""
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context.rename(_path(spark, source)[0], _path(spark, target)[0], no_options)


def publish(spark: SparkSession, path: str, write: Callable[[str], object], fail_if_exists: bool = False) -> bool:
    """Let ``write`` fill a folder beside ``path`` and give it that name. True when
    it has it; False, or an error with ``fail_if_exists``, when ``path`` was there
    before or another job was first, and then nothing is changed."""

    def left_alone() -> bool:
        if fail_if_exists:
            raise FileExistsError(f"{path} already exists")
        log.warning("%s already exists; nothing written", path)
        return False

    if target_exists(spark, path):
        return left_alone()
    target, files = _path(spark, path)
    name = f"_aside-{uuid.uuid4().hex}"
    aside = f"{target.getParent().toString()}/{name}"
    owner = f"_owner-{name}"
    files.mkdirs(target.getParent())
    try:
        write(aside)
        files.create(_path(spark, f"{aside}/{owner}")[0], False).close()
        try:
            rename(spark, aside, path)
        except Py4JJavaError:
            if not target_exists(spark, path):
                raise
        # a file system may move a folder into one that came first
        if not target_exists(spark, f"{path}/{owner}"):
            return left_alone()
        files.delete(_path(spark, f"{path}/{owner}")[0], False)
        return True
    finally:
        for rest in (aside, f"{path}/{name}"):
            files.delete(_path(spark, rest)[0], True)


def _flat(df: DataFrame) -> DataFrame:
    """Text files have no arrays: join list cells with commas."""
    return df.select(
        *[
            F.array_join(F.col(f"`{f.name}`"), ",").alias(f.name)
            if isinstance(f.dataType, T.ArrayType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def _write(df: DataFrame, path: str, fmt: str, fail_if_exists: bool, options: Mapping[str, str]) -> bool:
    """True when written; False when the target was there and was left alone."""
    return publish(df.sparkSession, path, df.write.format(fmt).options(**options).save, fail_if_exists)


def write_delimited(df: DataFrame, path: str, sep: str = "|", fail_if_exists: bool = False) -> bool:
    return _write(_flat(df), path, "csv", fail_if_exists, {"sep": sep, "header": "true"})


def write_table(df: DataFrame, path: str, fail_if_exists: bool = False) -> bool:
    return _write(df, path, "parquet", fail_if_exists, {})


def report(df: DataFrame, header: Mapping[str, str], decimals: int = 2) -> DataFrame:
    """Business column names, in the order of ``header``; floats rounded."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[
            (F.round(F.col(c), decimals) if c in floats else F.col(c)).alias(title)
            for c, title in header.items()
        ]
    )


def write_report(
    df: DataFrame,
    path: str,
    header: Mapping[str, str],
    sep: str = ",",
    fail_if_exists: bool = False,
) -> bool:
    return write_delimited(report(df, header), path, sep, fail_if_exists)
