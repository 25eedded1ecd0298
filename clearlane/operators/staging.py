"""Staging of small results and joins that survive any key distribution."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A key is hot when it holds more rows than a task should, and more than
# 1/MOST_HOT_KEYS of all rows, so there are always fewer than MOST_HOT_KEYS hot
# keys, whatever the size of the data.
HOT_ROWS = 5_000_000
MOST_HOT_KEYS = 100_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_tables: dict[str, SparkSession] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; only a local session
    without one gets a temporary folder, which goes with the session."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="clearlane-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)


def stage(df: DataFrame) -> DataFrame:
    """Write a (grouped, small) result to the checkpoint folder and cut its
    lineage, so later branches read it instead of recomputing it. Spark removes
    the files when nothing refers to them any more, where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the checkpoint folder, for one table. :func:`release`
    removes it."""
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{folder}/tables/{uuid.uuid4().hex}"
    _tables[path] = spark
    return path


# for tables with rows of some MB: Parquet else looks at the size of a page and of a
# row group only every 100 rows, and holds that much when it writes and reads them
LONG_ROWS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def stage_table(df: DataFrame, keep_shuffles: bool = True, long_rows: bool = False) -> DataFrame:
    """Write a result that several passes read as a columnar table in the
    checkpoint folder. Each pass then reads only its columns, and Spark knows
    the size. :func:`release` removes the tables of a finished job. Without
    ``keep_shuffles`` Spark removes what it shuffled for the table when this is
    written, not when the driver happens to collect garbage. With ``long_rows`` a
    page of the table ends after 1 MB and a row, a row group after 8 MB and a row."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    if not keep_shuffles:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("errorifexists").options(**(LONG_ROWS if long_rows else {})).parquet(path)
    finally:
        if not keep_shuffles:
            spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def staged() -> list[str]:
    """The tables that are staged now, the newest last."""
    return list(_tables)


def release(keep: Iterable[str] = ()) -> None:
    """Remove the tables staged so far but those in ``keep``; for the end of a job
    or of a part of it, when its results are written. Frames that still read such a
    table become unusable."""
    kept = {*keep}
    for path, spark in list(_tables.items()):
        if path not in kept:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
            del _tables[path]


def _match(left: DataFrame, right: DataFrame, on: Sequence[str], null_safe: bool) -> Column:
    condition = F.lit(True)
    for key in on:
        a, b = left[key], right[f"__r_{key}"]
        condition = condition & (a.eqNullSafe(b) if null_safe else a == b)
    return condition


def _prefixed(right: DataFrame, on: Sequence[str]) -> DataFrame:
    return right.select(
        *[F.col(k).alias(f"__r_{k}") for k in on],
        *[c for c in right.columns if c not in on],
    )


def bounded_left_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    null_safe: bool = False,
    staged: bool = False,
) -> DataFrame:
    """Left outer join of a large ``left`` with a lookup that is unique on ``on``.

    The lookup is stored, so Spark knows its bytes when it plans: a small one is
    broadcast and ``left`` is not shuffled, any other is joined by a shuffle
    whose skewed parts Spark splits at run time.
    """
    side = _prefixed(right if staged else stage_table(right), on)
    return left.join(side, _match(left, side, on, null_safe), "left").drop(*[f"__r_{k}" for k in on])


def keyed_left_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    rows_per_key: str,
    null_safe: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left outer join where ``right`` has one row per key and its column
    ``rows_per_key`` says how many left rows carry that key.

    ``right`` is stored once. Hot keys, more than ``hot_rows`` rows each and
    fewer than ``MOST_HOT_KEYS``, are broadcast. All other rows are shuffled by
    key. Rows already answered by the broadcast, and rows with a null key, would
    only pile up, so they are spread over the tasks by the number of the
    partition they come from: that number is the same when a lost task runs
    again, and costs no column.
    """
    values = [c for c in right.columns if c not in on and c != rows_per_key]
    right = stage_table(right)
    total = right.agg(F.sum(rows_per_key)).first()[0] or 0
    is_hot = F.col(rows_per_key) > F.lit(max(hot_rows, total // MOST_HOT_KEYS))

    hot = right.filter(is_hot).select(
        *[F.col(k).alias(f"__r_{k}") for k in on],
        *[F.col(v).alias(f"__hot_{v}") for v in values],
        F.lit(True).alias("__hot"),
    )
    tagged = left.join(F.broadcast(hot), _match(left, hot, on, null_safe), "left").drop(
        *[f"__r_{k}" for k in on]
    )
    answered = F.col("__hot").isNotNull()
    if not null_safe:
        for key in on:
            answered = answered | F.col(key).isNull()
    # part of the join key, so it decides where a row goes; computed on both
    # sides, because a constant would be optimised out of the shuffle
    routed = tagged.withColumn("__from", F.spark_partition_id().cast("long")).withColumn(
        "__route", F.when(answered, F.col("__from")).otherwise(F.xxhash64(*on))
    )

    types = {f.name: f.dataType for f in left.schema.fields}
    keys = [F.col(k).cast(types[k]) for k in on]
    cold = right.filter(~is_hot).select(
        *[key.alias(f"__r_{k}") for k, key in zip(on, keys, strict=True)],
        *[F.col(v).alias(f"__cold_{v}") for v in values],
        F.xxhash64(*keys).alias("__r_route"),
    )
    condition = _match(routed, cold, on, null_safe) & (routed["__route"] == cold["__r_route"])
    joined = routed.join(cold, condition, "left")
    return joined.select(
        *left.columns,
        *[
            F.when(F.col("__hot"), F.col(f"__hot_{v}")).otherwise(F.col(f"__cold_{v}")).alias(v)
            for v in values
        ],
    )
