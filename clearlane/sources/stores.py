"""Stored extracts laid out for the jobs that read them again.

* Referral lines lie in a folder for each month received. A reader with a closed
  period derives the months from it, so only their folders are read.
* Referral headers, with their lookups resolved, and detail lines lie in the same
  buckets of the referral key: their join needs no shuffle.
* Claims lie in a folder for each service month, which the join with the days of
  a period prunes while the query runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearlane import constants as K
from clearlane import schemas
from clearlane.operators.staging import HOT_ROWS, MOST_HOT_KEYS, stage_table
from clearlane.sources import warehouse
from clearlane.sources.sinks import children, publish, target_exists

MONTH = "month_received"
REFERRAL_KEY = "referral_key"
STORED_HEADER = T.StructType(
    [*schemas.REFERRAL_HEADER.fields, T.StructField("urgent", T.StringType())]
)


# --- lines by month -------------------------------------------------------------------


def write_referral_lines(df: DataFrame, path: str, fail_if_exists: bool = False) -> bool:
    """Extract stored for the later jobs, one folder per month received. Rows
    without a date go to the null folder. Rebalancing keeps files few and splits
    a crowded month."""
    by_month = df.withColumn(MONTH, F.date_format("date_received", "yyyy-MM")).hint("rebalance", MONTH)
    return publish(df.sparkSession, path, by_month.write.partitionBy(MONTH).parquet, fail_if_exists)


def read_referral_lines(
    spark: SparkSession,
    path: str,
    window: tuple[str, str] | None = None,
    schema: T.StructType = schemas.REFERRAL_LINE,
    months: Sequence[str] | None = None,
) -> DataFrame:
    """Stored lines of a closed period, whose last day ends at its first instant;
    the folders of other months are not read, nor is that of lines without a
    date. ``months`` (``2019-02``) asks for some months only. Without either, all
    lines."""
    stored = T.StructType([*schema.fields, T.StructField(MONTH, T.StringType())])
    lines = spark.read.schema(stored).parquet(path)
    if window is not None:
        first, last = (F.date_format(F.lit(day).cast("timestamp_ntz"), "yyyy-MM") for day in window)
        lines = lines.filter(F.col(MONTH).between(first, last) & warehouse.between_days("date_received", window))
    if months is not None:
        lines = lines.filter(F.col(MONTH).isin(*months))
    return lines.select(*schema.fieldNames())


# --- headers and details in buckets -----------------------------------------------------


def _write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """One file for each bucket. Only the catalogue can hold buckets while they are
    written, so the table is known to it for that time."""
    table = f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    dealt.option("path", f"{path}/{key}.{buckets}").format("parquet").saveAsTable(table)
    df.sparkSession.sql(f"DROP TABLE {table}")  # the files stay


def _read_bucketed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The folder's name says the key and the number of buckets."""
    folder = next(x for x in children(spark, path) if not x.startswith("_"))
    key, buckets = folder.rsplit(".", 1)
    table = f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
        f"INTO {buckets} BUCKETS LOCATION '{path}/{folder}'"
    )
    try:
        return spark.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")


def write_referrals(
    tables: warehouse.Tables,
    path: str,
    buckets: int,
    window: tuple[str, str] = K.REFERRAL_WINDOW,
    communities: Sequence[str] = K.COMMUNITIES,
    hot_rows: int = HOT_ROWS,
    fail_if_exists: bool = False,
) -> bool:
    """Resolved headers of a period, and all known detail lines, in ``buckets``
    buckets of the referral key; choose so many that a bucket of lines is some
    hundred MB. Lines of a referral with more than ``hot_rows`` rows (fewer than
    ``MOST_HOT_KEYS`` referrals) lie apart, so no bucket is much larger than the
    others. Lines without a key meet no header and are not stored."""
    spark = tables["referral_hdr"].sparkSession
    headers = warehouse.resolved_headers(tables, window, communities, with_priority=True)
    headers = headers.filter(F.col(REFERRAL_KEY).isNotNull())
    details = warehouse.known_details(tables).filter(F.col(REFERRAL_KEY).isNotNull())
    details = details.select(REFERRAL_KEY, F.col("px_code").cast("string"), F.col("units").cast("double"))
    sizes = stage_table(details.groupBy(REFERRAL_KEY).agg(F.count(F.lit(1)).alias("rows")))
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    hot = sizes.filter(F.col("rows") > max(hot_rows, total // MOST_HOT_KEYS)).select(REFERRAL_KEY)
    any_hot = not hot.isEmpty()

    def write(aside: str) -> None:
        stored = headers.select(REFERRAL_KEY, *[F.col(f.name).cast(f.dataType) for f in STORED_HEADER.fields])
        _write_bucketed(stored, f"{aside}/headers", REFERRAL_KEY, buckets)
        # fewer than MOST_HOT_KEYS keys
        cold = details.join(F.broadcast(hot), REFERRAL_KEY, "left_anti") if any_hot else details
        _write_bucketed(cold, f"{aside}/details", REFERRAL_KEY, buckets)
        if any_hot:
            details.join(F.broadcast(hot), REFERRAL_KEY, "left_semi").write.parquet(f"{aside}/hot")

    return publish(spark, path, write, fail_if_exists)


def read_referrals(
    spark: SparkSession,
    path: str,
    window: tuple[str, str] | None = None,
    communities: Sequence[str] | None = None,
    key_type: T.DataType | None = None,
) -> DataFrame:
    """The line extract from stored headers and details; both sides of the join
    come in the same buckets, so neither is shuffled."""
    key = T.StructField(REFERRAL_KEY, key_type or T.LongType())
    headers = _read_bucketed(spark, f"{path}/headers", T.StructType([key, *STORED_HEADER.fields]))
    if window is not None:
        headers = headers.filter(warehouse.between_days("date_received", window))
    if communities is not None:
        headers = headers.filter(F.col("region").isin(*communities))
    detail = T.StructType([key, T.StructField("px_code", T.StringType()), T.StructField("units", T.DoubleType())])
    lines = _read_bucketed(spark, f"{path}/details", detail).join(headers, REFERRAL_KEY)
    if target_exists(spark, f"{path}/hot"):
        hot = spark.read.schema(detail).parquet(f"{path}/hot")
        # fewer than MOST_HOT_KEYS referrals
        few = headers.join(F.broadcast(stage_table(hot.select(REFERRAL_KEY).distinct())), REFERRAL_KEY, "left_semi")
        lines = lines.unionByName(hot.join(F.broadcast(stage_table(few)), REFERRAL_KEY))
    return lines.select(F.col("px_code").alias("cpt_code"), *schemas.REFERRAL_LINE.fieldNames()[1:])


# --- claims by service month ---------------------------------------------------------------


def write_claims(fact: DataFrame, days: DataFrame, path: str, fail_if_exists: bool = False) -> bool:
    """The claim fact with a folder per service month, which ``days`` (dim_date, one
    row per day) gives. Claims of an unknown day go to the null folder; they are in
    no period."""
    months = days.groupBy(F.col("date_sk").alias("date_service_from_sk")).agg(
        F.date_format(F.min("date_bk"), "yyyy-MM").alias(warehouse.SERVICE_MONTH)
    )
    by_month = fact.join(months, "date_service_from_sk", "left").hint("rebalance", warehouse.SERVICE_MONTH)
    return publish(fact.sparkSession, path, by_month.write.partitionBy(warehouse.SERVICE_MONTH).parquet, fail_if_exists)


def read_claims(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored fact, for ``claims_cost_stats`` in place of the loaded one."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(warehouse.SERVICE_MONTH, T.StringType())])).parquet(path)
