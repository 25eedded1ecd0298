"""Readers. All of them take a declared schema; nothing is inferred."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# header of the row-number column that saved data frames carry
SAVED_INDEX = "Unnamed: 0"


def _typed(name: str, kind: T.DataType) -> Column:
    """The text as ``kind``; a cell that is not one stops the job."""
    text = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return text.alias(name)
    value = text.try_cast(kind)
    message = F.concat(F.lit(f"column {name}, not {kind.simpleString()}: "), text)
    bad = F.raise_error(message).cast(kind)
    return F.when(text.isNull() | value.isNotNull(), value).otherwise(bad).alias(name)


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    sep: str = ",",
    saved_index: bool = False,
    **options: str,
) -> DataFrame:
    """Delimited text with a header line, read by the names in the header: the
    order of the columns does not matter, and further columns are left out. A
    column that the header lacks and a cell of the wrong type are errors; an
    empty cell is null. ``saved_index`` says that the file has a column of saved
    row numbers, which is left out whatever its name."""
    reader = spark.read.option("header", True).option("inferSchema", False).option("sep", sep)
    for key, value in {"mode": "FAILFAST", **options}.items():
        reader = reader.option(key, value)
    frame = reader.csv(path)
    missing = [f.name for f in schema.fields if f.name not in frame.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(frame.columns)}")
    if saved_index and len(frame.columns) <= len(schema.fields):
        raise ValueError(f"{path} has no column of row numbers")
    return frame.select(*[_typed(f.name, f.dataType) for f in schema.fields])


@dataclass(frozen=True)
class Scan:
    """Rows of a text file that could be read, and the others: file, record, reason."""

    good: DataFrame
    rejected: DataFrame


def scan_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    sep: str = ",",
    saved_index: bool = False,
    **options: str,
) -> Scan:
    """``read_delimited`` that does not stop at a bad row. A row with too many or
    too few cells, or with a cell of the wrong type, is kept apart with the name of
    its file and what is wrong; the others are read. The columns of all files have
    to be those of the header, in one order; a missing column is an error, as it
    concerns every row."""
    def options_of(reader):
        for key, value in {"sep": sep, "header": "true", "enforceSchema": "false", **options}.items():
            reader = reader.option(key, value)
        return reader

    header = options_of(spark.read.option("inferSchema", False)).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(header)}")
    if saved_index and len(header) <= len(schema.fields):
        raise ValueError(f"{path} has no column of row numbers")
    damaged = "__damaged"
    text = T.StructType([*[T.StructField(c, T.StringType()) for c in header], T.StructField(damaged, T.StringType())])
    # all columns are parsed, else a row's number of cells would not be checked
    reader = options_of(spark.read.schema(text)).option("mode", "PERMISSIVE").option("columnPruning", "false")
    rows = reader.option("columnNameOfCorruptRecord", damaged).csv(path).select("*", F.col("_metadata.file_name").alias("__file"))

    wrong = [F.when(F.col(damaged).isNotNull(), F.lit("number of cells"))]
    for field in schema.fields:
        if not isinstance(field.dataType, T.StringType):
            cell = F.col(f"`{field.name}`")
            bad = cell.isNotNull() & cell.try_cast(field.dataType).isNull()
            wrong.append(F.when(bad, F.concat(F.lit(f"column {field.name}, not {field.dataType.simpleString()}: "), cell)))
    judged = rows.withColumn("__reason", F.concat_ws("; ", *wrong))
    good = judged.filter("__reason = ''").select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])
    record = F.coalesce(F.col(damaged), F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in header]))
    rejected = judged.filter("__reason <> ''").select(F.col("__file").alias("file"), record.alias("record"), F.col("__reason").alias("reason"))
    return Scan(good, rejected)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_query(
    spark: SparkSession,
    url: str,
    query: str,
    options: Mapping[str, str] | None = None,
    partition: tuple[str, int, int, int] | None = None,
) -> DataFrame:
    """Result of a query on a relational database over JDBC.

    ``partition`` is (column, lower bound, upper bound, number of reads): it
    splits the read across executors instead of pulling it through one
    connection.
    """
    reader = spark.read.format("jdbc").option("url", url)
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    if partition is None:
        return reader.option("query", query).load()
    column, lower, upper, reads = partition
    return (
        reader.option("dbtable", f"({query}) source_query")
        .option("partitionColumn", column)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", reads)
        .load()
    )


def run_sql_file(
    spark: SparkSession, path: str, tables: Mapping[str, DataFrame], **params: str
) -> DataFrame:
    """Run one query kept in a text file over the given tables. ``params`` are
    bound to ``:name`` markers. The tables are visible to this query only."""
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
    try:
        return spark.sql(text, args=params or None)
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
