"""One query for each operator, over its whole table, with the parameters meant
for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearlane.llm import (
    decontaminate,
    hard_negatives,
    kneser_ney,
    language,
    licenses,
    lines,
    minhash,
    mixing,
    oracle,
    phrases,
    sharding,
    simhash,
    substring,
    urlfilter,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are the files of a tree: source / language / id."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan_licenses(_table(spark, sf_dir, "documents").withColumn("path", path))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_template_lines(_table(spark, sf_dir, "documents"), with_text=False)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, by a checksum of the id, is not learned from."""
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    return language.predict(_table(spark, sf_dir, "documents"), learn)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row has the next label, every fiftieth is an anchor."""
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", moved), vec_id % 50 == 0)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_license_scan,
        op3_minhash_near_dedup,
        op4_document_fingerprints,
        op5_line_dedup,
        op6_decontamination,
        op7_mixing,
        op8_url_filter,
        op9_sharding,
        op10_quality,
        op11_collocations,
        op12_language_id,
        op13_hard_negatives,
    )
}
ORACLE: dict[str, str] = {
    "op1_substring_dedup": oracle.SUBSTRING,
    "op3_minhash_near_dedup": oracle.NEAR,
    "op5_line_dedup": oracle.LINES,
    "op8_url_filter": oracle.URLS,
    "op11_collocations": oracle.COLLOCATIONS,
    "op13_hard_negatives": oracle.HARD_NEGATIVES,
}
