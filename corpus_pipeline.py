"""From raw documents to shards for training: quality, near duplicates,
benchmark leaks, source weights, shards.

Each stage takes what its predecessor kept, and its decisions take effect. All
stages but the last return the columns of their input. Further columns go through
unchanged, whatever their names, and an empty table gives an empty one.

Documents are known by their id. Rows that share an id are one document to a
stage that drops documents: they stay or go together. A row without an id cannot
be named by a decision, so it stays in these stages. Rows that repeat as a whole
are near duplicates of one id and stay together, too. A null or empty text breaks
no rule of quality, is a copy of nothing and holds no benchmark item. A text of any
length is read as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clearlane.llm import decontaminate, kneser_ney, minhash, mixing, sharding
from clearlane.operators.staging import release, stage_table, staged

# near copies are linked from this similarity on, in per cent, by bands of so many
# minimum hashes; the query op3 has a higher one
SIMILAR, ROWS = 80, 4


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not listed; rows without an id stay, all rows of a listed
    id go."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity is outside the limits of their language.
    Without trusted documents all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, kneser_ney.judge_quality(docs, labels).filter("NOT kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates;
    texts without a word are in no group."""
    judged = minhash.near_duplicates(docs, percent=SIMILAR, rows=ROWS)
    return _without(docs, judged.filter("NOT kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or a paraphrase of one; with an
    empty benchmark all stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.leaks(docs, benchmark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the weights of the sources want it: a row
    may repeat or go. Null sources are a source of their own; rows that share an id
    are taken each by itself."""
    return mixing.repeat_rows(docs, mixing.mix_sources(docs))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row; rows with the same text share a shard."""
    return sharding.assign_shards(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]
# trained models, random projections and heaps have no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage needed on the way is removed
    when its result is written."""
    others = staged()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stage_table(docs)  # written as Parquet and read again
            release(keep=[*others, staged()[-1]])
    return docs
