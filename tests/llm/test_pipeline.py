import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from clearlane.llm import decontaminate, kneser_ney, minhash, mixing, sharding
from clearlane.llm.queries import ORACLE, QUERIES
from clearlane.operators import staging
from tests.compare import connect, differences
from tests.llm.cases import documents, prose
from tests.llm.test_minhash import brute as near_brute

SMALL = "/root/testdata/sf0.001"


def test_registered():
    assert {*QUERIES, "pipeline"} <= set(queries()) and set(ORACLE) <= set(oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, name):
    text, _, _ = differences(spark, connect(SMALL), SMALL, name, QUERIES[name], ORACLE[name])
    assert text == ""


def _ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_act_on_what_was_kept(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "mixture", "shards"]
    stage = dict(corpus_pipeline.STAGES)

    good = stage["quality"](spark, docs, SMALL)
    assert good.schema == docs.schema
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    assert _ids(good) == _ids(kneser_ney.judge_quality(docs, labels).filter("kept"))

    good = good.cache()
    single = stage["near_dedup"](spark, good, SMALL)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert _ids(single) == sorted(i for i, _, c in near_brute(rows, corpus_pipeline.SIMILAR) if i == c)
    assert minhash.near_duplicates(single).filter("NOT kept").count() == 0

    single = single.cache()
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    clean = stage["decontamination"](spark, single, SMALL)
    leaked = {r.doc_id for r in decontaminate.leaks(single, benchmark).collect()}
    assert _ids(clean) == sorted(set(_ids(single)) - leaked)

    clean = clean.cache()
    mixed = stage["mixture"](spark, clean, SMALL)
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(clean).collect()}
    assert mixed.schema == docs.schema
    assert _ids(mixed) == sorted(i for i, n in copies.items() for _ in range(n))

    result = stage["shards"](spark, mixed, SMALL).collect()
    assert sorted(map(tuple, result)) == sorted(map(tuple, sharding.assign_shards(mixed).collect()))
    assert len(result) == mixed.count()


def test_run_and_empty_input(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert corpus_pipeline.run(spark, SMALL).count() > 50
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
        assert empty.count() == 0


def test_nulls_repeated_ids_and_further_columns(spark, tmp_path):
    """Rows with one id stay or go together; rows without an id stay."""
    item = " ".join(prose("item", 30))
    good = [" ".join(prose(("good", i), 120, 300)) for i in range(40)]
    junk = "\u00a7%&! " * 60
    texts = [*good, None, "", junk, junk, good[3], item + " " + good[5], item, good[7]]
    ids = [*range(40), 40, 41, 42, None, None, 43, None, 7]
    docs = documents(spark, texts, ids, langs=["en"] * len(texts))
    folder = str(tmp_path)
    spark.createDataFrame([(i, 1, "x") for i in range(35)], "doc_id long, quality int, model string").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item, "x")], "item_id long, text string, word string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    quality = stage["quality"](spark, docs, folder)
    assert quality.schema == docs.schema
    left = [r.doc_id for r in quality.collect()]
    assert left.count(None) == 3 and left.count(7) in (0, 2) and 42 not in left and {40, 41} <= {*left}
    single = [r.doc_id for r in stage["near_dedup"](spark, docs, folder).collect()]
    # both rows of id 7 are one document; the copies without an id stay
    assert single.count(None) == 3 and single.count(7) == 2 and {40, 41} <= {*single}
    clean = [r.doc_id for r in stage["decontamination"](spark, docs, folder).collect()]
    assert clean.count(None) == 3 and 43 not in clean and {40, 41, 42} <= {*clean}
    mixed = stage["mixture"](spark, docs, folder)
    assert mixed.schema == docs.schema
    assert stage["shards"](spark, mixed, folder).count() == mixed.count()
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_run_removes_what_its_stages_needed(spark):
    before = staging.staged()
    rows = corpus_pipeline.run(spark, SMALL)
    kept = [x for x in staging.staged() if x not in before]
    assert rows.count() > 0 and set(before) <= set(staging.staged())
    assert len(kept) < 10
