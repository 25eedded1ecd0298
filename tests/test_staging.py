import os
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from clearlane.operators import approval, staging, summary
from clearlane.operators.staging import bounded_left_join, keyed_left_join


def _left(spark, hot_rows=3000, cold_keys=200):
    """One key holds most rows, one block of rows has no key."""
    hot = spark.range(hot_rows).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    cold = spark.range(cold_keys * 3).select(
        F.concat(F.lit("c"), (F.col("id") % cold_keys).cast("string")).alias("k"), F.col("id").alias("v")
    )
    none = spark.range(500).select(F.lit(None).cast("string").alias("k"), F.col("id").alias("v"))
    return hot.union(cold).union(none).repartition(8)


def _counts(df):
    return sorted((str(r["k"]), r["v"], r["w"]) for r in df.collect())


@pytest.fixture(scope="module")
def frames(spark):
    left = _left(spark)
    right = spark.createDataFrame(
        [("hot", 1), *[(f"c{i}", i) for i in range(0, 200, 2)], ("unused", 9)], "k string, w int"
    )
    want = _counts(left.join(right, "k", "left"))
    return left, right, want


@pytest.fixture(params=["10m", "-1"], ids=["broadcast", "shuffled"])
def join_size(spark, request):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bounded_join_is_the_same_either_way(frames, join_size):
    left, right, want = frames
    out = bounded_left_join(left, right, ["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (join_size != "-1")
    assert _counts(out) == want


def test_hot_key_without_partner_stays(spark, frames):
    left, right, _ = frames
    few = right.filter("k <> 'hot'")
    assert _counts(bounded_left_join(left, few, ["k"])) == _counts(left.join(few, "k", "left"))


def test_missing_keys_match_when_asked(spark, frames, join_size):
    left, right, _ = frames
    extra = right.union(spark.createDataFrame([(None, 77)], "k string, w int"))
    out = bounded_left_join(left, extra, ["k"], null_safe=True)
    assert out.filter("k IS NULL AND w = 77").count() == 500
    assert out.count() == left.count()


def test_hot_rows_are_spread(spark, frames):
    """The shuffled side of the join holds no partition with the hot group."""
    left, right, _ = frames
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k IS NOT NULL")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = keyed_left_join(left, counts.join(right, "k", "left"), ["k"], "n", hot_rows=1000)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == left.count()
    assert max(sizes) < 2000


def test_checkpoint_folder_comes_from_the_session(spark):
    staging.ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or folder.startswith(("file:" + named, named))
    table = staging.stage_table(spark.range(5))
    assert table.count() == 5 and folder.removeprefix("file:") in table.inputFiles()[0]


def test_staged_tables_are_removed_when_a_job_is_done(spark):
    table = staging.stage_table(spark.range(5))
    path = table.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    staging.release()
    assert not os.path.exists(path) and not staging._tables


def test_keyed_join_groups_the_lines_once(spark, frames):
    """The right side is stored, so the join's plan does not group again."""
    left, right, want = frames
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k IS NOT NULL")
    out = keyed_left_join(left, counts.join(right, "k", "left"), ["k"], "n", hot_rows=1000)
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert _counts(out) == want


def test_shared_referral_number_gives_the_same_report(spark):
    """A third of all lines under one number."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("SHARED")).otherwise(F.concat(F.lit("A"), (F.col("id") % 500).cast("string"))).alias("auth_number"),
        F.concat(F.lit("S"), (F.col("id") % 7).cast("string")).alias("specialty"),
        F.concat(F.lit("C"), (F.col("id") % 5).cast("string")).alias("cpt_code"),
        F.lit("OUTPT").alias("ref_type"),
        F.lit(1).alias("is_ppl"),
        (F.col("id") % 2).cast("int").alias("is_autoapp"),
        (F.col("id") % 4 == 1).cast("int").alias("is_den"),
        F.lit(1).alias("is_app"),
        F.lit(1.0).alias("units"),
        F.lit("x").alias("status_name"),
    )
    decisions = (
        rows.select("specialty", "cpt_code", "is_ppl").distinct()
        .withColumn("final_decision", (F.col("cpt_code") != "C4").cast("int"))
        .withColumn("avg_hcp_cost", F.lit(3.0)).withColumn("roi", F.lit(0.5))
    )
    whole = summary.specialty_summary(rows, decisions, 2.0).orderBy("specialty").collect()
    lines = summary.scored_line_financials(rows, decisions, 2.0)
    parts = summary.specialty_financials(lines).orderBy("specialty").collect()
    for a, b in zip(whole, parts, strict=True):
        for column in summary.DOLLARS:
            assert a[column] == pytest.approx(b[column])
    shared = approval.attach_referral_decision(approval.score_lines(rows, decisions))
    assert shared.filter("auth_number = 'SHARED'").select("aa_yn").distinct().collect()[0][0] == 0
    assert shared.count() == 3000


def test_shuffled_files_of_a_staged_table_go_at_once(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {x for x in files.mkString("\n").split("\n") if x.endswith(".data") and "shuffle_" in x}

    setting = spark.conf.get(staging.SHUFFLE_CLEANUP)
    rows = spark.range(1000).repartition(4).groupBy((F.col("id") % 7).alias("k")).count()
    before = shuffled()
    got = staging.stage_table(rows, keep_shuffles=False)
    end = time.time() + 20  # Spark removes them in the background
    while shuffled() - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffled() - before
    assert got.count() == 7 and spark.conf.get(staging.SHUFFLE_CLEANUP) == setting


def row_groups(path):
    """Rows of each row group of a staged table, by file."""
    files = [pq.read_metadata(f"{path}/{f}") for f in sorted(os.listdir(path)) if f.endswith(".parquet")]
    return [[m.row_group(i).num_rows for i in range(m.num_row_groups)] for m in files]


def test_long_rows_are_stored_a_few_at_a_time(spark):
    """A task that writes or reads rows of some MB holds a few of them, not 100."""
    rows = spark.range(0, 20, 1, 1).selectExpr("id", "CAST(randstr(2000000, 7) AS BINARY) AS long")
    table = staging.stage_table(rows, long_rows=True)
    (groups,) = row_groups(staging.staged()[-1].removeprefix("file:"))
    assert sum(groups) == 20 and max(groups) <= 7
    assert [tuple(r) for r in table.groupBy("id").agg(F.max(F.length("long"))).sort("id").collect()] == [(i, 2000000) for i in range(20)]
