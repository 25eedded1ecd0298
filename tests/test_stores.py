import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clearlane import schemas
from clearlane.operators import cleaning, costing, monthly, quality
from clearlane.sources import readers, sinks, stores, warehouse
from tests.fixtures import decisions, groups, lines
from tests.test_warehouse import _claim_tables, _fact, _referral_tables


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def _rows(frame):
    return sorted(map(str, frame.collect()))


DAYS = [datetime(2019, 1, 31, 23, 59, 59, 999999), datetime(2019, 2, 1), datetime(2019, 2, 28), datetime(2019, 2, 28, 0, 0, 1), datetime(2019, 3, 1), datetime(2020, 2, 5), None]


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "lines")
    frame = lines(spark, *[{"auth_number": f"A{i}", "date_received": day} for i, day in enumerate(DAYS)])
    assert stores.write_referral_lines(frame, path)
    return frame, path


def test_a_closed_period_reads_its_months_only(spark, stored):
    frame, path = stored
    assert stores.write_referral_lines(frame.limit(0), path) is False
    window = ("2019-02-01", "2019-02-28")
    got = stores.read_referral_lines(spark, path, window)
    assert got.columns == schemas.REFERRAL_LINE.fieldNames()
    assert _rows(got) == _rows(frame.filter(warehouse.between_days("date_received", window)))
    scan = next(x for x in _plan(got).splitlines() if "FileScan" in x)
    assert "PartitionFilters: [isnotnull(month_received" in scan and ">= 2019-02" in scan and "<= 2019-02" in scan
    assert {f.split("month_received=")[1][:7] for f in got.inputFiles()} == {"2019-01", "2019-02", "2019-03", "2020-02", "__HIVE_"}
    read = stores.read_referral_lines(spark, path, window).select("auth_number").distinct()
    files = spark.read.parquet(path).filter("month_received = '2019-02'").select(F.input_file_name()).distinct().count()
    assert read.count() == 2 and files >= 1


def test_lines_without_a_date_are_in_no_period_but_among_all(spark, stored):
    frame, path = stored
    assert _rows(stores.read_referral_lines(spark, path)) == _rows(frame)
    assert stores.read_referral_lines(spark, path, ("1900-01-01", "2100-01-01")).count() == 6
    assert stores.read_referral_lines(spark, path, months=["2020-02", "1999-01"]).count() == 1


def test_bucketed_headers_and_details_join_without_an_exchange(spark, tmp_path):
    tables = _referral_tables(spark)
    tables = {**tables, "referral_hdr": tables["referral_hdr"].withColumn("referral_key", F.col("referral_key").cast("long")),
              "referral_det": tables["referral_det"].withColumn("referral_key", F.col("referral_key").cast("long"))}
    for name, hot in (("plain", 10**6), ("hot", 0)):
        path = str(tmp_path / name)
        assert stores.write_referrals(tables, path, 4, hot_rows=hot)
        assert stores.write_referrals(tables, path, 4, hot_rows=hot) is False
        assert sinks.target_exists(spark, f"{path}/hot") == (name == "hot")
        got = stores.read_referrals(spark, path)
        want = warehouse.referral_lines(tables).withColumn("ref_type_key", F.col("ref_type_key").cast("string"))
        assert want.count() == 1 and _rows(got) == _rows(want)
        assert stores.read_referrals(spark, path, ("2019-01-02", "2019-02-01")).count() == 0
        assert stores.read_referrals(spark, path, communities=["Elsewhere"]).count() == 0
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(stores.read_referrals(spark, str(tmp_path / "plain")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def test_claims_by_month_are_pruned_by_the_days_of_the_period(spark, tmp_path):
    tables = _claim_tables(spark, [_fact(day=d, cost=float(10 + d)) for d in (1, 2, 3, 4)] + [_fact(day=99), _fact(day=None)])
    path = str(tmp_path / "claims")
    assert stores.write_claims(tables["fact_claim"], tables["dim_date"], path)
    stored = {**tables, "fact_claim": stores.read_claims(spark, path, tables["fact_claim"].schema)}
    got = warehouse.claims_cost_stats(stored)
    assert _rows(got) == _rows(warehouse.claims_cost_stats(tables))
    assert "dynamicpruning" in _plan(got)
    assert spark.read.parquet(path).filter("service_month IS NULL").count() == 2


# --- one writer wins --------------------------------------------------------------------


def test_of_two_writers_one_wins_whole(spark, tmp_path):
    """Both pass the first check before either has written."""
    path = str(tmp_path / "table")
    meet, wins = threading.Barrier(2), {}

    def job(number: int) -> None:
        def write(aside: str) -> None:
            spark.range(1000).select(F.lit(number).alias("writer")).write.parquet(aside)
            meet.wait(60)

        wins[number] = sinks.publish(spark, path, write)

    jobs = [threading.Thread(target=job, args=(i,)) for i in (1, 2)]
    for thread in jobs:
        thread.start()
    for thread in jobs:
        thread.join(120)
    assert sorted(wins.values()) == [False, True]
    winner = next(i for i, won in wins.items() if won)
    assert [tuple(r) for r in spark.read.parquet(path).groupBy("writer").count().collect()] == [(winner, 1000)]
    assert sinks.children(spark, str(tmp_path)) == ["table"]
    assert not [x for x in sinks.children(spark, path) if x.startswith(("_aside", "_owner"))]


def test_a_relative_target_lies_in_the_working_folder(spark):
    files = sinks._path(spark, "x")[1]
    target, _ = sinks._path(spark, "x")
    assert target.getParent().toString().rstrip("/") == files.getWorkingDirectory().toString().rstrip("/")


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "table")

    def write(aside: str) -> None:
        spark.range(3).write.parquet(aside)
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError, match="stopped"):
        sinks.publish(spark, path, write)
    assert sinks.children(spark, str(tmp_path)) == []
    assert sinks.write_table(spark.range(3), path)
    with pytest.raises(FileExistsError):
        sinks.publish(spark, path, write, fail_if_exists=True)


# --- monthly states ------------------------------------------------------------------------


def test_calendar():
    assert monthly.months_of(("2018-12-31", "2019-02-01")) == ["2018-12", "2019-01", "2019-02"]
    assert monthly.whole_months(("2018-12-31", "2019-02-28")) == ["2019-01"]
    assert monthly.whole_months(("2019-02-01", "2019-03-01")) == ["2019-02"]
    assert monthly.month_window("2020-02") == ("2020-02-01 00:00:00", "2020-02-29 23:59:59.999999")
    assert monthly.months_of(("2019-03-01", "2019-02-01")) == []


def _many_lines(spark):
    rows = []
    for i in range(120):
        day = datetime(2019, 1 + i % 4, 1 + i % 28, i % 24)
        rows.append({
            "auth_number": f"A{i}", "date_received": None if i % 17 == 0 else day, "cpt_code": str(i % 3), "ppl": "Y" if i % 2 else None,
            "status_name": ("APPROVED - AUTO", "DENIED - MD", "PENDING - CM")[i % 5 % 3], "units": None if i % 11 == 0 else 1.0,
        })
    return lines(spark, *rows)


@pytest.mark.parametrize("window", [("2019-01-01", "2019-04-30 23:59:59.999999"), ("2019-01-10", "2019-04-02"), ("2019-02-03", "2019-02-20")])
def test_merged_line_states_are_the_figures_of_one_pass(spark, tmp_path, window):
    frame, path, state = _many_lines(spark), str(tmp_path / "lines"), str(tmp_path / "state")
    stores.write_referral_lines(frame, path)
    monthly.add_line_months(spark, path, state, ("2019-01-01", "2019-03-31 23:59:59.999999"))
    want = costing.code_profile(cleaning.clean_referrals(frame.filter(warehouse.between_days("date_received", window))))
    assert _rows(monthly.line_profile(spark, path, state, window)) == _rows(want.select(*monthly.line_profile(spark, path, state, window).columns))


def test_a_new_extract_reads_one_month(spark, tmp_path):
    path, state = str(tmp_path / "lines"), str(tmp_path / "state")
    stores.write_referral_lines(_many_lines(spark), path)
    assert monthly.add_line_months(spark, path, state, ("2019-01-01", "2019-03-31")) == ["2019-01", "2019-02"]
    # months that have a state are not read again: their folders may be gone
    files = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
    for month in ("2019-01", "2019-02"):
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/month_received={month}"), True)
    assert monthly.add_line_months(spark, path, state, ("2019-01-01", "2019-05-31 23:59:59.999999")) == ["2019-03", "2019-04", "2019-05"]
    assert monthly.stored_months(spark, state) == ["2019-01", "2019-02", "2019-03", "2019-04", "2019-05"]
    assert monthly.add_line_months(spark, path, state, ("2019-01-01", "2019-05-31 23:59:59.999999")) == []
    dated = _many_lines(spark).filter("date_received IS NOT NULL")
    want = costing.code_profile(cleaning.clean_referrals(dated))
    got = monthly.line_profile(spark, path, state, ("2019-01-01", "2019-05-31 23:59:59.999999"))
    assert _rows(got) == _rows(want.select(*got.columns))


def test_merged_claim_states_are_the_statistics_of_one_pass(spark, tmp_path):
    tables = _claim_tables(spark, [_fact(day=100 + i % 90, cost=float(i * i % 997 + 1)) for i in range(400)] + [_fact(day=100, code=2, cost=7.0)])
    days = [(100 + i, datetime.fromordinal(datetime(2018, 11, 15).toordinal() + i)) for i in range(90)]
    tables["dim_date"] = spark.createDataFrame(days, "date_sk int, date_bk timestamp_ntz")
    tables["dim_procedure_code"] = spark.createDataFrame([(1, "00812"), (2, "1")], "procedure_code_sk int, procedure_code string")
    state = str(tmp_path / "state")
    assert monthly.add_claim_months(tables, state, ("2018-11-01", "2019-02-28")) == ["2018-11", "2018-12", "2019-01"]
    for window in (("2018-11-01", "2019-02-28"), ("2018-11-20", "2019-01-31"), ("2018-12-05", "2018-12-20")):
        got = {r.cpt_code: r for r in monthly.claim_cost_stats(tables, state, window).collect()}
        want = {r.cpt_code: r for r in warehouse.claims_cost_stats(tables, window).collect()}
        assert got.keys() == want.keys()
        for code, row in want.items():
            assert (got[code].cnt_hcp_cost, got[code].avg_hcp_cost) == (row.cnt_hcp_cost, row.avg_hcp_cost)
            assert got[code].sd_hcp_cost == (row.sd_hcp_cost if row.sd_hcp_cost is None else pytest.approx(row.sd_hcp_cost, rel=1e-12))


# --- watched writes ------------------------------------------------------------------------


def test_checks_seen_while_writing_equal_the_scanned_ones(spark, tmp_path):
    frame = lines(spark, {"date_received": datetime(2019, 1, 1)}, {"date_received": datetime(2019, 6, 1), "lob": None}, {"date_received": None})
    table = groups(spark, {}, {"roi": None, "units_man": 0}).withColumn("cost_to_review", F.lit(5.0))
    sheet = decisions(spark, {"reason": "Typed By Hand"}, {})
    watched, seen_lines = quality.watch_lines(frame)
    stores.write_referral_lines(watched, str(tmp_path / "lines"))
    written, seen_groups = quality.watch_decisions(table)
    sinks.write_table(written, str(tmp_path / "groups"))
    got = quality.written_checks(seen_lines, seen_groups, sheet, "2019-07-01")
    assert _rows(got) == _rows(quality.quality_checks(frame, table, sheet, "2019-07-01"))
    assert tuple(quality.missing_lob_seen(spark, seen_lines).first()) == (3, 1)
    plan = _plan(quality.date_checks_seen(spark, seen_lines, "2019-07-01"))
    assert "FileScan" not in plan


def test_checks_of_an_empty_extract(spark, tmp_path):
    frame = lines(spark, {}).filter("units > 100")
    watched, seen = quality.watch_lines(frame)
    stores.write_referral_lines(watched, str(tmp_path / "lines"))
    assert _rows(quality.date_checks_seen(spark, seen, "2019-07-01")) == _rows(quality.date_checks(frame, "2019-07-01"))
    assert tuple(quality.missing_lob_seen(spark, seen).first()) == (0, 0)


# --- text with bad rows ----------------------------------------------------------------------


def test_bad_rows_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text("cpt_code,units,day\n0071,2.5,2019-01-01\n1,abc,2019-01-01\n2,1.0\n3,,\n")
    (tmp_path / "b.csv").write_text("cpt_code,units,day\n4,1.0,x,9\n5,y,z\n6,3.0,2019-02-02\n")
    schema = schemas._struct("units double, cpt_code string, day date")
    scan = readers.scan_delimited(spark, str(tmp_path), schema)
    assert sorted((r.cpt_code, r.units, str(r.day)) for r in scan.good.collect()) == [("0071", 2.5, "2019-01-01"), ("3", None, "None"), ("6", 3.0, "2019-02-02")]
    assert sorted((r.file, r.record, r.reason) for r in scan.rejected.collect()) == [
        ("a.csv", "1,abc,2019-01-01", "column units, not double: abc"),
        ("a.csv", "2,1.0", "number of cells"),
        ("b.csv", "4,1.0,x,9", "number of cells; column day, not date: x"),
        ("b.csv", "5,y,z", "column units, not double: y; column day, not date: z"),
    ]
    # the number of cells is checked whatever columns are wanted
    assert scan.good.select("cpt_code").count() == 3 and scan.rejected.count() == 4


def test_scan_needs_its_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("cpt_code,units\n1,2\n")
    with pytest.raises(ValueError, match="no column name"):
        readers.scan_delimited(spark, str(tmp_path), schemas._struct("name string"))
    with pytest.raises(ValueError, match="row numbers"):
        readers.scan_delimited(spark, str(tmp_path), schemas._struct("cpt_code string, units double"), saved_index=True)
