import gzip

import pytest
from pyspark.sql import functions as F

from events import events, trip
from evengap.operators import describe, features, select
from evengap.plans import bus_subset, headways
from evengap.sources import (append_results, compact_results, open_clustered, pending, read_events, read_results,
                             read_static, read_table, results_wide, write_clustered, write_report, write_table)


def test_files_with_other_column_orders_are_read_by_name(spark, tmp_path):
    with gzip.open(tmp_path / "m01.csv.gz", "wt") as f:
        f.write("date,LineNumber,trip_id,TransportMode,stop_sequence\n20240101,185H,1,BUS,1\n20240101,4,2,BUS,\n")
    with gzip.open(tmp_path / "m02.csv.gz", "wt") as f:
        f.write("trip_id,date,TransportMode,LineNumber,tripupdates_not_merged_with_stoptimes_or_trip\n"
                "3,20240201,BUS,4,1\n4,20240201,TRAM,4,0\nx,20240201,BUS,4,0\n")
    df = read_events(spark, f"{tmp_path}/m*.csv.gz", partitions=3)
    assert dict(df.dtypes)["LineNumber"] == "string" and dict(df.dtypes)["trip_id"] == "bigint"
    got = {(r["trip_id"], r["date"], r["LineNumber"], r["stop_sequence"]) for r in df.collect()}
    assert got == {(1, 20240101, "185H", 1), (2, 20240101, "4", None), (3, 20240201, "4", None),
                   (4, 20240201, "4", None), (None, 20240201, "4", None)}
    kept = bus_subset(df, lines=["4"])
    assert kept.count() == 3 and "merge_flag_2" in kept.columns
    with pytest.raises(FileNotFoundError):
        read_events(spark, [])


def test_files_without_a_typed_column_keep_their_rows(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("LineNumber,trip_id\n4,1\n")
    (tmp_path / "c d.csv").write_text("trip_id,stop\n2,x\n3,y\n")
    (tmp_path / "empty.csv").write_text("")
    df = read_events(spark, f"{tmp_path}/*.csv", types={"LineNumber": "string"})
    assert {(r["LineNumber"], r["trip_id"], r["stop"]) for r in df.collect()} == {("4", "1", None), (None, "2", "x"), (None, "3", "y")}


def test_jobs_do_not_grow_with_the_files(spark, tmp_path):
    def jobs(n: int) -> int:
        folder = tmp_path / f"n {n}"
        folder.mkdir()
        for i in range(n):
            (folder / f"f{i}.csv").write_text(f"trip_id,date\n{i},2024\n" if i % 2 else f"date,trip_id\n2024,{i}\n")
        spark.sparkContext.setJobGroup(f"read {n}", "")
        df = read_events(spark, f"{folder}/*.csv")
        spark.sparkContext.setJobGroup("other", "")
        assert sorted(r["trip_id"] for r in df.collect()) == list(range(n)) and {r["date"] for r in df.collect()} == {2024}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"read {n}"))

    assert jobs(100) == jobs(200) < 6  # headers, and one job to list the files of each of three scans


def test_given_columns_are_checked_by_the_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text("trip_id,date\n1,2024\nx,2024\n")
    df = read_events(spark, f"{tmp_path}/*.csv", columns=["trip_id", "date"])
    assert {r["trip_id"] for r in df.collect()} == {1, None}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_events(spark, f"{tmp_path}/*.csv", columns=["trip_id", "date"], strict=True).collect()
    with pytest.raises(Exception, match="(?i)header"):
        read_events(spark, f"{tmp_path}/*.csv", columns=["date", "trip_id"]).collect()


def test_only_first_lines_are_headers(spark, tmp_path):
    """A cell may hold a column's name, and a file may begin with blank lines."""
    (tmp_path / "a.csv").write_text("\n \n\ufefftrip_id,LineNumber\n1,date\n2,trip_id\n")
    df = read_events(spark, f"{tmp_path}/a.csv")
    assert {(r["trip_id"], r["LineNumber"]) for r in df.collect()} == {(1, "date"), (2, "trip_id")}


def test_bytes_read_for_headers_do_not_grow_with_the_files(spark, tmp_path):
    """The end of a large file is damaged: whoever reads on fails."""
    body = b"".join(b"%d,%d\n" % (i, i * 7919 % 100_003) for i in range(3_000_000))
    data = gzip.compress(b"trip_id,date\n" + body, 1)
    (tmp_path / "big.csv.gz").write_bytes(data[:len(data) // 2] + bytes(100_000) + data[len(data) // 2:])
    with gzip.open(tmp_path / "small.csv.gz", "wt") as f:
        f.write("date,trip_id\n2024,1\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    df = read_events(spark, f"{tmp_path}/*.csv.gz")
    assert df.columns == ["trip_id", "date"] and spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    with pytest.raises(Exception):
        df.count()


def test_static_table_with_semicolons(spark, tmp_path):
    (tmp_path / "stops.csv").write_text("stop_id;stop_name;stop_lat;parent_station\n1;A, B;59.3;\n2;C;;7\n")
    typed = read_static(spark, str(tmp_path / "stops.csv"), ";", "stop_id long, stop_lat double, parent_station long")
    assert [tuple(r) for r in typed.orderBy("stop_id").collect()] == [(1, 59.3, None), (2, None, 7)]
    assert read_static(spark, str(tmp_path / "stops.csv"), ";").first()["stop_name"] == "A, B"


def test_round_trip_and_partition_pruning(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "if(id % 4 = 0, 'test', 'train') AS split", "id * 0.5D AS v")
    write_table(df, f"{tmp_path}/t", partition_by=["split"])
    back = read_table(spark, f"{tmp_path}/t")
    assert back.select(df.columns).exceptAll(df).count() == 0 and back.count() == 100
    plan = back.filter("split = 'test'").select("v")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "ReadSchema: struct<v:double>" in plan


def test_ledger_is_taken_up_again(spark, tmp_path):
    configs = spark.createDataFrame([("gbt", 3, n) for n in ("a", "b", "c")], "model string, k int, name string")
    path = f"{tmp_path}/ledger"
    assert pending(configs, path).count() == 3
    append_results(configs.filter("name = 'a'").withColumn("value", F.lit(0.5)), path)
    append_results(configs.filter("name = 'b'").withColumn("value", F.lit(0.7)), path)
    assert [r["name"] for r in pending(configs, path).collect()] == ["c"]
    assert describe.best_by(spark.read.parquet(path), ["model", "k"], "value").first()["name"] == "b"


def test_a_trial_that_is_stored_twice_counts_once(spark, tmp_path):
    row = lambda name, value, k=3: spark.createDataFrame([("gbt", k, name, "auc", value)],
                                                          "model string, k int, name string, metric string, value double")
    for name, value, k in (("a", 0.9, 3), ("b", 0.7, 3), ("a", 0.5, 3), ("c", 0.1, None), ("c", None, None)):
        append_results(row(name, value, k), f"{tmp_path}/ledger")
    want = [("a", 3, 0.5), ("b", 3, 0.7), ("c", None, None)]
    got = read_results(spark, f"{tmp_path}/ledger").orderBy("name").collect()
    assert [(r["name"], r["k"], r["value"]) for r in got] == want
    compact_results(spark, f"{tmp_path}/ledger", f"{tmp_path}/whole")
    assert len(list((tmp_path / "whole").glob("*.parquet"))) == 1
    got = read_results(spark, f"{tmp_path}/whole").orderBy("name").collect()
    assert [(r["name"], r["k"], r["value"]) for r in got] == want


def test_windows_over_a_clustered_stage_need_no_exchange(spark, tmp_path):
    hw = headways(events(spark, *[trip(i, 30000 + 600 * i, [30000 + 600 * i + 70 * j for j in range(12)]) for i in range(9)]))
    options = ("stage_hw", ["date", "trip_id"], ["stop_sequence"], 8)
    stage = write_clustered(hw, f"{tmp_path}/hw", *options)
    assert stage.columns == hw.columns and stage.exceptAll(hw).isEmpty() and hw.exceptAll(stage).isEmpty()
    builders = [features.with_history, features.with_targets, features.with_long_lags, features.with_sched_run,
                features.sequence_frame]
    for opened in (stage, None):
        if opened is None:
            spark.sql("DROP TABLE stage_hw")  # the files stay
            opened = open_clustered(spark, f"{tmp_path}/hw", *options)
        for build in builders:
            frame = build(opened)
            assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString(), build.__name__
            assert frame.exceptAll(build(hw)).isEmpty() and frame.count() == 108
    look = opened.groupBy("date", "trip_id").count()  # the look-up of large groups
    assert "Exchange" not in look._jdf.queryExecution().executedPlan().toString()


def test_wide_results(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (2, "a", 0.3)], "k int, model string, v double")
    wide = results_wide(df, "v", values=["a", "b"]).orderBy("k")
    assert [tuple(r) for r in wide.collect()] == [(1, 0.1, 0.2), (2, 0.3, None)]
    write_report(wide, f"{tmp_path}/report")
    assert spark.read.csv(f"{tmp_path}/report", header=True).count() == 2


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "key")
    one = {r[0] for r in describe.sample_n(df, ["key"], 700, 1).collect()}
    again = {r[0] for r in describe.sample_n(df.repartition(7), ["key"], 700, 1).collect()}
    other = {r[0] for r in describe.sample_n(df, ["key"], 700, 2).collect()}
    assert len(one) == 700 and one == again and one != other
    assert describe.sample_n(df, ["key"], 9999).count() == 5000
    ranks = describe.with_hash_rank(df, ["key"], 1).agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).first()
    assert tuple(ranks) == (1, 5000, 5000)


def test_line_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("cast(id AS string) AS LineNumber", "'BUS' AS TransportMode", "id AS trip_id",
                               "id AS other").write.parquet(f"{tmp_path}/e")
    df = select.select_lines(read_table(spark, f"{tmp_path}/e"), "BUS", ["4", "5"]).select("trip_id")
    plan = df._jdf.queryExecution().toString()
    assert "In(LineNumber, [4,5])" in plan and "EqualTo(TransportMode,BUS)" in plan
    assert "other" not in plan.split("ReadSchema")[1]
