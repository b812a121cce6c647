"""The route for large groups must equal plain windows."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evengap.operators import chains, evaluate, features, skew
from evengap.plans import headways, trip_features


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows in one group, a null key, and gaps in the order."""
    df = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN null ELSE concat('g', id % 40) END AS g",
        "id * 7 % 3001 AS pos", "cast(id % 11 AS double) AS v", "id")
    return df.withColumn("v", F.when(F.col("id") % 13 > 0, F.col("v")))


def columns(w):
    return {"back": F.lag("v", 3).over(w), "next": F.lead("v", 2).over(w),
            "roll": F.sum("v").over(w.rowsBetween(-2, 0)), "fwd": F.sum("v").over(w.rowsBetween(1, 2))}


def same(a, b):
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("limit", [5, 100, 999, 5000])
def test_along_equals_plain_windows(rows, limit):
    order = [F.col("pos")]
    got = skew.along(rows, ["g"], order, columns, {"lo": F.min("v"), "n": F.count("*")}, back=3, ahead=2, limit=limit)
    w = W.partitionBy("g")
    want = rows.select("*", F.min("v").over(w).alias("lo"), F.count("*").over(w).alias("n"),
                       *[c.alias(n) for n, c in columns(w.orderBy("pos")).items()])
    same(got, want)


@pytest.mark.parametrize("limit", [5, 100, 5000])
def test_running_equals_plain_windows(rows, limit):
    got = skew.running(rows, ["g"], [F.col("pos").desc()], {"rn": F.lit(1), "s": F.col("v")}, limit=limit)
    w = W.partitionBy("g").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)
    want = rows.select("*", F.count("*").over(w).cast("int").alias("rn"),
                       F.coalesce(F.sum("v").over(w), F.lit(0.0)).alias("s"))
    same(got.withColumn("rn", F.col("rn").cast("int")), want)


def test_running_without_keys(rows):
    got = skew.running(rows, [], [F.col("id")], {"rn": F.lit(1)}, limit=50)
    assert got.filter("rn <> id + 1").count() == 0 and got.columns == [*rows.columns, "rn"]


def test_large_groups_are_found(rows):
    assert skew.large_groups(rows, ["g"], 5000) is None
    assert [r["g"] for r in skew.large_groups(rows, ["g"], 500).collect()] == ["hot"]


def test_the_last_key_is_evaluated_in_large_groups_only(spark):
    df = spark.range(1000).selectExpr("id % 4 AS a", "if(id = 3, null, id % 8) AS b", "raise_error('evaluated') AS c")
    assert skew.large_groups(df, ["a", "c"], 250) is None
    half = spark.range(1000).selectExpr("if(id % 4 = 3, null, id % 4) AS a", "if(id % 4 = 3, 7, id) AS b")
    assert [(r.a, r.b) for r in skew.large_groups(half, ["a", "b"], 249).collect()] == [(None, 7)]


def test_a_large_group_is_found_in_a_small_file(spark, tmp_path):
    """Equal rows take little room: the size of the files says nothing of the groups."""
    spark.range(skew.GROUP_ROWS + 10).selectExpr("if(id < 5, 1, 2) AS g").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert [r["g"] for r in skew.large_groups(df, ["g"], skew.GROUP_ROWS).collect()] == [2]


def test_operators_agree_on_both_routes(spark):
    """One stop and one trip hold a large part of the rows."""
    ev = spark.range(1200).selectExpr(
        "20240105 + id % 2 AS date", "'4' AS LineNumber", "0 AS direction_id",
        "if(id % 3 = 0, 1, 2 + id % 40) AS trip_id", "id % 40 AS VehicleID", "cast(id AS int) AS stop_sequence",
        "if(id % 4 < 2, 7, id % 9) AS observed_stop_id", "300D AS dist_traveled",
        "20000 + id * 30 AS scheduled_arrival_time_sfm",
        "if(id % 17 = 0, null, 20000 + id * 30 + id * 37 % 200) AS observed_arrival_time_sfm",
        "if(id % 17 = 0, null, 20010 + id * 30 + id * 37 % 200) AS observed_departure_time_sfm",
        "if(id % 17 = 0, null, id * 37 % 200) AS observed_arrival_delay",
        "if(id % 17 = 0, null, id * 37 % 200 + id % 5) AS observed_departure_delay")
    plain, blocked = headways(ev), headways(ev, limit=20)
    same(plain, blocked.select(plain.columns))
    a, b = trip_features(plain), trip_features(plain, limit=20)
    same(a, b)
    same(chains.chain_onsets(a), chains.chain_onsets(a, limit=20))
    same(chains.chain_lengths(a), chains.chain_lengths(a, limit=20))
    same(features.with_long_lags(plain), features.with_long_lags(plain, limit=20))
    scored = a.selectExpr("1 AS k", "date", "coalesce(y_k1, 0) AS y", "round(1 / (1 + abs(headway_ratio)), 2) AS score"
                          ).filter("score IS NOT NULL")
    same(evaluate.score_cuts(scored), evaluate.score_cuts(scored, limit=3))


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {str(files.apply(i).getName()) for i in range(files.size()) if "shuffle_" in files.apply(i).getName()}


def test_lookups_and_stored_tables_leave_no_shuffle_files(spark, rows):
    before = shuffle_files(spark)
    assert skew.large_groups(rows.repartition(3, "id"), ["g", "pos"], 10**6) is None
    stored = skew.durable(rows.repartition(3, "id"))
    assert shuffle_files(spark) <= before
    assert spark.conf.get(skew.CLEANUP) == "false" and not skew._SWITCHED
    assert stored.count() == rows.count()


def test_passing_tables_go_and_others_stay(spark, rows, tmp_path, monkeypatch):
    folders = iter([f"{tmp_path}/{i}" for i in range(3)])
    monkeypatch.setattr(skew, "shared_folder", lambda spark: next(folders))
    kept = skew.durable(rows)
    with pytest.raises(ValueError), skew.passing(spark):
        skew.durable(rows)
        with skew.passing(spark):
            skew.durable(rows)
        assert sorted(p.name for p in tmp_path.iterdir()) == ["0", "1"]
        raise ValueError
    assert [p.name for p in tmp_path.iterdir()] == ["0"] and kept.count() == rows.count()
