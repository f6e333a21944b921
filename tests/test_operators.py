"""Operators on small inputs with nulls, ties and empty sides."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators.grouping import first_of_each, places, sessions
from quarry.operators.joins import as_of_join, within_join
from quarry.sources import formats, shared, table
from quarry.streaming import windows

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


@pytest.mark.parametrize("span", [1800, 86_400, 10**7])
def test_as_of(spark, span):
    left = spark.createDataFrame([(1, 1, at(0)), (2, 1, at(5)), (3, 1, at(100)), (4, 2, at(3)), (5, None, at(3)), (6, 1, None)], "id int, k int, ts timestamp_ntz")
    right = spark.createDataFrame([(1, at(1), "a"), (1, at(5), "b"), (1, at(5), "c"), (1, at(6), "d"), (2, at(4), "e"), (None, at(0), "f")], "k int, ts timestamp_ntz, v string")
    got = {r.id: r.v for r in as_of_join(left, right, "k", "ts", ["v"], span).collect()}
    assert got == {1: None, 2: "c", 3: "d", 4: None, 5: None, 6: None}
    named = as_of_join(left.withColumn("v", F.lit("own")), right, "k", "ts", ["v"], span)
    assert named.columns == ["id", "k", "ts", "v"] and {r.id: r.v for r in named.collect()} == got
    with pytest.raises(ValueError):
        as_of_join(left.withColumn("_span", F.lit(1)), right, "k", "ts", ["v"], span)
    assert {r.v for r in as_of_join(left, right.limit(0), "k", "ts", ["v"], span).collect()} == {None}


def test_within(spark):
    left = spark.createDataFrame([(1, 1, at(0)), (2, 1, at(5)), (3, None, at(0))], "id int, k int, ts timestamp_ntz")
    right = spark.createDataFrame([(7, 1, at(0)), (8, 1, at(2)), (9, 1, at(5)), (10, 1, at(7)), (11, None, at(1))], "id int, k int, ts timestamp_ntz")
    got = sorted((r.id, r.next_id) for r in within_join(left, right, "k", "ts", 2 * 3600).collect())
    assert got == [(1, 8), (2, 10)]


def test_first_of_each(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), (None, 5), (None, 4)], "g string, v int")
    got = sorted((r.g or "", r.v, r["rank"]) for r in first_of_each(df, ["g"], [df.v.desc()], 2).collect())
    assert got == [("", 4, 2), ("", 5, 1), ("a", 2, 2), ("a", 3, 1)]


def test_sessions(spark):
    df = spark.createDataFrame([(1, at(0)), (1, at(0.2)), (1, at(3)), (2, at(0))], "k int, ts timestamp_ntz")
    got = sorted((r.k, r.started, r.ended, r["rows"]) for r in sessions(df, "k", "ts", 1800).collect())
    assert got == [(1, at(0), at(0.2), 2), (1, at(3), at(3), 1), (2, at(0), at(0), 1)]


@pytest.mark.parametrize("kind", formats.FORMATS)
def test_formats(spark, sf_dir, tmp_path, kind):
    df = table(spark, sf_dir, "conversations")
    formats.save(df, str(tmp_path / kind), kind)
    got = formats.load(df, str(tmp_path / kind), kind)
    assert got.schema == df.schema and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_partitioned_folder_is_pruned(spark, sf_dir, tmp_path):
    df = table(spark, sf_dir, "events").select("event_id", "event_type")
    formats.save(df, str(tmp_path / "p"), "parquet", ["event_type"])
    got = spark.read.parquet(str(tmp_path / "p")).where("event_type = 'view'")
    assert got.count() == df.where("event_type = 'view'").count()
    assert "PartitionFilters: [isnotnull(event_type" in got._jdf.queryExecution().toString()


def test_places(spark):
    rows = [(g, v, i) for i, (g, v) in enumerate([("a", 1), ("a", 1), ("a", 2), ("a", None), ("b", 5), (None, 3), (None, 3), (None, 4)] + [("hot", i // 3) for i in range(200)])]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = {r.i: (r["_rank"], r["_dense"], r["_upto"], r["_rows"]) for r in places(df, "g", ["v"]).collect()}
    for g, v, i in rows:
        key = lambda x: (x is not None, x or 0)  # noqa: E731  nulls first
        same = [key(x) for h, x, _ in rows if h == g]
        less = [x for x in same if x < key(v)]
        assert got[i] == (len(less) + 1, len(set(less)) + 1, sum(x <= key(v) for x in same), len(same))
    hot = sorted(r["_row"] for r in places(df, "g", ["v", "i"]).where("g = 'hot'").collect())
    assert hot == list(range(1, 201))
    assert places(df.limit(0), "g", ["v"]).count() == 0


@pytest.fixture
def late_events(spark, tmp_path):
    """Three files, one batch each; the last has a row of a day that is closed by then. (Spark
    drops rows by the watermark that the batch before started with.)"""
    batches = [[(1, at(10), 7, "view"), (2, at(10), 7, "view"), (3, at(58), 8, "buy")], [(7, at(57), 8, "buy")], [(4, at(11), 9, "view"), (5, at(59), 8, "buy"), (5, at(59), 8, "buy"), (6, None, 8, "buy")]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(e, ts, u, k, 1.0, "{}") for e, ts, u, k in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        if i < 2:
            time.sleep(1.1)  # files are taken in the order of their times
    return str(tmp_path)


def test_late_rows_are_dropped_and_repeated_ones_count(spark, late_events):
    got = sorted((r.started, r.event_type, r.n) for r in windows.tumbling(spark, late_events, 1).collect())
    assert got == [(at(0), "view", 2), (at(48), "buy", 4)]
    got = {r.started: (r.n, r.users) for r in windows.sliding(spark, late_events, 1).collect()}
    assert got[at(6)] == (2, 1) and got[at(36)] == got[at(54)] == (4, 1) and at(60) not in got
    got = sorted((r.user_id, r.event_type, r.first_ts) for r in windows.first_events(spark, late_events, 1).collect())
    assert got == [(7, "view", at(10)), (8, "buy", at(57))]


def test_streams_of_nothing(spark, sf_dir, tmp_path):
    table(spark, sf_dir, "events").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    for stream in (windows.tumbling, windows.sliding, windows.first_events):
        assert stream(spark, str(tmp_path)).count() == 0


def test_intermediate_tables_can_be_cleared(spark, sf_dir):
    from pathlib import Path

    df = shared.materialize(table(spark, sf_dir, "region"), "x")
    folder = Path(shared.shared_dir(spark).removeprefix("file:"))
    assert df.count() == 5 and any(folder.iterdir())
    shared.clear(spark)
    assert not folder.exists()
    shared.clear(spark)
