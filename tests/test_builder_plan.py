"""The builder deals its wide rows once, and windows of one order share a sort."""

import re

import pytest
from pyspark.sql import functions as F

from gridstone.operators import records
from gridstone.operators import timeseries as ts
from gridstone.plans import pregame
from tests.league import league


@pytest.fixture
def no_small_tables(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wide_rows_are_dealt_once(spark, no_small_tables):
    text = plan(pregame.team_features(league(spark, seasons=(2020,), weeks=3)))
    assert text.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in text
    assert text.count("Sort [") <= 7


def test_a_streak_takes_one_sort(spark):
    df = spark.createDataFrame([("a", t, o) for t, o in enumerate((1, 1, None, 0, -1, -1))], "k string, t int, o int").repartition("k")
    got = ts.streak(df, "o", ["k"], ["t"], "s")
    assert plan(got).count("Sort [") == 1
    assert [r["s"] for r in got.orderBy("t").collect()] == [0, 1, 2, 2, 0, -1]


def test_several_means_share_their_sorts(spark):
    df = spark.createDataFrame([("a", t, float(t), None if t == 1 else 2.0 * t) for t in range(4)], "k string, t int, x double, y double").repartition("k")
    got = ts.ewm_priors(df, {"e": "x", "f": "y"}, ["k"], ["t"], 8.0)
    one = ts.ewm_prior(ts.ewm_prior(df, "x", ["k"], ["t"], 8.0, "e"), "y", ["k"], ["t"], 8.0, "f")
    assert plan(got).count("Sort [") <= 3
    assert sorted(got.collect()) == sorted(one.collect())


def nodes(df, name):
    """How often an operator stands in the plan's tree, without what is spelled out below it."""
    return sum(bool(re.match(rf"[ :+\-*()\d]*{name}\b", line)) for line in plan(df).splitlines())


def test_windows_share_their_passes(spark):
    assert 0 < nodes(pregame.team_features(league(spark, seasons=(2020,), weeks=3)), "Window") <= 6


def test_a_games_two_rows_meet_without_a_join(spark, no_small_tables):
    given = league(spark, seasons=(2020,), weeks=3)
    g = pregame.schedule(given["games"])
    team = spark.createDataFrame([("x", 1, 1.0), ("x", 0, 3.0)], "game_id string, is_home int, a double")
    assert nodes(pregame.game_rows(g, team, F.struct("a"), ["a"]), "SortMergeJoin") == 1  # with the schedule
    key = given["games"].first()["game_id"]
    rows = pregame.game_rows(g, team.withColumn("game_id", F.lit(key)), F.struct("a"), ["a"]).collect()
    assert [(r["home_a"], r["away_a"], r["diff_a"]) for r in rows if r["game_id"] == key] == [(1.0, 3.0, -2.0)]
    assert len(rows) == g.count() and all(r["home_a"] is r["away_a"] is None for r in rows if r["game_id"] != key)


def test_ratings_are_folded_where_they_are_asked_for(spark):
    given = league(spark, seasons=(2020,), weeks=3)
    g = pregame.schedule(given["games"])
    assert "MapInPandas" in plan(pregame.team_rows(g, given["ps"]))
    bare = pregame.team_features(given, ratings=False)
    whole = pregame.team_features(given)
    assert "MapInPandas" not in plan(pregame.team_rows(g, given["ps"], ratings=False)) and bare.columns == whole.columns
    rest = [c for c in whole.columns if c not in ("elo", "season_avg_opp_elo")]
    assert sorted(map(str, bare.select(rest).collect())) == sorted(map(str, whole.select(rest).collect()))


def test_latest_values_hash_before_they_sort(spark, no_small_tables):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("a", 3, None)], "k string, t int, v string")
    got = records.latest_values(df, ["k"], "t", ["v"])
    assert nodes(got, "HashAggregate") == 2
    assert [tuple(r) for r in got.collect()] == [("a", "z")]


def test_means_carry_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ts, "BLOCK", 4)
    values = [3.0, None, 1.0, 4.0, 1.0, 5.0, 9.0, None, 2.0, 6.0, 5.0, 3.0, 5.0]
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate(values)], "k string, t int, x double")
    got = [r["e"] for r in ts.ewm_prior(df, "x", ["k"], ["t"], 0.5, "e").orderBy("t").collect()]
    for t in range(len(values)):  # of a row's block and the one before it; what is older weighs nothing in blocks of full size
        seen = [(v, 2.0 ** ((j - t) / 0.5)) for j, v in enumerate(values[:t]) if v is not None and j >= (t // 4 - 1) * 4]
        want = sum(v * w for v, w in seen) / sum(w for _, w in seen) if seen else None
        assert got[t] == (want if want is None else pytest.approx(want))
