import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstone.functions import expressions as X
from gridstone.operators import asof, metrics, ratings, records
from gridstone.operators import timeseries as ts
from gridstone.plans import models, verification
from gridstone.sources import files


def values(df, column, *order):
    return [r[column] for r in df.orderBy(*order).collect()]


def series(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = [(k, t, rng.choice([None, 1.0, -2.0, 3.5])) for k in ("a", "b", None) for t in range(n)]
    return rows, spark.createDataFrame(rows, "k string, t int, v double")


def test_null_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0, None), (1.0, 2.0, 1.0), (1.0, None, float("nan"))], "n double, d double, x double")
    assert [r[0] for r in df.select(X.ratio("n", "d")).collect()] == [None, 0.5, None]
    assert [r[0] for r in df.select(X.truth(F.col("d") > 1)).collect()] == [False, True, False]
    assert [r[0] for r in df.select(X.differs(F.col("d"), F.col("x"))).collect()] == [True, True, True]
    assert [r[0] for r in df.select(X.nan_to_null("x")).collect()] == [None, 1.0, None]


def test_prior_windows_and_history(spark):
    rows, df = series(spark)
    out = df.withColumns({"s": ts.prior_sum("v", ["k"], ["t"]), "r": ts.rolling_prior("v", ["k"], ["t"], 3), "last": ts.last_known("v", ["k"], ["t"]), "n": ts.count_before(["k"], ["t"])})
    h, m = ts.padded_history(F.col("t"), ["k"], ["t"], 4)
    for r in out.withColumns({"h": h, "m": m}).collect():
        before = [v for k, t, v in rows if k == r["k"] and t < r["t"]]
        known = [v for v in before if v is not None]
        assert r["s"] == pytest.approx(sum(known)) and r["n"] == len(before)
        near = [v for v in before[-3:] if v is not None]
        assert r["r"] == (pytest.approx(sum(near)) if near else None)
        assert r["last"] == (known[-1] if known else None)
        got = list(range(max(0, r["t"] - 4), r["t"]))
        assert r["h"] == [None] * (4 - len(got)) + got and sum(r["m"]) == len(got)


@pytest.mark.parametrize("block", [4096, 16])
def test_weighted_mean(spark, monkeypatch, block):
    monkeypatch.setattr(ts, "BLOCK", block)
    rows, df = series(spark, 45)
    for r in ts.ewm_prior(df, "v", ["k"], ["t"], 0.5, "e").collect():
        w = [(4.0 ** -(r["t"] - t), v) for k, t, v in rows if k == r["k"] and t < r["t"] and v is not None]
        want = sum(a * v for a, v in w) / sum(a for a, _ in w) if w else None
        assert r["e"] == (pytest.approx(want, rel=1e-6) if w else None)


def test_streak(spark):
    rng = random.Random(2)
    rows = [(k, t, rng.choice([1, 1, -1, 0, None])) for k in "ab" for t in range(80)]
    got = ts.streak(spark.createDataFrame(rows, "k string, t int, o int"), "o", ["k"], ["t"], "s")
    for k in "ab":
        now, want = 0, []
        for _, _, o in (r for r in rows if r[0] == k):
            want.append(now)
            if o is not None:
                now = 0 if o == 0 else now + o if now * o > 0 else o
        assert values(got.filter(F.col("k") == k), "s", "t") == want


def test_strict_asof(spark):
    rng, day = random.Random(3), datetime.date(2020, 1, 1)
    date = lambda n: day + datetime.timedelta(days=n)
    left = [(i, rng.choice(["x", "y", None]), date(rng.randint(0, 20))) for i in range(80)]
    right = [(rng.choice(["x", "y", None]), date(rng.randint(0, 20)), i, rng.choice([None, float(i)])) for i in range(60)]
    got = asof.strict_asof(spark.createDataFrame(left, "i int, k string, d date"), spark.createDataFrame(right, "k string, d date, j int, v double"), ["k"], "d", "d", ["j", "v"], ties=["j"])
    for r in got.collect():
        best = max(((d, j, v) for k, d, j, v in right if k == r["k"] and k is not None and d < r["d"]), default=None, key=lambda x: x[:2])
        assert (r["j"], r["v"]) == ((best[1], best[2]) if best else (None, None))
    assert got.count() == len(left)
    assert asof.strict_asof(spark.createDataFrame([], "i int, k string, d date"), spark.createDataFrame(right, "k string, d date, j int, v double"), ["k"], "d", "d", ["j"]).count() == 0


def test_records(spark):
    df = spark.createDataFrame([("a", 1, "p", 1.0), ("a", 2, None, 2.0), ("a", 3, "q", None), ("b", 1, None, None)], "k string, t int, s string, v double")
    assert {tuple(r) for r in records.latest_values(df, ["k"], "t", ["s", "v"]).collect()} == {("a", "q", 2.0), ("b", None, None)}
    votes = spark.createDataFrame([("a", i, v) for i, v in enumerate("yxxyz")] + [("b", 0, None)], "k string, t int, v string")
    assert {tuple(r) for r in records.most_frequent(votes, ["k"], "v", F.col("t"), "m").collect()} == {("a", "y")}
    old, new = df.filter("t = 1"), df.withColumn("s", F.lit("new"))
    assert {r["s"] for r in records.first_source([old, new], ["k", "t"], ["t"]).filter("t = 1").collect()} == {"p", None}
    with pytest.raises(Exception, match="repeats a key"):
        records.one_to_one(df, df, ["k"]).collect()
    assert records.same_keys(df, new, ["k"]) and not records.same_keys(df, df.filter("k = 'a'"), ["k"])


def test_one_to_one_is_one_job_and_checks_itself(spark):
    left = spark.createDataFrame([(1, "a", None), (2, None, 5), (3, "c", 6), (None, "x", 1), (None, "y", 1)], "k int, s string, n int")
    right = spark.createDataFrame([(1, 1.0), (2, None), (4, 4.0)], "k int, x double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # under it each shuffle is a job of its own
    try:
        spark.sparkContext.setJobGroup("one", "one")
        got = records.one_to_one(left, right, ["k"])
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("one")
        assert got.columns == ["k", "s", "n", "x"] and sorted(map(tuple, got.collect())) == [(1, "a", None, 1.0), (2, None, 5, None)]
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("one")) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sparkContext.setJobGroup("rest", "rest")
    assert records.one_to_one(left, right.select("k"), ["k"]).count() == 2 and records.one_to_one(left.filter("false"), right, ["k"]).count() == 0
    twice = right.unionByName(right.filter("k = 4"))
    for a, b in ((left, twice), (twice, left)):
        with pytest.raises(Exception, match=r"repeats a key.*4"):
            records.one_to_one(a, b, ["k"]).select("k").collect()


def test_elo(spark):
    rows = [("l", i, i // 3, 2000 + i // 9, "ab"[i % 2], "c", i % 4 == 0, None if i == 5 else float(i % 5 - 2)) for i in range(18)]
    got = ratings.elo(spark.createDataFrame(rows, "league string, game_id int, at long, season int, home string, away string, neutral boolean, margin double")).orderBy("game_id").collect()
    assert got[0]["home_elo"] == got[0]["away_elo"] == 1500.0
    # first game: an even neutral game lost by two points
    gain = 20 * (math.log(3) * 2.2 / 2.2) * -0.5
    assert got[2]["home_elo"] == pytest.approx(1500 + gain)
    # a third of the way back at the new season, unplayed games change nothing
    assert abs(got[9]["home_elo"] - 1500) < 100 and len(got) == 18


def test_elo_in_steps(spark):
    rows = [("lm"[i % 5 == 0], i, i // 3, 2000 + i // 30, "abcd"[i % 4], "efg"[i % 3], i % 7 == 0, None if i % 11 == 5 else float(i % 9 - 4)) for i in range(90)]
    games = spark.createDataFrame(rows, "league string, game_id int, at long, season int, home string, away string, neutral boolean, margin double").repartition(3)
    want = {tuple(r) for r in ratings.elo(games).collect()}
    assert len(want) == 90 and {tuple(r) for r in ratings.elo(games, most=20).collect()} == want


def test_metrics_and_odds(spark):
    df = spark.createDataFrame([(0.5, 1.0, 0.6), (0.55, 1.0, 0.4), (0.9, 0.0, 0.7), (0.1, 0.0, None)], "p double, won double, market double")
    m = df.agg(*metrics.win_metrics(F.col("p"), F.col("won"))).first()
    assert m["n"] == 4 and m["accuracy"] == 0.5
    bins = {r["bin"]: r["games"] for r in metrics.confidence_buckets(df, F.col("p"), F.col("won"), F.col("market")).collect()}
    assert bins == {"(0.50, 0.55]": 1, "(0.75, 1.00]": 2}
    odd = spark.createDataFrame([(-150.0, 130.0)], "h double, a double").select(X.no_vig(F.col("h"), F.col("a"))).first()[0]
    assert odd == pytest.approx(0.6 / (0.6 + 100 / 230))
    x = np.linspace(-4, 4, 33).tolist()
    for v, p in spark.createDataFrame([(v,) for v in x], "v double").select("v", X.normal_cdf(F.col("v"))).collect():
        assert p == pytest.approx(0.5 * (1 + math.erf(v / math.sqrt(2))), abs=1e-6)


def test_ridge_and_logistic_equal_their_equations(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(150, 2))
    margin = a @ [3.0, -1.0] + rng.normal(size=150)
    rows = [(i, float(x), float(y) if i % 7 else None, float(m), float(m > 0)) for i, ((x, y), m) in enumerate(zip(a, margin, strict=True))]
    df = spark.createDataFrame(rows, "game_id int, diff_x double, diff_y double, margin double, won double")
    names = ["diff_x", "diff_y"]
    m = models.fit(df, names, "margin", models.ridge(50.0), True)
    assert m.preparation.medians["diff_y"] == pytest.approx(0) and m.preparation.flags == ["diff_y"]
    both = models.augmented(df.select(*names, "margin"), names, "margin", True)
    ready = m.preparation.apply(both).select("_x", "margin").collect()
    z, y = np.array([r["_x"].toArray() for r in ready]), np.array([r["margin"] for r in ready])
    want = np.linalg.solve(z.T @ z + 50 * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    assert np.allclose(m.model.coefficients.toArray(), want, atol=1e-6)
    w = models.fit(df, names, "won", models.logistic(0.1), False)
    got = w.predict(df.select("game_id", *names)).select("p").collect()
    assert all(0 < r["p"] < 1 for r in got)


def test_sources_and_sinks(spark, tmp_path):
    assert files.current_season(datetime.date(2024, 7, 31)) == 2023 and files.current_season(datetime.date(2024, 8, 1)) == 2024
    assert files.read_log(None) == files.read_log("no json") == {}
    a = spark.createDataFrame([(1999, "x", "7")], "season int, team string, n string")
    b = spark.createDataFrame([(2015, "y", "?", 1)], "season int, team string, n string, extra int")
    files.write_table(a, str(tmp_path / "a")), files.write_table(b, str(tmp_path / "b"))
    both = files.numbers(files.read_table(spark, str(tmp_path / "a"), str(tmp_path / "b")), ["n"])
    assert {(r["n"], r["extra"]) for r in both.collect()} == {(7.0, None), (None, 1)}
    files.write_in_ranges(both, str(tmp_path / "r"), [(1990, 2000), (2010, 2020)])
    assert {r["seasons"] for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {"1990_2000", "2010_2020"}
    files.write_csv(both, str(tmp_path / "c"), 2)
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def test_differences(spark):
    a = spark.createDataFrame([(1, 1.0, "s"), (2, None, "t"), (3, 1.0, None)], "k int, x double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-12, "s"), (2, 0.0, "u"), (4, 1.0, None)], "k int, x double, s string")
    assert {tuple(r) for r in verification.differences(a, b, ["k"], ["x", "s"]).collect()} == {("x", 3), ("s", 3)}
