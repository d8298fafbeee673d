import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstone.plans import folds, models

NAMES = ["diff_x", "diff_y", "temp", "is_playoff", "diff_none", "home_adv"]
SCHEMA = "game_id int, season int, diff_x double, diff_y double, temp double, is_playoff int, diff_none double, home_adv double, margin double, won double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for i in range(420):
        x, y, t = rng.normal(size=3)
        margin = 3 * x - y + 1.5 + rng.normal() * 2
        out.append((i, 2010 + i % 5, float(x), None if i % 7 == 0 else float(y), None if i % 5 == 1 or i % 11 == 0 else float(60 + 20 * t), int(i % 9 == 0), None, 1.0 - (i % 13 == 0), float(margin), float(margin > 0)))
    return spark.createDataFrame(out, SCHEMA).repartition(3).cache()


def test_ridges_of_all_folds_equal_the_single_fits(spark, rows):
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("folds", "folds")
    f = folds.Folds(rows, NAMES)
    n_jobs = len(jobs.getJobIdsForGroup("folds"))
    for cutoff in (2012, 2013, 2015):
        for alpha in (1.0, 300.0):
            f.ridge(cutoff, alpha, NAMES)
            f.sigma(cutoff, alpha, NAMES)
    assert len(jobs.getJobIdsForGroup("folds")) == n_jobs  # fits of further folds and strengths read nothing
    spark.sparkContext.setJobGroup("rest", "rest")
    for cutoff, alpha, names in ((2012, 1.0, NAMES), (2015, 300.0, NAMES), (2014, 30.0, ["diff_y", "temp"])):
        train, test = rows.filter(F.col("season") < cutoff), rows.filter(F.col("season") == min(cutoff, 2014))
        one = models.fit_margin(train, names, models.ridge(alpha))
        w, coefficients = f.ridge(cutoff, alpha, names)
        got = {r["game_id"]: r for r in f.predictions({("m", min(cutoff, 2014)): (w, f.sigma(cutoff, alpha, names))}).collect()}
        for r in one.predict(test).collect():
            assert got[r["game_id"]]["margin_hat"] == pytest.approx(r["margin_hat"], abs=1e-8)
            assert got[r["game_id"]]["p"] == pytest.approx(r["p"], abs=1e-8)
        assert f.sigma(cutoff, alpha, names) == pytest.approx(one.sigma, rel=1e-8)
        assert "diff_none" not in coefficients and len(coefficients) == len(one.model.coefficients)


def test_logistic_fits_of_all_folds_equal_the_single_fits(spark, rows):
    jobs = spark.sparkContext.statusTracker()
    fits = [(2012, 0.01, tuple(NAMES)), (2015, 1.0, tuple(NAMES)), (2014, 0.1, ("diff_x", "home_adv"))]
    f = folds.Folds(rows, NAMES)
    counts = []
    for k, some in enumerate((fits[1:2], fits)):
        spark.sparkContext.setJobGroup(f"newton{k}", "newton")
        got = f.logistic(some)
        counts.append(len(jobs.getJobIdsForGroup(f"newton{k}")))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert counts[1] <= counts[0] + 6  # jobs follow the steps, not the folds
    for cutoff, c, names in fits:
        train, test = rows.filter(F.col("season") < cutoff), rows.filter(F.col("season") == min(cutoff, 2014))
        one = models.fit(train, list(names), "won", models.logistic(c), False)
        mine = {r["game_id"]: r["p"] for r in f.predictions({("m", min(cutoff, 2014)): (got[cutoff, c, names][0], None)}).collect()}
        for r in one.predict(test).collect():
            assert mine[r["game_id"]] == pytest.approx(r["p"], abs=1e-6)


def test_few_seasons_and_rows(spark, rows):
    f = folds.Folds(rows, NAMES)
    past = rows.filter("season < 2012")
    assert f.sigma(2012, 5.0, NAMES) == pytest.approx(past.agg(F.stddev_pop("margin")).first()[0])
    none = folds.Folds(rows.filter("false"), NAMES)
    assert none.seasons == [] and none.by_season == {}
    whole = folds.walk_forward(rows, {"r": ("ridge", 30.0, ("diff_x",)), "l": ("logit", 0.1, ("diff_x", "temp"))}, [2011, 2012, 2013, 2014])
    assert whole.count() == 2 * rows.filter("season > 2010").count()
    assert whole.filter("p is null or p < 0 or p > 1 or (model = 'r') <> (margin_hat is not null)").isEmpty()
