import datetime
import random

import pytest
from pyspark.sql import functions as F

from gridstone.operators import quantiles, scans
from gridstone.operators import timeseries as ts
from gridstone.operators.asof import strict_asof

START = datetime.datetime(2024, 1, 1)


def rows_of(seed, n=600, hot=0.7):
    """A third key of its own, one hot key, null keys and times; ties in time."""
    rng = random.Random(seed)
    key = lambda: "hot" if rng.random() < hot else rng.choice(["a", "b", None, "c"])
    return [(i, key(), START + datetime.timedelta(hours=rng.randint(0, 90)) if rng.random() > 0.02 else None, rng.choice([None, 1, 2, 5]), rng.random()) for i in range(n)]


SCHEMA = "i long, k string, t timestamp, v long, x double"


def same(a, b):
    key = lambda r: tuple(str(v) for v in r)
    return sorted(map(tuple, a.select(*b.columns).collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_prefixes_equal_the_windows(spark, ranges):
    df = spark.createDataFrame(rows_of(1), SCHEMA).repartition(5)
    by, order = ["k"], ["t", "i"]
    want = df.withColumns({"s": ts.prior_sum("v", by, order), "l": ts.last_known("v", by, order), "n": ts.count_before(by, order)})
    assert same(scans.prefixes(df, by, order, {"s": "v"}, {"l": "v"}, ["n"], ranges=ranges), want)
    want = df.withColumns({"s": F.coalesce(ts.running_sum("v", by, order), F.lit(0))})
    assert same(scans.prefixes(df, by, order, {"s": "v"}, inclusive=True, ranges=ranges), want)


@pytest.mark.parametrize("ranges", [1, 4, 24])
def test_asof_equals_the_one_window_form(spark, ranges):
    left = spark.createDataFrame(rows_of(2), SCHEMA)
    right = spark.createDataFrame(rows_of(3), SCHEMA).withColumnsRenamed({"x": "y", "t": "at"}).withColumn("at", F.coalesce("at", F.lit(START)))
    right = right.filter("k is not null")
    for l, lt in ((left, "t"), (left.withColumn("d", F.to_date("t")), "d")):
        r, rt = (right, "at") if lt == "t" else (right.withColumn("e", F.to_date("at")), "e")
        known = l.filter(F.col(lt).isNotNull())
        got = scans.strict_asof(known, r, ["k"], lt, rt, ["y", "v2"] if "v2" in r.columns else ["y"], ties=["i"], ranges=ranges)
        assert same(got, strict_asof(known, r, ["k"], lt, rt, ["y"], ties=["i"]))
    nobody = scans.strict_asof(left, right.filter("false"), ["k"], "t", "at", ["y"])
    assert nobody.count() == left.count() and nobody.filter("y is not null").isEmpty()
    assert scans.strict_asof(left.filter("false"), right, ["k"], "t", "at", ["y"]).collect() == []
    assert scans.strict_asof(left, right, ["k"], "t", "at", ["y"]).filter("(k is null or t is null) and y is not null").isEmpty()


def test_one_key_is_many_tasks_work(spark):
    """All rows of one key: each task's share of the windows stays near the mean."""
    n, ranges = 40_000, 16
    left = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 2).alias("t"), "id")
    right = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 2 - 1).alias("t"), F.col("id").alias("p"))
    whole = scans.laid(left.select("k", "t").unionByName(right.select("k", "t")), ["k"], ["t"], ranges)
    sizes = [r["count"] for r in whole.groupBy(scans.PART).count().collect()]
    assert len(sizes) == ranges and max(sizes) < 2 * sum(sizes) / ranges
    got = scans.strict_asof(left, right, ["k"], "t", "t", ["p"], ranges=ranges)
    assert got.filter("p <> id").isEmpty() and got.filter("p is not null").count() == n


@pytest.mark.parametrize("ranges", [1, 5])
def test_medians_of_every_fold(spark, ranges):
    rng = random.Random(8)
    rows = [(rng.choice([2001, 2002, 2003, 2005]), rng.choice([None, 1.0, 2.5, -3.0]), rng.choice([None, *range(40)]), None, float(i) if i > 150 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "season int, a double, b int, c double, d double")
    cuts, names = [2001, 2002, 2003, 2004, 2006], ["a", "b", "c", "d"]
    got = {(r["column"], r["cutoff"]): (r["median"], r["missing"]) for r in quantiles.medians_before(df, names, cuts, ranges=ranges).collect()}
    for cut in cuts:
        part = df.filter(F.col("season") < cut)
        want = part.agg(*(F.median(c).alias(c) for c in names), *(F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in names)).first()
        for c in names:
            assert got[c, cut] == (want[c], want[f"n_{c}"])
