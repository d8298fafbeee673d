import math
import random

import numpy as np
import pytest

from gridstone.operators import histtrees
from gridstone.plans import models


def data(n=700, seed=6):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.choice([0.0, 1.0, 2.0, 5.0])
        c = None if rng.random() < 0.3 else rng.uniform(-2, 2)
        y = 3 * (a > 0.2) - b + (2 if c is None else 0.5 * c) + rng.gauss(0, 0.3)
        out.append((i, a, b, c, None, y, float(y > 0)))
    return out


SCHEMA = "i int, diff_a double, b double, c double, nothing double, y double, won double"
NAMES = ["diff_a", "b", "c", "nothing"]


def plain(rows, label, classify, rate, depth, rounds, leaf, penalty, ends):
    """Row by row: every split of every feature and both sides for missing values, tried in order."""
    xs = [[None if r[1 + j] is None else sum(r[1 + j] > e for e in ends[f]) for j, f in enumerate(NAMES)] for r in rows]
    ys = [r[5 if label == "y" else 6] for r in rows]
    mean = sum(ys) / len(ys)
    raw = [math.log(mean / (1 - mean)) if classify else mean] * len(ys)

    def grow(ids, level):
        ps = [1 / (1 + math.exp(-raw[i])) if classify else None for i in ids]
        g = {i: (p - ys[i]) if classify else raw[i] - ys[i] for i, p in zip(ids, ps, strict=True)}
        h = {i: p * (1 - p) if classify else 1.0 for i, p in zip(ids, ps, strict=True)}
        of = lambda s: sum(g[i] for i in s) ** 2 / (sum(h[i] for i in s) + penalty)
        leaf_value = -rate * sum(g.values()) / (sum(h.values()) + penalty)
        best = None
        if level < depth:
            for j in range(len(NAMES)):
                gaps = any(xs[i][j] is None for i in ids)
                for missing_left in (False, True) if gaps else (False,):
                    for b in range(len(ends[NAMES[j]])):
                        left = [i for i in ids if (missing_left if xs[i][j] is None else xs[i][j] <= b)]
                        if leaf <= len(left) <= len(ids) - leaf:
                            inside = set(left)
                            right = [i for i in ids if i not in inside]
                            gain = of(left) + of(right) - of(ids)
                            if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                                best = gain, left, right
        if best is None:
            return dict.fromkeys(ids, leaf_value)
        return grow(best[1], level + 1) | grow(best[2], level + 1)

    for _ in range(rounds):
        step = grow(list(range(len(ys))), 0)
        raw = [x + step[i] for i, x in enumerate(raw)]
    return raw


@pytest.mark.parametrize(("classify", "label"), [(False, "y"), (True, "won")])
def test_equals_the_plain_form(spark, monkeypatch, classify, label):
    monkeypatch.setattr(histtrees, "KEPT", 2)
    rows = data(260)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(histtrees.thresholds, "__defaults__", (12,))
    ends = histtrees.thresholds(df, NAMES)
    assert ends["b"] == [0.0, 1.0, 2.0] and ends["nothing"] == [] and len(ends["diff_a"]) == 11
    model = histtrees.HistogramBoosting(classify, 0.3, 2, 3, leaf=20).fit(df, NAMES, label)
    want = plain(rows, label, classify, 0.3, 2, 3, 20, 1.0, ends)
    got = {r["i"]: r["p"] for r in df.select("i", model.value().alias("p")).collect()}
    for i, raw in enumerate(want):
        assert got[i] == pytest.approx(1 / (1 + math.exp(-raw)) if classify else raw, abs=1e-9)
    again = histtrees.Model.of(model.told())
    assert {r["i"]: r["p"] for r in df.select("i", again.value().alias("p")).collect()} == pytest.approx(got)


def test_many_values_are_cut_at_even_ranks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    ends = histtrees.thresholds(df, ["x"])["x"]
    sizes = np.bincount(np.searchsorted(ends, x))
    assert len(sizes) == histtrees.BINS and sizes.min() >= 11 and sizes.max() <= 12


def test_leaves_and_missing_values(spark):
    df = spark.createDataFrame(data(), SCHEMA)
    model = histtrees.HistogramBoosting(False, 0.5, 3, 2, leaf=80).fit(df, NAMES, "y")
    rows = np.array([[np.nan if v is None else v for v in r[1:5]] for r in data()])
    for t in model.trees:
        counts = np.bincount(t.nodes(histtrees.bin_of(rows, model.ends)), minlength=len(t.feature))
        assert all(c >= 80 for c, f in zip(counts, t.feature, strict=True) if f < 0)
    flat = histtrees.HistogramBoosting(False, 0.5, 3, 1, leaf=400).fit(df, NAMES, "y")
    assert flat.trees[0].feature == [-1] and flat.trees[0].value[0] == pytest.approx(0, abs=1e-12)
    with pytest.raises(ValueError, match="no labelled row"):
        histtrees.HistogramBoosting(False, 0.5, 3, 1).fit(df.filter("false"), NAMES, "y")


def test_candidates_use_it_and_are_saved(spark, tmp_path):
    features, estimator, margin = models.candidates(NAMES)["hgb_reg_lr0.03_d3_n300"]
    kind = estimator(1, 1.0)
    assert isinstance(kind, histtrees.HistogramBoosting) and margin and (kind.rate, kind.depth, kind.rounds, kind.leaf, kind.penalty) == (0.03, 3, 300, 80, 1.0)
    df = spark.createDataFrame(data(300), SCHEMA).withColumnsRenamed({"y": "margin", "i": "game_id"})
    m = models.fit(df, NAMES, "margin", models.boosted(False, 0.2, 2, 2, 20), True)
    models.save(spark, str(tmp_path / "m"), {"trees": m}, {})
    back = models.restore(spark, str(tmp_path / "m"))[0]["trees"]
    a, b = ({r["game_id"]: r["margin_hat"] for r in x.predict(df).collect()} for x in (m, back))
    assert a == pytest.approx(b) and len(set(a.values())) > 3
    turned = df.select("game_id", *models.flipped(NAMES))
    assert {r["game_id"]: -r["margin_hat"] for r in m.predict(turned).collect()} == pytest.approx(a)
