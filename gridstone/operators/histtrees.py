"""Boosted trees from histograms of gradients.

Values become bins once. A level of a tree is one pass: tasks sum gradients,
curvatures and rows by (node, feature, bin), the sums meet in one aggregation, and
the driver, which holds histograms and trees but no rows, takes each node's best
split. Missing values have a bin of their own and go to the side that gains more;
the leaf penalty counts in gains and leaf values; a leaf has a least number of rows.
Rows carry the prediction of the trees so far and are written anew every KEPT
trees; the trees since then are walked in each pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.operators import scans
from gridstone.operators.quantiles import value_counts
from gridstone.session import settled

#: Bins of known values, and the bin of missing ones.
BINS, MISSING = 255, 255
#: Trees that passes walk before the rows are written with their predictions.
KEPT = 25


def thresholds(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """By feature the upper ends of all bins but the last: every value but the largest if there are few, else values at even ranks."""
    counts = value_counts(rows.select("*", F.lit(0).alias("_all")), features, "_all").filter("value is not null").select("column", "value", "n")
    wide = counts.groupBy("column").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("total"))
    ranked = scans.prefixes(counts, ["column"], ["value"], sums={"upto": "n"}, inclusive=True).join(F.broadcast(wide), "column")  # a row a feature
    step = lambda c: F.floor(c * bins / F.col("total"))
    ends = F.when(F.col("values") <= bins, F.col("upto") < F.col("total")).otherwise((step(F.col("upto")) > step(F.col("upto") - F.col("n"))) & (F.col("upto") < F.col("total")))
    out: dict[str, list[float]] = {f: [] for f in features}
    for r in ranked.filter(ends).select("column", "value").collect():  # at most `bins` rows a feature
        out[r["column"]].append(r["value"])
    return {f: sorted(v) for f, v in out.items()}


@dataclass
class Tree:
    """Nodes by number; a node without a feature is a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int, missing_left: bool, values: tuple[float, float]) -> tuple[int, int]:
        a, b = len(self.feature), len(self.feature) + 1
        self.feature[node], self.bin[node], self.missing_left[node], self.left[node], self.right[node] = feature, bin_, missing_left, a, b
        for v in values:
            self.feature.append(-1)
            self.bin.append(0)
            self.missing_left.append(False)
            self.left.append(0)
            self.right.append(0)
            self.value.append(v)
        return a, b

    def nodes(self, binned: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(binned), np.int64)
        feature, left, right = np.array(self.feature), np.array(self.left), np.array(self.right)
        while True:
            on = np.flatnonzero(feature[at] >= 0)
            if not len(on):
                return at
            k = at[on]
            b = binned[on, feature[k]]
            go = np.where(b == MISSING, np.array(self.missing_left)[k], b <= np.array(self.bin)[k])
            at[on] = np.where(go, left[k], right[k])

    def values(self, binned: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(binned)]


def bin_of(x: np.ndarray, ends: list[list[float]]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(ends):
        out[:, j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(e, x[:, j]))
    return out


def gradients(y: np.ndarray, raw: np.ndarray, classify: bool) -> tuple[np.ndarray, np.ndarray]:
    if not classify:
        return raw - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-raw))
    return p - y, p * (1 - p)


@dataclass
class Histogram:
    """Of a node: sums by feature and bin (the last bin: missing values)."""

    g: np.ndarray
    h: np.ndarray
    n: np.ndarray

    def best(self, penalty: float, leaf: int) -> tuple[float, int, int, bool, tuple[float, float]] | None:
        """Gain, feature, bin, whether missing values go left, and both sides' shares (minus gradient over curvature and penalty); None if no split gains."""
        g, h, n = (x[:, :MISSING].cumsum(axis=1)[:, None, :-1] for x in (self.g, self.h, self.n))
        side = np.array([0.0, 1.0])[None, :, None]  # missing values right, left
        gm, hm, nm = (x[:, MISSING][:, None, None] * side for x in (self.g, self.h, self.n))
        g, h, n = g + gm, h + hm, n + nm
        G, H, N = self.g[0].sum(), self.h[0].sum(), self.n[0].sum()
        ok = (n >= leaf) & (N - n >= leaf)
        ok[:, 1] &= (self.n[:, MISSING] > 0)[:, None]  # without missing values both sides are one
        if not ok.any():
            return None
        score = np.where(ok, g**2 / (h + penalty) + (G - g) ** 2 / (H - h + penalty) - G**2 / (H + penalty), -np.inf)
        f, m, b = np.unravel_index(int(score.argmax()), score.shape)
        if score[f, m, b] <= 1e-12:
            return None
        gl, hl = g[f, m, b], h[f, m, b]
        # where no missing value was met they go with the more rows
        left = bool(m) if self.n[f, MISSING] > 0 else bool(2 * n[f, m, b] > N)
        return float(score[f, m, b]), int(f), int(b), left, (-gl / (hl + penalty), -(G - gl) / (H - hl + penalty))


@dataclass
class Model:
    features: list[str]
    ends: list[list[float]]
    base: float
    trees: list[Tree]
    classify: bool

    def raw(self, frame: pd.DataFrame) -> np.ndarray:
        binned = bin_of(frame[self.features].to_numpy(float), self.ends)
        return self.base + sum((t.values(binned) for t in self.trees), np.zeros(len(frame)))

    def value(self) -> Column:
        """The predicted value, or the probability."""
        model = self

        @F.pandas_udf("double")
        def predicted(x: pd.DataFrame) -> pd.Series:
            raw = model.raw(x.astype(float))
            return pd.Series(1 / (1 + np.exp(-raw)) if model.classify else raw)

        return predicted(F.struct(*(F.col(f"`{f}`").cast("double").alias(f) for f in self.features)))

    def told(self) -> dict:
        """All of it in plain values."""
        return {"features": self.features, "ends": self.ends, "base": self.base, "classify": self.classify, "trees": [vars(t) for t in self.trees]}

    @classmethod
    def of(cls, told: dict) -> Model:
        return cls(told["features"], told["ends"], told["base"], [Tree(**t) for t in told["trees"]], told["classify"])


@dataclass
class HistogramBoosting:
    classify: bool
    rate: float
    depth: int
    rounds: int
    leaf: int = 80
    penalty: float = 1.0

    def fit(self, rows: DataFrame, features: Sequence[str], label: str) -> Model:
        features = list(features)
        known = rows.select(*(F.col(f"`{f}`").cast("double").alias(f) for f in features), F.col(label).cast("double").alias("_y")).filter("_y is not null")
        by = thresholds(known, features)
        mean = known.agg(F.avg("_y")).first()[0]
        if mean is None:
            raise ValueError("there is no labelled row")
        share = min(max(mean, 1e-12), 1 - 1e-12)
        model = Model(features, [by[f] for f in features], float(np.log(share / (1 - share))) if self.classify else float(mean), [], self.classify)
        state = settled(self._binned(known, model))
        for _ in range(self.rounds):
            tree = self._tree(state, model)
            model.trees.append(tree)
            if len(model.trees) % KEPT == 0 and len(model.trees) < self.rounds:
                state = settled(self._moved(state, model.trees[-KEPT:]))
        return model

    def _binned(self, rows: DataFrame, model: Model) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in frames:
                binned = bin_of(df[model.features].to_numpy(float), model.ends)
                yield pd.DataFrame({"bins": [r.tobytes() for r in binned], "y": df["_y"], "raw": model.base})

        return rows.mapInPandas(run, "bins binary, y double, raw double")

    def _moved(self, state: DataFrame, trees: list[Tree]) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in frames:
                binned = np.frombuffer(b"".join(df["bins"]), np.uint8).reshape(len(df), -1)
                yield df.assign(raw=df["raw"] + sum(t.values(binned) for t in trees))

        return state.mapInPandas(run, "bins binary, y double, raw double")

    def _tree(self, state: DataFrame, model: Model) -> Tree:
        since = model.trees[len(model.trees) - len(model.trees) % KEPT :]
        tree, open_ = Tree(), [0]
        for _ in range(self.depth):
            got = self._histograms(state, since, tree, open_, len(model.features)) if open_ else {}
            new = []
            for node in open_:
                found = got[node].best(self.penalty, self.leaf) if node in got else None
                if node == 0 and found is None and node in got:
                    tree.value[0] = -self.rate * float(got[0].g[0].sum() / (got[0].h[0].sum() + self.penalty))
                if found:
                    _, feature, bin_, missing_left, shares = found
                    new += tree.split(node, feature, bin_, missing_left, (self.rate * float(shares[0]), self.rate * float(shares[1])))
            open_ = new
        return tree

    def _histograms(self, state: DataFrame, since: list[Tree], tree: Tree, nodes: list[int], n_features: int) -> dict[int, Histogram]:
        """Of the open nodes, in one pass."""
        classify, width = self.classify, BINS + 1

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros((len(nodes), n_features, 3, width))
            offset = np.arange(n_features) * width
            for df in frames:
                binned = np.frombuffer(b"".join(df["bins"]), np.uint8).reshape(len(df), -1)
                raw = df["raw"].to_numpy() + sum((t.values(binned) for t in since), np.zeros(len(df)))
                g, h = gradients(df["y"].to_numpy(), raw, classify)
                at = tree.nodes(binned)
                for k, node in enumerate(nodes):
                    on = np.flatnonzero(at == node)
                    cell = (binned[on] + offset).ravel()
                    for j, weight in enumerate((g, h, np.ones(len(df)))):
                        sums[k, :, j] += np.bincount(cell, np.repeat(weight[on], n_features), n_features * width).reshape(n_features, width)
            for k, node in enumerate(nodes):
                yield pd.DataFrame({"node": node, "i": np.arange(n_features), "row": list(sums[k].reshape(n_features, -1))})

        out: dict[int, np.ndarray] = {}
        for r in scans.summed_rows(state.mapInPandas(run, "node int, i int, row array<double>"), ["node"]):
            out.setdefault(r["node"], np.zeros((n_features, 3 * width)))[r["i"]] = r["row"]
        return {k: Histogram(*np.split(x, 3, axis=1)) for k, x in out.items()}
