"""Walk-forward fits of all folds and strengths at once, from statistics that add up.

A row is v = (1, z, m, y): its features with zeros for missing values, the marks of
missing values, its labels. Filling by a fold's medians and scaling are linear in v, and so is
the view from the other side. So one pass that sums v v' by season holds every ridge fit of
every fold: prefix sums over seasons give a fold, a small solve gives a strength. Logistic fits
take Newton steps, all folds and strengths in one pass a step. The driver holds matrices of the
number of features, by season, fold and strength; never rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.functions.expressions import normal_cdf
from gridstone.operators.quantiles import medians_before
from gridstone.operators.scans import summed_rows

#: Steps after which, and step size below which, a logistic fit ends.
STEPS, SMALL = 50, 1e-10


def is_odd(feature: str) -> bool:
    """Whether the other side sees the feature negated."""
    return feature.startswith("diff_") or feature == "home_adv"


@dataclass
class Layout:
    """Where v holds what."""

    features: list[str]
    labels: list[str]

    @property
    def p(self) -> int:
        return len(self.features)

    def z(self, feature: str) -> int:
        return 1 + self.features.index(feature)

    def m(self, feature: str) -> int:
        return 1 + self.p + self.features.index(feature)

    def y(self, label: str) -> int:
        return 1 + 2 * self.p + self.labels.index(label)

    @property
    def size(self) -> int:
        return 1 + 2 * self.p + len(self.labels)

    def flip(self, margins: Sequence[str] = ("margin",)) -> np.ndarray:
        """The matrix of the view from the other side: odd features and margins negated, wins one minus themselves."""
        d = np.eye(self.size)
        for f in self.features:
            if is_odd(f):
                d[self.z(f), self.z(f)] = -1
        for label in self.labels:
            d[self.y(label), self.y(label)] = -1
            if label not in margins:
                d[self.y(label), 0] = 1
        return d

    def rows(self, df: pd.DataFrame) -> np.ndarray:
        x = df[self.features].to_numpy(float)
        missing = np.isnan(x)
        return np.column_stack([np.ones(len(df)), np.where(missing, 0, x), missing, df[self.labels].to_numpy(float)])


def _needed(rows: DataFrame, features: Sequence[str], labels: Sequence[str], season: str) -> DataFrame:
    return rows.select(F.col(season).cast("long").alias("season"), *(F.col(c).cast("double").alias(c) for c in (*features, *labels)))


def moments(rows: DataFrame, layout: Layout, season: str = "season") -> dict[int, np.ndarray]:
    """The sum of v v' of each season, in one pass."""
    n = layout.size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for df in frames:
            v = layout.rows(df)
            of = df["season"].to_numpy()
            for s in np.unique(of):
                some = v[of == s]
                sums[int(s)] = sums.get(int(s), 0) + some.T @ some
        for s, x in sums.items():
            yield pd.DataFrame({"season": s, "i": np.arange(n), "row": list(x)})

    parts = _needed(rows, layout.features, layout.labels, season).mapInPandas(run, "season long, i int, row array<double>")
    out: dict[int, np.ndarray] = {}
    for r in summed_rows(parts, ["season"]):
        out.setdefault(r["season"], np.zeros((n, n)))[r["i"]] = r["row"]
    return out


@dataclass
class Prepared:
    """A fold's filled and scaled columns as a matrix over v: a constant, the features that have a median, the marks of missing values."""

    t: np.ndarray
    names: list[str]
    n: float


def prepared(s: np.ndarray, medians: dict[str, float | None], layout: Layout, features: Sequence[str]) -> Prepared:
    """s: the fold's sum of v v', both orientations."""
    kept = [f for f in features if medians[f] is not None]
    flags = [f for f in kept if s[0, layout.m(f)] > 0]
    t = np.zeros((1 + len(kept) + len(flags), layout.size))
    t[0, 0] = 1
    for k, f in enumerate(kept, 1):
        t[k, layout.z(f)], t[k, layout.m(f)] = 1, medians[f]
    for k, f in enumerate(flags, 1 + len(kept)):
        t[k, layout.m(f)] = 1
    n = s[0, 0]
    raw = t @ s @ t.T
    mean = raw[0] / n
    square = np.diag(raw) / n
    variance = square - mean**2
    sd = np.where(variance > 1e-13 * np.maximum(square, 1e-300), np.sqrt(np.maximum(variance, 0)), 1.0)
    for k in range(1, len(t)):
        t[k] = (t[k] - mean[k] * t[0]) / sd[k]
    return Prepared(t, [*kept, *(f"{f}_missing" for f in flags)], n)


class Folds:
    """The sums before every cutoff, and every fold's medians: two passes over the rows, whatever the number of folds and strengths."""

    def __init__(self, rows: DataFrame, features: Sequence[str], labels: Sequence[str] = ("margin", "won"), season: str = "season", cutoffs: Sequence[int] = ()):
        self.layout, self.rows, self.season = Layout(list(features), list(labels)), rows, season
        self.by_season = moments(rows, self.layout, season)
        self.seasons = sorted(self.by_season)
        self.flip = self.layout.flip()
        wanted = set(cutoffs) | set(self.seasons) | {self.seasons[-1] + 1} if self.seasons else set(cutoffs)
        self.medians: dict[int, dict[str, float | None]] = {c: {} for c in wanted}
        # the other side's odd features mirror a row's own: their medians are 0, if any is known, and need no count of values
        odd = [f for f in features if is_odd(f)]
        for c in wanted if self.seasons else ():
            n = self.before(c)
            self.medians[c] = {f: 0.0 if n[0, 0] > n[0, self.layout.m(f)] else None for f in odd}
        even = [f for f in features if not is_odd(f)]
        for r in medians_before(rows, even, sorted(wanted), season).collect() if wanted and even else []:  # a row a feature and cutoff
            self.medians[r["cutoff"]][r["column"]] = r["median"]

    def before(self, cutoff: int) -> np.ndarray:
        zero = np.zeros((self.layout.size, self.layout.size))
        return sum((self.by_season[s] for s in self.seasons if s < cutoff), zero)

    def both(self, cutoff: int) -> np.ndarray:
        s = self.before(cutoff)
        return s + self.flip @ s @ self.flip.T

    def prepared(self, cutoff: int, features: Sequence[str]) -> Prepared:
        return prepared(self.both(cutoff), self.medians[cutoff], self.layout, features)

    def ridge(self, cutoff: int, alpha: float, features: Sequence[str], label: str = "margin") -> tuple[np.ndarray, dict[str, float]]:
        """The prediction, mean of both orientations, as weights of v, and the coefficients of the scaled columns."""
        s, ready = self.both(cutoff), self.prepared(cutoff, features)
        y = self.layout.y(label)
        gram, side = ready.t @ s @ ready.t.T, ready.t @ s[:, y]
        centre = s[0, y] / ready.n
        w = np.linalg.solve(gram[1:, 1:] + alpha * np.eye(len(gram) - 1), side[1:] - centre * gram[0, 1:]) if len(gram) > 1 else np.zeros(0)
        full = np.concatenate([[centre], w]) @ ready.t
        return (full - full @ self.flip) / 2, dict(zip(ready.names, w.tolist(), strict=True))

    def errors(self, weights: np.ndarray, seasons: Sequence[int], label: str = "margin") -> tuple[float, float, float]:
        """n, mean and mean square of label minus prediction over whole seasons."""
        s = sum((self.by_season[x] for x in seasons if x in self.by_season), np.zeros((self.layout.size, self.layout.size)))
        r = -weights.copy()
        r[self.layout.y(label)] += 1
        n = s[0, 0]
        return n, (r @ s[0]) / n if n else 0.0, (r @ s @ r) / n if n else 0.0

    def sigma(self, cutoff: int, alpha: float, features: Sequence[str]) -> float:
        """Deviation of the errors on the last two seasons before the cutoff, of the fit on those before them."""
        past = [s for s in self.seasons if s < cutoff]
        if len(past) > 2:
            weights, _ = self.ridge(past[-2], alpha, features)
            seasons = past[-2:]
        else:
            weights, seasons = np.zeros(self.layout.size), past
        _, mean, square = self.errors(weights, seasons)
        return float(np.sqrt(max(square - mean**2, 0.0))) or 1.0

    def logistic(self, fits: Sequence[tuple[int, float, tuple[str, ...]]], label: str = "won") -> dict[tuple, tuple[np.ndarray, dict[str, float]]]:
        """For each (cutoff, C, features): the log odds as weights of v, and the coefficients of the scaled columns. One job a Newton step, for all fits together."""
        ready = {f: self.prepared(f[0], f[2]) for f in fits}
        w = {f: np.zeros(len(ready[f].t)) for f in fits}
        moving, y = set(fits), self.layout.y(label)
        for _ in range(STEPS):
            if not moving:
                break
            now = sorted(moving, key=str)
            got = self._gradients(now, ready, w, y)
            for k, f in enumerate(now):
                g, h = got[k][:, -1].copy(), got[k][:, :-1].copy()
                g[1:] += w[f][1:] / f[1]
                h[np.arange(1, len(h)), np.arange(1, len(h))] += 1 / f[1]
                step = np.linalg.solve(h, g)
                w[f] = w[f] - step
                if np.abs(step).max() < SMALL:
                    moving.discard(f)
        return {f: (w[f] @ ready[f].t, dict(zip(ready[f].names, w[f][1:].tolist(), strict=True))) for f in fits}

    def _gradients(self, fits: list[tuple], ready: dict, w: dict, y: int) -> dict[int, np.ndarray]:
        """By fit the Hessian and, as its last column, the gradient of the summed losses of both orientations."""
        layout, flip = self.layout, self.flip
        plan = [(f[0], ready[f].t, w[f]) for f in fits]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = [np.zeros((len(t), len(t) + 1)) for _, t, _ in plan]
            for df in frames:
                v, of = layout.rows(df), df["season"].to_numpy()
                for k, (cutoff, t, at) in enumerate(plan):
                    some = v[of < cutoff]
                    for rows in (some, some @ flip.T):
                        x = rows @ t.T
                        p = 1 / (1 + np.exp(-(x @ at)))
                        sums[k][:, :-1] += (x * (p * (1 - p))[:, None]).T @ x
                        sums[k][:, -1] += x.T @ (p - rows[:, y])
            for k, x in enumerate(sums):
                yield pd.DataFrame({"fit": k, "i": np.arange(len(x)), "row": list(x)})

        parts = _needed(self.rows, layout.features, layout.labels, self.season).mapInPandas(run, "fit int, i int, row array<double>")
        out = {k: np.zeros((len(t), len(t) + 1)) for k, (_, t, _) in enumerate(plan)}
        for r in summed_rows(parts, ["fit"]):
            out[r["fit"]][r["i"]] = r["row"]
        return out

    def predictions(self, fits: dict[tuple[str, int], tuple[np.ndarray, float | None]], key: str = "game_id", also: Sequence[str] = ()) -> DataFrame:
        """key, season, model, margin_hat, p of each model in its season, and the rows' columns named in `also`. fits: by (model, season) the weights of v, and sigma of a margin model."""
        lay, spark = self.layout, self.rows.sparkSession
        odd = np.array([1.0, *(-1.0 if is_odd(f) else 1.0 for f in lay.features), *[1.0] * lay.p])
        table = []
        for (model, season), (weights, sigma) in fits.items():
            mine = weights[: 1 + 2 * lay.p]
            table.append((model, season, mine.tolist(), (mine * odd).tolist(), sigma))
        of = spark.createDataFrame(table, "model string, season long, w array<double>, u array<double>, sigma double")
        known = [F.col(f"`{f}`").cast("double") for f in lay.features]
        v = F.array(F.lit(1.0), *(F.coalesce(c, F.lit(0.0)) for c in known), *(c.isNull().cast("double") for c in known))
        kept = [F.col(c).alias(f"_also_{c}") for c in also]
        rows = self.rows.select(key, F.col(self.season).cast("long").alias("season"), v.alias("v"), *kept).join(F.broadcast(of), "season")  # a row a model and season
        dot = lambda c: F.aggregate(F.zip_with("v", c, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        half = lambda x: 1 / (1 + F.exp(-x))
        margin = F.col("sigma").isNotNull()
        rows = rows.withColumn("_a", dot("w")).withColumn("_b", dot("u"))
        p = F.when(margin, normal_cdf(F.col("_a") / F.col("sigma"))).otherwise((half(F.col("_a")) + 1 - half(F.col("_b"))) / 2)
        return rows.select(key, "season", "model", F.when(margin, F.col("_a")).alias("margin_hat"), p.alias("p"), *(F.col(f"_also_{c}").alias(c) for c in also))


#: Names of models: kind and strength, on which features.
Candidate = tuple[str, float, tuple[str, ...]]


def walk_forward(rows: DataFrame, models: dict[str, Candidate], seasons: Sequence[int], key: str = "game_id", season: str = "season", also: Sequence[str] = ()) -> DataFrame:
    """key, season, model, margin_hat, p, and the rows' columns named in `also`: each season's predictions by all models, fitted on the seasons before.

    models: by name the kind ("ridge" of `margin`, "logit" of `won`), its strength and features."""
    features = list(dict.fromkeys(f for _, _, names in models.values() for f in names))
    folds = Folds(rows, features, season=season, cutoffs=seasons)
    fits: dict[tuple[str, int], tuple[np.ndarray, float | None]] = {}
    logits = [(s, c, names) for kind, c, names in models.values() if kind == "logit" for s in seasons]
    odds = folds.logistic(list(dict.fromkeys(logits)))
    for name, (kind, strength, names) in models.items():
        for s in seasons:
            fits[name, s] = (folds.ridge(s, strength, names)[0], folds.sigma(s, strength, names)) if kind == "ridge" else (odds[s, strength, names][0], None)
    return folds.predictions(fits, key, also)
