"""Win and margin models: preparation, linear fits, boosted trees, walk-forward evaluation."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.functions.expressions import normal_cdf
from gridstone.operators import histtrees, metrics
from gridstone.operators.histtrees import HistogramBoosting
from gridstone.plans import folds
from gridstone.session import settled
from gridstone.sources import files


# fixed values: what a schedule tells of a game, beside the differences of both sides
CONTEXT = ["is_playoff", "div_game", "is_indoor", "is_grass", "temp", "wind", "is_primetime"]
# fixed values: the hand-picked features
CURATED = [
    "diff_elo",
    "diff_ewm_pt_diff",
    "diff_season_avg_pt_diff",
    "diff_prev_season_pt_diff_pg",
    "diff_qb_last8_anya",
    "diff_qb_career_anya",
    "diff_ewm_off_anya",
    "diff_ewm_def_anya_allowed",
    "diff_season_off_anya",
    "diff_season_def_anya_allowed",
    "diff_rest_days",
    "diff_off_bye",
    "diff_inj_exp_qb_out_or_doubtful",
    "diff_qb_changed_last_game",
    "diff_qb_career_starts",
    "diff_season_to_margin_pg",
    "diff_coach_new_this_season",
    "diff_season_avg_opp_elo",
    "diff_win_pct",
    "diff_div_rank",
    "home_adv",
    "is_playoff",
]
RATING = ["diff_elo", "home_adv"]
# fixed values: the models chosen by walk-forward validation, for winners and for margins
WINNERS = ["ridge_a3000", "curated_ridge_a3000", "curated_logit_C0.001", "hgb_reg_lr0.03_d3_n300"]
MARGINS = ["ridge_a3000", "curated_ridge_a3000", "hgb_reg_lr0.03_d3_n300"]
# fixed values: validation and test seasons
VALIDATION, TEST = list(range(2015, 2023)), [2023, 2024]
#: Smallest leaf of the boosted trees.
LEAF = 80


def flipped(features: Sequence[str]) -> list[Column]:
    """The features as the other side sees them: differences and the home side's advantage negated, the game's own as they are."""
    return [(-F.col(c)).alias(c) if c.startswith("diff_") or c == "home_adv" else F.col(c) for c in features]


def augmented(df: DataFrame, features: Sequence[str], label: str, margin: bool = False) -> DataFrame:
    """The rows and the rows seen from the other side: features flipped, the label negated or, of wins, one minus it."""
    other = -F.col(label) if margin else 1 - F.col(label)
    rest = [c for c in df.columns if c not in (*features, label)]
    return df.unionByName(df.select(*rest, *flipped(features), other.alias(label)))


@dataclass
class Preparation:
    """Median filling with indicators of missing values, then scaling; columns never seen are left out."""

    medians: dict[str, float] = field(default_factory=dict)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)
    flags: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame, features: Sequence[str], scaled: bool = True) -> Preparation:
        row = df.agg(*(F.median(c).alias(f"m_{c}") for c in features), *(F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in features)).first()
        self.medians = {c: float(row[f"m_{c}"]) for c in features if row[f"m_{c}"] is not None}
        self.flags = [c for c in self.medians if row[f"n_{c}"]]
        raw = self._raw()
        names = [c for c, _ in raw]
        if not scaled:
            self.scales = dict.fromkeys(names, (0.0, 1.0))
            return self
        got = df.select(*(e.alias(c) for c, e in raw)).agg(*(F.avg(c).alias(f"a_{c}") for c in names), *(F.stddev_pop(c).alias(f"s_{c}") for c in names)).first()
        self.scales = {c: (got[f"a_{c}"], got[f"s_{c}"] or 1.0) for c in names}
        return self

    def _raw(self) -> list[tuple[str, Column]]:
        filled = [(c, F.coalesce(F.col(c).cast("double"), F.lit(m))) for c, m in self.medians.items()]
        return filled + [(f"{c}_missing", F.col(c).isNull().cast("double")) for c in self.flags]

    def apply(self, df: DataFrame) -> DataFrame:
        parts = [((e - self.scales[c][0]) / self.scales[c][1]).alias(f"x_{c}") for c, e in self._raw()]
        out = df.select("*", *parts)
        names = [f"x_{c}" for c, _ in self._raw()]
        return VectorAssembler(inputCols=names, outputCol="_x").transform(out).drop(*names)


@dataclass
class Fitted:
    preparation: Preparation
    model: object
    features: list[str]
    margin: bool
    sigma: float | None = None
    #: Whether predictions are the mean of both orientations.
    both: bool = True

    def _value(self, df: DataFrame, name: str) -> DataFrame:
        if isinstance(self.model, histtrees.Model):
            return df.withColumn(name, self.model.value())
        out = self.model.transform(self.preparation.apply(df))
        return out.withColumn(name, F.col("prediction") if self.margin else vector_to_array("probability")[1])

    def predict(self, df: DataFrame, key: str = "game_id") -> DataFrame:
        """The rows with `margin_hat` or `p`: the mean of both orientations, if it was fitted on both; both are computed on the row itself."""
        name = "margin_hat" if self.margin else "p"
        if not self.both:
            return self._value(df, name).select(*df.columns, name)
        own = df.columns
        mine = self._value(df, "_a").select(*own, "_a")
        turned = mine.select(F.struct(*own).alias("_row"), "_a", *flipped(self.features))
        both = self._value(turned, "_b").select("_row.*", "_a", "_b")
        if not self.margin:
            return both.withColumn("p", (F.col("_a") + 1 - F.col("_b")) / 2).drop("_a", "_b")
        out = both.withColumn("margin_hat", (F.col("_a") - F.col("_b")) / 2).drop("_a", "_b")
        return out.withColumn("p", normal_cdf(F.col("margin_hat") / self.sigma)) if self.sigma else out


def logistic(c: float) -> Callable:
    return lambda n, sd: LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9)


def ridge(alpha: float) -> Callable:
    return lambda n, sd: LinearRegression(featuresCol="_x", labelCol="_y", solver="normal", regParam=alpha * sd / n, elasticNetParam=0.0, standardization=False)


def boosted(classify: bool, rate: float, depth: int, rounds: int, leaf: int = LEAF) -> Callable:
    """Histogram boosting on the features as they are: missing values have a side of their own, leaves a penalty."""
    return lambda n, sd: HistogramBoosting(classify, rate, depth, rounds, leaf)


def fit(df: DataFrame, features: Sequence[str], label: str, estimator: Callable, margin: bool, both: bool = True, scaled: bool = True) -> Fitted:
    rows = df.select(*features, F.col(label).cast("double").alias("_y"))
    if both:
        rows = augmented(rows, features, "_y", margin)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("_y").alias("sd")).first()
    kind = estimator(stats["n"], stats["sd"] or 1.0)
    if isinstance(kind, HistogramBoosting):
        return Fitted(Preparation(), kind.fit(rows, features, "_y"), list(features), margin, both=both)
    preparation = Preparation().fit(rows, features, scaled)
    return Fitted(preparation, kind.fit(preparation.apply(rows)), list(features), margin, both=both)


def fit_margin(df: DataFrame, features: Sequence[str], estimator: Callable, season: str = "season") -> Fitted:
    """A margin model with sigma from its errors on the last two seasons, fitted on those before; then refitted on all."""
    seasons = [r[0] for r in df.select(season).distinct().orderBy(F.desc(season)).limit(3).collect()]
    held = seasons[:2]
    sigma = None
    if len(seasons) > 2:
        inner = fit(df.filter(~F.col(season).isin(held)), features, "margin", estimator, True)
        sigma = inner.predict(df.filter(F.col(season).isin(held))).agg(F.stddev_pop(F.col("margin") - F.col("margin_hat"))).first()[0]
    out = fit(df, features, "margin", estimator, True)
    out.sigma = sigma or df.agg(F.stddev_pop("margin")).first()[0] or 1.0
    return out


def linear_candidates(features: Sequence[str], curated: Sequence[str] = CURATED, rating: Sequence[str] = RATING) -> dict[str, tuple[str, float, tuple[str, ...]]]:
    """Name: kind (`logit` of wins, `ridge` of margins), strength, features."""
    out: dict[str, tuple[str, float, tuple[str, ...]]] = {"elo_logit": ("logit", 1.0, tuple(rating)), "elo_margin": ("ridge", 1.0, tuple(rating))}
    # fixed values: the grid
    for prefix, names, strengths, alphas in (("", features, [0.0003, 0.001, 0.003, 0.01, 0.03, 0.1], [30, 100, 300, 1000, 3000, 10000]), ("curated_", curated, [0.001, 0.003, 0.01], [300, 1000, 3000])):
        out |= {f"{prefix}logit_C{c}": ("logit", c, tuple(names)) for c in strengths}
        out |= {f"{prefix}ridge_a{a}": ("ridge", a, tuple(names)) for a in alphas}
    return out


def candidates(features: Sequence[str], curated: Sequence[str] = CURATED, rating: Sequence[str] = RATING) -> dict[str, tuple[list[str], Callable, bool]]:
    """Name: features, estimator, whether it predicts margins."""
    linear = {"logit": logistic, "ridge": ridge}
    out: dict[str, tuple[list[str], Callable, bool]] = {n: (list(names), linear[kind](x), kind == "ridge") for n, (kind, x, names) in linear_candidates(features, curated, rating).items()}
    # fixed values: the grid
    for rate, depth, rounds in ((0.03, 2, 300), (0.03, 3, 300), (0.02, 3, 600), (0.05, 2, 200)):
        for kind, classify in (("clf", True), ("reg", False)):
            out[f"hgb_{kind}_lr{rate}_d{depth}_n{rounds}"] = list(features), boosted(classify, rate, depth, rounds), not classify
    return out


def fit_named(rows: DataFrame, names: Sequence[str], features: Sequence[str]) -> dict[str, Fitted]:
    """The candidates of these names; rows hold the features, season, margin and won."""
    known = candidates(features)
    return {n: fit_margin(rows, known[n][0], known[n][1]) if known[n][2] else fit(rows, known[n][0], "won", known[n][1], False) for n in names}


def selected(rows: DataFrame, fitted: dict[str, Fitted], winners: Sequence[str] = WINNERS, margins: Sequence[str] = MARGINS) -> DataFrame:
    """game_id, p, margin_hat: the means of the chosen models."""
    got = {n: fitted[n].predict(rows) for n in dict.fromkeys([*winners, *margins])}
    p = ensemble([got[n] for n in winners], "p")
    return p.join(ensemble([got[n] for n in margins], "margin_hat"), "game_id")


def save(spark: SparkSession, path: str, fitted: dict[str, Fitted], about: dict) -> None:
    """The models and, as one line of JSON, all else; any store that Spark writes to."""
    told = {"about": about, "models": {}}
    for name, m in fitted.items():
        trees = isinstance(m.model, histtrees.Model)
        if not trees:
            m.model.write().overwrite().save(f"{path}/models/{name}")
        told["models"][name] = {
            "class": f"{type(m.model).__module__}.{type(m.model).__name__}",
            "trees": m.model.told() if trees else None,
            "features": m.features,
            "margin": m.margin,
            "sigma": m.sigma,
            "both": m.both,
            "medians": m.preparation.medians,
            "scales": m.preparation.scales,
            "flags": m.preparation.flags,
        }
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def restore(spark: SparkSession, path: str) -> tuple[dict[str, Fitted], dict]:
    """What `save` wrote: the models by name, and what was told about them."""
    told = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    out = {}
    for name, m in told["models"].items():
        module, kind = m["class"].rsplit(".", 1)
        model = histtrees.Model.of(m["trees"]) if m["trees"] else getattr(importlib.import_module(module), kind).load(f"{path}/models/{name}")
        preparation = Preparation(m["medians"], {c: tuple(x) for c, x in m["scales"].items()}, m["flags"])
        out[name] = Fitted(preparation, model, m["features"], m["margin"], m["sigma"], m["both"])
    return out, told["about"]


def ensemble(predictions: Sequence[DataFrame], value: str, key: str = "game_id") -> DataFrame:
    """The mean of the models' predictions of each game."""
    whole = predictions[0].select(key, value)
    for p in predictions[1:]:
        whole = whole.unionByName(p.select(key, value))
    return whole.groupBy(key).agg(F.avg(value).alias(value))


def out_of_fold(df: DataFrame, features: Sequence[str], seasons: Sequence[int], estimator: Callable, margin: bool) -> DataFrame:
    """Each season's predictions from a model of the seasons before."""
    folds = []
    for s in seasons:
        train = df.filter(F.col("season") < s)
        model = fit_margin(train, features, estimator) if margin else fit(train, features, "won", estimator, False)
        folds.append(model.predict(df.filter(F.col("season") == s)))
    whole = folds[0]
    for f in folds[1:]:
        whole = whole.unionByName(f)
    return whole


def final_test(rows: DataFrame, market: DataFrame, features: Sequence[str], seasons: Sequence[int] = TEST, winners: Sequence[str] = WINNERS, margins: Sequence[str] = MARGINS) -> dict[str, DataFrame]:
    """The chosen models, fitted before the test seasons and scored in them once, beside the baselines.

    winner and margin: a row of metrics a predictor; agreement, seasons, buckets: against the market; predictions. Rows hold the
    features, season, margin and won; market: game_id, spread_line, home_implied_prob_novig."""
    train, test = rows.filter(F.col("season") < min(seasons)), rows.filter(F.col("season").isin(list(seasons)))
    fitted = fit_named(train, dict.fromkeys([*winners, *margins, "elo_logit"]), features)
    t = test.select("game_id", "season", "won", "margin").join(selected(test, fitted, winners, margins), "game_id")
    t = t.join(fitted["elo_logit"].predict(test).select("game_id", F.col("p").alias("p_elo")), "game_id").join(market.select("game_id", "spread_line", F.col("home_implied_prob_novig").alias("p_market")), "game_id", "left")
    home = F.lit(train.agg(F.avg("won")).first()[0])
    t = settled(t)
    named = lambda name, df: df.select(F.lit(name).alias("predictor"), "*")
    whole = lambda frames: reduce(DataFrame.unionByName, frames)
    by = {"ensemble": F.col("p"), "elo": F.col("p_elo"), "always_home": home, "market": F.col("p_market")}
    winner = whole([named(n, t.filter(p.isNotNull()).agg(*metrics.win_metrics(p, F.col("won")))) for n, p in by.items()])
    margin = whole([named(n, t.filter(m.isNotNull()).agg(*metrics.margin_metrics(m, F.col("margin")))) for n, m in {"ensemble": F.col("margin_hat"), "market": F.col("spread_line"), "zero": F.lit(0.0)}.items()])
    priced = t.filter("p_market is not null")
    return {
        "winner": winner,
        "margin": margin,
        "agreement": priced.agg(*metrics.agreement(F.col("p"), F.col("p_market"), F.col("won"))),
        "seasons": t.groupBy("season").agg(*(F.avg(((F.col(c) > 0.5) == (F.col("won") > 0.5)).cast("double")).alias(n) for n, c in (("ours", "p"), ("market", "p_market"))), F.count(F.lit(1)).alias("games")),
        "buckets": metrics.confidence_buckets(t, F.col("p"), F.col("won"), F.col("p_market")),
        "predictions": t,
    }


def write_final_test(tables: dict[str, DataFrame], path: str) -> str:
    """Writes `final_test`'s predictions as a table and its few rows of metrics as one JSON text; returns the text."""
    spark = tables["predictions"].sparkSession
    files.write_table(tables["predictions"], f"{path}/predictions")
    text = json.dumps({name: json.loads(files.json_report(df)) for name, df in tables.items() if name != "predictions"}, indent=1)
    files.write_text(spark, text, f"{path}/report")
    return text


# fixed values: the features of the market's errors
BIAS = [
    "spread_line",
    "abs_spread",
    "home_fav",
    "home_adv",
    "is_primetime",
    "div_game",
    "is_playoff",
    "diff_streak",
    "diff_last3_avg_pt_diff",
    "diff_form_vs_season",
    "diff_form_vs_ewm",
    "diff_h2h_last_margin",
    "diff_off_bye",
    "diff_short_week",
    "diff_rest_days",
    "diff_qb_changed_last_game",
    "diff_inj_exp_qb_out_or_doubtful",
    "diff_coach_new_this_season",
    "diff_prev_season_win_pct",
    "diff_win_pct",
    "temp",
    "wind",
    "is_indoor",
]


def market_rows(rows: DataFrame, market: DataFrame) -> DataFrame:
    """Games with a line: what it missed, its size and side, and form against the longer run."""
    priced = rows.join(market.select("game_id", "spread_line"), "game_id").filter("spread_line is not null")
    return priced.withColumns(
        {
            "resid": F.col("margin") - F.col("spread_line"),
            "abs_spread": F.abs("spread_line"),
            "home_fav": (F.col("spread_line") > 0).cast("double"),
            "diff_form_vs_season": F.col("diff_last3_avg_pt_diff") - F.col("diff_season_avg_pt_diff"),
            "diff_form_vs_ewm": F.col("diff_last3_avg_pt_diff") - F.col("diff_ewm_pt_diff"),
        }
    )


def market_residuals(rows: DataFrame, seasons: Sequence[int] = VALIDATION, curated: Sequence[str] = CURATED, bias: Sequence[str] = BIAS, trees: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """Walk-forward models of what the line misses, from `market_rows`: predictions (p_ and r_ of each model) and a row of metrics a model.

    The gap between a margin model without the line and the line is out of sample in training too: on the last three seasons
    before the fold, from a model of those before them."""
    trees = trees or boosted(False, 0.02, 2, 200, 100)
    folds = []
    for s in seasons:
        train, test = rows.filter(F.col("season") < s), rows.filter(F.col("season") == s)
        last = [r[0] for r in train.select("season").distinct().orderBy(F.desc("season")).limit(3).collect()]
        gap = lambda model, df: model.predict(df).withColumn("model_gap", F.col("margin_hat") - F.col("spread_line"))
        whole = fit_margin(train, curated, ridge(3000))
        inner = fit_margin(train.filter(~F.col("season").isin(last)), curated, ridge(3000))
        recent = settled(gap(inner, train.filter(F.col("season").isin(last))).drop("margin_hat", "p").withColumn("own", F.col("spread_line") + F.col("model_gap")))
        out = settled(gap(whole, test).withColumnRenamed("p", "p_v1").drop("margin_hat").withColumn("own", F.col("spread_line") + F.col("model_gap")))
        sigma = train.agg(F.stddev_pop("resid")).first()[0]
        kept = ["game_id", "season", "won", "margin", "spread_line", "resid", "p_v1"]
        got = out.select(*kept, normal_cdf(F.col("spread_line") / sigma).alias("p_spread"))
        for name, df, names, estimator in (
            ("ridge_bias", train, bias, ridge(3000)),
            ("trees_bias", train, bias, trees),
            ("ridge_bias_gap", recent, [*bias, "model_gap"], ridge(3000)),
            ("ridge_gap", recent, ["model_gap", "spread_line"], ridge(3000)),
        ):
            r = fit(df, names, "resid", estimator, True, both=False).predict(out).select("game_id", F.col("margin_hat").alias(f"r_{name}"))
            got = got.join(r, "game_id").withColumn(f"p_{name}", normal_cdf((F.col("spread_line") + F.col(f"r_{name}")) / sigma))
        stack = fit(recent, ["spread_line", "own"], "won", logistic(1.0), False, both=False, scaled=False).predict(out)
        folds.append(settled(got.join(stack.select("game_id", F.col("p").alias("p_stack")), "game_id")))
    whole = reduce(DataFrame.unionByName, folds)
    summary = []
    for c in [c for c in whole.columns if c.startswith("p_")]:
        name = c[2:]
        edge = [*metrics.against_the_spread(F.col(f"r_{name}"), F.col("resid")), F.avg(F.abs(F.col("resid") - F.col(f"r_{name}"))).alias("resid_mae")] if f"r_{name}" in whole.columns else []
        summary.append(whole.agg(*metrics.win_metrics(F.col(c), F.col("won")), *edge, F.avg(F.abs("resid")).alias("resid_mae_of_zero")).select(F.lit(name).alias("model"), "*"))
    return whole, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), summary)


def validate(rows: DataFrame, features: Sequence[str], seasons: Sequence[int] = VALIDATION, names: Sequence[str] | None = None, curated: Sequence[str] = CURATED, rating: Sequence[str] = RATING) -> DataFrame:
    """model, game_id, season, won, margin, margin_hat, p: out-of-fold predictions of the candidates (or those named), each season's from the seasons before.

    The linear ones come from one pass of statistics and one job a Newton step; boosted trees are a fit a fold."""
    linear, every = linear_candidates(features, curated, rating), candidates(features, curated, rating)
    names = list(every) if names is None else list(names)
    got = [folds.walk_forward(rows, some, seasons)] if (some := {n: linear[n] for n in names if n in linear}) else []
    for n in names:
        if n not in linear:
            own, estimator, margin = every[n]
            p = out_of_fold(rows, own, seasons, estimator, margin)
            got.append(p.select("game_id", F.col("season").cast("long").alias("season"), F.lit(n).alias("model"), (F.col("margin_hat") if margin else F.lit(None).cast("double")).alias("margin_hat"), "p"))
    whole = reduce(DataFrame.unionByName, got)
    return whole.join(rows.select("game_id", "won", "margin"), "game_id").select("model", "game_id", "season", "won", "margin", "margin_hat", "p")


def validation_summary(predictions: DataFrame) -> DataFrame:
    """A row of metrics a model, the smallest log loss first; mae and rmse of margin models."""
    known = F.col("margin_hat").isNotNull()
    margin = [F.when(F.bool_or(known), x).alias(n) for n, x in zip(("mae", "rmse"), metrics.margin_metrics(F.col("margin_hat"), F.col("margin")), strict=True)]
    return predictions.groupBy("model").agg(F.when(F.bool_or(known), "margin").otherwise("win").alias("kind"), *metrics.win_metrics(F.col("p"), F.col("won")), *margin).orderBy("log_loss", "model")


def write_validation(predictions: DataFrame, path: str) -> DataFrame:
    """Writes the out-of-fold predictions, a folder a model, and the summary as one CSV file; returns the summary."""
    predictions.write.mode("overwrite").partitionBy("model").parquet(f"{path}/validation_oof")
    back = predictions.sparkSession.read.parquet(f"{path}/validation_oof")
    summary = validation_summary(back)
    files.write_one_csv(summary, f"{path}/validation_summary.csv")
    return summary


def walk_forward(df: DataFrame, features: Sequence[str], seasons: Sequence[int]) -> DataFrame:
    """model, season, n, accuracy, log_loss, brier of a ridge margin and a logistic model."""
    rows = df.withColumn("won", (F.col("margin") > 0).cast("double"))
    got = folds.walk_forward(rows, {"ridge": ("ridge", 1000.0, tuple(features)), "logit": ("logit", 0.01, tuple(features))}, seasons, also=["won"])
    scored = got.groupBy("model", "season").agg(*metrics.win_metrics(F.col("p"), F.col("won")))
    return scored.select("model", "season", "n", *(F.round(c, 4).alias(c) for c in ("accuracy", "log_loss", "brier")))
