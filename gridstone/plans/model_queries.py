"""Walk-forward models as queries over the star-schema tables.

The features are odd (the other side sees them negated), so on both orientations every mean is
0, marks of missing values take no part, and a fit is a small linear system of sums over the
earlier seasons; the SQL states it so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.operators import metrics, records
from gridstone.operators.quantiles import medians_before
from gridstone.plans import folds, models
from gridstone.plans.fixture_queries import LONG, RECORD, query, record_rows, recorded
from gridstone.session import written

FEATURES = ["diff_wins", "diff_win_pct", "diff_avg_diff", "home_adv"]
ALPHAS, STRENGTHS = [30.0, 1000.0, 3000.0], [0.001, 0.01, 1.0]
#: Newton steps of the SQL; the sums no longer change after some six.
SQL_STEPS = 9
D = range(1, len(FEATURES) + 1)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided games with what the sides' records tell, all known before the day."""
    # season and margin go along with the rows: the games are not read and dealt a second time
    sides = record_rows(spark, sf_dir).withColumn("margin", F.when(F.col("played") == 1, F.col("diff")).cast("double")).filter("margin <> 0")
    diffs = [f"diff_{c}" for c in RECORD]
    out = records.wide(sides, ["game_id", "season"], [*RECORD, "margin"]).select("game_id", "season", *recorded(diffs), F.col("home_margin").alias("margin"))
    out = out.withColumn("home_adv", F.lit(1.0)).withColumn("won", (F.col("margin") > 0).cast("double"))
    # every season's list, sum, Newton step and prediction reads them: none plays the records again
    return written(out.select("game_id", "season", *FEATURES, "margin", "won"))


def seasons_of(df: DataFrame) -> list[int]:
    """All seasons but the first, which has no past to fit on."""
    return sorted(r["season"] for r in df.select("season").distinct().collect())[1:]


#: x: the rows; folds: a row a season after the first; z: each fold's earlier rows and its own (test), scaled.
BASE = f"""
    {LONG}, f AS (
        SELECT game_id, is_home, coalesce(sum(played) OVER w, 0) AS games_played, coalesce(sum(win) OVER w, 0) AS wins, coalesce(sum(win + 0.5 * tie) OVER w, 0) AS points, coalesce(sum(diff) OVER w, 0) AS diffs
        FROM long WINDOW w AS (PARTITION BY team, season ORDER BY day, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), r AS (
        SELECT *, CASE WHEN games_played > 0 THEN CAST(points AS DOUBLE) / CAST(games_played AS DOUBLE) END AS win_pct, CASE WHEN games_played > 0 THEN CAST(diffs AS DOUBLE) / CAST(games_played AS DOUBLE) END AS avg_diff FROM f
    ), x AS (
        SELECT h.game_id, g.season, CAST(h.wins - a.wins AS DOUBLE) AS x1, coalesce(round(h.win_pct - a.win_pct, 6), 0) AS x2, coalesce(round(h.avg_diff - a.avg_diff, 6), 0) AS x3, CAST(1 AS DOUBLE) AS x4,
               CAST(home_score - away_score AS DOUBLE) AS y, CAST(home_score > away_score AS DOUBLE) AS won
        FROM r h JOIN r a ON h.game_id = a.game_id AND h.is_home = 1 AND a.is_home = 0 JOIN games g ON g.game_id = h.game_id WHERE home_score <> away_score
    ), folds AS (SELECT DISTINCT season AS s FROM x WHERE season > (SELECT min(season) FROM x)),
    scales AS (
        SELECT s, count(*) AS n, {", ".join(f"CASE WHEN sum(x{i} * x{i}) > 0 THEN sqrt(sum(x{i} * x{i}) / count(*)) ELSE 1 END AS d{i}" for i in D)} FROM folds JOIN x ON x.season < s GROUP BY s
    ), z AS (
        SELECT s, n, game_id, season, season = s AS test, y, won, {", ".join(f"x{i} / d{i} AS z{i}" for i in D)} FROM scales JOIN x ON x.season <= s
    )"""


def solved(name: str, source: str, keys: str) -> str:
    """CTEs that solve a system (a11.., b1..) a row of the source by elimination: w1.. in the last."""
    out, last = [], source
    for k in D:
        cells = [f"a{k}{j} / a{k}{k} AS a{k}{j}" for j in D] + [f"b{k} / a{k}{k} AS b{k}"]
        for i in D:
            if i != k:
                cells += [f"a{i}{j} - a{i}{k} * a{k}{j} / a{k}{k} AS a{i}{j}" for j in D] + [f"b{i} - a{i}{k} * b{k} / a{k}{k} AS b{i}"]
        out.append(f"{name}_{k} AS (SELECT {keys}, {', '.join(cells)} FROM {last})")
        last = f"{name}_{k}"
    return ", ".join(out) + f", {name} AS (SELECT {keys}, {', '.join(f'b{i} AS w{i}' for i in D)} FROM {last})"


def ridge_sql(alphas: list[float]) -> str:
    """w: weights by s and alpha; sigmas: by s and alpha; margins: each fold's own games with their prediction."""
    sums = ", ".join([f"2 * sum(z{i} * z{j}) + CASE WHEN {i} = {j} THEN alpha ELSE 0 END AS a{i}{j}" for i in D for j in D] + [f"2 * sum(z{i} * y) AS b{i}" for i in D])
    dot = " + ".join(f"w{i} * z{i}" for i in D)
    inner = " + ".join(f"w{i} * x{i} / d{i}" for i in D)
    return f"""alphas AS (SELECT CAST(unnest({alphas}) AS DOUBLE) AS alpha), systems AS (SELECT s, alpha, {sums} FROM z, alphas WHERE NOT test GROUP BY s, alpha), {solved("w", "systems", "s, alpha")},
    past AS (SELECT s, list(season ORDER BY season DESC) AS before FROM folds JOIN (SELECT DISTINCT season FROM x) ON season < s GROUP BY s),
    sigmas AS (
        SELECT past.s, a.alpha, stddev_pop(y - CASE WHEN len(before) > 2 THEN {inner} ELSE 0 END) AS sigma
        FROM past CROSS JOIN alphas a JOIN x ON x.season < s AND (len(before) <= 2 OR x.season >= before[2]) LEFT JOIN scales c ON c.s = before[2] AND len(before) > 2
        LEFT JOIN w ON w.s = before[2] AND w.alpha = a.alpha AND len(before) > 2 GROUP BY ALL
    ), margins AS (SELECT z.s, w.alpha, y, won, {dot} AS margin_hat, sigma FROM z JOIN w ON w.s = z.s JOIN sigmas g ON g.s = z.s AND g.alpha = w.alpha WHERE test)"""


def logit_sql(strengths: list[float]) -> str:
    """odds: weights by s and c after the last Newton step; chances: each fold's own games with their probability."""
    zero = ", ".join(f"CAST(0 AS DOUBLE) AS w{i}" for i in D)
    dot = " + ".join(f"w{i} * z{i}" for i in D)
    steps, last = [f"strengths AS (SELECT CAST(unnest({strengths}) AS DOUBLE) AS c), odds0 AS (SELECT s, c, {zero} FROM folds, strengths)"], "odds0"
    for k in range(1, SQL_STEPS + 1):
        h = [f"2 * sum(z{i} * z{j} * p * (1 - p)) + CASE WHEN {i} = {j} THEN 1 / c ELSE 0 END AS a{i}{j}" for i in D for j in D]
        g = [f"2 * sum(z{i} * (p - won)) + any_value(w{i}) / c AS b{i}" for i in D]
        steps.append(f"newton{k} AS (SELECT s, c, {', '.join(h + g)} FROM (SELECT z.*, c, {', '.join(f'w{i}' for i in D)}, 1 / (1 + exp(-({dot}))) AS p FROM z JOIN {last} o ON o.s = z.s WHERE NOT test) GROUP BY s, c)")
        steps.append(solved(f"step{k}", f"newton{k}", "s, c"))
        steps.append(f"odds{k} AS (SELECT s, c, {', '.join(f'o.w{i} - t.w{i} AS w{i}' for i in D)} FROM {last} o JOIN step{k} t USING (s, c))")
        last = f"odds{k}"
    steps.append(f"chances AS (SELECT z.s, c, y, won, 1 / (1 + exp(-({dot}))) AS p FROM z JOIN {last} o ON o.s = z.s WHERE test)")
    return ", ".join(steps)


def cdf(x: str) -> str:
    """The normal distribution's approximation 26.2.17 of Abramowitz and Stegun."""
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    upper = f"(exp(-({x}) * ({x}) / 2) / 2.5066282746310002 * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"CASE WHEN {x} >= 0 THEN 1 - {upper} ELSE {upper} END"


def scores(p: str, digits: int) -> str:
    q = f"least(greatest({p}, {metrics.CLIP}), 1 - {metrics.CLIP})"
    return f"""count(*) AS n, round(avg(CAST(({p} > 0.5) = (won > 0.5) AS DOUBLE)), {digits}) AS accuracy,
        round(avg(-(won * ln({q}) + (1 - won) * ln(1 - {q}))), {digits}) AS log_loss, round(avg(({p} - won) * ({p} - won)), {digits}) AS brier"""


@query(
    f"""
    WITH {BASE}, {ridge_sql(ALPHAS)}
    SELECT m.s AS season, m.alpha, count(*) AS n, round(any_value(sigma), 5) AS sigma, round(avg(abs(margin_hat - y)), 5) AS mae, round(sqrt(avg((margin_hat - y) * (margin_hat - y))), 5) AS rmse,
           {", ".join(f"round(any_value(w{i}), 5) AS w_{f}" for i, f in zip(D, FEATURES, strict=True))}
    FROM margins m JOIN w ON w.s = m.s AND w.alpha = m.alpha GROUP BY m.s, m.alpha
    """
)
def ridge_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge margins of every fold and strength, from one pass of sums by season."""
    df = rows(spark, sf_dir)
    seasons = seasons_of(df)
    fit = folds.Folds(df, FEATURES, cutoffs=seasons)
    fits, told = {}, []
    for s in seasons:
        for alpha in ALPHAS:
            weights, by = fit.ridge(s, alpha, FEATURES)
            sigma = fit.sigma(s, alpha, FEATURES)
            fits[str(alpha), s] = weights, sigma
            told.append((s, alpha, sigma, *(by[f] for f in FEATURES)))
    of = spark.createDataFrame(told, "season long, alpha double, sigma double, " + ", ".join(f"w_{f} double" for f in FEATURES))
    got = fit.predictions(fits, also=["margin"]).withColumn("alpha", F.col("model").cast("double"))
    scored = got.groupBy("season", "alpha").agg(F.count(F.lit(1)).alias("n"), *metrics.margin_metrics(F.col("margin_hat"), F.col("margin")))
    return scored.join(F.broadcast(of), ["season", "alpha"]).select("season", "alpha", "n", *(F.round(c, 5).alias(c) for c in ("sigma", "mae", "rmse", *(f"w_{f}" for f in FEATURES))))


@query(
    f"""
    WITH {BASE}, {logit_sql(STRENGTHS)}
    SELECT h.s AS season, h.c, {scores("p", 5)}, {", ".join(f"round(any_value(w{i}), 5) AS w_{f}" for i, f in zip(D, FEATURES, strict=True))}
    FROM chances h JOIN odds{SQL_STEPS} o ON o.s = h.s AND o.c = h.c GROUP BY h.s, h.c
    """
)
def logit_win(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic wins of every fold and strength, a job a Newton step for all of them."""
    df = rows(spark, sf_dir)
    seasons, names = seasons_of(df), tuple(FEATURES)
    fit = folds.Folds(df, FEATURES, cutoffs=seasons)
    got = fit.logistic([(s, c, names) for s in seasons for c in STRENGTHS])
    of = spark.createDataFrame([(s, c, *(by[f] for f in FEATURES)) for (s, c, _), (_, by) in got.items()], "season long, c double, " + ", ".join(f"w_{f} double" for f in FEATURES))
    p = fit.predictions({(str(c), s): (w, None) for (s, c, _), (w, _) in got.items()}, also=["won"]).withColumn("c", F.col("model").cast("double"))
    scored = p.groupBy("season", "c").agg(*metrics.win_metrics(F.col("p"), F.col("won")))
    return scored.join(F.broadcast(of), ["season", "c"]).select("season", "c", "n", *(F.round(x, 5).alias(x) for x in ("accuracy", "log_loss", "brier", *(f"w_{f}" for f in FEATURES))))


@query(
    f"""
    WITH {BASE}, {ridge_sql([1000.0])}, {logit_sql([0.01])}
    SELECT 'ridge' AS model, s AS season, {scores("p", 4)} FROM (SELECT *, {cdf("(margin_hat / sigma)")} AS p FROM margins) GROUP BY s
    UNION ALL SELECT 'logit', s, {scores("p", 4)} FROM chances GROUP BY s
    """
)
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge margins and logistic wins by season, each fitted on the seasons before."""
    df = rows(spark, sf_dir)
    return models.walk_forward(df.drop("won"), FEATURES, seasons=seasons_of(df))


@query(
    """
    WITH x AS (
        SELECT year(o_orderdate) AS season, UNNEST([{'column': 'o_totalprice', 'value': o_totalprice}, {'column': 'parts', 'value': n}, {'column': 'discount', 'value': d}], recursive := true)
        FROM orders LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n, CASE WHEN l_orderkey % 5 > 0 THEN max(l_discount) END AS d FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
    )
    SELECT "column", CAST(cutoff AS BIGINT) AS cutoff, round(median(value), 6) AS median, count(*) FILTER (value IS NULL) AS missing FROM x JOIN (SELECT DISTINCT season + 1 AS cutoff FROM x) ON season < cutoff GROUP BY 1, 2
    """
)
def fold_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians and missing counts of columns over the seasons before each cutoff."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("double").alias("parts"), F.max("l_discount").alias("d"))
    lines = lines.withColumn("discount", F.when(F.col("l_orderkey") % 5 > 0, F.col("d")))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("season", F.year("o_orderdate")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    cutoffs = [r["season"] + 1 for r in orders.select("season").distinct().collect()]
    got = medians_before(orders, ["o_totalprice", "parts", "discount"], sorted(cutoffs))
    return got.select("column", F.col("cutoff").cast("long").alias("cutoff"), F.round("median", 6).alias("median"), "missing")
