"""Predictions of games to come, and a backtest over those played."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridstone.functions.expressions import truth
from gridstone.operators import metrics
from gridstone.operators.asof import strict_asof
from gridstone.plans import models, pregame
from gridstone.session import settled
from gridstone.sources import files, landing


#: What the builder reads of reports; files of any season are cast to it.
INJURIES = "season int, week int, team string, gsis_id string, position string, report_status string, date_modified timestamp"


def early_flags(games: DataFrame) -> DataFrame:
    """game_id and whether a team of the game has an unplayed game before it: by each team's first open day, no range join."""
    g = games.withColumn("day", F.to_date("gameday"))
    sides = g.select("game_id", "day", "home_score", F.explode(F.array("home_team", "away_team")).alias("team"))
    first = F.min(F.when(F.col("home_score").isNull(), F.col("day"))).over(Window.partitionBy("team"))
    return sides.withColumn("e", truth(first < F.col("day"))).groupBy("game_id").agg(F.max("e").alias("early"))


def until_targets(games: DataFrame, targets: DataFrame) -> DataFrame:
    """Played games and those not after the last target."""
    last = targets.select("game_id").join(games.select("game_id", "gameday"), "game_id").agg(F.max(F.to_date("gameday"))).first()[0]
    return games.filter(F.col("home_score").isNotNull() | (F.to_date("gameday") <= F.lit(last)))


def features_for(inputs: dict[str, DataFrame], targets: DataFrame) -> DataFrame:
    games = until_targets(inputs["games"], targets)
    played = games.filter("home_score is not null").select("game_id")
    built = pregame.build({"games": games, "ps": inputs["ps"].join(played, "game_id", "left_semi"), "injuries": inputs["injuries"]})
    return built["features"].join(targets.select("game_id"), "game_id", "left_semi").join(early_flags(inputs["games"]), "game_id", "left")


def next_week(games: DataFrame) -> tuple[int, int] | None:
    """The season and week of the first unplayed game."""
    row = games.filter("home_score is null").agg(F.min_by(F.struct("season", "week"), F.struct("gameday", "game_id")).alias("w")).first()["w"]
    return (row["season"], row["week"]) if row else None


def expected_names(games: DataFrame, targets: DataFrame) -> DataFrame:
    """game_id, home_qb, away_qb: who started each team's last game before, else "?"."""
    from gridstone.operators.records import two_sided

    g = games.withColumn("day", F.to_date("gameday"))
    rows = two_sided(g, {"team": ("home_team", "away_team"), "qb": ("home_qb_name", "away_qb_name")}, ["game_id", "day"])
    known = rows.filter("qb is not null").withColumnRenamed("qb", "starter")
    got = strict_asof(rows.join(targets.select("game_id"), "game_id", "left_semi"), known, ["team"], "day", "day", ["starter"], ties=["game_id"])
    side = lambda k: F.coalesce(F.max(F.when(F.col("is_home") == k, F.col("starter"))), F.lit("?"))
    return got.groupBy("game_id").agg(side(1).alias("home_qb"), side(0).alias("away_qb"))


def table_of(predictions: DataFrame, games: DataFrame, early: DataFrame) -> DataFrame:
    """The report's rows (predictions: game_id, p, margin_hat), by day and probability."""
    rows = predictions.join(games.select("game_id", "gameday", "home_team", "away_team", "spread_line"), "game_id").join(early, "game_id", "left").join(expected_names(games, predictions), "game_id", "left")
    p, line = F.col("p"), F.col("spread_line")
    pick = F.when(p >= 0.5, F.col("home_team")).otherwise(F.col("away_team"))
    short = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    text = F.when(line > 0, F.concat("home_team", F.lit(" -"), short(line))).when(line < 0, F.concat("away_team", F.lit(" -"), short(-line))).when(line == 0, "PK").otherwise("")
    return rows.select(
        F.to_date("gameday").alias("date"),
        F.concat("away_team", F.lit(" @ "), "home_team").alias("matchup"),
        pick.alias("pick"),
        F.bround(F.greatest(p, 1 - p), 3).alias("win_prob"),
        F.bround(p, 3).alias("p_home_win"),
        F.concat(pick, F.lit(" by "), F.format_string("%.1f", F.abs("margin_hat"))).alias("pred_margin"),
        text.alias("market_line"),
        F.concat("away_qb", F.lit(" @ "), "home_qb").alias("expected_qbs"),
        truth(F.col("early")).alias("early_prediction"),
        "game_id",
    ).orderBy("date", F.desc("win_prob"), "game_id")


def backtest(predictions: DataFrame, labels: DataFrame, market: DataFrame) -> DataFrame:
    """One row: accuracies without ties (the market's without even lines too) and errors of all games."""
    rows = predictions.join(labels.select("game_id", "margin"), "game_id").join(market.select("game_id", "spread_line"), "game_id", "left").filter("margin is not null")
    decided, m, s = F.col("margin") != 0, F.col("margin"), F.col("spread_line")
    right = lambda x: ((x > 0) == (m > 0)).cast("double")
    return rows.agg(
        F.count(F.lit(1)).alias("games"),
        F.avg(F.when(decided, right(F.col("p") - 0.5))).alias("accuracy"),
        F.avg(F.when(decided & (s != 0), right(s))).alias("market_accuracy"),
        F.avg(F.abs(F.col("margin_hat") - m)).alias("mae"),
        F.avg(F.abs(s - m)).alias("market_mae"),
        *metrics.win_metrics(F.col("p"), (m > 0).cast("double"))[2:],
    )


SCHEDULE, PLAYERS, REPORTS = "schedules/", "stats_player/", "injuries/"


def load_inputs(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """games, ps and injuries: the tables below `root`, and what `--refresh` has landed there.

    The landed schedule stands for the table of games; landed player rows and those of `ps_new` come after the older
    release's; a landed file of reports stands for its season. Reports without a stamp are known from their file's
    fetch on, by the manifest or by the older log (download_log.json)."""
    landed = list(landing.current(spark, root).values())
    of = lambda kind: [f for f in landed if f.name.startswith(kind)]
    schedule = of(SCHEDULE)
    games = files.read_table(spark, schedule[0].path if schedule else f"{root}/games")
    ps = files.read_table(spark, f"{root}/ps")
    newer = [f.path for f in of(PLAYERS)] + [p for p in [f"{root}/ps_new"] if landing.exists(spark, p)]
    if newer:
        ps = files.merged_stats(ps, files.scan(spark, newer, files.new_stats_schema(ps.schema)), ps.columns)
    reports = of(REPORTS)
    injuries = files.scan(spark, [f"{root}/injuries"], INJURIES)
    if reports:
        seasons = [f.season for f in reports]
        injuries = injuries.filter(~F.col("season").isin(seasons) | F.col("season").isNull()).unionByName(files.scan(spark, [f.path for f in reports], INJURIES))
    log = f"{root}/download_log.json"
    text = "".join(r["value"] for r in spark.read.text(log).collect()) if landing.exists(spark, log) else None  # a line a file
    stamps = files.season_stamps(files.read_log(text)) | {f.season: f.fetched_at for f in reports}
    return {"games": games, "ps": ps, "injuries": files.stamped_injuries(injuries, stamps)}


def known_rows(built: dict[str, DataFrame]) -> DataFrame:
    return settled(pregame.model_rows(built["features"], built["labels"]).withColumn("won", F.col("home_win")))


def retrain(rows: DataFrame, path: str) -> tuple[dict[str, models.Fitted], dict]:
    """The chosen models, fitted on all completed games and saved."""
    fitted = models.fit_named(rows, list(dict.fromkeys([*models.WINNERS, *models.MARGINS])), pregame.feature_columns(rows))
    row = rows.agg(F.max("gameday").cast("string").alias("day"), F.count(F.lit(1)).alias("n")).first()
    about = {"winners": models.WINNERS, "margins": models.MARGINS, "trained_through": row["day"], "n_games": row["n"]}
    models.save(rows.sparkSession, path, fitted, about)
    return fitted, about


def smoke(rows: DataFrame, fitted: dict[str, models.Fitted], about: dict, n: int = 3) -> DataFrame:
    """The last n games as the models see them, the latest first."""
    last = rows.orderBy(F.desc("gameday"), F.desc("game_id")).limit(n)
    got = models.selected(last, fitted, about["winners"], about["margins"])
    return last.select("game_id", "gameday", "home_team", "away_team", "margin").join(got, "game_id").orderBy(F.desc("gameday"), F.desc("game_id"))


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description="Predicts a week of games, or scores a finished season.")
    a.add_argument("root", help="folder of games, ps and injuries as Parquet")
    a.add_argument("out")
    a.add_argument("--models", help="folder of the saved models; by default `models` below root")
    a.add_argument("--season", type=int)
    a.add_argument("--week", type=int)
    a.add_argument("--refresh", metavar="ADDRESS", help="fetch the schedule, player rows and reports from below this address first")
    a.add_argument("--retrain", action="store_true", help="fit the chosen models on all completed games")
    a.add_argument("--backtest", type=int, metavar="SEASON")
    o = a.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if o.refresh:
        for name, why in landing.refresh(spark, o.refresh, o.root, files.weekly_files()).items():
            print("skipped", name, why)
    inputs = load_inputs(spark, o.root)
    games, folder = inputs["games"], o.models or f"{o.root}/models"
    done = lambda: pregame.build(inputs | {"games": games.filter("home_score is not null and away_score is not null")})
    built = done() if o.retrain or o.backtest else None
    if o.retrain:
        rows = known_rows(built)
        fitted, about = retrain(rows, folder)
        for r in smoke(rows, fitted, about).collect():  # three rows
            print(f"{r['gameday']} {r['away_team']} @ {r['home_team']}: home wins with {r['p']:.3f}, by {r['margin_hat']:.1f}; it was {r['margin']:.0f}")
    else:
        fitted, about = models.restore(spark, folder)
    use = lambda rows: models.selected(rows.withColumn("home_adv", F.lit(1.0) - F.col("neutral_site")), fitted, about["winners"], about["margins"])
    if o.backtest:
        got = use(built["features"].filter(F.col("season") == o.backtest))
        seen = str(about["trained_through"])[:4] >= str(o.backtest)
        result = backtest(got, built["labels"], built["benchmark"]).withColumn("out_of_sample", F.lit(not seen))
        files.write_one_csv(result.select(*(F.round(c, 4).alias(c) if t == "double" else c for c, t in result.dtypes)), f"{o.out}/backtest_{o.backtest}.csv")
        return
    week = (o.season, o.week) if o.season and o.week else next_week(games)
    if not week:
        raise SystemExit("no unplayed game is left in the schedule; try --refresh")
    targets = games.filter((F.col("season") == week[0]) & (F.col("week") == week[1]) & F.col("home_score").isNull())
    if targets.isEmpty():
        raise SystemExit("these games are played; use --backtest to score a finished season")
    rows = features_for(inputs, targets)
    files.write_one_csv(table_of(use(rows), games, early_flags(games)), f"{o.out}/{week[0]}_week{week[1]:02d}.csv")


if __name__ == "__main__":
    main()
