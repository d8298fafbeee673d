"""Inputs of the history experiment: each team's last games before each game as padded, masked arrays, and scaled features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.operators import timeseries as ts
from gridstone.plans import pregame

#: Games of a history.
LENGTH = 16
# fixed values: what a game's missing measures count as
DEFAULTS = {"anya": 5.5, "ypc": 4.2, "turnovers": 1.5}


def team_boxes(stats: DataFrame) -> DataFrame:
    """game_id, team, anya, ypc, turnovers of each team's player rows."""
    b = pregame.box_scores(stats)
    per = lambda n, d: F.when(F.col(d) != 0, F.col(n) / F.col(d))
    return b.select("game_id", "team", per("anya_num", "anya_den").alias("anya"), per("rushing_yards", "carries").alias("ypc"), "turnovers")


# fixed values: each measure's place, its centre and its scale, in the order in which models read them
SCALES = {"pt_diff": (0, 14), "pf": (21, 10), "pa": (21, 10), "win": (0.5, 1), "anya": (5.5, 2), "d_anya": (5.5, 2), "ypc": (4.2, 1), "d_ypc": (4.2, 1), "to_margin": (0, 2), "opp_elo": (1500, 100), "was_home": (0.5, 1), "adj_diff": (0, 14)}
#: Points of rating that are worth a point of margin. (fixed value)
PER_POINT = 25


def results(team_features: DataFrame, games: DataFrame, stats: DataFrame) -> DataFrame:
    """A row a team and game with `result`: twelve measures of what the game came to, for later games to look back on.

    What a side had in a game (its box and its rating) is one struct a game and team; a game's two sides are collected
    once, and each row finds its own and the other's among them."""
    boxes = team_boxes(stats)
    had = team_features.select("game_id", "team", "season", "gameday", "is_home", "elo").join(boxes, ["game_id", "team"], "left")
    sides = had.groupBy("game_id").agg(F.collect_list(F.struct("team", "season", "gameday", "is_home", "elo", "anya", "ypc", "turnovers")).alias("sides"))  # two a game
    scores = games.select("game_id", F.array(F.col("away_score").cast("double"), F.col("home_score").cast("double")).alias("scores"))
    whole = sides.filter(F.size("sides") == 2).join(scores, "game_id")
    pair = F.explode(F.array(*(F.struct(F.col("sides")[k].alias("own"), F.col("sides")[1 - k].alias("other")) for k in (0, 1))))
    t = whole.select("game_id", "scores", pair.alias("p")).select("game_id", "scores", "p.*")
    own, other = (lambda c: F.col("own")[c]), (lambda c: F.col("other")[c])
    points = F.get("scores", own("is_home").cast("int"))
    against = F.get("scores", other("is_home").cast("int"))
    margin = points - against
    known = lambda c, name: F.coalesce(c, F.lit(DEFAULTS[name]))
    raw = {
        "pt_diff": margin,
        "pf": points,
        "pa": against,
        "win": F.coalesce((points > against).cast("double"), F.lit(0.0)),
        "anya": known(own("anya"), "anya"),
        "d_anya": known(other("anya"), "anya"),
        "ypc": known(own("ypc"), "ypc"),
        "d_ypc": known(other("ypc"), "ypc"),
        "to_margin": known(other("turnovers"), "turnovers") - known(own("turnovers"), "turnovers"),
        "opp_elo": other("elo"),
        "was_home": own("is_home"),
        "adj_diff": margin - (own("elo") - other("elo")) / PER_POINT,
    }
    measures = [((raw[n] - centre) / scale).cast("double").alias(n) for n, (centre, scale) in SCALES.items()]
    return t.select("game_id", own("season").alias("season"), F.to_date(own("gameday")).alias("day"), own("team").alias("team"), other("team").alias("opp"), F.struct(*measures).alias("result"))


def histories(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """game_id, team, history (arrays of the result's measures, log of the days since, same season; nulls on the left), mask (1: a game)."""
    order = ["day", "game_id"]
    past = F.struct("result", "day", "season")
    got, mask = ts.padded_history(past, ["team"], order, length)
    names = rows.schema["result"].dataType.names
    row = lambda x: F.when(x.isNotNull(), F.array(*(x["result"][n] for n in names), F.log1p(F.datediff(F.col("day"), x["day"]).cast("double")) / 5, (x["season"] == F.col("season")).cast("double")))
    return rows.withColumns({"_h": got, "mask": mask}).select("game_id", "team", F.transform("_h", row).alias("history"), "mask")


def scaled(df: DataFrame, train: DataFrame, features: Sequence[str], clip: float = 6.0) -> DataFrame:
    """The rows with z_ (scaled by the training rows and clipped, 0 where unknown) and m_ (1: unknown) of each feature.

    Differences stay centred on nothing and are scaled by their mean size, the others by mean and sample deviation."""
    row = train.agg(*(F.avg(c).alias(f"a_{c}") for c in features), *(F.stddev_samp(c).alias(f"s_{c}") for c in features), *(F.avg(F.abs(F.col(c))).alias(f"d_{c}") for c in features)).first()

    def z(c: str) -> Column:
        diff = c.startswith("diff_")
        at, by = (0.0, row[f"d_{c}"]) if diff else (row[f"a_{c}"] or 0.0, row[f"s_{c}"])
        value = (F.col(c).cast("double") - at) / (by or 1.0)
        return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(clip)), F.lit(-clip))).otherwise(0.0)

    return df.withColumns({f"z_{c}": z(c) for c in features} | {f"m_{c}": F.col(c).isNull().cast("int") for c in features})
