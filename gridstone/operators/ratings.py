"""Elo ratings before each game: a fold over all games of a league in order.

Each game couples two teams, so a league is one sequence by nature; leagues run in
parallel. Spark sorts the games and a worker folds over their batches, with the
teams' ratings as its only state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gridstone.session import fresh_path, written

#: Published constants: step, home advantage in points, first rating, share of the way back to it at a new season.
STEP, HOME, FIRST, BACK = 20.0, 65.0, 1500.0, 1 / 3


class Ratings:
    """The state: ratings and the season in which each was last used."""

    def __init__(self):
        self.of: dict = {}

    def before(self, team, season) -> float:
        rating, last = self.of.get(team, (FIRST, season))
        if last != season:
            rating += (FIRST - rating) * BACK
        self.of[team] = rating, season
        return rating

    def after(self, home, away, neutral: bool, margin: float, season) -> None:
        h, a = self.of[home][0], self.of[away][0]
        lead = h - a + (0.0 if neutral else HOME)
        expected = 1 / (1 + 10 ** (-lead / 400))
        sign = (margin > 0) - (margin < 0)
        weight = 2.2 * math.log1p(abs(margin)) / (2.2 + 0.001 * sign * lead) if sign else 1.0
        gain = STEP * weight * ((sign + 1) / 2 - expected)
        self.of[home], self.of[away] = (h + gain, season), (a - gain, season)


#: Games, of all leagues, that a step of the fold takes: what bounds a task's memory and reading.
STEP_GAMES = 1 << 20
LAID = ["league", "game_id", "at", "season", "home", "away", "neutral", "margin"]


def elo(games: DataFrame, most: int = STEP_GAMES) -> DataFrame:
    """league, game_id, home_elo, away_elo from league, game_id, at, season, home, away, neutral, margin (null if unplayed); games of one `at` go by game_id.

    More than `most` games are dealt by ranges of (at, game_id) and folded range after range; the ratings go from one
    to the next in a table, a row a team."""
    spark, rows = games.sparkSession, games.select(*LAID)
    steps = -(-rows.count() // most)
    if steps <= 1:
        return folded(rows.withColumn("kind", F.lit(1))).filter("kind = 1").select(*RATED)
    dealt = written(rows.repartitionByRange(steps, "at", "game_id").withColumn("step", F.spark_partition_id()), "step")
    state, paths = None, []
    for k in range(steps):
        some = dealt.filter(F.col("step") == k).select(*LAID, F.lit(1).alias("kind"))
        out = folded(some if state is None else some.unionByName(state, allowMissingColumns=True))
        paths.append(fresh_path(spark))
        out.write.parquet(paths[k])
        kept = spark.read.schema(out.schema).parquet(paths[k]).filter("kind = 0")
        state = kept.select("league", "season", "home", F.col("home_elo").alias("margin"), "kind")
    return spark.read.schema(out.schema).parquet(*paths).filter("kind = 1").select(*RATED)


RATED = ["league", "game_id", "home_elo", "away_elo"]


def folded(rows: DataFrame) -> DataFrame:
    """The ratings before each game (kind 1) and, of each league, every team's after the last one (kind 0: home, home_elo, and the season of its last game); rows of kind 0 (home, season, and the rating as margin) are what the fold begins with."""
    kind = lambda c: rows.schema[c].dataType.simpleString()
    schema = f"league {kind('league')}, game_id {kind('game_id')}, home_elo double, away_elo double, home {kind('home')}, season {kind('season')}, kind int"
    names = [f.split()[0] for f in schema.split(", ")]

    def left(league, state: Ratings) -> pd.DataFrame:  # noqa: ANN001
        return pd.DataFrame([(league, None, rating, None, team, season, 0) for team, (rating, season) in state.of.items()], columns=names)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, league = Ratings(), None
        for rows in batches:
            out = []
            for of, game, season, home, away, neutral, margin, kind in zip(*(rows[c].tolist() for c in ("league", "game_id", "season", "home", "away", "neutral", "margin", "kind")), strict=True):
                if of != league:
                    if state.of:
                        yield left(league, state)
                    state, league = Ratings(), of
                if kind == 0:
                    state.of[home] = margin, season
                    continue
                out.append((of, game, state.before(home, season), state.before(away, season), None, None, 1))
                if margin == margin and margin is not None:
                    state.after(home, away, bool(neutral), float(margin), season)
            yield pd.DataFrame(out, columns=names)
        if state.of:
            yield left(league, state)

    laid = rows.select(*LAID, "kind").repartition("league").sortWithinPartitions("league", "kind", "at", "game_id")
    return laid.mapInPandas(fold, schema)


#: The state store that keyed state needs; a streaming session sets it before it starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
GAME = ["game_id", "at", "season", "home", "away", "neutral", "margin"]


class Kept(Ratings):
    """Ratings that are read from keyed state when a team first plays in a batch, and written back after it."""

    def __init__(self, state):  # noqa: ANN001  a map state
        super().__init__()
        self.state = state

    def before(self, team, season) -> float:
        if team not in self.of and self.state.containsKey((team,)):
            rating, last = self.state.getValue((team,))
            self.of[team] = rating, last
        return super().before(team, season)

    def store(self) -> None:
        for team, (rating, season) in self.of.items():
            self.state.updateValue((team,), (float(rating), int(season)))


class Fold(StatefulProcessor):
    """The fold as keyed state: a league's ratings by team, and the day up to which they stand."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ratings = handle.getMapState("ratings", "team string", "rating double, season int")
        self.day = handle.getValueState("day", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        batch = pd.concat(list(rows)).sort_values(["at", "game_id"])  # one batch of one league
        last = self.day.get()[0] if self.day.exists() else None
        if last is not None and batch["at"].iloc[0] < last:
            raise ValueError(f"league {key[0]}: a game of {batch['at'].iloc[0]} comes after the ratings of {last}; rate the league anew")
        state, out = Kept(self.ratings), []
        for r in batch[GAME].itertuples(index=False):
            out.append((key[0], r.game_id, state.before(r.home, r.season), state.before(r.away, r.season)))
            if not pd.isna(r.margin):
                state.after(r.home, r.away, bool(r.neutral), float(r.margin), r.season)
        state.store()
        self.day.update((int(batch["at"].iloc[-1]),))
        yield pd.DataFrame(out, columns=["league", "game_id", "home_elo", "away_elo"])

    def close(self) -> None:
        pass


def elo_stream(games: DataFrame) -> DataFrame:
    """`elo` over a stream of played games: a new week costs a week.

    Each batch goes on from the ratings kept in state, which a restart finds in the query's checkpoint. Batches must
    come in order: a game of a day before its league's last one ends the query with an error, as ratings cannot
    be taken back. Games of one day in two batches are rated in the order of the batches."""
    schema = f"league {games.schema['league'].dataType.simpleString()}, game_id {games.schema['game_id'].dataType.simpleString()}, home_elo double, away_elo double"
    keyed = games.filter("margin is not null").select("league", *GAME).groupBy("league")
    return keyed.transformWithStateInPandas(statefulProcessor=Fold(), outputStructType=schema, outputMode="Append", timeMode="None")
