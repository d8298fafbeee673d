"""From the releases' raw files to the core tables that the builder and the models read."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstone.sources import files

#: Columns of rosters that hold numbers and text in turn.
MIXED = ["jersey_number", "draft_number"]
# fixed values: the last season of the core tables, and the ranges of the weekly rosters
CUTOFF, RANGES = 2024, [(2002, 2010), (2011, 2017), (2018, 2024)]


def union_schema(spark: SparkSession, path: str, mixed: list[str] = MIXED) -> T.StructType:
    """All columns of the files below a path; a column whose type differs between files is a number where it is among `mixed` or each of its types is one, else text."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(files.FOOTERS) as pool:
        schemas = list(pool.map(lambda f: spark.read.parquet(f).schema, files.files_below(spark, path)))
    kinds: dict[str, set[T.DataType]] = {}
    for schema in schemas:
        for f in schema:
            kinds.setdefault(f.name, set()).add(f.dataType)
    void = T.NullType()

    def one(name: str, found: set[T.DataType]) -> T.DataType:
        found = found - {void}
        if name in mixed:
            return T.DoubleType()
        if len(found) == 1:
            return next(iter(found))
        return T.DoubleType() if found and all(isinstance(k, T.NumericType) for k in found) else T.StringType()

    return T.StructType([T.StructField(n, one(n, k)) for n, k in kinds.items()])


def season_table(spark: SparkSession, path: str, cutoff: int) -> DataFrame:
    """The files of all seasons as one table, up to the cutoff."""
    return files.until(files.scan(spark, [path], union_schema(spark, path)), cutoff)


def player_stats(spark: SparkSession, path: str, games: DataFrame, cutoff: int) -> DataFrame:
    """Player rows with the game of their team that week and its day."""
    stats = season_table(spark, path, cutoff)
    stats = stats.withColumnRenamed("recent_team", "team") if "team" not in stats.columns else stats
    named = files.with_game_ids(stats.drop("game_id", "gameday"), games)
    return named.join(games.select("game_id", "gameday"), "game_id", "left")


def build(spark: SparkSession, raw: str, out: str, cutoff: int = CUTOFF, ranges: list[tuple[int, int]] = RANGES) -> DataFrame:
    """Writes the core tables below `out` and returns table, rows, match_rate (null where no game is sought) of each."""
    schedule = files.read_table(spark, f"{raw}/schedules/games.parquet")
    games = files.until(schedule, cutoff)
    files.write_table(games, f"{out}/games")
    files.write_csv(games, f"{out}/games_csv")
    files.write_table(files.read_table(spark, f"{raw}/players/players.parquet"), f"{out}/players")
    files.write_table(season_table(spark, f"{raw}/rosters", cutoff), f"{out}/season_rosters")
    files.write_in_ranges(season_table(spark, f"{raw}/weekly_rosters", cutoff), f"{out}/weekly_rosters", ranges)
    for name, source in (("ps", "player_stats.parquet"), ("ps_defense", "player_stats_def.parquet")):
        files.write_table(player_stats(spark, f"{raw}/player_stats/{source}", schedule, cutoff), f"{out}/{name}")
    return summary(spark, out)


def summary(spark: SparkSession, out: str) -> DataFrame:
    whole = None
    for name in ("games", "players", "season_rosters", "weekly_rosters", "ps", "ps_defense"):
        df = spark.read.parquet(f"{out}/{name}")
        rate = F.avg(F.col("game_id").isNotNull().cast("double")) if name.startswith("ps") else F.lit(None).cast("double")
        row = df.agg(F.count(F.lit(1)).alias("rows"), rate.alias("match_rate")).select(F.lit(name).alias("table"), "*")
        whole = row if whole is None else whole.unionByName(row)
    return whole


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description="Builds the core tables from the releases' raw files.")
    a.add_argument("raw", help="folder with the release's files in their places")
    a.add_argument("out")
    a.add_argument("--cutoff", type=int, default=CUTOFF)
    o = a.parse_args(argv)
    print(files.json_report(build(SparkSession.builder.getOrCreate(), o.raw, o.out, o.cutoff)))


if __name__ == "__main__":
    main()
