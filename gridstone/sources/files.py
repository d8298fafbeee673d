"""Readers and writers. Paths go to Spark's own readers and writers, so any store that Spark knows will do."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstone.functions.expressions import renamed
from gridstone.functions.maps import RELOCATED
from gridstone.operators.records import first_source

GAME_KEYS = ["season", "week", "team"]


def read_table(spark: SparkSession, *paths: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One table from one or several Parquet paths (globs too) whose files agree in their types; missing columns are null."""
    df = spark.read.option("mergeSchema", str(len(paths) > 1).lower()).parquet(*paths)
    return df.select(*columns) if columns else df


#: Footers read at once.
FOOTERS = 16


def files_below(spark: SparkSession, path: str) -> list[str]:
    """The Parquet files at or below a path; globs too. Hidden ones and those of Spark's own bookkeeping are left out."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for top in fs.globStatus(at) or []:
        found = fs.listFiles(top.getPath(), True)
        while found.hasNext():
            p = found.next().getPath()
            if not p.getName().startswith(("_", ".")) and not p.getName().endswith(".part"):
                out.append(p.toString())
    return sorted(out)


def scan(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str) -> DataFrame:
    """One table of the declared schema from files whose schemas differ.

    The footers tell each file's schema (read side by side; no data). Files of one schema
    are one scan, so there are as many scans as schemas, not files; each is cast to the declared
    types and they are united. Columns that a file lacks, and values that a type cannot hold, are
    null; columns that are not declared are not read."""
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    found = [f for p in paths for f in files_below(spark, p)]
    with ThreadPoolExecutor(FOOTERS) as pool:
        schemas = list(pool.map(lambda f: spark.read.parquet(f).schema, found))
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    for f, own in zip(found, schemas, strict=True):
        groups.setdefault(own.simpleString(), (own, []))[1].append(f)
    whole = None
    for own, members in groups.values():
        df = spark.read.schema(own).parquet(*members)
        names = {c.lower(): c for c in df.columns}
        part = df.select(*((F.col(f"`{names[c.name.lower()]}`").try_cast(c.dataType) if c.name.lower() in names else F.lit(None).cast(c.dataType)).alias(c.name) for c in declared))
        whole = part if whole is None else whole.unionByName(part)
    return spark.createDataFrame([], declared) if whole is None else whole


def numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mixed columns as doubles; what is no number is null."""
    return df.withColumns({c: F.expr(f"try_cast({c} as double)") for c in columns if c in df.columns})


def until(df: DataFrame, season: int) -> DataFrame:
    return df.filter(F.col("season") <= season)


def with_game_ids(stats: DataFrame, games: DataFrame) -> DataFrame:
    """Player rows with the game_id of their team's game that week; one pass over the games gives both sides."""
    side = lambda c: F.struct(renamed(F.col(c), RELOCATED).alias("team"))
    keys = games.select("game_id", "season", "week", F.explode(F.array(side("home_team"), side("away_team"))).alias("s")).select("game_id", "season", "week", "s.team")
    named = stats.withColumn("_team", renamed(F.col("team"), RELOCATED))
    return named.join(keys.withColumnRenamed("team", "_team"), ["season", "week", "_team"], "left").drop("_team")


def match_rate(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(F.col("game_id").isNotNull().cast("double")).alias("match_rate"))


def new_stats_as_old(stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The newer release's names and its signed sack yards in the older form."""
    df = stats.withColumnsRenamed({"passing_interceptions": "interceptions", "sacks_suffered": "sacks"})
    return df.withColumn("sack_yards", -F.col("sack_yards_lost")).select(*columns)


def new_stats_schema(old: T.StructType) -> T.StructType:
    """The newer release's columns that make the older release's."""
    names = {"interceptions": "passing_interceptions", "sacks": "sacks_suffered", "sack_yards": "sack_yards_lost"}
    return T.StructType([T.StructField(names.get(f.name, f.name), f.dataType) for f in old])


def merged_stats(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both releases; of a player's rows of one game the older release's counts."""
    return first_source([old.select(*columns), new_stats_as_old(new, columns)], ["player_id", "game_id"], ["team"])


def stamped_injuries(injuries: DataFrame, stamps: dict[int, datetime]) -> DataFrame:
    """Injury rows; those without a stamp are known from their season's file's download on, or never."""
    if not stamps:
        return injuries
    pairs = F.create_map(*(F.lit(x) for pair in stamps.items() for x in pair))
    return injuries.withColumn("date_modified", F.coalesce(F.col("date_modified").cast("timestamp"), F.element_at(pairs, F.col("season").cast("int"))))


def season_stamps(log: dict[str, datetime]) -> dict[int, datetime]:
    """Season and download time of the log's injury files (`injuries_<season>`)."""
    return {int(m[1]): at for name, at in log.items() if (m := re.match(r"injuries_(\d{4})", name))}


def current_season(today: date | None = None) -> int:
    today = today or datetime.now(UTC).date()
    return today.year if today.month >= 8 else today.year - 1


def read_log(text: str | None) -> dict[str, datetime]:
    """File names and when they were fetched; a missing or bad log is an empty one."""
    try:
        return {k: datetime.fromisoformat(v).astimezone(UTC) for k, v in json.loads(text or "").items()}
    except (ValueError, AttributeError, TypeError):
        return {}


def season_files(first: int, last: int, pattern: str) -> list[str]:
    return [pattern.format(season=s) for s in range(first, last + 1)]


#: Last season of the older release of player rows.
OLD_RELEASE = 2024


def release_files(last: int | None = None) -> list[str]:
    """All files of the releases up to a season, by their places below the base address."""
    last = last or current_season()
    # fixed values: names and first seasons
    out = ["schedules/games.parquet", "players/players.parquet", "player_stats/player_stats.parquet", "player_stats/player_stats_def.parquet"]
    for first, pattern in ((2002, "weekly_rosters/roster_weekly_{season}.parquet"), (1999, "rosters/roster_{season}.parquet"), (2009, "injuries/injuries_{season}.parquet")):
        out += season_files(first, OLD_RELEASE, pattern)
    return out + weekly_files(last)


def weekly_files(last: int | None = None) -> list[str]:
    """What a season's refresh fetches: the schedule, and player rows and reports of the newer release."""
    last = last or current_season()
    new = [season_files(OLD_RELEASE + 1, last, p) for p in ("stats_player/stats_player_week_{season}.parquet", "injuries/injuries_{season}.parquet")]
    return ["schedules/games.parquet", *(f for pair in zip(*new, strict=True) for f in pair)]


# ---------------------------------------------------------------- sinks


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, round_to: int | None = None) -> None:
    """For small results: one file with a header."""
    if round_to is not None:
        df = df.select(*(F.round(c, round_to).alias(c) if t == "double" else c for c, t in df.dtypes))
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_in_ranges(df: DataFrame, path: str, ranges: Sequence[tuple[int, int]]) -> None:
    """One folder a range of seasons."""
    bucket = F.lit(None).cast("string")
    for lo, hi in ranges:
        bucket = F.when(F.col("season").between(lo, hi), f"{lo}_{hi}").otherwise(bucket)
    df.withColumn("seasons", bucket).filter("seasons is not null").write.mode("overwrite").partitionBy("seasons").parquet(path)


def json_report(df: DataFrame) -> str:
    """A few aggregate rows as JSON."""
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], indent=1, default=str)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file in a folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_one_csv(df: DataFrame, path: str) -> None:
    """A small result as one file of this name, with a header: written aside, then renamed in its file system."""
    spark = df.sparkSession
    aside = f"{path}.parts"
    df.coalesce(1).write.mode("overwrite").csv(aside, header=True)
    jvm = spark._jvm.org.apache.hadoop.fs
    to = jvm.Path(path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(x.getPath() for x in fs.listStatus(jvm.Path(aside)) if x.getPath().getName().startswith("part-"))
    fs.delete(to, False)
    fs.rename(part, to)
    fs.delete(jvm.Path(aside), True)
