"""Proof that features do not look ahead: corrupt what lies after a cutoff, build again, compare."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.functions.expressions import truth
from gridstone.plans import models, pregame
from gridstone.session import settled, written
from gridstone.sources import files

TOLERANCE = 1e-9
#: Names, and parts of names, that no feature of a game may have.
FORBIDDEN = {"result", "margin", "total", "total_points", "overtime", "home_win", "is_tie"}
FORBIDDEN_PARTS = ("score", "moneyline", "spread", "total_line", "_odds", "implied_prob")


def corrupted(df: DataFrame, after: Column, keys: Sequence[str], columns: Sequence[str], seed: int = 7) -> DataFrame:
    """The table with other values in `columns` where `after` holds; they follow from key and seed, so any plan gives the same."""

    def other(c: str) -> Column:
        kind = df.schema[c].dataType
        h = F.xxhash64(*keys, F.lit(c), F.lit(seed))
        if kind.typeName() == "string":
            return F.concat(F.lit("x"), F.lower(F.hex(h)))
        if kind.typeName() in ("date", "timestamp", "timestamp_ntz"):
            return F.col(c)
        return (F.pmod(h, F.lit(97)) + 100).cast(kind)

    return df.withColumns({c: F.when(after, other(c)).otherwise(F.col(c)) for c in columns})


def differences(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = TOLERANCE, by: Sequence[str] = ()) -> DataFrame:
    """column, mismatches (by group, if `by` names some of the keys): rows that only one side has count in every column."""
    tagged = lambda df, p: df.select(*keys, F.struct(*columns).alias(p))
    both = tagged(a, "a").join(tagged(b, "b"), list(keys), "full_outer")

    def differ(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        numeric = a.schema[c].dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal")
        apart = F.abs(x.cast("double") - y.cast("double")) > tolerance if numeric else x != y
        return F.col("a").isNull() | F.col("b").isNull() | (x.isNull() != y.isNull()) | F.coalesce(apart, F.lit(False))

    sums = both.groupBy(*by).agg(*(F.coalesce(F.sum(differ(c).cast("long")), F.lit(0)).alias(c) for c in columns))
    return sums.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("mismatches")) for c in columns))).alias("e")).select(*by, "e.*")


# fixed values: what of a schedule is known long before, and what a game comes to
SCHEDULED = {"game_id", "season", "week", "gameday", "home_team", "away_team", "game_type", "location"}
OUTCOMES = ["home_score", "away_score", "result", "total", "overtime", "home_qb_id", "away_qb_id", "home_qb_name", "away_qb_name", "spread_line", "total_line", "home_moneyline", "away_moneyline", "home_spread_odds", "away_spread_odds", "over_odds", "under_odds"]
#: Statuses and positions that corrupted reports get.
STATUSES, POSITIONS = ["Out", "Doubtful", "Questionable", None], ["QB", "WR", "T", "DE", "CB"]


def _share(keys: Sequence[str], what: str, seed: int) -> Column:
    """A number from 0 to 99 that follows from the keys."""
    return F.pmod(F.xxhash64(*keys, F.lit(what), F.lit(seed)), F.lit(100))


def corrupted_inputs(inputs: dict[str, DataFrame], day: str | Column, seed: int = 7) -> dict[str, DataFrame]:
    """The inputs with all that is not known before `day` (a day, or a column of each table; where it is null nothing changes) changed: outcomes, starters (other known ones) and lines of games from that day on,
    half of their scores blank; schedule facts of later games; player rows of those games, half of them gone; reports stamped on or after the day, or never."""
    games = inputs["games"]
    cut = (F.lit(day) if isinstance(day, str) else day).cast("date")
    on, after = truth(F.to_date("gameday") >= cut), truth(F.to_date("gameday") > cut)
    key, w = ["game_id"], pregame.worlds(games)
    outcomes = [c for c in OUTCOMES if c in games.columns]
    bad = corrupted(games, on, key, [c for c in outcomes if c not in ("home_qb_id", "away_qb_id")], seed)
    scores = {c: F.when(on, (F.pmod(F.xxhash64("game_id", F.lit(c), F.lit(seed)), F.lit(55))).cast(games.schema[c].dataType)).otherwise(F.col(c)) for c in ("home_score", "away_score")}
    bad = bad.withColumns(scores)
    bad = bad.withColumns({c: F.when(on & (_share(key, "blank", seed) < 50), None).otherwise(F.col(c)) for c in scores})
    pool = games.select(F.explode(F.array("home_qb_id", "away_qb_id")).alias("q")).filter("q is not null").distinct().agg(F.array_sort(F.collect_set("q")).alias("q")).scalar()  # the league's starters
    bad = bad.withColumns({c: F.when(on, F.get(pool, F.pmod(F.xxhash64("game_id", F.lit(c), F.lit(seed)), F.size(pool)).cast("int"))).otherwise(F.col(c)) for c in ("home_qb_id", "away_qb_id")})
    bad = corrupted(bad, after, key, [c for c in games.columns if c not in SCHEDULED and c not in OUTCOMES and c not in (*w, "cut")], seed)
    played = games.filter(on).select(*w, "game_id", F.lit(True).alias("_late"))
    ps, own = inputs["ps"], ["game_id", "player_id", "team"]
    late = ps.join(played, [*w, "game_id"], "left").withColumn("_late", F.coalesce("_late", F.lit(False)))
    late = late.filter(~F.col("_late") | (_share(own, "gone", seed) < 50))
    late = corrupted(late, F.col("_late"), own, [c for c in ps.columns if c not in (*own, *w, "cut")], seed).select(*ps.columns)
    injuries = inputs["injuries"]
    unknown = cut.isNotNull() & F.coalesce(F.col("date_modified").cast("timestamp") >= cut.cast("timestamp"), F.lit(True))
    other = lambda values, c: F.get(F.array(*map(F.lit, values)), F.pmod(F.xxhash64("season", "week", "team", "gsis_id", F.lit(c), F.lit(seed)), F.lit(len(values))).cast("int"))
    reports = injuries.withColumns({c: F.when(unknown, other(v, c)).otherwise(F.col(c)) for c, v in (("report_status", STATUSES), ("position", POSITIONS))})
    out = {"games": bad, "ps": late, "injuries": reports}
    return out | {"rosters": corrupted_rosters(inputs["rosters"], games, cut, seed)} if "rosters" in inputs else out


# fixed values: what a corrupted roster row may say
ROSTER_STATUSES, PICKS, YEARS = ["ACT", "RES", "CUT"], 259, 15


def week_ends(games: DataFrame) -> DataFrame:
    """season, week, end: the last day of games of each week."""
    return games.groupBy(*pregame.worlds(games), "season", "week").agg(F.max(F.to_date("gameday")).alias("end"))


def corrupted_rosters(rosters: DataFrame, games: DataFrame, cut: Column, seed: int = 7) -> DataFrame:
    """Weekly rosters with other players, statuses, picks and years in the weeks that end on the cutoff or later, or that no game tells of."""
    w = pregame.worlds(rosters)
    key = [c for c in ("season", "week", "team", "gsis_id") if c in rosters.columns]
    pool = rosters.select("gsis_id").filter("gsis_id is not null").distinct().agg(F.array_sort(F.collect_set("gsis_id")).alias("q")).scalar()  # the league's players
    draw = lambda what, n: F.pmod(F.xxhash64(*key, F.lit(what), F.lit(seed)), n)
    rows = rosters.join(week_ends(games), [*w, "season", "week"], "left").withColumn("_late", cut.isNotNull() & F.coalesce(F.col("end") >= cut, F.lit(True)))
    other = {
        "gsis_id": F.get(pool, draw("gsis_id", F.size(pool)).cast("int")),
        "status": F.get(F.array(*map(F.lit, ROSTER_STATUSES)), draw("status", F.lit(len(ROSTER_STATUSES))).cast("int")),
        "draft_number": draw("draft_number", F.lit(PICKS)) + 1,
        "years_exp": draw("years_exp", F.lit(YEARS)),
    }
    changed = {c: F.when(F.col("_late"), e.cast(rosters.schema[c].dataType)).otherwise(F.col(c)) for c, e in other.items() if c in rosters.columns}
    return rows.withColumns(changed).select(*rosters.columns)


def leaky(build: Callable[[dict], dict]) -> Callable[[dict], dict]:
    """The build with each game's own margin as a feature: what the check must find."""

    def run(inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
        out = build(inputs)
        w = pregame.worlds(inputs["games"])
        own = inputs["games"].select(*w, "game_id", (F.col("home_score") - F.col("away_score")).cast("double").alias("leaky_feature"))
        return out | {"features": out["features"].join(own, [*w, "game_id"], "left")}

    return run


def cutoffs(games: DataFrame, n: int, seed: int = 7) -> dict[str, str]:
    """Names and days: n days of games in an order that follows from the seed, each season's first day but the first season's, and the last day."""
    days = games.groupBy(F.to_date("gameday").cast("string").alias("day")).agg(F.min("season").alias("season"))
    some = days.orderBy(F.xxhash64("day", F.lit(seed)), "day").limit(n).collect()
    firsts = games.groupBy("season").agg(F.min(F.to_date("gameday")).cast("string").alias("day")).orderBy("season").collect()  # a row a season
    last = days.agg(F.max("day")).first()[0]
    return {f"day {r['day']}": r["day"] for r in sorted(some, key=lambda r: r["day"])} | {f"first day of {r['season']}": r["day"] for r in firsts[1:]} | {"last day": last}


def invariance(build: Callable[[dict], dict], inputs: dict, clean: dict, day: str, seed: int = 7) -> DataFrame:
    """column, mismatches of all features of games and teams up to `day`, between the clean build and one from corrupted inputs."""
    bad = build(corrupted_inputs(inputs, day, seed))
    upto = F.to_date("gameday") <= F.lit(day).cast("date")
    out = None
    for name, keys in (("features", ["game_id"]), ("team_features", ["game_id", "team"])):
        a, b = clean[name].filter(upto), bad[name].filter(upto)
        found = differences(a, b, keys, [c for c in a.columns if c not in keys])
        out = found if out is None else out.unionByName(found)
    return out


CLEAN = "clean"


def in_worlds(inputs: dict[str, DataFrame], days: dict[str, str], seed: int = 7, corrupt: Callable[[dict, Column, int], dict] = corrupted_inputs) -> dict[str, DataFrame]:
    """All corrupted versions of the inputs and the clean one side by side: one copy a cutoff, as many as days and one more."""
    spark = inputs["games"].sparkSession
    of = spark.createDataFrame([(CLEAN, None), *days.items()], "world string, cut string")
    copies = {n: df.crossJoin(F.broadcast(of)) for n, df in inputs.items()}
    return {n: df.drop("cut") for n, df in corrupt(copies, F.col("cut"), seed).items()}


def invariances(build: Callable[[dict], dict], inputs: dict[str, DataFrame], days: dict[str, str], seed: int = 7, corrupt: Callable[[dict, Column, int], dict] = corrupted_inputs) -> DataFrame:
    """world, column, mismatches: `invariance` at all cutoffs (name: day) from one build, in which the world is part of every key."""
    built = build(in_worlds(inputs, days, seed, corrupt))
    of = F.broadcast(inputs["games"].sparkSession.createDataFrame(list(days.items()), "world string, cut string"))
    out = None
    for name, keys in (("features", ["game_id"]), ("team_features", ["game_id", "team"])):
        df = written(built[name])
        upto = F.to_date("gameday") <= F.col("cut").cast("date")
        a = df.filter(F.col("world") == CLEAN).drop("world").crossJoin(of).filter(upto).drop("cut")
        b = df.filter(F.col("world") != CLEAN).join(of, "world").filter(upto).drop("cut")
        found = differences(a, b, ["world", *keys], [c for c in df.columns if c not in (*keys, "world")], by=["world"])
        out = found if out is None else out.unionByName(found)
    return out


def smoke_accuracy(features: DataFrame, labels: DataFrame, first_test: int) -> tuple[float, int]:
    """Accuracy and number of games of a logistic model of the earlier seasons: above 70 % something leaks."""
    rows = features.join(labels.select("game_id", "home_win"), "game_id").filter("home_win is not null").withColumn("won", F.col("home_win"))
    names = [c for c in features.columns if c.startswith("diff_")] + ["neutral_site", "is_playoff", "div_game"]
    model = models.fit(rows.filter(F.col("season") < first_test), names, "won", models.logistic(0.05), False, both=False)
    got = model.predict(rows.filter(F.col("season") >= first_test)).agg(F.avg(((F.col("p") > 0.5) == (F.col("won") > 0.5)).cast("double")), F.count(F.lit(1))).first()
    return got[0], got[1]


def verify(build: Callable[[dict], dict], inputs: dict, n: int = 20, first_test: int | None = None, alarm: float = 0.70) -> tuple[str, list[str]]:
    """The report in Markdown and what failed: static checks, invariance at the cutoffs, the control, the smoke alarm."""
    clean = build(inputs)
    problems = static_problems(clean["features"], clean["labels"], clean["team_features"])
    lines, failed = ["# Leakage verification", "", "## Static checks", "", *(f"- {p}" for p in problems or ["none failed"])], list(problems)
    lines += ["", "## Invariance", "", "| cutoff | changed features | result |", "|---|---|---|"]
    days = cutoffs(inputs["games"], n)
    every = settled(invariances(leaky(build), inputs, days))  # with the control's feature: what else differs is the build's own
    by_world: dict[str, list[tuple[str, int]]] = {}
    for r in every.filter("mismatches > 0 and column <> 'leaky_feature'").orderBy("world", "column").collect():  # a row a cutoff and feature
        by_world.setdefault(r["world"], []).append((r["column"], r["mismatches"]))
    for name in days:
        found = by_world.get(name, [])
        lines.append(f"| {name} | {found[:5] or 0} | {'FAIL' if found else 'PASS'} |")
        failed += [f"invariance at {name}"] if found else []
    name = list(days)[len(days) // 2]
    day = days[name]
    found = {r["column"] for r in every.filter((F.col("world") == name) & (F.col("mismatches") > 0)).collect()}
    caught = found == {"leaky_feature"}
    lines += ["", "## Positive control", "", f"Flagged at {day}: {sorted(found)}. {'PASS' if caught else 'FAIL'}"]
    failed += [] if caught else ["positive control"]
    if first_test is not None:
        accuracy, games = smoke_accuracy(clean["features"], clean["labels"], first_test)
        lines += ["", "## Smoke alarm", "", f"{accuracy:.1%} on {games} games, alarm at {alarm:.0%}: {'PASS' if accuracy < alarm else 'FAIL'}"]
        failed += [] if accuracy < alarm else ["smoke alarm"]
    lines[1:1] = ["", "ALL CHECKS PASSED" if not failed else f"FAILED: {failed}"]
    return "\n".join(lines) + "\n", failed


def main(argv: list[str] | None = None) -> None:
    """Writes the report and ends with 1 if a check failed."""
    a = argparse.ArgumentParser(description="Verifies that features do not look ahead.")
    a.add_argument("root", help="folder of games, ps and injuries as Parquet")
    a.add_argument("report", help="folder of the report")
    a.add_argument("--cutoffs", type=int, default=20)
    a.add_argument("--first-test", type=int, help="first season of the smoke alarm's test")
    o = a.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    inputs = {n: files.read_table(spark, f"{o.root}/{n}") for n in ("games", "ps", "injuries")}
    text, failed = verify(pregame.build, inputs, o.cutoffs, o.first_test)
    files.write_text(spark, text, o.report)
    print(text)
    if failed:
        raise SystemExit(1)


def static_problems(features: DataFrame, labels: DataFrame, team_rows: DataFrame, key: str = "game_id") -> list[str]:
    """What a look at the schema and the keys finds."""
    out = [f"forbidden column {c}" for c in features.columns if c.lower() in FORBIDDEN or any(f in c.lower() for f in FORBIDDEN_PARTS)]
    if not features.groupBy(key).count().filter("count > 1").isEmpty():
        out.append("a game has several feature rows")
    if not team_rows.groupBy(key).count().filter("count <> 2").isEmpty():
        out.append("a game has not two team rows")
    if not team_rows.groupBy("team", "gameday").count().filter("count > 1").isEmpty():
        out.append("a team plays twice on a day")
    if not (features.join(labels, key, "left_anti").isEmpty() and labels.join(features, key, "left_anti").isEmpty()):
        out.append("features and labels differ in their games")
    return out


if __name__ == "__main__":
    main()
