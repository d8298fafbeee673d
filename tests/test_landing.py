import datetime
import shutil

import pytest
from pyspark.sql import functions as F

from gridstone.plans import core, models, predict
from gridstone.sources import files, landing
from tests.league import league

NEW = {"interceptions": "passing_interceptions", "sacks": "sacks_suffered"}


def one_file(df, path):
    """The rows as one Parquet file of this name."""
    aside = path.parent / (path.name + ".dir")
    path.parent.mkdir(parents=True, exist_ok=True)
    df.coalesce(1).write.mode("overwrite").parquet(str(aside))
    shutil.copy(next(aside.glob("part-*.parquet")), path)
    shutil.rmtree(aside)


def newer(ps):
    return ps.withColumn("sack_yards_lost", -F.col("sack_yards")).drop("sack_yards").withColumnsRenamed(NEW)


def release(source, games, ps, injuries):
    """What the address serves; the season's reports have no stamps."""
    one_file(games, source / "schedules" / "games.parquet")
    one_file(newer(ps.filter("game_id like '2025%'")), source / "stats_player" / "stats_player_week_2025.parquet")
    one_file(injuries.filter("season = 2025").drop("date_modified").withColumn("week", F.col("week").cast("double")), source / "injuries" / "injuries_2025.parquet")


@pytest.fixture
def places(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "WINNERS", ["curated_ridge_a3000"])
    monkeypatch.setattr(models, "MARGINS", ["curated_ridge_a3000"])
    inputs = league(spark, seasons=(2022, 2023, 2024, 2025), weeks=3)
    root = tmp_path / "root"
    for name, df in inputs.items():
        files.write_table(df.filter("season < 2025") if name != "ps" else df.filter("game_id < '2025'"), str(root / name))
    (tmp_path / "out").mkdir()
    return inputs, tmp_path / "source", root, tmp_path / "out"


def test_refresh_reaches_the_predictions(spark, places):
    inputs, source, root, out = places
    games, ps, injuries = inputs["games"], inputs["ps"], inputs["injuries"]
    release(source, games, ps, injuries)
    # a root that only Hadoop's file systems open
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.gs.link./in", root.as_uri())
    place = "viewfs://gs/in"
    predict.main([place, str(out), "--refresh", source.as_uri(), "--retrain"])
    first = [r.asDict() for r in spark.read.csv(f"{out}/2025_week03.csv", header=True).collect()]
    assert len(first) == 4
    got = predict.load_inputs(spark, place)
    assert got["ps"].filter("game_id like '2025%'").count() == ps.filter("game_id like '2025%'").count() > 0
    stamps = got["injuries"].filter("season = 2025").select("date_modified").distinct().collect()
    assert len(stamps) == 1 and abs((datetime.datetime.now() - stamps[0][0]).total_seconds()) < 86_400
    assert got["injuries"].filter("season < 2025").count() == injuries.filter("season < 2025").count()

    # a changed score changes what is predicted of the same week
    changed = games.withColumn("home_score", F.when((F.col("season") == 2025) & (F.col("week") == 2), F.col("home_score") + 40).otherwise(F.col("home_score")))
    release(source, changed, ps, injuries)
    predict.main([place, str(out), "--refresh", source.as_uri()])
    second = [r.asDict() for r in spark.read.csv(f"{out}/2025_week03.csv", header=True).collect()]
    assert {r["game_id"] for r in first} == {r["game_id"] for r in second} and {r["game_id"]: r["p_home_win"] for r in first} != {r["game_id"]: r["p_home_win"] for r in second}

    # the week is played and a new one is in the schedule
    day = F.date_add(F.to_date("gameday"), 7).cast("string")
    last = changed.filter("season = 2025 and week = 3")
    fresh = last.withColumns({"week": F.lit(4), "gameday": day, "game_id": F.concat(F.lit("2025_04_"), "away_team", F.lit("_"), "home_team")})
    done = changed.filter("not (season = 2025 and week = 3)").unionByName(last.withColumns({"home_score": F.lit(21.0), "away_score": F.lit(14.0)}))
    release(source, done.unionByName(fresh), ps, injuries)
    predict.main([place, str(out), "--refresh", source.as_uri()])
    assert {r["game_id"] for r in spark.read.csv(f"{out}/2025_week04.csv", header=True).collect()} == {r["game_id"] for r in fresh.collect()}
    with pytest.raises(SystemExit):
        predict.main([place, str(out), "--season", "2025", "--week", "3"])


def test_what_fails_keeps_its_old_state(spark, places):
    inputs, source, root, _ = places
    names = ["schedules/games.parquet", "stats_player/stats_player_week_2025.parquet", "injuries/injuries_2025.parquet"]
    release(source, inputs["games"], inputs["ps"], inputs["injuries"])
    at = datetime.datetime(2025, 9, 1, tzinfo=datetime.UTC)
    assert landing.refresh(spark, source.as_uri(), str(root), names, at) == {}
    before = landing.current(spark, str(root))
    assert {n: f.fetched_at for n, f in before.items()} == dict.fromkeys(names, at) and before[names[2]].season == 2025
    (source / names[0]).write_bytes(b"no parquet")
    (source / names[1]).unlink()
    later = at + datetime.timedelta(days=7)
    failed = landing.refresh(spark, source.as_uri(), str(root), [*names, "injuries/injuries_2026.parquet"], later)
    assert set(failed) == {names[0], names[1], "injuries/injuries_2026.parquet"}
    after = landing.current(spark, str(root))
    assert after[names[0]] == before[names[0]] and after[names[1]] == before[names[1]] and after[names[2]].fetched_at == later
    assert landing.prune(spark, str(root), 1) == 1 and spark.read.parquet(after[names[2]].path).count() > 0
    assert not landing.exists(spark, before[names[2]].path) and landing.prune(spark, str(root), 1) == 0
    assert landing.refresh(spark, str(source / "nowhere"), str(root), names).keys() == set(names)


def test_files_of_several_schemas_are_one_table(spark, tmp_path):
    stamped = spark.createDataFrame([(2024, 1, "A", "p1", "QB", "Out", datetime.datetime(2024, 9, 1), "7")], "season int, week int, team string, gsis_id string, position string, report_status string, date_modified timestamp, jersey_number string")
    bare = spark.createDataFrame([(2025.0, 2.0, "B", "p2", "WR", None, 12), (None, 3.0, "C", None, None, None, None)], "season double, week double, team string, gsis_id string, position string, report_status string, jersey_number int")
    text = spark.createDataFrame([("2026", "x", "D", "QB1", "n/a")], "season string, week string, TEAM string, gsis_id string, jersey_number string")
    for year, df in ((2024, stamped), (2025, bare), (2026, text)):
        one_file(df, tmp_path / "in" / f"injuries_{year}.parquet")
    stamped.withColumn("season", F.lit(2023)).write.parquet(str(tmp_path / "in" / "injuries_2023"))
    got = files.scan(spark, [str(tmp_path / "in")], predict.INJURIES + ", jersey_number double")
    assert got.columns == [*[c.split()[0] for c in predict.INJURIES.split(", ")], "jersey_number"]
    rows = sorted(map(tuple, got.select("season", "week", "team", "gsis_id", F.col("date_modified").isNotNull(), "jersey_number").collect()), key=str)
    assert rows == [(2023, 1, "A", "p1", True, 7.0), (2024, 1, "A", "p1", True, 7.0), (2025, 2, "B", "p2", False, 12.0), (2026, None, "D", "QB1", False, None), (None, 3, "C", None, False, None)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3  # as many scans as schemas
    assert files.scan(spark, [str(tmp_path / "none*")], "a int").collect() == []


def test_core_tables_from_raw_files(spark, tmp_path):
    inputs = league(spark, seasons=(2023, 2024, 2025), weeks=2)
    raw, out = tmp_path / "raw", tmp_path / "core"
    games = inputs["games"]
    one_file(games, raw / "schedules" / "games.parquet")
    one_file(spark.createDataFrame([("p", "A Name")], "gsis_id string, display_name string"), raw / "players" / "players.parquet")
    for year, kind, value in ((2023, "string", "12"), (2024, "int", 13), (2025, "double", 14.0)):
        roster = spark.createDataFrame([(year, "p", value)], f"season int, gsis_id string, jersey_number {kind}")
        one_file(roster, raw / "rosters" / f"roster_{year}.parquet")
        one_file(roster.withColumn("week", F.lit(1)).withColumn("draft_number", F.lit("x")), raw / "weekly_rosters" / f"roster_weekly_{year}.parquet")
    ps = inputs["ps"].join(games.select("game_id", "season", "week"), "game_id").drop("game_id").withColumnRenamed("team", "recent_team")
    strange = ps.limit(1).withColumn("recent_team", F.lit("NOWHERE"))
    one_file(ps.unionByName(strange), raw / "player_stats" / "player_stats.parquet")
    one_file(ps.withColumnRenamed("recent_team", "team"), raw / "player_stats" / "player_stats_def.parquet")
    told = {r["table"]: r for r in core.build(spark, str(raw), str(out), 2024, [(2002, 2023), (2024, 2030)]).collect()}
    n = ps.filter("season <= 2024").count()
    assert told["games"]["rows"] == games.filter("season <= 2024").count() and told["season_rosters"]["rows"] == 2
    assert told["ps"]["rows"] == n + strange.filter("season <= 2024").count() and told["ps_defense"]["match_rate"] == 1.0 > told["ps"]["match_rate"]
    assert sorted(r[0] for r in spark.read.parquet(f"{out}/season_rosters").select("jersey_number").collect()) == [12.0, 13.0]
    assert {p.name for p in (out / "weekly_rosters").iterdir() if p.is_dir()} == {"seasons=2002_2023", "seasons=2024_2030"}
    assert spark.read.parquet(f"{out}/ps").filter("game_id is not null and gameday is null").isEmpty()
    core.main([str(raw), str(tmp_path / "again"), "--cutoff", "2023"])
    assert spark.read.parquet(str(tmp_path / "again" / "games")).filter("season > 2023").isEmpty()
