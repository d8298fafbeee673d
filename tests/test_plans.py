import json
import math

import pytest
from pyspark.sql import functions as F

from gridstone.plans import history, models, predict, pregame, verification
from gridstone.sources import files
from tests.league import league


@pytest.fixture(scope="module")
def built(spark):
    inputs = league(spark, seasons=(2017, 2018, 2019, 2020, 2021), weeks=4)
    out = pregame.build(inputs)
    return inputs, {n: df.cache() for n, df in out.items()}


def small(monkeypatch):
    monkeypatch.setattr(models, "WINNERS", ["curated_ridge_a3000", "curated_logit_C0.001"])
    monkeypatch.setattr(models, "MARGINS", ["curated_ridge_a3000"])


def test_candidates_and_columns(built):
    rows = pregame.model_rows(built[1]["features"], built[1]["labels"])
    columns = pregame.feature_columns(rows)
    assert len(columns) == 74 and len(models.CURATED) == 22 and set(models.CURATED) <= set(columns)
    names = set(models.candidates(columns))
    assert len(names) == 28 and {*models.WINNERS, *models.MARGINS} <= names
    assert {"logit_C0.0003", "ridge_a30", "hgb_reg_lr0.03_d2_n300", "hgb_clf_lr0.02_d3_n600", "hgb_reg_lr0.05_d2_n200", "elo_margin"} <= names
    two = rows.select("diff_elo", "home_adv", "is_playoff").limit(1)
    a, b = two.first(), two.select(*models.flipped(two.columns)).first()
    assert (b[0], b[1], b[2]) == (-a[0], -a[1], a[2])


def test_leakage_suite(built):
    inputs, out = built
    days = verification.cutoffs(inputs["games"], 1)
    assert len(days) == 6 and days["last day"] == max(r["gameday"] for r in inputs["games"].collect())
    day = days["first day of 2020"]
    bad = verification.corrupted_inputs(inputs, day)
    late = F.col("gameday") >= day
    n = inputs["games"].filter(late).count()
    blank = bad["games"].filter(late & F.col("home_score").isNull()).count()
    assert 0.2 * n < blank < 0.8 * n
    assert bad["ps"].count() < inputs["ps"].count()
    before = bad["games"].filter(~late).orderBy("game_id").collect()
    assert before == inputs["games"].filter(~late).orderBy("game_id").collect()
    assert verification.invariance(pregame.build, inputs, out, day).filter("mismatches > 0").collect() == []
    leaky = verification.leaky(pregame.build)
    found = {r["column"] for r in verification.invariance(leaky, inputs, leaky(inputs), day).filter("mismatches > 0").collect()}
    assert found == {"leaky_feature"}
    accuracy, games = verification.smoke_accuracy(out["features"], out["labels"], 2021)
    assert games == out["labels"].filter("season = 2021 and home_win is not null").count() > 5 and 0 <= accuracy <= 1


def test_many_worlds_are_one_build(built):
    inputs, out = built
    days = {"first day of 2019": verification.cutoffs(inputs["games"], 0)["first day of 2019"], "some day": "2020-09-22", "last day": verification.cutoffs(inputs["games"], 0)["last day"]}
    builds = []

    def counted(x):
        builds.append(1)
        return verification.leaky(pregame.build)(x)

    got = {(r["world"], r["column"]): r["mismatches"] for r in verification.invariances(counted, inputs, days).collect()}
    assert len(builds) == 1 and {w for w, _ in got} == set(days)
    assert {c for (_, c), n in got.items() if n} == {"leaky_feature"} and len(got) > 3 * 280
    leaky = verification.leaky(pregame.build)
    for name in ("some day", "last day"):
        one = {r["column"]: r["mismatches"] for r in verification.invariance(leaky, inputs, leaky(inputs), days[name]).filter("column = 'leaky_feature'").collect()}
        assert got[name, "leaky_feature"] == one["leaky_feature"]


def test_written_tables_keep_their_orders(spark, built, tmp_path):
    pregame.write(built[1], str(tmp_path))
    team = [tuple(r) for r in spark.read.parquet(str(tmp_path / "team_features")).select("gameday", "game_id", "is_home").collect()]
    assert team == sorted(team, key=lambda r: (r[0], r[1], -r[2])) and len(team) > 100
    games = [tuple(r) for r in spark.read.parquet(str(tmp_path / "labels")).select("gameday", "game_id").collect()]
    assert games == sorted(games)


def test_validation_files(spark, built, tmp_path):
    rows = pregame.model_rows(built[1]["features"], built[1]["labels"]).withColumn("won", F.col("home_win")).cache()
    names = ["elo_logit", "elo_margin", "curated_ridge_a3000"]
    predictions = models.validate(rows, pregame.feature_columns(rows), [2020, 2021], names)
    summary = models.write_validation(predictions, str(tmp_path)).collect()
    assert {p.name for p in (tmp_path / "validation_oof").iterdir() if p.is_dir()} == {f"model={n}" for n in names}
    n = rows.filter("season >= 2020").count()
    assert all(r["n"] == n for r in summary) and [r["log_loss"] for r in summary] == sorted(r["log_loss"] for r in summary)
    assert {r["model"]: (r["kind"], r["mae"] is not None) for r in summary} == {"elo_logit": ("win", False), "elo_margin": ("margin", True), "curated_ridge_a3000": ("margin", True)}
    assert (tmp_path / "validation_summary.csv").is_file()


def test_report_and_exit(spark, built, tmp_path, monkeypatch):
    inputs, out = built
    monkeypatch.setattr(pregame, "build", lambda _: out)
    found = lambda rows: monkeypatch.setattr(verification, "invariances", lambda build, inputs, days: spark.createDataFrame([(d, *r) for d in days for r in rows], "world string, column string, mismatches long"))
    found([("leaky_feature", 3), ("diff_elo", 0)])
    text, failed = verification.verify(pregame.build, inputs, 2)
    assert failed == [] and "ALL CHECKS PASSED" in text and "| last day | 0 | PASS |" in text
    found([("x", 1)])
    for name, df in inputs.items():
        files.write_table(df, str(tmp_path / name))
    with pytest.raises(SystemExit):
        verification.main([str(tmp_path), str(tmp_path / "report"), "--cutoffs", "0"])
    assert "positive control" in "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "report")).collect())


def test_final_test_and_saved_models(spark, built, tmp_path, monkeypatch):
    _, out = built
    rows = pregame.model_rows(out["features"], out["labels"]).withColumn("won", F.col("home_win")).cache()
    columns = pregame.feature_columns(rows)
    got = models.final_test(rows, out["benchmark"], columns, [2021], ["curated_ridge_a3000", "curated_logit_C0.001"], ["curated_ridge_a3000"])
    n = rows.filter("season = 2021").count()
    winner = {r["predictor"]: r for r in got["winner"].collect()}
    assert set(winner) == {"ensemble", "elo", "always_home", "market"} and all(r["n"] == n for r in winner.values())
    assert {r["predictor"] for r in got["margin"].collect()} == {"ensemble", "market", "zero"}
    p = {r["game_id"]: r for r in got["predictions"].collect()}
    assert winner["ensemble"]["brier"] == pytest.approx(sum((r["p"] - r["won"]) ** 2 for r in p.values()) / n)
    assert sum(r["games"] for r in got["seasons"].collect()) == n and got["agreement"].count() == 1
    told = json.loads(models.write_final_test(got, str(tmp_path / "final")))
    assert {r["predictor"] for r in told["winner"]} == set(winner) and told["agreement"][0]["disagreements"] >= 0 and "predictions" not in told
    assert spark.read.parquet(str(tmp_path / "final" / "predictions")).count() == n and "winner" in "".join(r["value"] for r in spark.read.text(str(tmp_path / "final" / "report")).collect())
    fitted = models.fit_named(rows.filter("season < 2021"), ["curated_ridge_a3000", "elo_logit"], columns)
    last = predict.smoke(rows, fitted, {"winners": ["elo_logit"], "margins": ["curated_ridge_a3000"]}).collect()
    days = sorted(((r["gameday"], r["game_id"]) for r in rows.collect()), reverse=True)
    assert [(r["gameday"], r["game_id"]) for r in last] == days[:3] and all(0 < r["p"] < 1 for r in last)
    models.save(spark, str(tmp_path / "m"), fitted, {"trained_through": 2020})
    back, about = models.restore(spark, str(tmp_path / "m"))
    assert about == {"trained_through": 2020}
    for name, m in fitted.items():
        test = rows.filter("season = 2021")
        a, b = ({r["game_id"]: r["p"] for r in x.predict(test).collect()} for x in (m, back[name]))
        assert a == pytest.approx(b)


def test_market_residuals(built):
    _, out = built
    rows = pregame.model_rows(out["features"], out["labels"]).withColumn("won", F.col("home_win"))
    rows = models.market_rows(rows, out["benchmark"].withColumn("spread_line", F.col("spread_line") + F.length("game_id") % 3)).cache()
    r = rows.first()
    assert r["resid"] == r["margin"] - r["spread_line"] and r["abs_spread"] == abs(r["spread_line"])
    whole, summary = models.market_residuals(rows, [2021], ["diff_elo", "home_adv"], ["spread_line", "abs_spread", "home_adv"], models.boosted(False, 0.1, 2, 2, 5))
    got = {r["model"]: r for r in summary.collect()}
    assert set(got) == {"v1", "spread", "ridge_bias", "trees_bias", "ridge_bias_gap", "ridge_gap", "stack"}
    assert whole.count() == rows.filter("season = 2021").count() and got["stack"]["hit_rate"] is None and got["ridge_bias"]["bets"] > 0
    for r in whole.collect():
        assert all(0 <= r[c] <= 1 for c in whole.columns if c.startswith("p_"))


def test_prediction_tool(spark, tmp_path, monkeypatch):
    small(monkeypatch)
    inputs = league(spark, seasons=(2018, 2019, 2020, 2021), weeks=3)
    for name, df in inputs.items():
        files.write_table(df, str(tmp_path / name))
    (tmp_path / "download_log.json").write_text(json.dumps({"injuries_2021.parquet": "2021-09-01T00:00:00+00:00"}))
    root, out = str(tmp_path), str(tmp_path / "out")
    (tmp_path / "out").mkdir()
    predict.main([root, out, "--retrain"])
    rows = spark.read.csv(f"{out}/2021_week03.csv", header=True).collect()
    assert rows and list(rows[0].asDict()) == ["date", "matchup", "pick", "win_prob", "p_home_win", "pred_margin", "market_line", "expected_qbs", "early_prediction", "game_id"]
    for r in rows:
        assert r["pred_margin"].startswith(f"{r['pick']} by ") and r["market_line"].endswith("-2.5") and " @ " in r["expected_qbs"] and float(r["win_prob"]) >= 0.5
    predict.main([root, out, "--backtest", "2020"])
    r = spark.read.csv(f"{out}/backtest_2020.csv", header=True).first()
    assert int(r["games"]) > 0 and r["out_of_sample"] == "false"
    with pytest.raises(SystemExit):
        predict.main([root, out, "--season", "2020", "--week", "2"])


def test_early_flags_and_targets(spark):
    games = spark.createDataFrame([("a", "2021-09-01", "X", "Y", None), ("b", "2021-09-08", "Y", "Z", None), ("c", "2021-09-08", "V", "W", None), ("d", "2021-08-01", "V", "X", 3.0), ("e", "2021-10-01", "V", "W", None)], "game_id string, gameday string, home_team string, away_team string, home_score double")
    assert {r["game_id"] for r in predict.early_flags(games).filter("early").collect()} == {"b", "e"}
    left = predict.until_targets(games, spark.createDataFrame([("b",)], "game_id string"))
    assert {r["game_id"] for r in left.collect()} == {"a", "b", "c", "d"}


def test_histories(built):
    inputs, out = built
    rows = history.results(out["team_features"], inputs["games"], inputs["ps"]).cache()
    got = {(r["game_id"], r["team"]): r for r in history.histories(rows, 4).collect()}
    past: dict = {}
    for r in sorted(rows.collect(), key=lambda r: (r["day"], r["game_id"])):
        mine = past.setdefault(r["team"], [])
        h = got[r["game_id"], r["team"]]
        want = mine[-4:]
        assert h["mask"] == [0] * (4 - len(want)) + [1] * len(want) and len(h["history"]) == 4
        for x, p in zip(h["history"][4 - len(want) :], want, strict=True):
            assert len(x) == 14 and x[0] == p["result"]["pt_diff"]
            assert x[12] == pytest.approx(math.log1p((r["day"] - p["day"]).days) / 5) and x[13] == float(p["season"] == r["season"])
        mine.append(r)
    f = out["features"]
    z = history.scaled(f, f.filter("season < 2021"), ["diff_elo", "diff_h2h_last_margin", "temp"]).first()
    assert z["m_temp"] == 1 and z["z_temp"] == 0.0 and abs(z["z_diff_elo"]) <= 6


def test_measures_of_a_game(spark):
    feature = [("g", 2020, "2020-09-10", "A", "B", 1, 1550.0), ("g", 2020, "2020-09-10", "B", "A", 0, 1500.0), ("u", 2020, "2020-09-17", "A", "B", 0, 1560.0), ("u", 2020, "2020-09-17", "B", "A", 1, 1490.0)]
    team = spark.createDataFrame(feature, "game_id string, season int, gameday string, team string, opp string, is_home int, elo double")
    games = spark.createDataFrame([("g", 24, 10), ("u", None, None)], "game_id string, home_score int, away_score int")
    boxes = spark.createDataFrame([("g", "A", 6.5, None, 2.0)], "game_id string, team string, anya double, ypc double, turnovers double")
    original, history.team_boxes = history.team_boxes, lambda stats: stats
    try:
        got = {(r["game_id"], r["team"]): r["result"].asDict() for r in history.results(team, games, boxes).collect()}
    finally:
        history.team_boxes = original
    want = {"pt_diff": 1.0, "pf": 0.3, "pa": -1.1, "win": 0.5, "anya": 0.5, "d_anya": 0.0, "ypc": 0.0, "d_ypc": 0.0, "to_margin": -0.25, "opp_elo": 0.0, "was_home": 0.5, "adj_diff": 12 / 14}
    assert got["g", "A"] == pytest.approx(want) and list(got["g", "A"]) == list(want)
    assert got["g", "B"]["d_anya"] == 0.5 and got["g", "B"]["to_margin"] == 0.25 and got["g", "B"]["adj_diff"] == pytest.approx(-12 / 14)
    assert got["u", "B"]["pt_diff"] is None and got["u", "B"]["win"] == -0.5 and got["u", "B"]["opp_elo"] == pytest.approx(0.6)


def test_corrupted_rosters(spark):
    games = spark.createDataFrame([("a", 2020, 1, "2020-09-10"), ("b", 2020, 1, "2020-09-14"), ("c", 2020, 2, "2020-09-20")], "game_id string, season int, week int, gameday string")
    assert {(r["week"], str(r["end"])) for r in verification.week_ends(games).collect()} == {(1, "2020-09-14"), (2, "2020-09-20")}
    rows = [(2020, w, "T", f"p{i}", "ACT", 300, 99, i) for w in (1, 2, 3) for i in range(30)]
    rosters = spark.createDataFrame(rows, "season int, week int, team string, gsis_id string, status string, draft_number int, years_exp int, jersey int")
    got = verification.corrupted_rosters(rosters, games, F.lit("2020-09-15").cast("date"))
    assert got.columns == rosters.columns and got.count() == 90
    assert sorted(map(tuple, got.filter("week = 1").collect())) == sorted(r for r in rows if r[1] == 1)
    late = got.filter("week > 1").collect()
    assert all(1 <= r["draft_number"] <= 259 and 0 <= r["years_exp"] < 15 and r["status"] in verification.ROSTER_STATUSES and r["gsis_id"] in {f"p{i}" for i in range(30)} for r in late)
    assert sum(r["gsis_id"] != f"p{r['jersey']}" for r in late) > 40
    on_the_day = verification.corrupted_rosters(rosters, games, F.lit("2020-09-14").cast("date")).filter("week = 1 and draft_number = 300").count()
    assert on_the_day == 0 and verification.corrupted_rosters(rosters, games, F.lit(None).cast("date")).exceptAll(rosters).isEmpty()


def test_release_files_and_merging(spark, tmp_path):
    names = files.release_files(2026)
    assert len(names) == 4 + 23 + 26 + 16 + 1 + 4 and "weekly_rosters/roster_weekly_2002.parquet" in names and names[-1] == "injuries/injuries_2026.parquet"
    old = spark.createDataFrame([("p", "g", "T", 1.0, 5.0, 2.0)], "player_id string, game_id string, team string, interceptions double, sacks double, sack_yards double")
    new = spark.createDataFrame([("p", "g", "T", 9.0, 9.0, -9.0), ("q", "g", "T", 1.0, 2.0, -3.0)], "player_id string, game_id string, team string, passing_interceptions double, sacks_suffered double, sack_yards_lost double")
    assert {tuple(r) for r in files.merged_stats(old, new, old.columns).collect()} == {("p", "g", "T", 1.0, 5.0, 2.0), ("q", "g", "T", 1.0, 2.0, 3.0)}
    injuries = spark.createDataFrame([(2025, "2025-01-01 00:00:00"), (2025, None), (2024, None)], "season int, date_modified string").withColumn("date_modified", F.col("date_modified").cast("timestamp"))
    got = files.stamped_injuries(injuries, files.season_stamps(files.read_log('{"injuries_2025.parquet": "2025-11-02T10:00:00+00:00"}'))).selectExpr("season", "cast(date_modified as string) d").collect()
    assert sorted((r["season"], r["d"] or "") for r in got) == [(2024, ""), (2025, "2025-01-01 00:00:00"), (2025, "2025-11-02 10:00:00")]
    games = spark.createDataFrame([("g1", 2020, 1, "OAK", "KC"), ("g2", 2020, 2, "LV", "DEN")], "game_id string, season int, week int, home_team string, away_team string")
    stats = spark.createDataFrame([(2020, 1, "LV"), (2020, 2, "OAK"), (2020, 3, "KC")], "season int, week int, team string")
    named = files.with_game_ids(stats, games)
    assert {(r["week"], r["game_id"]) for r in named.collect()} == {(1, "g1"), (2, "g2"), (3, None)}
    assert files.match_rate(named).first()[0] == pytest.approx(2 / 3)
