from gridstone.plans import fixture_queries as own
from gridstone.plans import model_queries

SF = "/root/testdata/sf0.001"


def test_every_season_after_the_first_is_predicted(spark):
    played = own.games(spark, SF).filter("home_score <> away_score").groupBy("season").count().collect()
    first, *rest = sorted((r["season"], r["count"]) for r in played)
    got = model_queries.walk_forward(spark, SF).collect()
    assert len(rest) > 2
    for model in ("ridge", "logit"):
        assert sorted((r["season"], r["n"]) for r in got if r["model"] == model) == rest


def test_rows_are_played_once(spark):
    plan = model_queries.rows(spark, SF)._jdf.queryExecution().toString()
    assert "parquet" in plan.lower() and "Window" not in plan and "Aggregate" not in plan


def test_games_are_read_once_and_predictions_join_nothing(spark, monkeypatch):
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        scored = model_queries.walk_forward(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in scored
        monkeypatch.setattr(model_queries, "written", lambda df: df)
        played = model_queries.rows(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert played.count("Scan parquet") == 1 and "Join" not in played
    finally:
        spark.conf.set(name, old)
