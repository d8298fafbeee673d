import random

import pytest

from gridstone.operators import ratings

GAMES = "league string, game_id int, at long, season int, home string, away string, neutral boolean, margin double"


def rows():
    rng = random.Random(2)
    out = []
    for i in range(240):
        home, away = rng.sample("abcdef", 2)
        out.append(("lm"[i % 2], i, i // 8, 2000 + i // 60, home, away, i % 5 == 0, None if i % 31 == 30 else float(rng.choice([-7, -3, 0, 3, 10]))))
    return out


@pytest.fixture
def states(spark):
    before = spark.conf.get(ratings.STORE[0], None)
    spark.conf.set(*ratings.STORE)
    yield
    spark.conf.set(ratings.STORE[0], before) if before else spark.conf.unset(ratings.STORE[0])


def run(spark, source, sink, checkpoint):
    stream = spark.readStream.schema(GAMES).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = ratings.elo_stream(stream).writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return len([p for p in q.recentProgress if p["numInputRows"]])


def test_batches_equal_one_pass_and_restart(spark, states, tmp_path):
    games = rows()
    weeks = [games[k : k + 48] for k in range(0, 240, 48)]
    source, sink, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "state"

    def deliver(week):
        spark.createDataFrame(week[::-1], GAMES).coalesce(1).write.mode("append").parquet(str(source))

    for week in weeks[:2]:
        deliver(week)
    assert run(spark, source, sink, checkpoint) == 2
    for week in weeks[2:4]:  # another query on the same checkpoint goes on from its state
        deliver(week)
    assert run(spark, source, sink, checkpoint) == 2
    deliver(weeks[4])
    assert run(spark, source, sink, checkpoint) == 1
    played = spark.createDataFrame([g for g in games if g[-1] is not None], GAMES)
    want = {(r["league"], r["game_id"]): (r["home_elo"], r["away_elo"]) for r in ratings.elo(played).collect()}
    got = {(r["league"], r["game_id"]): (r["home_elo"], r["away_elo"]) for r in spark.read.parquet(str(sink)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    deliver(weeks[0][:2])  # a game from before
    with pytest.raises(Exception, match="rate the league anew"):
        run(spark, source, sink, checkpoint)
