"""Metrics of win probabilities and margins, each set in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLIP = 1e-6
#: Right-closed confidence bins from one half.
BINS = [(0.50, 0.55), (0.55, 0.60), (0.60, 0.65), (0.65, 0.70), (0.70, 0.75), (0.75, 1.00)]


def win_metrics(p: Column, won: Column) -> list[Column]:
    """n, accuracy (a probability above one half picks a win), log_loss, brier."""
    q = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    loss = -(won * F.log(q) + (1 - won) * F.log(1 - q))
    right = ((p > 0.5) == (won > 0.5)).cast("double")
    return [F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), F.avg(loss).alias("log_loss"), F.avg((p - won) * (p - won)).alias("brier")]


def margin_metrics(predicted: Column, margin: Column) -> list[Column]:
    """mae, rmse."""
    e = predicted - margin
    return [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")]


def confidence_bin(p: Column) -> Column:
    """The right-closed bin of the picked side's probability; exactly one half has none."""
    c = F.greatest(p, 1 - p)
    out = F.lit(None).cast("string")
    for lo, hi in reversed(BINS):
        out = F.when((c > lo) & (c <= hi), f"({lo:.2f}, {hi:.2f}]").otherwise(out)
    return out


def confidence_buckets(df: DataFrame, p: Column, won: Column, market: Column) -> DataFrame:
    """By bin: games, accuracy, average confidence, the market's accuracy where it has a price."""
    right = ((p > 0.5) == (won > 0.5)).cast("double")
    market_right = F.when(market.isNotNull(), ((market > 0.5) == (won > 0.5)).cast("double"))
    rows = df.withColumn("bin", confidence_bin(p)).filter("bin is not null")
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("games"), F.avg(right).alias("accuracy"), F.avg(F.greatest(p, 1 - p)).alias("confidence"), F.avg(market_right).alias("market"))


def agreement(p: Column, market: Column, won: Column) -> list[Column]:
    """agreement, and each side's accuracy where they disagree."""
    differ = (p > 0.5) != (market > 0.5)
    hit = lambda x: F.avg(F.when(differ, ((x > 0.5) == (won > 0.5)).cast("double")))
    return [F.avg((~differ).cast("double")).alias("agreement"), F.sum(differ.cast("long")).alias("disagreements"), hit(p).alias("ours"), hit(market).alias("markets")]


def against_the_spread(edge: Column, result: Column, least: float = 1.5) -> list[Column]:
    """Hit rate of the edge's side without pushes, overall and where the edge exceeds `least`. result: margin minus spread."""
    bet = (result != 0) & (edge != 0)
    hit = ((edge > 0) == (result > 0)).cast("double")
    big = bet & (F.abs(edge) > least)
    return [
        F.sum(bet.cast("long")).alias("bets"),
        F.avg(F.when(bet, hit)).alias("hit_rate"),
        F.sum(big.cast("long")).alias("big_bets"),
        F.avg(F.when(big, hit)).alias("big_hit_rate"),
    ]
