"""Column expressions with the null rules that point-in-time features need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den where den is above zero, else null."""
    return F.when(col(den) > 0, col(num) / col(den))


def truth(condition: Column) -> Column:
    """A comparison with an unknown side is false."""
    return F.coalesce(condition, F.lit(False))


def differs(a: Column, b: Column) -> Column:
    """An unknown side counts as different, even from an unknown one."""
    return F.coalesce(a != b, F.lit(True))


def nan_to_null(c: Column | str) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def renamed(value: Column, codes: dict[str, str]) -> Column:
    """The value under its code's new name; others as they are."""
    pairs = [F.lit(x) for kv in sorted(codes.items()) for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), value), value) if codes else value


def implied_probability(moneyline: Column) -> Column:
    """Of an American moneyline."""
    return F.when(moneyline < 0, -moneyline / (100 - moneyline)).otherwise(100 / (moneyline + 100))


def no_vig(home: Column, away: Column) -> Column:
    """The home side's share of both implied probabilities."""
    h, a = implied_probability(home), implied_probability(away)
    return h / (h + a)


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 26.2.17 for the absolute value; its error is below 7.5e-8."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def season_of(day: Column) -> Column:
    """The year in which a season that starts in August began."""
    return F.when(F.month(day) >= 8, F.year(day)).otherwise(F.year(day) - 1)
