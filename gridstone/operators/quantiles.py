"""Exact medians of many columns over growing sets of seasons, from counts of values.

Values are counted once by (column, value) and season; counts add up, so every
fold's medians and missing counts come from one table. Ranks are two-level prefix
sums over the sorted values: no task holds a column's values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.operators import scans


def value_counts(rows: DataFrame, columns: Sequence[str], season: str = "season") -> DataFrame:
    """column, value (null: missing), season, n."""
    entries = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns)))
    return rows.select(season, entries.alias("e")).groupBy("e.column", "e.value", F.col(season).alias("season")).agg(F.count(F.lit(1)).alias("n"))


def medians_before(rows: DataFrame, columns: Sequence[str], cutoffs: Sequence[int], season: str = "season", ranges: int | None = None) -> DataFrame:
    """column, cutoff, median (null without a value), missing: over the rows of seasons before each cutoff."""
    names = [f"f{i}" for i in range(len(cutoffs))]
    before = lambda c: F.coalesce(F.sum(F.when(F.col("season") < c, F.col("n"))), F.lit(0))
    counts = value_counts(rows, columns, season).groupBy("column", "value").agg(*(before(c).alias(n) for n, c in zip(names, cutoffs, strict=True)))
    totals = counts.groupBy("column").agg(*(F.sum(F.when(F.col("value").isNotNull(), F.col(n))).alias(f"t_{n}") for n in names), *(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col(n))), F.lit(0)).alias(f"m_{n}") for n in names))
    ranked = scans.prefixes(counts.filter("value is not null"), ["column"], ["value"], sums={f"r_{n}": n for n in names}, inclusive=True, ranges=ranges)
    some = ranked.join(F.broadcast(totals), "column")  # a row a column

    def holds(n: str, rank: str) -> F.Column:
        """The value whose places hold the rank, counted from 0; only one value does."""
        at = F.floor((F.col(f"t_{n}") - 1) / 2) if rank == "low" else F.floor(F.col(f"t_{n}") / 2)
        return F.max(F.when((F.col(f"r_{n}") - F.col(n) <= at) & (at < F.col(f"r_{n}")), F.col("value")))

    picked = some.groupBy("column").agg(*(((holds(n, "low") + holds(n, "high")) / 2).alias(f"d_{n}") for n in names))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("cutoff"), F.col(f"d_{n}").alias("median"), F.col(f"m_{n}").alias("missing")) for n, c in zip(names, cutoffs, strict=True))))
    return totals.join(picked, "column", "left").select("column", each.alias("e")).select("column", "e.*")
