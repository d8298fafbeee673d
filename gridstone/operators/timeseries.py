"""Windows that end before the current row.

Each function gives a Column over (partition, order); windows of one partitioning
and order share one exchange and sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from gridstone.functions.expressions import col, differs

Keys = Sequence[str]
#: Rows of a block of the exponentially weighted mean; further rows weigh nothing in double precision.
BLOCK = 4096


def spec(by: Keys, order: Keys) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def before(by: Keys, order: Keys, rows: int | None = None) -> WindowSpec:
    """The rows before the current one, all or the last few."""
    return spec(by, order).rowsBetween(Window.unboundedPreceding if rows is None else -rows, -1)


def prior_sum(value: Column | str, by: Keys, order: Keys) -> Column:
    """Sum over all earlier rows; zero before the first."""
    return F.coalesce(F.sum(col(value)).over(before(by, order)), F.lit(0))


def rolling_prior(value: Column | str, by: Keys, order: Keys, rows: int) -> Column:
    """Sum over the last few earlier rows; null before the first."""
    return F.sum(col(value)).over(before(by, order, rows))


def running_sum(value: Column | str, by: Keys, order: Keys, rows: int | None = None) -> Column:
    """Sum up to the current row, of all or the last few rows."""
    return F.sum(col(value)).over(spec(by, order).rowsBetween(Window.unboundedPreceding if rows is None else 1 - rows, 0))


def last_known(value: Column | str, by: Keys, order: Keys) -> Column:
    """The latest earlier value that is not null."""
    return F.last(col(value), ignorenulls=True).over(before(by, order))


def count_before(by: Keys, order: Keys) -> Column:
    return (F.row_number().over(spec(by, order)) - 1).cast("long")


def history(value: Column, by: Keys, order: Keys, rows: int) -> Column:
    """The last few earlier values as an array, oldest first."""
    return F.collect_list(value).over(before(by, order, rows))


def padded_history(value: Column, by: Keys, order: Keys, rows: int) -> tuple[Column, Column]:
    """The history padded on the left with nulls to `rows` entries, and its mask."""
    got = history(value, by, order, rows)
    missing = F.lit(rows) - F.size(got)
    mask = F.concat(F.array_repeat(F.lit(0), missing), F.array_repeat(F.lit(1), F.size(got)))
    return F.concat(F.transform(F.array_repeat(F.lit(0), missing), lambda _: F.lit(None)), got), mask


def ewm_prior(df: DataFrame, value: str, by: Keys, order: Keys, halflife: float, name: str) -> DataFrame:
    """Adds the exponentially weighted mean of earlier rows; rows without a value still age the others."""
    return ewm_priors(df, {name: value}, by, order, halflife)


def ewm_priors(df: DataFrame, values: dict[str, Column | str], by: Keys, order: Keys, halflife: float) -> DataFrame:
    """`ewm_prior` of several values (name: value), which share their sorts."""
    kept = df.columns
    for step in ewm_steps(values, by, order, halflife):
        df = df.withColumns(step)
    return df.drop(*(c for c in df.columns if c not in (*kept, *values)))


def ewm_steps(values: dict[str, Column | str], by: Keys, order: Keys, halflife: float, alike: dict[str, str] | None = None) -> list[dict[str, Column]]:
    """The columns of `ewm_priors` in four steps, each from those before: windows in the first, second and third; the values must stay until the last.

    A caller adds columns of other windows of one order to a step, so that they share its pass over the rows. `alike` (name: name)
    tells which values are known in the same rows as another, whose weights count for both. Weights grow by
    position within blocks, so they stay finite in partitions of any length; the block before joins with its total, which
    its last row has."""
    p = F.row_number().over(spec(by, order)) - 1
    w = F.pow(F.lit(2.0), F.col("_p") / halflife)
    scale = 2.0 ** (-BLOCK / halflife)
    terms = {f"n_{name}": col(value) * w for name, value in values.items()}
    terms |= {f"d_{name}": F.when(col(value).isNotNull(), w) for name, value in values.items() if name not in (alike or {})}
    within = {f"_{k}": F.coalesce(F.sum(term).over(before([*by, "_b"], order)), F.lit(0.0)) for k, term in terms.items()}
    last = lambda k: F.when(F.col("_p") == BLOCK - 1, F.col(f"_{k}") + F.coalesce(terms[k], F.lit(0.0)))
    earlier = {f"_e{k}": F.coalesce(last_known(last(k), by, order), F.lit(0.0)) * scale for k in terms}
    total = lambda k: F.col(f"_{k}") + F.col(f"_e{k}")
    den = lambda name: total(f"d_{(alike or {}).get(name, name)}")
    return [{"_p": p % BLOCK, "_b": F.floor(p / BLOCK)}, within, earlier, {name: F.when(den(name) > 0, total(f"n_{name}") / den(name)) for name in values}]


def islands(df: DataFrame, value: str, by: Keys, order: Keys, name: str) -> DataFrame:
    """Adds the number of the run of equal values that a row belongs to; unknown values start runs."""
    new = differs(F.col(value), F.lag(value).over(spec(by, order))).cast("long")
    return df.withColumn("_new", new).withColumn(name, running_sum("_new", by, order)).drop("_new")


def streak(df: DataFrame, outcome: str, by: Keys, order: Keys, name: str) -> DataFrame:
    """Adds the signed run of equal outcomes (1, -1; 0 ends a run) before each row; null outcomes are skipped."""
    kept = df.columns
    for step in streak_steps(outcome, by, order, name):
        df = df.withColumns(step)
    return df.drop(*(c for c in df.columns if c not in (*kept, name)))


def streak_steps(outcome: str, by: Keys, order: Keys, name: str) -> list[dict[str, Column]]:
    """The columns of `streak` in three steps, each from those before and with windows of one order; see `ewm_steps`.

    A run's length is the count of known outcomes less that before its first one, so all windows share one sort."""
    known = F.col(outcome).isNotNull()
    change = known & differs(F.col(outcome), last_known(outcome, by, order))
    start = F.max(F.when(F.col("_change"), F.col("_known") - 1)).over(spec(by, order).rowsBetween(Window.unboundedPreceding, 0))
    signed = F.when(known, F.col(outcome) * (F.col("_known") - F.col("_start")))
    return [{"_change": change, "_known": running_sum(known.cast("long"), by, order)}, {"_start": start}, {name: F.coalesce(last_known(signed, by, order), F.lit(0)).cast("long")}]
