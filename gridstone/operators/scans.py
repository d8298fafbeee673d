"""Prefix operators for keys of any size: two-level scans.

Rows are dealt by ranges of (key, order), so one key's rows may lie in many
tasks; rows of one key and one order value always lie together. Each range gives
its own prefix values and one total a key; totals of the ranges before are carried
in. Only keys that lie in several ranges need a carry, and n ranges have at most n - 1
borders, so the carries are at most 2 n rows and are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridstone.functions.expressions import col
from gridstone.operators.asof import clock
from gridstone.session import settled

PART = "_range"


def laid(df: DataFrame, by: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """The rows with their range; written once, as the ranges' borders are drawn from a sample."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(df.repartitionByRange(n, *by, *order).withColumn(PART, F.spark_partition_id()))


def carries(rows: DataFrame, by: Sequence[str], totals: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """by, range and the carried values: of each key in several ranges, over its totals in the ranges before."""
    per = rows.groupBy(*by, PART).agg(*(e.alias(c) for c, e in totals.items()))
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    wide = per.withColumn("_ranges", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    out = wide.select(*by, PART, "_ranges", *(e.over(before).alias(c) for c, e in carried.items()))
    return out.filter("_ranges > 1").drop("_ranges")


def with_carries(rows: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows with the carries of their key and range, null keys included."""
    other = found.select(*(F.col(b).alias(f"_c_{b}") for b in by), F.col(PART).alias("_c_range"), *(c for c in found.columns if c not in (*by, PART)))
    on = reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(f"_c_{b}")) for b in by), F.col(PART) == F.col("_c_range"))
    return rows.join(F.broadcast(other), on, "left").drop("_c_range", *(f"_c_{b}" for b in by))


def prefixes(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, Column | str] | None = None, lasts: dict[str, Column | str] | None = None, counts: Sequence[str] = (), inclusive: bool = False, ranges: int | None = None) -> DataFrame:
    """Adds, over each key's earlier rows (or, if inclusive, those up to the row): sums (0 before the first), latest known values, counts of rows.

    The same values as `prior_sum`, `running_sum`, `last_known` and `count_before` of `timeseries`; `order` must be
    unique within a key. A key's rows may lie in many tasks."""
    sums, lasts = sums or {}, lasts or {}
    rows = df.withColumns({f"_s_{c}": col(v) for c, v in sums.items()} | {f"_l_{c}": col(v) for c, v in lasts.items()})
    rows = laid(rows, by, order, ranges)
    key = F.struct(*order)
    totals = {f"_s_{c}": F.sum(f"_s_{c}") for c in sums} | {f"_l_{c}": F.max_by(f"_l_{c}", F.when(F.col(f"_l_{c}").isNotNull(), key)) for c in lasts} | {"_n": F.count(F.lit(1))}
    carried = {f"_cs_{c}": F.sum(f"_s_{c}") for c in sums} | {f"_cl_{c}": F.last(f"_l_{c}", ignorenulls=True) for c in lasts} | {"_cn": F.sum("_n")}
    rows = with_carries(rows, carries(rows, by, totals, carried), by)
    inside = Window.partitionBy(*by, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    known = lambda c: F.last(f"_l_{c}", ignorenulls=True).over(inside)
    add = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    out = {c: add(F.sum(f"_s_{c}").over(inside), F.col(f"_cs_{c}")) for c in sums}
    out |= {c: F.coalesce(known(c), F.col(f"_cl_{c}")) for c in lasts}
    out |= {c: add(F.count(F.lit(1)).over(inside), F.col("_cn")) for c in counts}
    return rows.select(*df.columns, *(e.alias(c) for c, e in out.items()))


def strict_asof(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], ties: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """`asof.strict_asof` for keys of any size: the same rows, with a key's rows in many tasks.

    Both sides are dealt together by (key, time): rows of one time share a range, so what is stamped at a row's own
    time is never seen, neither in its range nor in a carry."""
    keys = [f"k_{b}" for b in by]
    tie = F.struct(*(F.col(c) for c in ties)) if ties else F.struct(F.lit(0).alias("t"))
    payload = F.struct(*(F.col(c).alias(f"p_{c}") for c in columns))
    r = right.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), clock(right, right_time).alias("at"), tie.alias("tie"), payload.alias("payload"))
    r = r.filter(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)) & F.col("at").isNotNull())
    r = r.groupBy(*keys, "at").agg(F.max_by("payload", "tie").alias("payload"))
    row = F.struct(*(F.col(c) for c in left.columns))
    l = left.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), clock(left, left_time).alias("at"), F.lit(None).cast(r.schema["payload"].dataType).alias("payload"), row.alias("row"))
    whole = laid(l.unionByName(r.withColumn("row", F.lit(None).cast(l.schema["row"].dataType))), keys, ["at"], ranges)
    found = carries(whole, keys, {"_l": F.max_by("payload", F.when(F.col("payload").isNotNull(), F.col("at")))}, {"_carry": F.last("_l", ignorenulls=True)})
    whole = with_carries(whole, found, keys)
    frame = Window.partitionBy(*keys, PART).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    got = whole.withColumn("found", F.coalesce(F.last("payload", ignorenulls=True).over(frame), F.col("_carry"))).filter("row is not null")
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)) & F.col("at").isNotNull()
    return got.select("row.*", *(F.when(known, F.col(f"found.p_{c}")).alias(c) for c in columns))


def summed_rows(parts: DataFrame, keys: Sequence[str]) -> list:
    """Rows of matrices (keys, i, row), added up: one result row a matrix row."""
    cells = parts.select(*keys, "i", F.posexplode("row").alias("j", "x")).groupBy(*keys, "i", "j").agg(F.sum("x").alias("x"))
    return cells.groupBy(*keys, "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda e: e["x"]).alias("row")).collect()
