"""Record-level operators: dedup, latest values, modes, both sides of a game, validated joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def two_sided(games: DataFrame, sides: dict[str, tuple[str, str]], common: Sequence[str]) -> DataFrame:
    """Two rows a game: `sides` maps an output column to its columns in the home and in the away row; is_home tells them apart.

    One pass over the games: each row is exploded, not scanned twice."""
    row = lambda k: F.struct(F.lit(1 - k).alias("is_home"), *(F.col(pair[k]).alias(name) for name, pair in sides.items()))
    return games.select(*common, F.explode(F.array(row(0), row(1))).alias("_s")).select(*common, "_s.*")


def wide(rows: DataFrame, key: str | Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row a game: home_, away_ and diff_ of each feature, by one aggregation."""
    side = lambda c, home: F.max(F.when(F.col("is_home") == home, F.col(c)))
    out = rows.groupBy(*([key] if isinstance(key, str) else key)).agg(*(side(c, 1).alias(f"home_{c}") for c in features), *(side(c, 0).alias(f"away_{c}") for c in features))
    return out.select("*", *((F.col(f"home_{c}") - F.col(f"away_{c}")).alias(f"diff_{c}") for c in features))


def latest_values(df: DataFrame, by: Sequence[str], time: str, columns: Sequence[str]) -> DataFrame:
    """By key each column's latest value that is not null (not the latest row).

    First the latest time of each key's different values, which are hashed: the sort that values of any type take gets few rows."""
    pick = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct(time, c))).alias(c)
    return df.groupBy(*by, *columns).agg(F.max(time).alias(time)).groupBy(*by).agg(*map(pick, columns))


def first_source(frames: Sequence[DataFrame], by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The union of frames; of rows with one key those of the earliest frame (then in `order`) count."""
    tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    whole = tagged[0]
    for f in tagged[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_source", *order))
    return whole.withColumn("_rank", rank).filter("_rank = 1").drop("_source", "_rank")


def most_frequent(df: DataFrame, by: Sequence[str], value: str, position: Column, name: str) -> DataFrame:
    """By key the most frequent known value; of equally frequent ones the first seen. Counted before it is ranked."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"), F.min(position).alias("_first"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col("_first"))).alias(name))


def one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """An inner join that fails if a side repeats a key; null keys match nothing and may repeat.

    Both sides meet in one aggregation by key that counts each side's rows and keeps one of them, so the check is
    part of the join's own job: no job before it, and no pairs of a repeated key."""
    on = list(on)
    rows = lambda df, mine: F.struct(*(F.col(c) for c in df.columns if c not in on)) if mine else F.lit(None)
    sides = [("_left", left), ("_right", right)]
    kinds = {n: df.select(rows(df, True).alias(n)).schema[n].dataType if len(df.columns) > len(on) else None for n, df in sides}
    kinds = {n: k or "struct<_:int>" for n, k in kinds.items()}

    def tagged(name: str, df: DataFrame) -> DataFrame:
        known = df.dropna(subset=on)
        own = rows(df, True) if len(df.columns) > len(on) else F.lit(None)
        return known.select(*on, F.lit(name).alias("_side"), *((own if n == name else F.lit(None)).cast(kinds[n]).alias(n) for n, _ in sides))

    counted = tagged(*sides[0]).unionByName(tagged(*sides[1])).groupBy(*on)
    of = lambda n: F.col("_side") == n
    met = counted.agg(*(F.count_if(of(n)).alias(f"_n{n}") for n, _ in sides), *(F.first(F.when(of(n), F.col(n)), ignorenulls=True).alias(n) for n, _ in sides))
    key = F.concat_ws(", ", *(F.col(c).cast("string") for c in on))
    fail = F.raise_error(F.concat(F.lit(f"a side repeats a key of {on}: "), key)).cast("boolean")
    whole = met.filter(F.when((F.col("_n_left") > 1) | (F.col("_n_right") > 1), fail).otherwise((F.col("_n_left") == 1) & (F.col("_n_right") == 1)))
    return whole.select(*on, *(F.col(f"{n}.{c}") for n, df in sides for c in df.columns if c not in on))


def same_keys(a: DataFrame, b: DataFrame, on: Sequence[str]) -> bool:
    return a.join(b, list(on), "left_anti").isEmpty() and b.join(a, list(on), "left_anti").isEmpty()


def members_of(rows: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each row once a member of its group; the members are a dimension whose size the optimizer knows."""
    return rows.join(members, list(on))
