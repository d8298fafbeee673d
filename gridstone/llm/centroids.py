"""Centroid clustering in integers: Lloyd's rounds with Yinyang bounds.

Components become integers once, so distances, sums and centroids are exact and
no order of rows or tasks changes a result. The first centroids are put into
groups once. Every vector carries an upper bound of the distance to its own
centroid and for each group a lower bound of the distance to the group's others;
as centroids move, the bounds move by as much. A vector whose upper bound lies
below all its lower bounds stays where it is (the global filter); else its own
distance is made exact, groups whose bound still lies above it are left out (the
group filter), and only the surviving groups' centroids are scanned. Bounds are
compared with a margin for rounding, so a tie is always scanned and goes to the
smaller number.

A round is one pass over the vectors: each task turns a batch into new state and
sums by cluster, which meet in one small aggregation; the driver holds k centroids
and k sums. State is written to the shared folder once a round.

Edge cases: a null vector, one of another length, or with a null or non-finite
component is left out; equal vectors and repeated rows are rows of their own; a
null vec_id never starts a centroid, the rest does; fewer vectors than k give as
many centroids as there are vectors; an empty table gives an empty one; extra
columns are ignored. A component of 2^27 or more in size after scaling cannot be
squared and summed in 64 bits: such a vector ends the run with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.llm import kernel as K
from gridstone.llm.common import bound_arrow, drop_cut, table_cut

SCALE, DIM, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Centroids of one group, about.
PER_GROUP = 4
#: Largest size of a scaled component: 64 squared differences then fit 64 bits.
MOST = 1 << 27
#: Relative margin of a comparison of bounds.
SLACK = 1e-9


def integers(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, x (array of longs) of the vectors that count."""
    x = F.col("embedding")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.filter((F.size(x) == dim) & whole)
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    fits = F.forall(x, lambda c: F.abs(c.cast("double") * scale) < float(MOST))
    return kept.select("vec_id", F.when(fits, scaled).otherwise(F.raise_error(F.lit(f"a scaled component has a size of {MOST} or more"))).cast("array<int>").alias("x"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest digests, by digest."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(F.coalesce(key, F.lit("~")).alias("key"), "x").orderBy("key", "x").limit(k).collect()  # k rows
    return np.array([r["x"] for r in first], np.int64)


def groups_of(centroids: np.ndarray, n: int) -> np.ndarray:
    """A group for each centroid: some rounds over the centroids themselves, from evenly spaced ones."""
    k = len(centroids)
    if n >= k:
        return np.arange(k)
    c = centroids.astype(float)
    mid = c[np.linspace(0, k - 1, n).astype(int)]
    for _ in range(5):
        own = ((c[:, None] - mid[None]) ** 2).sum(2).argmin(1)
        mid = np.array([c[own == g].mean(0) if (own == g).any() else mid[g] for g in range(n)])
    return np.unique(own, return_inverse=True)[1]


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, a row for each vector; exact."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = x - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


class State:
    """Vectors with their cluster, upper bound and lower bounds by group."""

    def __init__(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.x, self.own, self.upper, self.lower = x, own, upper, lower

    @classmethod
    def fresh(cls, x: np.ndarray, groups: int) -> State:
        """Of vectors without a cluster: nothing is ruled out."""
        return cls(x, np.zeros(len(x), np.int32), np.full(len(x), np.inf), np.zeros((len(x), groups)))

    def moved(self, drift: np.ndarray, group: np.ndarray) -> None:
        """The bounds after the centroids moved by `drift`."""
        self.upper = self.upper + drift[self.own]
        for g in range(self.lower.shape[1]):
            self.lower[:, g] = np.maximum(self.lower[:, g] - drift[group == g].max(), 0.0)

    def assign(self, centroids: np.ndarray, group: np.ndarray) -> int:
        """Every vector's nearest centroid; returns how many distances were computed."""
        may = ~(self.lower.min(axis=1) > self.upper * (1 + SLACK) + SLACK)
        rows = np.flatnonzero(may)
        if not len(rows):
            return 0
        x, own = self.x[rows], self.own[rows]
        d = x - centroids[own]
        exact = np.einsum("ij,ij->i", d, d)
        self.upper[rows] = np.sqrt(exact)
        n = len(rows)
        open_ = ~(self.lower[rows] > (self.upper[rows] * (1 + SLACK) + SLACK)[:, None])  # by group: not ruled out
        best, to = exact, own.copy()
        found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for g in range(self.lower.shape[1]):
            at = np.flatnonzero(open_[:, g])
            if not len(at):
                continue
            members = np.flatnonzero(group == g)
            near = distances(x[at], centroids[members])
            n += near.size
            first = near.argmin(1)
            found[g] = at, members, near
            low, who = near[np.arange(len(at)), first], members[first]
            better = (low < best[at]) | ((low == best[at]) & (who < to[at]))
            best[at[better]], to[at[better]] = low[better], who[better]
        # the lower bound of a scanned group: its nearest centroid but the vector's own
        for g, (at, members, near) in found.items():
            other = np.where(members[None] == to[at][:, None], np.iinfo(np.int64).max, near)
            self.lower[rows[at], g] = np.sqrt(other.min(1).astype(float))
        # of a group that was not scanned and that the vector leaves: its old centroid is an other one now
        left = np.flatnonzero((to != own) & ~open_[np.arange(len(rows)), group[own]])
        if len(left):
            r, g = rows[left], group[own[left]]
            self.lower[r, g] = np.minimum(self.lower[r, g], np.sqrt(exact_of(x[left], centroids[own[left]])))
        self.own[rows], self.upper[rows] = to, np.sqrt(best)
        return n


def exact_of(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    d = x - centroids
    return np.einsum("ij,ij->i", d, d)


def _vectors(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return K.column(batch, name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel(), kind))


STATE = "vec_id {}, x array<int>, cluster int, upper double, lower array<double>, distance long"


def passed(rows: DataFrame, centroids: np.ndarray, group: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """The state after one assignment; `rows` hold the state before, or without drift the vectors alone. distance is exact in every row."""
    n_groups, dim = int(group.max()) + 1, centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b, "x", dim).astype(np.int64)
            if drift is None:
                s = State.fresh(x, n_groups)
            else:
                own = K.column(b, "cluster").to_numpy().copy()
                s = State(x, own, K.column(b, "upper").to_numpy().copy(), _vectors(b, "lower", n_groups).copy())
                s.moved(drift, group)
            s.assign(centroids, group)
            d = exact_of(x, centroids[s.own])
            arrays = [K.column(b, "vec_id"), _lists(x.astype(np.int32), pa.int32()), pa.array(s.own, pa.int32()), pa.array(s.upper), _lists(s.lower, pa.float64()), pa.array(d)]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "x", "cluster", "upper", "lower", "distance"])

    return rows.mapInArrow(run, STATE.format(rows.schema["vec_id"].dataType.simpleString()))


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids' new places: exact floors of their vectors' means. Tasks send one row a cluster."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            own, x = K.column(b, "cluster").to_numpy(), _vectors(b, "x", dim).astype(np.int64)
            n += np.bincount(own, minlength=k)
            np.add.at(sums, own, x)
        some = np.flatnonzero(n)
        place = np.tile(np.arange(dim), len(some))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dim), pa.int32()), pa.array(place, pa.int32()), pa.array(np.repeat(n[some], dim)), pa.array(sums[some].ravel())], ["cluster", "place", "n", "total"])

    parts = state.select("cluster", "x").mapInArrow(run, "cluster int, place int, n long, total long")
    wide = F.sum(F.col("total").cast("decimal(38,0)"))
    out = centroids.copy()
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), wide.alias("total")).collect():  # k rows of dim components
        out[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return out


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE, per_group: int = PER_GROUP) -> tuple[DataFrame, np.ndarray]:
    """vec_id, x, cluster, distance of every vector that counts, and the final centroids."""
    bound_arrow(vectors.sparkSession)
    rows = integers(vectors, dim, scale)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).filter("false"), centroids
    group = groups_of(centroids, -(-len(centroids) // per_group))
    drift, path = None, None
    for _ in range(rounds):
        state, last = table_cut(passed(rows, centroids, group, drift), "vectors"), path
        rows, path = state
        if last:  # the round before is not read again
            drop_cut(vectors.sparkSession, last)
        new = means(rows, centroids)
        drift = np.sqrt(((new - centroids) ** 2).sum(axis=1).astype(float)) * (1 + SLACK)
        centroids = new
    return passed(rows, centroids, group, drift).select("vec_id", "x", "cluster", "distance"), centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """What op13 returns."""
    got, centroids = clustered(vectors)
    spark = vectors.sparkSession
    got, _ = table_cut(got.drop("x"), "clusters")
    sums = {r["cluster"]: int(r["d"]) for r in got.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row a cluster
    of = spark.createDataFrame([(j, sums.get(j, 0), sum(sums.values()), digest(c)) for j, c in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return got.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    near = """
        near{r} AS (
            SELECT vec_id, x, n, CAST(j AS INTEGER) AS cluster, d AS distance FROM (
                SELECT v.vec_id, v.x, v.n, c.j, list_sum(list_transform(range(1, {dim} + 1), lambda i: (v.x[i] - c.c[i]) * (v.x[i] - c.c[i]))) AS d
                FROM v CROSS JOIN c{r} c
            ) QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, j) = 1
        )"""
    mean = """
        c{next} AS (
            SELECT c.j, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN (
                SELECT cluster, list(q ORDER BY i) AS c FROM (
                    SELECT cluster, i, (s - ((s % m) + m) % m) // m AS q FROM (
                        SELECT cluster, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS m
                        FROM near{r}, (SELECT unnest(range(1, {dim} + 1)) AS i) GROUP BY cluster, i
                    )
                ) GROUP BY cluster
            ) m ON m.cluster = c.j
        )"""
    steps = []
    for r in range(ROUNDS):
        steps += [near.format(r=r, dim=DIM), mean.format(r=r, next=r + 1, dim=DIM)]
    steps.append(near.format(r=ROUNDS, dim=DIM))
    return f"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x, row_number() OVER () AS n
            FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIM}
        ),
        c0 AS (
            SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x AS c FROM (SELECT x, sha256('{SEED}:' || vec_id) AS h FROM v ORDER BY h, x LIMIT {CLUSTERS})
        ),
        {", ".join(steps)}
        SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
        FROM near{ROUNDS} n JOIN c{ROUNDS} c ON c.j = n.cluster
    """


SQL = _sql()
