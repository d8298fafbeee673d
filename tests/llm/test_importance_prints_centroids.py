import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridstone.llm import centroids, editprints, resampling
from gridstone.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, bucket int, n long"


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


# ---------------------------------------------------------------- importance resampling


def grams(t, order):
    w = words(t)
    return [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def brute_weights(rows, target, order, buckets):
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1])
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = {i: Counter(bucket(f) for t in ts for f in grams(t, order)) for i, ts in texts.items()}
    s, t = Counter(), Counter(bucket(f) for x in target for f in grams(x, order))
    for c in own.values():
        s.update(c)
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    return {i: (sum(c.values()), sum(len(words(x)) for x in texts[i]), sum(n * gain[b] for b, n in c.items())) for i, c in own.items()}


@pytest.mark.parametrize(("order", "buckets"), [(1, 10_000), (2, 97)])
def test_weights_equal_plain_counting(spark, docs, rows, order, buckets):
    target = [rows[3][1], "The run of MAÑANA; 中文 idiot", None, ""]
    df = spark.createDataFrame([(i, t, 0, 1) for i, t in enumerate(target)], ITEMS)
    got = {r["doc_id"]: (r["n_features"], r["n_words"], r["weight"]) for r in resampling.weights(docs, df, order, buckets).collect()}
    assert got == brute_weights(rows, target, order, buckets)


def test_long_features_and_checksums():
    pieces = [b"", b"a", b"ab" * 20, b"x" * 48, b"y" * 49, "é中".encode() * 40]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    got = resampling.checksums(data, ends - [len(p) for p in pieces], ends)
    assert got.tolist() == [zlib.crc32(p) for p in pieces]


def test_draws_and_ranks(spark, docs, rows, none):
    target = [rows[3][1], rows[5][1]]
    df = spark.createDataFrame([(i, t, 0, 1) for i, t in enumerate(target)], ITEMS)
    got = {r["doc_id"]: r for r in resampling.report(docs, df).collect()}
    want = brute_weights(rows, target, 1, resampling.BUCKETS)

    def score(i):
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        return want[i][2] + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))

    able = sorted((i for i in want if i is not None and want[i][1] >= 20), key=lambda i: (-score(i), i))
    rank = {i: k + 1 for k, i in enumerate(able[: len(able) * 10 // 100])}
    assert rank and set(got) == set(want)
    for i, r in got.items():
        assert (r["n_features"], r["weight"], r["rank"]) == (want[i][0], want[i][2], rank.get(i))
        assert r["score"] == (None if i is None else score(i))
    kept = resampling.sampled(docs, df)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(rank)
    assert resampling.report(none, df).collect() == []
    assert resampling.report(docs, spark.createDataFrame([], ITEMS)).count() == len(want)


def test_equal_scores_go_to_smaller_documents(spark):
    rows = spark.createDataFrame([(i, 7, 30) for i in range(200)], "doc_id long, score long, n_words long")
    got = {r["doc_id"]: r["rank"] for r in resampling.ranked(rows.repartition(7), 25, 20).collect()}
    assert got == {i: i + 1 if i < 50 else None for i in range(200)}


# ---------------------------------------------------------------- edit fingerprints


def brute_neighbours(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    texts = [r[1] or "" for r in order]
    out = []
    for k, (r, t) in enumerate(zip(order, texts, strict=True)):
        other, n = texts[(k + 1) % len(texts)], len(t) // 3
        edited = t[: len(t) - n] + other[:n]
        a, b, c = (editprints.Text(x).print for x in (t, edited, other))
        out.append((r[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, editprints.likeness(a, b), editprints.likeness(a, c)))
    return Counter(out)


def test_neighbours_equal_the_plain_order(docs, rows):
    assert Counter(tuple(r) for r in editprints.neighbours(docs).collect()) == brute_neighbours(rows)


@pytest.mark.parametrize("rows", [[(5, "alone")], [(None, "b"), (None, "a")], [(1, "x" * 9), (1, "y" * 9), (3, None)], []])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn
    got = Counter(tuple(r) for r in editprints.neighbours(df("part", editprints.F.lit(1))).collect())
    assert got == brute_neighbours(rows)


def test_walks_agree_with_the_step_by_step_form():
    table, rng = editprints.waits(), random.Random(2)
    text = "".join(rng.choice("abc é中") for _ in range(300))
    points = editprints.points_of(text)
    shown, at = [], 0
    classes = (editprints.K.splitmix(points.astype(np.uint64)) % np.uint64(editprints.CLASSES)).tolist()
    for k, c in enumerate(classes):  # a step shows the code point until its bit says move: then one step remains
        while True:
            shown.append(k)
            moves = table[c][at % editprints.PERIOD] == 1
            at += 1
            if moves:
                break
    ends = editprints.walk(points)
    assert ends[-1] == len(shown) and np.searchsorted(ends, np.arange(len(shown)), side="right").tolist() == shown


def test_likeness_follows_edits(spark):
    rng = random.Random(9)
    likes = defaultdict(list)
    for _ in range(60):
        t = "".join(rng.choice("etaoin shrdlu") for _ in range(rng.randint(300, 3000)))
        other = "".join(rng.choice("etaoin shrdlu") for _ in range(len(t)))
        for share in (0.0, 0.01, 0.1):
            x = list(t)
            for _ in range(int(share * len(t))):
                at = rng.randrange(len(x))
                x[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "zz"])
            likes[share].append(editprints.likeness(*(editprints.Text(y).print for y in (t, "".join(x)))))
        likes["other"].append(editprints.likeness(*(editprints.Text(y).print for y in (t, other))))
    mean = {k: sum(v) / len(v) for k, v in likes.items()}
    assert min(likes[0.0]) == 1 and mean[0.01] > 0.5 > mean[0.1] > mean["other"] and mean["other"] < 0.15


def test_edited_texts_are_nearer_than_neighbours(spark):
    got = editprints.neighbours(table(spark, "/root/testdata/sf0.01", "documents")).filter("n_chars >= 100").collect()
    assert sum(r["near_edited"] > r["near_next"] or r["near_next"] == 1 for r in got) > 0.99 * len(got)


def test_classes_hold_copies_and_equal_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("etaoin shrdlu") for _ in range(400)) for _ in range(60)]
    rows = list(enumerate(texts)) + [(100 + i, t) for i, t in enumerate(texts[:20])] + [(200 + i, t[:-20] + "q" * 20) for i, t in enumerate(texts[10:40])]
    rows += [(300, None), (301, ""), (None, texts[0])]
    got = {r["doc_id"]: r["class_id"] for r in editprints.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    known = [(i, editprints.Text(t or "").print) for i, t in rows if i is not None]
    root = {i: i for i, _ in known}
    for a, x in known:
        for b, y in known:
            if a < b and editprints.likeness(x, y) >= editprints.ALIKE and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    assert got == root and all(got[100 + i] == i for i in range(20)) and got[301] == 300
    assert sum(got[200 + i] == 10 + i for i in range(30)) >= 25


# ---------------------------------------------------------------- centroid clustering

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, x string"


def vectors(n=300, dim=64, seed=3):
    rng = np.random.default_rng(seed)
    mids = rng.normal(size=(9, dim))
    x = mids[rng.integers(0, 9, n)] + rng.normal(size=(n, dim)) * 0.4
    rows = [(i, [float(v) for v in v32], 0, 1, "z") for i, v32 in enumerate(x.astype(np.float32))]
    bad = [list(rows[0][1]) for _ in range(3)]
    bad[0][3], bad[1][4], bad[2][5] = None, float("nan"), float("-inf")
    rows += [(1000 + i, b, 0, 1, "z") for i, b in enumerate(bad)] + [(1003, [1.0] * 63, 0, 1, "z"), (1004, None, 0, 1, "z"), (1005, [], 0, 1, "z")]
    return rows + [rows[5], rows[5], (None, rows[7][1], 0, 1, "z")] + [(2000 + i, rows[9][1], 0, 1, "z") for i in range(40)]


def brute_clusters(rows, k=16, rounds=3, scale=64):
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v, *_ in rows if v and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    key = lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for r in range(rounds + 1):
        own = [min((dist(v, m), j) for j, m in enumerate(c)) for _, v in kept]
        if r < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), (_, o) in zip(kept, own, strict=True) if o == j]
                if mine:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    inertia = Counter()
    for d, j in own:
        inertia[j] += d
    name = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), name[j]) for (i, _), (d, j) in zip(kept, own, strict=True))


@pytest.mark.parametrize("n", [300, 4])
def test_clusters_equal_plain_rounds(spark, n):
    rows = vectors(n) if n > 50 else vectors(n=20)[:n]
    got = centroids.report(spark.createDataFrame(rows, VECTORS).repartition(5))
    assert Counter(tuple(r) for r in got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()) == brute_clusters(rows)


def test_no_vectors_and_vectors_out_of_range(spark):
    assert centroids.report(spark.createDataFrame([], VECTORS)).collect() == []
    with pytest.raises(Exception, match="scaled component"):
        centroids.report(spark.createDataFrame([(1, [1e9] * 64, 0, 1, "z")], VECTORS)).collect()


def test_bounds_spare_distances_and_change_nothing():
    rng = np.random.default_rng(0)
    mids = rng.integers(-500, 500, (12, 16))
    x = (mids[rng.integers(0, 12, 2000)] + rng.integers(-40, 40, (2000, 16))).astype(np.int64)
    x[:60] = x[0]
    c = x[rng.integers(0, 2000, 12)].copy()
    c[3] = c[7]
    group = centroids.groups_of(c, 3)
    s, counts = centroids.State.fresh(x, int(group.max()) + 1), []
    for _ in range(8):
        counts.append(s.assign(c, group))
        d = centroids.distances(x, c)
        assert (s.own == d.argmin(1)).all()
        new = np.array([x[s.own == j].sum(0) // (s.own == j).sum() if (s.own == j).any() else c[j] for j in range(12)])
        s.moved(np.sqrt(((new - c) ** 2).sum(1).astype(float)) * (1 + centroids.SLACK), group)
        c = new
    assert counts[0] >= 2000 * 12 and counts[-1] < 0.5 * counts[0]
