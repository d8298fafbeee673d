import random
import re

import numpy as np

from gridstone.llm import nearcopies
from gridstone.llm.common import table
from tests.llm.conftest import grouped


def shingle_set(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def test_counters_equal_plain_distances():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (1, 64), dtype=np.uint8)
    fp = np.repeat(base, 200, axis=0)
    for i in range(200):
        flips = rng.choice(512, rng.integers(0, 130), replace=False)
        bits = np.unpackbits(fp[i])
        bits[flips] ^= 1
        fp[i] = np.packbits(bits)
    sliced = nearcopies.planes(fp)
    bits = np.unpackbits(fp, axis=1)
    for radius in (3, 60, 88, 127):
        for d in (1, 5, 64, 70, 130):
            want = [i for i in range(200 - d) if (bits[i] ^ bits[i + d]).sum() <= radius]
            lanes = nearcopies.simhash.lane_mask(np.arange(200) < 200 - d, sliced.shape[1] - 1)
            assert nearcopies.near(sliced, d, lanes, radius).tolist() == want


def edited(rng, words, share):
    out = list(words)
    for _ in range(round(share * len(words))):
        at = rng.randrange(len(out))
        out[at : at + rng.randint(0, 1)] = [f"new{rng.randrange(10**6)}"]
    return out


def test_recall_at_a_similarity_of_four_fifths(spark):
    rng = random.Random(7)
    texts, pairs = [], []
    for k in range(400):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        other = edited(rng, words, rng.choice([0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08]))
        texts += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = (shingle_set(t) for _, t in texts[-2:])
        pairs.append((2 * k, len(a & b) / len(a | b)))
    got = {r["doc_id"]: r["class_id"] for r in nearcopies.classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    near = [got[i + 1] == i for i, j in pairs if j >= 0.8]
    far = [got[i + 1] == i for i, j in pairs if j < 0.6]
    assert len(near) > 100 and sum(near) > 0.95 * len(near)
    assert len(far) > 50 and sum(far) < 0.1 * len(far) and all(got[i] == i for i, _ in pairs)


def test_recall_on_the_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], shingle_set(r["text"])) for r in docs.collect()]
    got = {r["doc_id"]: r["class_id"] for r in nearcopies.classes(docs).collect()}
    of: dict = {}
    for i, s in rows:
        for x in s:
            of.setdefault(x, []).append(i)
    sets = dict(rows)
    met = {(a, b) for ids in of.values() for a in ids for b in ids if a < b}
    near = [(a, b) for a, b in met if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(near) > 50 and sum(got[a] == got[b] for a, b in near) >= 0.97 * len(near)
    low = [(a, b) for a, b in met if len(sets[a] & sets[b]) < 0.6 * len(sets[a] | sets[b])]
    parent = grouped(max(sets) + 1, near)
    assert sum(got[a] == got[b] and parent[a] != parent[b] for a, b in low) <= 0.02 * len(low)


def test_edge_cases_and_hot_buckets(spark, docs, none):
    got = nearcopies.classes(docs)
    assert got.count() == docs.filter("doc_id is not null").select("doc_id").distinct().count()
    by = {r["doc_id"]: r["class_id"] for r in got.collect()}
    assert by[44] == by[45] == by[3] == 3 and by[51] == by[52] == by[50] == 50
    assert {r["doc_id"]: r["class_id"] for r in nearcopies.classes(docs, hot=1).collect()} == by
    assert nearcopies.classes(none).collect() == [] and nearcopies.first_of_each(none).columns == none.columns
    kept = nearcopies.first_of_each(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == docs.filter("doc_id is null").count()
    assert {r["doc_id"] for r in kept.collect()} - {None} == {i for i, c in by.items() if i == c}


def test_large_groups_are_compared_in_cells(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(120)]
    texts = [(i, " ".join(edited(rng, words, 0.01))) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["class_id"] for r in nearcopies.classes(df, hot=40).collect()} == {0}
