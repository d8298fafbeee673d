"""Near-duplicate documents by five-word shingles: wide SimHash fingerprints, compared bit-sliced.

At a Jaccard similarity of 0.8 two fingerprints differ in 15 bits of 100, so no few
blocks of them agree and blocks would have to grow shorter as the corpus grows.
Documents meet instead where the smallest hashes of their different shingles
agree: 8 keys of 4 hashes each, of which two documents with a similarity of 0.8 share
one with a probability of 0.985 and unrelated ones none, however many there are.
In a bucket all pairs are compared: bit planes lie vertically, full adders count the
differing bits of 64 pairs at once, and words whose pairs all exceed the radius are
abandoned. Of 512 bits some 78 differ at 0.8 (with a deviation of 8), 98 at 0.7.
Buckets over HOT lanes are compared as pairs of blocks, each in a task of its own;
nothing is capped. A bucket gives a spanning forest of its links, classes come from
alternating stars in written tables.

Edge cases: a text of fewer words than a shingle is one shingle; texts without a
word are alike; rows of one doc_id with different texts are one node of the class
graph; rows without a doc_id are left out of `classes` and all kept by
`first_of_each`; extra columns are kept; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.llm import kernel as K
from gridstone.llm import simhash
from gridstone.llm.common import bound_arrow, cut, text_rows

U = np.uint64
SHINGLE, BITS, RADIUS = 5, 512, 88
BANDS, ROWS = 8, 4
#: Lanes that are compared in one go; a larger bucket is dealt by pairs of blocks of half as many.
HOT = 16_384
#: Shingles of a text that are turned into bits at once; lanes that a worker compares at once, but for a larger bucket.
STEP, TOGETHER = 4096, 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SALTS = K.splitmix(np.arange(BITS // 64, dtype=U) + U(1 << 41))
_ODD = K.splitmix(np.arange(BANDS * ROWS, dtype=U) + U(1 << 42)) | U(1)


def shingles(batch: pa.RecordBatch, key: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, document by document, and each document's first."""
    data, off = K.buffer(K.column(batch, "text"))
    data = _LOWER[data]
    starts, ends, first = K.runs(~K.is_space(data), off)
    h = K.Hash(key)
    prefix = h.prefix(h.words(data, starts, ends))
    words = np.diff(first)
    count = np.maximum(words - n + 1, 1)  # a text without words has the hash of nothing
    to = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[:-1] - to[:-1], count) + np.arange(to[-1])
    return K.splitmix(h.spans(prefix, at, np.minimum(at + n, np.repeat(first[1:], count)))), to


def sketch(h: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The fingerprint and the keys of a document's different shingles."""
    h = np.unique(h)
    votes, low = np.zeros(BITS, np.int64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, U)
    for k in range(0, len(h), STEP):
        some = h[k : k + STEP, None]
        votes += np.unpackbits(K.splitmix(some ^ _SALTS).view(np.uint8).reshape(len(some), -1), axis=1).sum(axis=0, dtype=np.int64)
        low = np.minimum(low, (some * _ODD).min(axis=0))
    acc = np.arange(BANDS, dtype=U)
    for r in range(ROWS):
        acc = K.splitmix(acc * U(0x9E3779B97F4A7C15) ^ low[r::ROWS])
    return np.packbits(votes * 2 > len(h)).tobytes(), acc.view(np.int64)


def sketches(docs: DataFrame, n: int, key: int) -> DataFrame:
    bound_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches):
            h, at = shingles(b, key, n)
            got = [sketch(h[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            keys = np.concatenate([k for _, k in got]) if got else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys))
            yield pa.RecordBatch.from_arrays([K.column(b, "doc_id"), pa.array([f for f, _ in got], pa.binary()), lists], ["doc_id", "fp", "keys"])

    return text_rows(docs).filter("doc_id is not null").mapInArrow(run, "doc_id long, fp binary, keys array<long>")


def planes(fp: np.ndarray) -> np.ndarray:
    """Bit-sliced: a row for each bit, a lane for each fingerprint, a word of zeros beyond."""
    n = len(fp)
    out = np.zeros((BITS, (n + 63) // 64 + 1), U)
    bits = np.packbits(np.unpackbits(fp, axis=1).T, axis=1, bitorder="little")
    out.view(np.uint8)[:, : bits.shape[1]] = bits
    return out


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A full adder of three planes: sum and carry."""
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def near(sliced: np.ndarray, d: int, lanes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The lanes i, among those set in `lanes`, within the radius of lane i + d."""
    words, width = np.flatnonzero(lanes), radius.bit_length()
    q, r = divmod(d, 64)
    alive = lanes[words]
    counter = [np.zeros(len(words), U) for _ in range(width)]

    def differing(k: int) -> np.ndarray:
        plane = sliced[k]
        x = plane[words + q] if not r else (plane[words + q] >> U(r)) | (plane[np.minimum(words + q + 1, len(plane) - 1)] << U(64 - r))
        return x ^ plane[words]

    for k in range(0, len(sliced), 7):
        p = [differing(j) for j in range(k, min(k + 7, len(sliced)))]
        p += [np.zeros(len(words), U)] * (7 - len(p))
        a, x = _add(p[0], p[1], p[2])
        b, y = _add(p[3], p[4], p[5])
        one, z = _add(a, b, p[6])
        two, four = _add(x, y, z)
        carry = None
        for level, plane in enumerate((one, two, four)):
            if level < width:
                counter[level], carry = _add(counter[level], plane, carry if carry is not None else np.zeros(len(words), U))
        for level in range(3, width):
            counter[level], carry = counter[level] ^ carry, counter[level] & carry
        alive &= ~carry  # beyond the counter
        if k % 28 == 21 or k + 7 >= len(sliced):
            over, equal = np.zeros(len(words), U), np.full(len(words), ~U(0))
            for level in range(width - 1, -1, -1):
                if radius >> level & 1:
                    equal = equal & counter[level]
                else:
                    over |= equal & counter[level]
                    equal = equal & ~counter[level]
            alive &= ~over
            on = alive != 0
            if not on.all():
                words, alive, counter = words[on], alive[on], [c[on] for c in counter]
                if not len(words):
                    return words
    bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w, lane = np.nonzero(bits)
    return words[w] * 64 + lane


def links(buckets: DataFrame, radius: int) -> DataFrame:
    """a, b: documents that link, connecting each bucket (key, cell)."""

    def compare(rows: list[tuple[int, int, bytes, int]]) -> pa.RecordBatch:
        key = np.array([(k, c) for k, c, _, _ in rows], np.int64)
        group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(axis=1))])
        many = np.bincount(group)[group] > 1
        a = b = np.zeros(0, np.int64)
        if many.any():
            fp = np.frombuffer(b"".join(f for _, _, f, _ in rows), np.uint8).reshape(len(rows), -1)[many]
            rep = np.array([r for *_, r in rows], np.int64)[many]
            a, b = simhash.forest(fp, rep, np.unique(group[many], return_inverse=True)[1], planes, lambda s, d, on: near(s, d, on, radius))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, int]] = []
        for batch in batches:
            held += zip(*(K.column(batch, c).to_pylist() for c in ("key", "cell", "fp", "rep")), strict=True)
            if len(held) >= TOGETHER:
                last = len(held) - 1
                while last and held[last][:2] == held[last - 1][:2]:
                    last -= 1
                if last:
                    yield compare(held[:last])
                    held = held[last:]
        if held:
            yield compare(held)
        del held
        K.give_back()

    return buckets.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(run, "a long, b long")


def in_cells(buckets: DataFrame, hot: int) -> DataFrame:
    """The rows with `cell`: 0, but in buckets over `hot` rows one for each pair of blocks, so that all pairs of rows still meet."""
    sizes = cut(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot), "nearcopies-hot")
    if sizes.isEmpty():
        return buckets.withColumn("cell", F.lit(0).cast("long"))
    rows = buckets.join(F.broadcast(sizes), "key", "left")  # a row for `hot` rows
    blocks = F.ceil(F.col("n") * 2 / hot).cast("long")
    mine = F.pmod(F.xxhash64("fp"), blocks)
    cells = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.least(mine, j) * blocks + F.greatest(mine, j))
    return rows.select("key", "fp", "rep", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(cells)).alias("cell"))


def classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """doc_id, class_id: the smallest doc_id that links reach; a row a doc_id."""
    rows = cut(sketches(docs, shingle, K.fresh_key()), "nearcopies-rows")
    distinct = cut(rows.groupBy("fp", "keys").agg(F.min("doc_id").alias("rep")), "nearcopies-distinct")
    buckets = distinct.select("fp", "rep", F.explode("keys").alias("key"))
    own = rows.join(distinct, ["fp", "keys"]).select("doc_id", "rep").distinct()
    edges = links(in_cells(buckets, hot), radius).unionByName(own.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = simhash.components(edges, "nearcopies-links")
    ids = rows.select("doc_id").distinct()
    return ids.join(found, ids.doc_id == found.node, "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """The documents that have the smallest doc_id of their class, with all their columns; rows without a doc_id all stay. Rows of one doc_id: see `simhash.kept_rows`."""
    first = classes(docs).filter("doc_id = class_id").select("doc_id")
    return simhash.kept_rows(docs, first)
