"""SimHash near-duplicate classes by bit-sliced comparison.

Fingerprints within the radius agree on at least one block of bits, so only
fingerprints of one bucket (table, block value) are compared. A bucket's bit
planes lie vertically, a lane a fingerprint; for a distance d in the bucket all
lanes meet the lanes d further on at once: XOR of planes, carry-save counters of
two bits and an overflow, and words of lanes that all exceed the radius are
abandoned. Only distinct fingerprints are compared and a bucket gives a spanning
forest of its links, not all pairs. Buckets over HOT rows are first dealt by the
remaining bits. Links join to classes by alternating stars, in written tables.

Edge cases: a null or empty text has fingerprint zero and is linked like any
other; a null doc_id gets a fingerprint and the class of its fingerprint, if
any; repeated rows share a class; extra columns are ignored; an empty table gives
an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridstone.llm import kernel as K
from gridstone.llm.common import bound_arrow, cut, free_name, text_rows

U = np.uint64
RADIUS = 3
#: A bucket of more distinct fingerprints is dealt again by its remaining bits.
HOT = 20_000
#: Rows that a worker compares at once, but for a larger bucket.
TOGETHER = 1 << 18


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed=42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - shingle] + 1]).tolist()
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]), np.uint8)
    votes = np.zeros(64, np.int64)
    for k in range(0, len(h), 8 << 15):
        votes += np.unpackbits(h[k : k + (8 << 15)].reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(h) // 8).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long)."""
    bound_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches):
            data, off = K.buffer(K.column(b, "text"))
            raw, at = data.tobytes(), off.tolist()
            fps = np.array([fingerprint(raw[x:y], shingle) for x, y in zip(at[:-1], at[1:], strict=True)], U)
            yield pa.RecordBatch.from_arrays([K.column(b, "doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return text_rows(docs).mapInArrow(run, "doc_id long, fp long")


def blocks(bits: list[int], n: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.array(bits), n)]


def tables(bits: list[int], n: int, radius: int = RADIUS) -> list[list[int]]:
    """The bits of each table's key: all choices of n - radius of n blocks."""
    return [[b for block in some for b in block] for some in combinations(blocks(bits, n), n - radius)]


def taken(fp: Column, bits: list[int]) -> Column:
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def dealt(rows: DataFrame, keys: list[list[int]], before: Column | None = None) -> DataFrame:
    """The rows once a table, with the table's bits (a mask) and the bucket's key."""
    fp = F.col("fp")

    def entry(bits: list[int]) -> Column:
        mask = sum(1 << b for b in bits)
        return F.struct(F.lit(mask - (1 << 64) if mask >> 63 else mask).alias("mask"), taken(fp, bits).alias("key"))

    more = [] if before is None else [before.alias("before")]
    return rows.select(*more, "fp", "rep", F.explode(F.array(*map(entry, keys))).alias("e")).select(
        F.col("e.mask").alias("mask"),
        F.col("e.key") if before is None else F.xxhash64("before", "e.mask", "e.key").alias("key"),
        "fp",
        "rep",
    )


def planes(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """Bit-sliced: a row for each of the bits, a lane for each fingerprint, a word of zeros beyond."""
    n = len(fp)
    out = np.zeros((len(bits), (n + 63) // 64 + 1), U)
    for i, b in enumerate(bits):
        packed = np.packbits(((fp >> U(b)) & U(1)).astype(np.uint8), bitorder="little")
        out[i].view(np.uint8)[: len(packed)] = packed
    return out


def near(sliced: np.ndarray, d: int, lanes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The lanes i, among those set in `lanes`, within the radius of lane i + d."""
    if radius != 3:
        raise ValueError("the counters hold distances to 3")
    words = np.flatnonzero(lanes)
    q, r = divmod(d, 64)
    ones, twos = np.zeros(len(words), U), np.zeros(len(words), U)
    alive = lanes[words]
    for k, plane in enumerate(sliced):
        x = plane[words + q] if not r else (plane[words + q] >> U(r)) | (plane[np.minimum(words + q + 1, len(plane) - 1)] << U(64 - r))
        x ^= plane[words]
        carry = ones & x
        ones ^= x
        alive &= ~(twos & carry)
        twos ^= carry
        if k % 4 == 3 and k >= 7:
            on = alive != 0
            if not on.all():
                words, ones, twos, alive = words[on], ones[on], twos[on], alive[on]
                if not len(words):
                    return words
    bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w, lane = np.nonzero(bits)
    return words[w] * 64 + lane


def lane_mask(on: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words, U)
    packed = np.packbits(on, bitorder="little")
    out.view(np.uint8)[: len(packed)] = packed
    return out


def forest(fp: np.ndarray, rep: np.ndarray, group: np.ndarray, slices: Callable[[np.ndarray], np.ndarray], near: Callable[[np.ndarray, int, np.ndarray], np.ndarray] = near) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each group of consecutive rows, what chains of near fingerprints connect. slices: the bit planes of fingerprints; near: as `near`."""
    label, a, b = np.arange(len(fp)), [], []
    parent = list(range(len(fp)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    rows, d = np.arange(len(fp)), 1
    size = np.bincount(group)[group]
    while True:
        rows = rows[size[rows] > d]
        if not len(rows):
            break
        own, sliced = group[rows], slices(fp[rows])
        words = sliced.shape[1] - 1
        for d in range(d, min(2 * d, int(size[rows].max()))):  # noqa: B020  rows are packed anew at each power of two
            same = np.zeros(len(rows), bool)
            same[: len(rows) - d] = own[d:] == own[:-d]
            i = near(sliced, d, lane_mask(same, words))
            if len(i):
                x, y = rows[i], rows[i + d]
                new = label[x] != label[y]
                changed = False
                for p, q in zip(x[new].tolist(), y[new].tolist(), strict=True):
                    r, s = root(p), root(q)
                    if r != s:
                        parent[max(r, s)] = min(r, s)
                        a.append(p)
                        b.append(q)
                        changed = True
                if changed and len(x) > 256:
                    label = np.array(parent)
                    while np.any(label != label[label]):
                        label = label[label]
        d += 1
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return rep[a], rep[b]


def links(buckets: DataFrame) -> DataFrame:
    """a, b: documents whose fingerprints link, connecting each bucket; rows come sorted by mask and key."""

    def compare(mask: np.ndarray, key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        for m in np.unique(mask):
            of = mask == m
            held = int(m) & (1 << 64) - 1
            bits = [i for i in range(63, -1, -1) if not held >> i & 1]
            k, first, sizes = np.unique(key[of], return_index=True, return_counts=True)
            group = np.repeat(np.arange(len(k)), sizes)
            many = np.bincount(group)[group] > 1
            if many.any():
                _, own = np.unique(group[many], return_inverse=True)
                x, y = forest(fp[of][many], rep[of][many], own, lambda x, bits=bits: planes(x, bits))
                a.append(x)
                b.append(y)
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([join(a), join(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            held.append(np.stack([K.column(batch, c).to_numpy() for c in ("mask", "key", "fp", "rep")]))
            n += held[-1].shape[1]
            if n >= TOGETHER:
                rows = np.concatenate(held, axis=1)
                last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
                whole = int(last[-1]) + 1 if len(last) else 0
                if whole:
                    part = rows[:, :whole]
                    yield compare(part[0], part[1], part[2].view(U), part[3])
                held, n = [rows[:, whole:]], rows.shape[1] - whole
        if n:
            rows = np.concatenate(held, axis=1)
            yield compare(rows[0], rows[1], np.ascontiguousarray(rows[2]).view(U), rows[3])

    return buckets.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(run, "a long, b long")


def all_links(distinct: DataFrame, n: int, hot: int = HOT) -> DataFrame:
    """Links between distinct fingerprints (fp, rep); the number of tables follows their number n."""
    every = list(range(64))
    keys = tables(every, 4 if n < 1 << 24 else 5 if n < 1 << 34 else 6)
    buckets = dealt(distinct, keys)
    sizes = buckets.groupBy("mask", "key").count()
    large = cut(sizes.filter(F.col("count") > hot).select("mask", "key"), "simhash-hot")
    if large.isEmpty():
        return links(buckets)
    out = links(buckets.join(large, ["mask", "key"], "left_anti"))
    for bits in keys:
        rest = [b for b in every if b not in bits]
        mask = sum(1 << b for b in bits)
        mine = large.filter(F.col("mask") == F.lit(mask - (1 << 64) if mask >> 63 else mask)).select("key")
        inside = distinct.withColumn("key", taken(F.col("fp"), bits)).join(mine, "key")
        out = out.unionByName(links(dealt(inside, tables(rest, 4), F.col("key"))))
    return out


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """node, root (the smallest node that links reach), of all nodes with a link; large and small stars in turn."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name)
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    state = now.select(mark.alias("m")).first()["m"]
    while state["n"]:  # each round lowers a root; chains halve, so a chain of n links takes about 2 log n rounds
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        now = cut(small.unionByName(low.select("u", F.col("low").alias("v"))).distinct(), name)
        last, state = state, now.select(mark.alias("m")).first()["m"]
        if state == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(docs: DataFrame, shingle: int = 3, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id of every document."""
    rows = cut(fingerprints(docs, shingle), "simhash-rows")
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep is not null"), "simhash-fps")
    found = components(all_links(distinct, distinct.count(), hot), "simhash-links")
    of = distinct.join(found, distinct.rep == found.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return rows.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """What op10 returns."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The documents that have the smallest doc_id of their class, with all their columns; rows without a doc_id all stay.

    Rows of one doc_id are one document: of rows with one text, the first in the order of their columns stays; different texts all stay."""
    return kept_rows(docs, classes(docs).filter("doc_id = component_id").select("doc_id").distinct())


def kept_rows(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of the documents in `first` (doc_id, once each), and those without a doc_id."""
    first = cut(first, "simhash-kept")
    one = docs.join(first, "doc_id", "left_semi")
    bare = docs.filter("doc_id is null")
    again = cut(docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "simhash-again")
    if again.isEmpty():
        return one.unionByName(bare)
    order, rank = F.to_json(F.struct(*docs.columns)), free_name(docs, "rank")
    several = one.join(again, "doc_id", "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(order))).filter(F.col(rank) == 1).drop(rank)
    return one.join(again, "doc_id", "left_anti").unionByName(several).unionByName(bare)
