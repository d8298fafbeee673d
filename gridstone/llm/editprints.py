"""Document fingerprints by a randomised edit embedding.

All texts walk through one random sequence: at a step a text shows the code point
where it stands, and a shared bit of the step and the code point tells whether it
moves on. After an edit two walks fall back into step, so a small edit distance
between texts is a small Hamming distance between their walks. A fingerprint
holds the walk's length and bits sampled from it, one half of them over all of its
length rounded up to a power of two, the other over half of that, so texts of up to
twice the length have samples in common. Likeness is the share of equal bits, set
so that chance is 0, over the samples that either walk reaches.

`classes` finds alike documents: fingerprints meet in bands of sampled bits, each
bucket's different fingerprints are verified against each other in blocks, and
links join to classes.

A text's neighbour is the next one by descending doc_id. Documents are dealt by
ranges of doc_id; the first document of each range also goes to the range before
it, so one shuffle brings neighbours together and no task sees all of them.

Edge cases: a null or empty text has a walk of no steps; equal texts have equal
fingerprints and a likeness of 1; rows with one doc_id stand in the order of their
texts; rows without a doc_id stand last; one document alone is its own neighbour;
an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstone.llm import kernel as K
from gridstone.llm.common import bound_arrow, cut, text_rows
from gridstone.llm.simhash import components

U = np.uint64
#: Steps after which the shared sequence repeats, classes of code points with bits of their own, sampled bits of each half.
PERIOD, CLASSES, BITS = 1 << 13, 64, 128
#: Bands of so many sampled bits; fingerprints are alike from this likeness on.
BANDS, BAND_BITS, ALIKE = 16, 12, 0.8
#: Fingerprints that are verified against each other at once.
BLOCK = 1024


@lru_cache(1)
def waits() -> list[list[int]]:
    """By class and step (modulo PERIOD): how many steps a text stays before it moves on, the moving one included."""
    bits = K.splitmix(np.arange(CLASSES * PERIOD, dtype=U) + U(1 << 40)) >> U(63)
    out = np.empty((CLASSES, PERIOD), np.int64)
    for c, row in enumerate(bits.reshape(CLASSES, PERIOD)):
        on = np.flatnonzero(row)
        on = np.append(on, on[0] + PERIOD)
        steps = np.arange(PERIOD)
        out[c] = on[np.searchsorted(on, steps)] - steps + 1
    return out.tolist()


def walk(points: np.ndarray, at: int = 0) -> np.ndarray:
    """The step after each code point's last one, from step `at` on."""
    table, mask, out = waits(), PERIOD - 1, []
    classes = (K.splitmix(points.astype(U)) % U(CLASSES)).astype(np.int64).tolist()
    add = out.append
    for c in classes:
        at += table[c][at & mask]
        add(at)
    return np.array(out, np.int64)


@lru_cache(64)
def samples(level: int) -> np.ndarray:
    """The sampled steps of a walk of up to 2^level steps, in order."""
    return np.sort(K.splitmix(np.arange(BITS, dtype=U) + U(level << 20)) & U((1 << level) - 1)).astype(np.int64)


@lru_cache(64)
def salts(level: int) -> np.ndarray:
    return K.splitmix(np.arange(BITS, dtype=U) + U((level << 20) + (1 << 50)))


def level_of(length: int) -> int:
    return max(1, (length - 1).bit_length())


def bits(points: np.ndarray, ends: np.ndarray, level: int) -> np.ndarray:
    """The sampled bits; beyond the text's end those of no code point."""
    at = np.searchsorted(ends, samples(level), side="right")
    shown = np.append(points, 0).astype(U) + U(1)
    shown[-1] = 0
    return K.splitmix(shown[at] ^ salts(level)) >> U(63)


def fingerprint(points: np.ndarray, ends: np.ndarray) -> str:
    """12 hexadecimal digits of the walk's length, then those of the bits over all of it and over its first half."""
    length = int(ends[-1]) if len(ends) else 0
    level = level_of(length)
    both = np.concatenate([bits(points, ends, level), bits(points, ends, level - 1)]).astype(np.uint8)
    return f"{length:012x}" + np.packbits(both).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """0 (as chance has it, or below) to 1 (the same fingerprint)."""
    if a == b:
        return 1.0
    lengths = int(a[:12], 16), int(b[:12], 16)
    levels = [level_of(n) for n in lengths]
    halves = [np.unpackbits(np.frombuffer(bytes.fromhex(x[12:]), np.uint8)).reshape(2, BITS) for x in (a, b)]
    reach, seen, same = max(lengths), 0, 0
    for level in {levels[0], levels[0] - 1} & {levels[1], levels[1] - 1}:
        on = samples(level) < reach
        seen += int(on.sum())
        same += int((halves[0][levels[0] - level] == halves[1][levels[1] - level])[on].sum())
    return max(0.0, 2 * same / seen - 1) if seen else 0.0


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Text:
    """A text, its code points and its walk."""

    def __init__(self, text: str):
        self.text, self.points = text, points_of(text)
        self.ends = walk(self.points)
        self.print = fingerprint(self.points, self.ends)

    def edited(self, other: Text) -> tuple[str, str]:
        """The text whose last third is replaced by the other's beginning, and its fingerprint; the walk goes on from where the texts part."""
        n = len(self.text) // 3
        kept = len(self.text) - n
        new = np.concatenate([self.points[:kept], other.points[:n]])
        ends = np.concatenate([self.ends[:kept], walk(other.points[:n], int(self.ends[kept - 1]) if kept else 0)])
        return self.text[:kept] + other.text[:n], fingerprint(new, ends)


def in_ranges(docs: DataFrame) -> DataFrame:
    """part, extra, doc_id, text: ranges by descending doc_id, in order; each ends with the first row of the next range (extra), the last one with the first of all."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    part = F.lit(len(cuts))
    bounds = F.array(*(F.lit(-c) for c in cuts)).cast("array<long>")
    if cuts:  # the first bound that is not above it
        part = F.when(F.col("doc_id").isNotNull(), F.size(F.filter(bounds, lambda b: b < -F.col("doc_id")))).otherwise(len(cuts))
    heads = ids.select(part.alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("head")).orderBy("part").collect()  # a row a range
    rows = docs.select(part.alias("part"), F.lit(False).alias("extra"), "doc_id", "text")
    if not heads:
        return rows
    order = [(r["part"], r["head"]) for r in heads]
    to = {h: order[i - 1][0] for i, (_, h) in enumerate(order)}
    extra = docs.filter(F.col("doc_id").isin([h for h in to if h is not None]))
    if None in to:  # no row has a doc_id beyond the last bound: its first row is the smallest text without one
        extra = extra.unionByName(docs.filter("doc_id is null").orderBy("text").limit(1))
    where = F.lit(to.get(None))
    known = {h: p for h, p in to.items() if h is not None}
    if known:
        where = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), F.col("doc_id")), where)
    rows = rows.unionByName(extra.select(where.cast("int").alias("part"), F.lit(True).alias("extra"), "doc_id", "text"))
    return rows.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "extra", F.desc_nulls_last("doc_id"), "text")


def neighbours(docs: DataFrame) -> DataFrame:
    """What op12 returns: each text's fingerprint, that of its edited text, and how like it that and its neighbour's are."""
    bound_arrow(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, Text] | None = None
        closed = False
        for b in batches:
            for c in K.chunks(iter([b])):
                out = []
                for extra, doc_id, text in zip(*(K.column(c, k).to_pylist() for k in ("extra", "doc_id", "text")), strict=True):
                    if closed:
                        break
                    now = held[1] if held and held[1].text == text else Text(text)
                    if held:
                        edited, print_ = held[1].edited(now)
                        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                        out.append((held[0], len(held[1].text), digest, held[1].print, print_, likeness(held[1].print, print_), likeness(held[1].print, now.print)))
                    held, closed = (doc_id, now), extra
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2), strict=True)], names)

    return in_ranges(text_rows(docs)).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every document."""
    bound_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in K.chunks(iter([b])):
                yield pa.RecordBatch.from_arrays([K.column(c, "doc_id"), pa.array([Text(t).print for t in K.column(c, "text").to_pylist()])], ["doc_id", "fingerprint"])

    return text_rows(docs).mapInArrow(run, "doc_id long, fingerprint string")


def band_keys(prints: DataFrame) -> DataFrame:
    """key, fingerprint, rep, once a band of each half: the bits at places that the band draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [K.splitmix(np.arange(BAND_BITS, dtype=U) + U((k << 16) + (1 << 45))) % U(BITS) for k in range(BANDS)]
        for b in batches:
            texts = K.column(b, "fingerprint").to_pylist()
            if not texts:
                continue
            level = np.array([level_of(int(x[:12], 16)) for x in texts])
            all_bits = np.unpackbits(np.frombuffer(bytes.fromhex("".join(x[12:] for x in texts)), np.uint8)).reshape(len(texts), 2, BITS)
            for half in (0, 1):
                for k, at in enumerate(places):
                    value = (all_bits[:, half][:, at.astype(int)].astype(np.int64) << np.arange(BAND_BITS)).sum(1)
                    key = ((level - half) * BANDS + k << BAND_BITS) | value
                    yield pa.RecordBatch.from_arrays([pa.array(key), K.column(b, "fingerprint"), K.column(b, "rep")], ["key", "fingerprint", "rep"])

    return prints.mapInArrow(run, "key long, fingerprint string, rep long")


def classes(docs: DataFrame, least: float = ALIKE) -> DataFrame:
    """doc_id, fingerprint, class_id: the smallest doc_id that likenesses of `least` or more reach. Rows without a doc_id are left out.

    Candidates agree in a whole band (likeness 0.8 is nine equal bits of ten: two candidates that alike share one
    of 32 bands with a probability of 0.9999)."""
    rows = cut(fingerprints(docs.filter("doc_id is not null")), "editprints")
    distinct = cut(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "editprints-distinct")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: list[tuple[int, str]] = []
        last = None

        def links() -> pa.RecordBatch:
            a, b = alike(bucket, least)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for key, text, rep in zip(*(K.column(batch, c).to_pylist() for c in ("key", "fingerprint", "rep")), strict=True):
                if key != last:
                    if len(bucket) > 1:
                        yield links()
                    bucket, last = [], key
                bucket.append((rep, text))
        if len(bucket) > 1:
            yield links()

    edges = band_keys(distinct).repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long")
    found = components(edges, "editprints-links")
    of = distinct.join(found, distinct.rep == found.node, "left").select("fingerprint", F.coalesce("root", "rep").alias("class_id"))
    return rows.join(of, "fingerprint").select("doc_id", "fingerprint", "class_id")


def alike(bucket: list[tuple[int, str]], least: float) -> tuple[list[int], list[int]]:
    """Links that connect what chains of alike fingerprints connect: each fingerprint meets all before it, a block at a time, and keeps one link to each class it meets."""
    ids = [i for i, _ in bucket]
    length = np.array([int(x[:12], 16) for _, x in bucket])
    level = np.array([level_of(int(n)) for n in length])
    halves = np.unpackbits(np.frombuffer(bytes.fromhex("".join(x[12:] for _, x in bucket)), np.uint8)).reshape(len(bucket), 2, BITS)
    root = np.arange(len(bucket))
    a, b = [], []
    for i in range(1, len(bucket)):
        for lo in range(0, i, BLOCK):
            some = np.arange(lo, min(i, lo + BLOCK))
            some = some[root[some] != root[i]]
            if not len(some):
                continue
            reach = np.maximum(length[some], length[i])
            seen, same = np.zeros(len(some)), np.zeros(len(some))
            for mine in (0, 1):
                for other in (0, 1):
                    on = np.flatnonzero(level[some] - other == level[i] - mine)
                    if len(on):
                        counts = samples(int(level[i]) - mine)[None] < reach[on][:, None]
                        seen[on] += counts.sum(1)
                        same[on] += ((halves[some[on], other] == halves[i, mine]) & counts).sum(1)
            near = some[np.maximum(0.0, 2 * same / np.maximum(seen, 1) - 1) >= least]
            for r in np.unique(root[near]).tolist():
                if r != root[i]:
                    a.append(ids[near[root[near] == r][0]])
                    b.append(ids[i])
                    root[root == root[i]] = r
    return a, b
