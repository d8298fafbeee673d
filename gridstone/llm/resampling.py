"""Importance resampling towards a target: hashed n-gram features, gains by bucket, Gumbel draws.

A task turns a run of documents into postings by bucket: the documents that have
the bucket and how often. Postings are dealt by bucket (and by slice, so that a
bucket of a third of all documents is many tasks' work) and written once. Both
corpora's counts meet by bucket and give its gain; each posting becomes a
contribution where it lies, tasks add up their contributions by document, and one
aggregation by document gives the weights. Ranks come from a sort by ranges of the
scores; no task sees all documents.

Edge cases: a null or empty text has no features and weight 0; rows with one
doc_id are one document whose texts count together; rows without a doc_id count
as one document that has no score and is never drawn (its words still count for
the corpus); an empty target has only the counts that smoothing gives; an empty
table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridstone.llm import kernel as K
from gridstone.llm.common import bound_arrow, cut, text_rows

BUCKETS, ORDER, SEED, SHARE, LEAST = 10_000, 1, 2024, 10, 20
#: A posting row holds one bucket of so many bytes of text; a slice's buckets are dealt in so many groups.
TOGETHER, GROUPS = 8 << 20, 4
#: A task adds up so many postings before it hands on sums by document.
HELD = 1 << 21
#: The bucket under which every document stands with its number of features.
ALL = -1
#: Longest feature whose checksum is computed beside the others'.
LONG = 48

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _steps() -> np.ndarray:
    """The byte-wise table of CRC-32 (reflected, 0xEDB88320)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_TABLE = _steps()


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the pieces data[start:end], all of them a byte at a time."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    on = np.flatnonzero(size <= LONG)
    on = on[np.argsort(size[on], kind="stable")]  # the longest stand last: each step takes a tail
    at, left = starts[on], np.sort(size[on], kind="stable")
    acc = out[on]
    for k in range(int(left[-1]) if len(on) else 0):
        lo = np.searchsorted(left, k, side="right")
        acc[lo:] = _TABLE[(acc[lo:] ^ data[at[lo:] + k]) & 0xFF] ^ (acc[lo:] >> np.uint32(8))
    out[on] = acc ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def features(batch: pa.RecordBatch, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Checksum of each feature, the row it stands in, and each row's number of words."""
    data, off = K.buffer(K.column(batch, "text"))
    data = _LOWER[data]
    starts, ends, first = K.runs(K.in_class(data, (48, 57), (97, 122), (128, 255)), off)
    n_words = np.diff(first)
    if order == 1:
        return checksums(data, starts, ends), np.repeat(np.arange(batch.num_rows), n_words), n_words
    spaced = K.gather(np.append(data, np.uint8(32)), starts, ends - starts + 1)
    to = np.cumsum(ends - starts + 1)
    spaced[to - 1] = 32
    begin = to - (ends - starts + 1)
    crc, rows = [], []
    for n in range(1, order + 1):
        at = K.window_starts(first, n)
        crc.append(checksums(spaced, begin[at], to[at + n - 1] - 1))
        rows.append(np.repeat(np.arange(batch.num_rows), np.maximum(n_words - n + 1, 0)))
    return np.concatenate(crc), np.concatenate(rows), n_words


def _cells(batches: Iterator[pa.RecordBatch], order: int, buckets: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each run of documents: bucket, row and count of its cells, sorted by bucket, and each row's features and words."""
    for b in K.chunks(batches):
        crc, row, n_words = features(b, order)
        key, n = np.unique((crc.astype(np.int64) % buckets) * b.num_rows + row, return_counts=True)
        yield b, key // max(1, b.num_rows), key % max(1, b.num_rows), n, np.bincount(row, minlength=b.num_rows), n_words


def postings(docs: DataFrame, order: int, buckets: int) -> DataFrame:
    """bucket, slice, n (all its counts), docs and counts (packed) of every run of documents; rows without a doc_id are doc 0, known 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slice_ = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            bucket, doc, known, n = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.argsort(bucket, kind="stable")
            bucket, doc, known, n = bucket[by], doc[by], known[by], n[by]
            some, first = np.unique(bucket, return_index=True)
            ends = np.append(first[1:], len(bucket))
            pack = lambda x, kind: [x[a:z].astype(kind).tobytes() for a, z in zip(first.tolist(), ends.tolist(), strict=True)]
            sums = np.add.reduceat(n, first) if len(first) else n[:0]
            return pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array(np.full(len(some), slice_, np.int32)), pa.array(sums), pa.array(pack(doc, "<i8"), pa.binary()), pa.array(pack(known, "u1"), pa.binary()), pa.array(pack(n, "<u4"), pa.binary())],
                ["bucket", "slice", "n", "docs", "known", "counts"],
            )

        for b, bucket, row, n, total, n_words in _cells(batches, order, buckets):
            ids = K.column(b, "doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            held.append((bucket, ids[row], known[row], n))
            held.append((np.full(b.num_rows, ALL), ids, known, total))
            held.append((np.full(b.num_rows, ALL - 1), ids, known, n_words))
            size += sum(c.nbytes for c in b.columns)
            if size >= TOGETHER:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return text_rows(docs).mapInArrow(run, "bucket int, slice int, n long, docs binary, known binary, counts binary")


def counted(texts: DataFrame, order: int, buckets: int) -> DataFrame:
    """bucket, n of a corpus: at most a row a bucket and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, bucket, _, n, _, _ in _cells(batches, order, buckets):
            np.add.at(total, bucket, n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain of each bucket of the source (bucket, n): the co-grouped counts of both corpora."""
    s, t = (df.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias(c)) for df, c in ((source, "_s"), (target, "_t")))
    both = source.join(target.withColumnRenamed("n", "m"), "bucket", "left").crossJoin(F.broadcast(s.crossJoin(t)))  # one row
    up = (F.coalesce("m", F.lit(0)).cast("double") + 1) * (F.col("_s") + buckets)
    down = (F.col("n").cast("double") + 1) * (F.col("_t") + buckets)
    return both.select("bucket", F.floor(1000 * F.log(up / down)).alias("gain"))


def weights(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, n_words, weight of every document."""
    spark = docs.sparkSession
    bound_arrow(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.pmod(F.col("slice") * GROUPS + F.pmod("bucket", F.lit(GROUPS)), F.lit(n)).cast("int")  # in turn, so no task gets several by chance
    dealt = postings(docs, order, buckets).repartitionById(n, place)
    rows = cut(dealt.sortWithinPartitions("slice", "bucket"), "postings")
    source = rows.filter(F.col("bucket") >= 0).groupBy("bucket").agg(F.sum("n").alias("n"))
    gain = gains(source, counted(target, order, buckets), buckets)
    valued = rows.join(F.broadcast(gain), "bucket", "left")  # at most a row a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def out() -> pa.RecordBatch:
            doc, known, weight, feature, word = (np.concatenate(x) for x in zip(*held, strict=True))
            doc = np.where(known, doc, 0)
            by = np.lexsort((known, doc))
            doc, known = doc[by], known[by]
            first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (known[1:] != known[:-1]))) if len(doc) else np.zeros(0, np.int64)
            sums = [np.add.reduceat(x[by], first) if len(first) else x for x in (weight, feature, word)]
            return pa.RecordBatch.from_arrays([pa.array(doc[first], pa.int64(), mask=~known[first]), *(pa.array(x) for x in sums)], ["doc_id", "weight", "n_features", "n_words"])

        for b in batches:
            for bucket, gain, docs_, known, counts in zip(*(K.column(b, c).to_pylist() for c in ("bucket", "gain", "docs", "known", "counts")), strict=True):
                doc, count = np.frombuffer(docs_, "<i8"), np.frombuffer(counts, "<u4").astype(np.int64)
                none = np.zeros(len(doc), np.int64)
                parts = (count * gain, none, none) if bucket >= 0 else (none, count, none) if bucket == ALL else (none, none, count)
                held.append((doc, np.frombuffer(known, "u1").astype(bool), *parts))
                n += len(doc)
                if n >= HELD:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    parts = valued.select("bucket", "gain", "docs", "known", "counts").mapInArrow(run, "doc_id long, weight long, n_features long, n_words long")
    return parts.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("n_features", "n_words", "weight")))


def noise(doc_id: Column, seed: int) -> Column:
    """The floor of 1000 times a Gumbel draw that follows from the seed and the doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """`weights` with the score; without a doc_id there is none."""
    return weights(docs, target, order, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(rows: DataFrame, share: int, least: int) -> DataFrame:
    """The rows (doc_id, score, n_words) with `rank` of those drawn: share per cent, rounded down, of the documents of `least` words or more.

    Rows are dealt by ranges of their place in the order; a place is its place in the range after all ranges before."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc("doc_id")]
    able = rows.filter((F.col("n_words") >= least) & F.col("doc_id").isNotNull())
    ranges = cut(able.select("doc_id", "score").repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "scores")
    sizes = {r["part"]: r["n"] for r in ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a range
    base, total = {}, 0
    for part in sorted(sizes):
        base[part] = total
        total += sizes[part]
    drawn = total * share // 100
    if not drawn:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    before = F.element_at(F.create_map(*(F.lit(x) for kv in base.items() for x in kv)), F.col("part"))
    some = ranges.filter(F.col("part").isin([p for p in base if base[p] < drawn]))
    place = (F.row_number().over(Window.partitionBy("part").orderBy(*order)) + before).cast("long")
    return rows.join(some.select("doc_id", place.alias("rank")).filter(F.col("rank") <= drawn), "doc_id", "left")


def sampled(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The drawn documents with all their columns."""
    drawn = ranked(cut(scored(docs, target, order, buckets, seed), "weights"), share, least).filter("rank is not null")
    return docs.join(drawn.select("doc_id"), "doc_id", "left_semi")


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """What op11 returns."""
    return ranked(cut(scored(docs, target), "weights"), SHARE, LEAST).select("doc_id", "n_features", "weight", "score", "rank")


SQL = rf"""
    WITH d AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
    ), b AS (
        SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
    ), bytes AS (
        SELECT w, list_transform(range(0, octet_length(encode(w))), lambda i: CAST(('0x' || hex(encode(w))[2 * i + 1 : 2 * i + 2]) AS UBIGINT)) AS x
        FROM (SELECT w FROM d UNION SELECT w FROM b)
    ), crc AS (
        SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), x), lambda c, e: list_reduce(list_prepend(xor(c, e), [CAST(0 AS UBIGINT) FOR k IN range(8)]),
               lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, CAST(3988292384 AS UBIGINT)) ELSE a // 2 END)), CAST(4294967295 AS UBIGINT)) % {BUCKETS} AS bucket
        FROM bytes
    ), own AS (SELECT doc_id, bucket, count(*) AS n FROM d JOIN crc USING (w) GROUP BY doc_id, bucket),
    s AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS s FROM own GROUP BY bucket),
    t AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS t FROM b JOIN crc USING (w) GROUP BY bucket),
    totals AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS ss, coalesce((SELECT sum(t) FROM t), 0) AS tt),
    gains AS (
        SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (ss + {BUCKETS}) / ((s + 1) * (tt + {BUCKETS})))) AS BIGINT) AS gain
        FROM s LEFT JOIN t USING (bucket) CROSS JOIN totals
    ), w AS (
        SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM own JOIN gains USING (bucket) GROUP BY doc_id
    ), scores AS (
        SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
               coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || sha256('{SEED}:' || doc_id)[1:8]) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
        FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN w USING (doc_id)
    ), ranks AS (
        SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scores WHERE n_features >= {LEAST}
    )
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {SHARE} * n // 100 THEN rank END AS rank
    FROM scores LEFT JOIN ranks USING (doc_id)
"""
