"""Substring dedup: Rabin-Karp hashes of every window of 50 words, counted over the corpus.

Texts that a smaller document has as they are lose all their windows: they are
found by their digests and take no further part. Of the others, equal windows
have equal minimizers (the smallest hash of their 8-word parts),
so a first count over minimizers, a few per cent of the windows, tells which
windows can occur in two documents at all; only those windows' hashes are
counted. Each hash's smallest document keeps the window; in the others the
covered words, merged to maximal intervals, are removed.

A window has two hashes modulo 2^61 - 1 under two bases that the driver draws for
the run. Two different windows of n bytes share both with a probability of at most
((n / 7 + 50) / 2^61)^2, about 10^-32 for 350 bytes, whatever the texts are.

Edge cases: a null or empty text has no words; a text of fewer words than a
window keeps all; a window repeated in one document alone stays; rows with one
doc_id count as one document and lose nothing to each other; a row without a
doc_id keeps all and takes nothing from others; extra columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstone.llm import kernel as K
from gridstone.llm.common import bound_arrow, cut, drop_cut, free_name, join_by_counts, table_cut, text_rows

U = np.uint64
WINDOW, PART = 50, 8


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minima of all k consecutive values, by doubling."""
    have = 1
    while have < k:
        step = min(have, k - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


class Words:
    """The words of a chunk of texts: their bytes, places, documents and values under two secret bases."""

    def __init__(self, batch: pa.RecordBatch, keys: tuple[int, int]):
        self.data, self.offsets = K.buffer(K.column(batch, "text"))
        self.starts, self.ends, self.first = K.runs(~K.is_space(self.data), self.offsets)
        self.hashes = [K.Hash(k) for k in keys]
        self.values = [h.words(self.data, self.starts, self.ends) for h in self.hashes]

    def minimizers(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all windows: the minimizer, the first word, the document."""
        part = min(PART, window)
        low, at = K.windows(self.hashes[0], self.values[0], self.first, part)
        size = np.maximum(np.diff(self.first) - part + 1, 0)
        span = window - part + 1
        if len(low) < span:
            return low[:0], at[:0], at[:0]
        low, at = sliding_min(low, span), at[: len(low) - span + 1]
        doc = np.repeat(np.arange(len(size)), size)
        own = doc[: len(low)] == doc[span - 1 :]
        return low[own], at[own], doc[: len(low)][own]

    def windows(self, at: np.ndarray, window: int) -> list[np.ndarray]:
        """Both hashes of the windows that start at the words `at`."""
        return [h.spans(h.prefix(v), at, at + window) for h, v in zip(self.hashes, self.values, strict=True)]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """doc_ids; rows without one are dropped before."""
    return K.column(batch, "doc_id").to_numpy(zero_copy_only=False).astype(np.int64)


def _distinct(docs: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Places of one row for each (keys, document)."""
    order = np.lexsort((docs, keys[0]))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (docs, *keys)])
    return order[new]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def minimizer_rows(docs: DataFrame, window: int, keys: tuple[int, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches):
            low, _, doc = Words(b, keys).minimizers(window)
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
            low, ids = low[new], _ids(b)[doc[new]]
            one = _distinct(ids, low)
            yield pa.RecordBatch.from_arrays([_signed(low[one]), pa.array(ids[one])], ["low", "doc_id"])

    return docs.mapInArrow(run, "low long, doc_id long")


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All values of a list column with the row of each; null lists are empty."""
    n = np.diff(column.offsets.to_numpy())
    if column.null_count:
        n = np.where(column.is_valid().to_numpy(zero_copy_only=False), n, 0)
    return column.flatten(), np.repeat(np.arange(len(n)), n)


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(U)


def _among(doc: np.ndarray, keys: list[np.ndarray], of_doc: np.ndarray, of: list[np.ndarray]) -> np.ndarray:
    """Which (document, keys) are among (of_doc, of)."""
    mixed = lambda d, k: K.splitmix(k[0] ^ (d.astype(U) * U(0x9E3779B97F4A7C15)))
    if not len(of_doc):
        return np.zeros(len(doc), bool)
    some = mixed(of_doc, of)
    order = np.argsort(some)
    x = mixed(doc, keys)
    at = order[np.minimum(np.searchsorted(some, x, sorter=order), len(some) - 1)]
    return np.logical_and.reduce([of_doc[at] == doc, *(b[at] == a for a, b in zip(keys, of, strict=True))])


def window_rows(docs: DataFrame, window: int, keys: tuple[int, int]) -> DataFrame:
    """The windows whose minimizer is in the row's lists `own` or `shared`: both hashes, doc_id, and whether it is of `shared`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches):
            w = Words(b, keys)
            low, at, doc = w.minimizers(window)
            for name in ("own", "shared"):
                values, of_doc = _lists(K.column(b, name))
                on = _among(doc, [low], of_doc, [_unsigned(values)])
                h, ids = w.windows(at[on], window), _ids(b)[doc[on]]
                one = _distinct(ids, *h)
                yield pa.RecordBatch.from_arrays([*(_signed(x[one]) for x in h), pa.array(ids[one]), pa.array(np.full(len(one), name == "shared"))], ["h", "g", "doc_id", "later"])

    return docs.mapInArrow(run, "h long, g long, doc_id long, later boolean")


def digest() -> Column:
    return F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))


def exact_copies(docs: DataFrame) -> DataFrame:
    """doc_id, copies (digests of its texts that a smaller document has), all_copies: whether all its rows are such."""
    prints = docs.select("doc_id", digest().alias("print"))
    counted = prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    firsts = cut(counted.filter("first < last").select("print", "first", "n"), "copies-first")
    found = join_by_counts(prints, firsts, ["print"]).filter("doc_id > first")
    found = found.groupBy("doc_id").agg(F.collect_set("print").alias("copies"), F.count(F.lit(1)).alias("n_copies"))
    sizes = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return cut(found.join(sizes, "doc_id").select("doc_id", "copies", (F.col("n_copies") == F.col("n_rows")).alias("all_copies")), "copies")


def removals(docs: DataFrame, window: int, keys: tuple[int, int]) -> DataFrame:
    """doc_id, gone (hashes of its windows that start in a smaller document too), copies (digests of texts that a smaller document has).

    A document that is the first with a minimizer loses none of its windows; they
    are counted, but only those of later documents are joined with the counts."""
    known = docs.filter("doc_id is not null")
    copies = exact_copies(known)
    every, path = table_cut(minimizer_rows(known, window, keys), "windows-low")
    lows = every.join(copies.filter("all_copies").select("doc_id"), "doc_id", "left_anti")
    counted = lows.groupBy("low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = cut(counted.filter("first < last").select("low", "first", "n"), "windows-shared")
    first = F.col("doc_id") == F.col("first")
    may = cut(join_by_counts(lows, shared, ["low"]).groupBy("doc_id").agg(F.collect_set(F.when(first, F.col("low"))).alias("own"), F.collect_set(F.when(~first, F.col("low"))).alias("shared")), "windows-may")
    drop_cut(docs.sparkSession, path)
    rows = cut(window_rows(known.join(may, "doc_id"), window, keys), "windows")
    firsts = rows.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.count_if("later").alias("n")).filter("n > 0")
    later = join_by_counts(rows.filter("later").drop("later"), cut(firsts, "windows-first"), ["h", "g"])
    gone = later.filter("first < doc_id").groupBy("doc_id").agg(F.collect_set(F.struct("h", "g")).alias("gone"))
    return gone.join(copies.select("doc_id", "copies"), "doc_id", "full_outer")


def edited(batch: pa.RecordBatch, window: int, keys: tuple[int, int], gone_column: str = "gone", copy_column: str = "copied") -> list[pa.Array]:
    """n_words, n_removed, kept of each text; a copied one loses all words of its windows, that is all if it has a window."""
    w = Words(batch, keys)
    values, of_doc = _lists(K.column(batch, gone_column))
    some = np.zeros(batch.num_rows, bool)
    some[of_doc] = True
    at = K.window_starts(w.first, window)
    doc = np.searchsorted(w.first, at, side="right") - 1
    at, doc = at[some[doc]], doc[some[doc]]
    on = _among(doc, w.windows(at, window), of_doc, [_unsigned(x) for x in values.flatten()]) if len(at) else np.zeros(0, bool)
    gone = K.covered(len(w.starts), at[on], window)
    n_words = np.diff(w.first)
    gone |= np.repeat(K.column(batch, copy_column).to_numpy(zero_copy_only=False).astype(bool) & (n_words >= window), n_words)
    n_gone = K.per_doc(gone, w.first)
    size = (w.ends - w.starts + 1)[~gone]
    kept = K.gather(np.append(w.data, np.uint8(32)), w.starts[~gone], size)  # each word with what follows it
    ends = np.cumsum(size)
    kept[ends - 1] = 32
    left = np.diff(w.first) - n_gone
    to = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(left)])]
    keep = np.ones(len(kept), bool)
    keep[to[1:][left > 0] - 1] = False  # the space after a document's last word
    offsets = to - np.concatenate([[0], np.cumsum(left > 0)])
    return [pa.array(np.diff(w.first)), pa.array(n_gone), K.to_array(kept[keep], offsets, pa.string())]


def copied(copies: str) -> Column:
    return F.coalesce(F.array_contains(copies, digest()), F.lit(False))


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, one space between)."""
    bound_arrow(docs.sparkSession)
    docs = text_rows(docs)
    keys = K.fresh_key(), K.fresh_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches):
            yield pa.RecordBatch.from_arrays([K.column(b, "doc_id"), *edited(b, window, keys)], ["doc_id", "n_words", "n_removed", "kept"])

    rows = docs.join(removals(docs, window, keys), "doc_id", "left").withColumn("copied", copied("copies")).drop("copies")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def cleaned(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with all their columns; where words were removed the text is what stays, and n_chars its length.

    Rows that lose all their words go; other texts stay as they are."""
    bound_arrow(docs.sparkSession)
    names = docs.columns
    keys = K.fresh_key(), K.fresh_key()
    gone_name, kept_name, removed_name, copies_name, copied_name = (free_name(docs, c) for c in ("gone", "kept", "removed", "copies", "copied"))
    gone = removals(text_rows(docs), window, keys).withColumnsRenamed({"gone": gone_name, "copies": copies_name})
    rows = docs.join(gone, "doc_id", "left").withColumn(copied_name, copied(copies_name))
    schema = T.StructType([*docs.schema.fields, T.StructField(kept_name, T.StringType()), T.StructField(removed_name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches):
            _, n_gone, kept = edited(b, window, keys, gone_name, copied_name)
            yield pa.RecordBatch.from_arrays([*(K.column(b, c) for c in names), kept, n_gone], [*names, kept_name, removed_name])

    out = rows.select(*names, gone_name, copied_name).mapInArrow(run, schema)
    kept, cut_short = F.col(kept_name), F.col(removed_name) > 0
    out = out.filter(~cut_short | (kept != ""))
    changed = {"text": F.when(cut_short, kept).otherwise(F.col("text"))}
    if "n_chars" in names:
        changed["n_chars"] = F.when(cut_short, F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*names)


def report(docs: DataFrame) -> DataFrame:
    """What op4 returns."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))

