"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all lower-cased words (runs of digits, letters and signs beyond ASCII) of a
bounded sample of labelled documents (SAMPLE, those of smallest hash): none is left out.
A term weighs (1 + log tf) * idf, its idf counted over all documents, times FLOOR plus its
lift: how much likelier, drawn towards even by SHRINK examples, a sampled text that
holds it is toxic (0 for terms that are not). The lift keeps a few telling words of a long text from drowning in the rest of it.
The index keeps the examples by blocks, and of each term with a long list of postings the
largest weight in each block; short lists are read whole. A query visits blocks by their upper bounds until none can enter its
NEIGHBOURS nearest, so the neighbours are the exact ones: candidates are found in single precision with room for its error and compared
in double precision. A block is compared with all queries of a batch that visit it in one product. Votes weighted by distance are
calibrated on the sample (each example without itself) by pooled isotonic steps.

Only texts and the labels of the rows that are not held out are used; labels, language,
source and doc_id are no inputs of a score. Terms that no sampled text has are in no example and
count for nothing. Edge cases: a null or empty text, or one without any
term of the sample, gets the calibrated rate of examples without a neighbour; without toxic
examples every score is that rate; equal texts get equal scores; repeated label
rows count once (toxic if any is), of repeated rows of a document the text that comes first in order is learned from; a null doc_id is never held out nor learned from; extra
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.llm import kernel as K
from gridstone.llm.common import bound_arrow, cut, text_rows

U = np.uint64
#: Bound of what is learned from: labelled documents.
SAMPLE = 8192
NEIGHBOURS, BLOCK = 15, 64
#: Blocks that a query visits before it compares the bounds of the others.
FIRST = 8
#: A list is long if more than one example in SHARE has its term; at most the COLUMNS longest are held as columns.
SHARE, COLUMNS = 16, 1024
#: Texts compared at once, and postings of short lists read at once.
QUERIES, POSTINGS = 128, 1 << 18
FLOOR, SHRINK = 0.05, 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def counted(data: np.ndarray, offsets: np.ndarray, h: K.Hash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, word and number of times of each word of each text, by text and word."""
    lower = data + 32 * K.in_class(data, (65, 90)).astype(np.uint8)
    starts, ends, first = K.runs(K.in_class(lower, (48, 57), (97, 122), (128, 255)), offsets)
    word = h.words(lower, starts, ends).view(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    order = np.lexsort((word, doc))
    word, doc = word[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])])) if len(word) else np.zeros(0, np.int64)
    return doc[new], word[new], np.diff(np.append(new, len(word)))


class Vocabulary:
    """The sample's words in order, and their weights."""

    def __init__(self, words: np.ndarray, weight: np.ndarray):
        self.words, self.weight = words, weight

    def places(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which are among the words, and where."""
        if not len(self.words):
            return np.zeros(len(word), bool), np.zeros(len(word), np.int64)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return self.words[at] == word, at

    def vectors(self, doc: np.ndarray, word: np.ndarray, n: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms and unit weights of all texts end to end, and each text's first."""
        on, at = self.places(word)
        doc, term, n = doc[on], at[on], n[on]
        w = (1 + np.log(n)) * self.weight[term]
        norm = np.sqrt(np.bincount(doc, weights=w * w, minlength=texts)[:texts]) if len(doc) else np.zeros(texts)
        on = norm[doc] > 0 if len(doc) else np.zeros(0, bool)
        doc, term, w = doc[on], term[on], w[on]
        return term, w / norm[doc] if len(w) else w, np.searchsorted(doc, np.arange(texts + 1))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start .. start + length of all pairs, end to end."""
    to = np.cumsum(lengths)
    return np.repeat(starts - (to - lengths), lengths) + np.arange(int(to[-1]) if len(to) else 0)


def kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest along the last axis; 0 if there are fewer."""
    n = x.shape[-1]
    return np.partition(x, n - k)[..., n - k] if n >= k else np.zeros(x.shape[:-1], x.dtype)


class Index:
    """Examples by blocks. Long lists of postings lie as columns by block, with each one's largest weight in each block; the others lie end to end."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: np.ndarray):
        # texts of one leading term stand together, which keeps the blocks' bounds low
        order = sorted(range(len(vectors)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), i))
        self.labels, self.ids, self.n = labels[order].astype(float), ids[order], len(order)
        self.blocks = max(1, -(-self.n // BLOCK))
        self.places = self.blocks * BLOCK
        term = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in order]) if order else np.zeros(0)
        doc = np.repeat(np.arange(self.n), [len(vectors[i][0]) for i in order])
        by = np.lexsort((doc, term))
        term, doc, weight = term[by], doc[by], weight[by]
        size = np.bincount(term) if len(term) else np.zeros(0, np.int64)
        long = np.argsort(-size, kind="stable")[:COLUMNS]
        long = np.sort(long[size[long] * SHARE > self.n])
        self.column = np.full(len(size), -1, np.int32)
        self.column[long] = np.arange(len(long))
        # in narrow types, for a worker holds a copy
        self.held = np.zeros((self.places, len(long)), np.float32)
        on = self.column[term] >= 0
        self.held[doc[on], self.column[term[on]]] = weight[on]
        self.most = self.held.reshape(self.blocks, BLOCK, len(long)).max(1)
        self.doc, self.weight = doc[~on].astype(np.min_scalar_type(self.n)), weight[~on].astype(np.float32)
        self.start = np.searchsorted(term[~on], np.arange(len(size) + 1)).astype(np.int32)
        # sums of so many products in single precision, of unit vectors, are less than this off
        self.slack = (len(long) + 16) * 2.0**-23

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine above 0 (ties by place) and their cosines."""
        return next(self.search(np.array([0, len(term)]), term, weight, k, np.array([without])))

    def search(self, first: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, without: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What `nearest` returns for each of many texts: text i has the terms from first[i] on. QUERIES texts are compared at once."""
        for at in range(0, len(first) - 1, QUERIES):
            to = min(at + QUERIES, len(first) - 1)
            part = slice(first[at], first[to])
            text = np.repeat(np.arange(to - at), np.diff(first[at : to + 1]))
            own = term[part] < len(self.column)
            yield from self.some(to - at, text[own], term[part][own], weight[part][own], k, without[at:to])

    def some(self, n: int, text: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, without: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """`search` for n texts at once."""
        at = self.column[term]
        on = at >= 0
        query = np.zeros((n, len(self.most[0])))
        query[text[on], at[on]] = weight[on]
        short = self.short(n, text[~on], term[~on], weight[~on])
        itself = np.flatnonzero(without >= 0)
        short[itself, without[itself]] = -np.inf
        score, q = short.astype(np.float32).reshape(n, self.blocks, BLOCK), query.astype(np.float32)
        # what a block's examples have of the short lists is known, of the long ones they have its largest weights at most
        bound = score.max(2) + q @ self.most.T
        visit = np.zeros((n, self.blocks), bool)
        np.put_along_axis(visit, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST], True, 1)
        self.add(score, q, visit)
        # the largest bounds first; what they find says which of the other blocks are left
        least = np.array([kth(score[i, visit[i]].ravel(), k) for i in range(n)])
        left = ~visit & (bound >= np.maximum(least - 2 * self.slack, 0)[:, None])
        self.add(score, q, left)
        score[~(visit | left)] = 0
        least = kth(score.max(2), k)
        score = score.reshape(n, self.places)
        for i in range(n):
            docs = np.flatnonzero((score[i] > 0) & (score[i] >= least[i] - 2 * self.slack))
            docs = docs[score[i, docs] >= kth(score[i, docs], k) - 2 * self.slack]
            on = np.flatnonzero(query[i])
            exact = short[i, docs] + (self.held[np.ix_(docs, on)] * query[i, on]).sum(1)  # in one order, whatever other texts there are
            keep = np.lexsort((docs, -np.round(exact, 9)))[:k]
            yield docs[keep], exact[keep]

    def short(self, n: int, text: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What the short lists add to the cosines of n texts with all places, read about POSTINGS at a time."""
        out = np.zeros((n, self.places))
        size = (self.start[term + 1] - self.start[term]).astype(np.int64)
        cuts = [*np.flatnonzero(np.diff(np.cumsum(size) // POSTINGS, prepend=-1)).tolist(), len(size)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            texts, many = slice(text[a], text[z - 1] + 1), size[a:z]
            at = _ranges(self.start[term[a:z]].astype(np.int64), many)
            place = np.repeat((text[a:z] - text[a]) * self.places, many) + self.doc[at]
            out[texts] += np.bincount(place, weights=np.repeat(weight[a:z], many) * self.weight[at], minlength=out[texts].size).reshape(-1, self.places)
        return out

    def add(self, score: np.ndarray, q: np.ndarray, visit: np.ndarray) -> None:
        """Adds what the long lists give in the blocks that a text visits: a block is compared with all its texts in one product."""
        for b in np.flatnonzero(visit.any(0)).tolist():
            texts = np.flatnonzero(visit[:, b])
            score[texts, b] += q[texts] @ self.held[b * BLOCK : (b + 1) * BLOCK].T

    def votes(self, first: np.ndarray, term: np.ndarray, weight: np.ndarray, without: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Of each text the weighted share of toxic neighbours (-1 without neighbours), and who they are."""
        votes, evidence = np.full(len(first) - 1, -1.0), []
        for i, (docs, s) in enumerate(self.search(first, term, weight, NEIGHBOURS, without)):
            if len(docs):
                w = 1 / (1.05 - np.minimum(s, 1.0))
                votes[i] = np.round(w @ self.labels[docs] / w.sum(), 9)  # else the last bit says on which side of a step a vote lies
            evidence.append(self.ids[docs].tolist())
        return votes, evidence


class Model:
    """Vocabulary and index, sent to the workers once, and how votes become scores."""

    def __init__(self, spark: SparkSession, vocabulary: Vocabulary, index: Index, key: int):
        self.shared, self.key = spark.sparkContext.broadcast((vocabulary, index)), key  # at most SAMPLE examples
        self.edges = self.values = np.zeros(0)
        self.bare = 0.0

    def calibrate(self, votes: np.ndarray, toxic: np.ndarray) -> None:
        """By the votes on the examples, each without itself."""
        alone = votes < 0
        self.bare = float((toxic[alone].sum() + 0.5) / (alone.sum() + 2.0)) if len(votes) else 0.0
        self.edges, self.values = isotonic(votes[~alone], toxic[~alone].astype(float))

    def scores(self) -> Callable[[np.ndarray], np.ndarray]:
        edges, values, bare = self.edges, self.values, self.bare

        def of(votes: np.ndarray) -> np.ndarray:
            if not len(edges):
                return np.full(len(votes), bare)
            return np.where(votes < 0, bare, values[np.maximum(np.searchsorted(edges, votes, side="right") - 1, 0)])

        return of


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps: from edges[i] on the value values[i]; each pool's rate is drawn towards one half by one example."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # edge, toxic, number
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        if pools and pools[-1][0] == a:
            pools[-1][1] += b
            pools[-1][2] += 1
        else:
            pools.append([a, b, 1])
        while len(pools) > 1 and (pools[-2][1] + 0.5) / (pools[-2][2] + 1) >= (pools[-1][1] + 0.5) / (pools[-1][2] + 1):
            _, t, n = pools.pop()
            pools[-1][1] += t
            pools[-1][2] += n
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


def sample_of(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """doc_id, toxic, text of at most `size` labelled documents that are not held out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    return text_rows(docs).join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def document_frequencies(docs: DataFrame, words: np.ndarray, key: int) -> tuple[np.ndarray, int]:
    """In how many of all documents each of the words stands, counted by workers before it is summed; and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # the words of at most SAMPLE documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, h = Vocabulary(shared.value, np.zeros(0)), K.Hash(key)
        total, rows = np.zeros(len(shared.value), np.int64), 0
        for b in K.chunks(batches):
            on, at = vocabulary.places(counted(*K.buffer(K.column(b, "text")), h)[1])
            total += np.bincount(at[on], minlength=len(total))[: len(total)]
            rows += b.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], rows))], ["term", "df"])

    got = docs.mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row a word
    term, df = got["term"].to_numpy(), got["df"].to_numpy()
    out = np.zeros(len(words), np.int64)
    out[term[term >= 0]] = df[term >= 0]
    return out, int(df[term < 0].sum())


def weights(df: np.ndarray, n: int, held: np.ndarray, toxic: np.ndarray, rate: float) -> np.ndarray:
    """idf times FLOOR plus lift; held, toxic: how many examples, and toxic ones, have the word."""
    lift = np.log2((toxic + SHRINK * rate) / (held + SHRINK) / rate) if rate > 0 else np.zeros(len(df))
    return np.log((n + 1) / (np.minimum(df, n) + 1)) * (FLOOR + np.maximum(lift, 0))


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    bound_arrow(spark)
    key = K.fresh_key()
    sample = cut(sample_of(docs, labels, size), "toxic-sample")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = K.Hash(key)
        for b in K.chunks(batches):
            doc, word, n = counted(*K.buffer(K.column(b, "text")), h)
            at = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int64))) for x in (word, n)]
            yield pa.RecordBatch.from_arrays([K.column(b, "doc_id"), K.column(b, "toxic"), *lists], ["doc_id", "toxic", "word", "n"])

    rows = sample.mapInArrow(words, "doc_id long, toxic long, word array<long>, n array<long>").toArrow().sort_by("doc_id").combine_chunks()  # at most SAMPLE rows
    ids, labels_ = rows["doc_id"].to_numpy(), (rows["toxic"].to_numpy() > 0).astype(np.int64)
    flat = lambda c: np.concatenate([x.flatten().to_numpy() for x in rows[c].chunks]) if rows.num_rows else np.zeros(0, np.int64)
    word, n = flat("word"), flat("n")
    doc = np.repeat(np.arange(len(ids)), np.concatenate([np.diff(x.offsets.to_numpy()) for x in rows["word"].chunks])) if rows.num_rows else np.zeros(0, np.int64)
    known, at = np.unique(word, return_inverse=True)
    df, total = document_frequencies(text_rows(docs), known, key)
    held = np.bincount(at, minlength=len(known))
    toxic = np.bincount(at, weights=labels_[doc], minlength=len(known)) if len(at) else np.zeros(0)
    vocabulary = Vocabulary(known, weights(df, total, held, toxic, float(labels_.mean()) if len(ids) else 0.0))
    term, weight, first = vocabulary.vectors(doc, word, n, len(ids))
    vectors = [(term[a:z], weight[a:z]) for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    some = [i for i, v in enumerate(vectors) if len(v[0])]
    model = Model(spark, vocabulary, Index([vectors[i] for i in some], labels_[some], ids[some]), key)
    votes = voted(sample, model, True).select("vote", "toxic").toArrow()
    model.calibrate(votes["vote"].to_numpy(), (votes["toxic"].to_numpy() > 0).astype(np.int64))
    return model


def voted(docs: DataFrame, model: Model, without_itself: bool = False) -> DataFrame:
    """doc_id, vote, evidence (the labelled examples that voted, nearest first) of every document, and toxic if the examples vote on each other."""
    shared, key, scores = model.shared, model.key, model.scores()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, index = shared.value
        h = K.Hash(key)
        place = {int(d): p for p, d in enumerate(index.ids)} if without_itself else {}
        for b in K.chunks(batches):
            term, weight, first = vocabulary.vectors(*counted(*K.buffer(K.column(b, "text")), h), b.num_rows)
            without = np.array([place.get(i, -1) for i in K.column(b, "doc_id").to_pylist()], np.int64)
            votes, evidence = index.votes(first, term, weight, without)
            more = [K.column(b, "toxic")] if without_itself else []
            yield pa.RecordBatch.from_arrays([K.column(b, "doc_id"), pa.array(votes, pa.float64()), pa.array(scores(votes)), pa.array(evidence, pa.list_(pa.int64())), *more], ["doc_id", "vote", "score", "evidence", "toxic"][: 4 + len(more)])

    rows = docs.select("doc_id", "text", "toxic") if without_itself else text_rows(docs)
    return rows.mapInArrow(run, "doc_id long, vote double, score double, evidence array<long>" + (", toxic long" if without_itself else ""))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, vote, score and evidence (the labelled examples that voted, nearest first) of every document."""
    bound_arrow(docs.sparkSession)
    return voted(docs, model)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What op6 returns."""
    rows = scored(docs, fit(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
