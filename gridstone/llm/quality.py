"""Quality rules: text statistics and the perplexity of a modified Kneser-Ney model.

The model is over runs of ORDER code points (white space is one sign, A-Z is a-z, code
points from 512 on share 512 classes). Workers gather the different runs of ORDER + 1
signs of all documents, Spark joins them by language; a run of ORDER signs counts by the
different signs found before it, as Kneser-Ney's lower orders do, so that copies of a
text do not make it likelier. Shorter runs count in the same way. That is the model of
`decisions` and `keep`; `report` takes the published method's (raw): the runs of ORDER
signs count by their places, the shorter ones as above. The model grows with the corpus. Discounted estimates and the weights of the next lower order are stored as
sorted arrays of 64-bit hashes: files of at most SHARD_ROWS entries in the shared
folder, each with the range of its hashes. A worker looks its texts' runs up in the
files whose ranges hold them, and keeps files of at most CACHE_ROWS entries; nothing of
the model goes through the driver but the list of its files. Every corpus takes this way.

A document is rejected if its mean log-perplexity lies outside the band of its
language and length class (from LOWER robust deviations below the median to UPPER
above it, from a histogram of all documents), or if a base rule fails.

Edge cases: a null or empty text has no words, so its base rules fail; a null
language is a language of its own; equal rows get equal results; classes of
fewer than CLASS_ROWS documents take a wider class's band; extra columns are ignored by
the report and kept by `keep`; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridstone.llm import kernel as K
from gridstone.llm.common import bound_arrow, cut, free_name, fresh_path

U = np.uint64
ORDER, BITS = 5, 10
#: Entries of a file of the model (12 bytes each), and of the files that a worker keeps.
SHARD_ROWS, CACHE_ROWS = 1 << 19, 1 << 21
#: Bytes of text that are worked on at once; bytes whose runs are looked up together (the files are read once for so much
#: text) and about how many different runs that are not remembered.
STEP_BYTES, LOOK_BYTES, LOOK_RUNS = 1 << 18, 16 << 20, 1 << 19
#: Runs that a worker holds before it passes them on; a power of two of runs that it remembers.
HELD, REMEMBERED = 2_000_000, 20
#: A band's reach below and above its median in robust deviations: README has the measured rejection.
LOWER, UPPER = 5.0, 4.0
#: The least deviation; resolution of the histogram; smallest class with a band of its own.
LEAST, STEP, CLASS_ROWS = 0.02, 0.002, 30
#: Bands that may be broadcast, at about 60 bytes a row; more are joined, each SALTS times.
BAND_ROWS, SALTS = 50_000, 16
UNKNOWN = "und"


def _fold() -> np.ndarray:
    t = np.arange(512, dtype=U)
    t[65:91] += U(32)
    t[[*range(9, 14), 32]] = 0
    return t


FOLD = _fold()


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signs of all texts (BITS bits each), and each text's first."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    point = data[at].astype(np.int64)
    wide = np.flatnonzero(point >= 0xC0)
    if len(wide):
        tail = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64) & 0x3F
        b, i = point[wide], at[wide]
        two, three = (b & 0x1F) << 6 | tail[i + 1], (b & 0xF) << 12 | tail[i + 1] << 6 | tail[i + 2]
        four = (b & 7) << 18 | tail[i + 1] << 12 | tail[i + 2] << 6 | tail[i + 3]
        point[wide] = np.where(b < 0xE0, two, np.where(b < 0xF0, three, four))
    return np.where(point < 512, FOLD[point & 511], (512 + (point & 511)).astype(U)), np.searchsorted(at, offsets)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each code point the run of ORDER + 1 signs that ends there, packed (a text begins after white space); each text's first."""
    sym, first = symbols(data, offsets)
    out = sym.copy()
    place = np.arange(len(sym)) - np.repeat(first[:-1], np.diff(first))
    for k in range(1, ORDER + 1):
        back = np.zeros(len(sym), U)
        back[k:] = sym[:-k]
        back[place < k] = 0
        out |= back << U(BITS * k)
    return out, first


class Remembered:
    """A table of hashes with a value each; a newer hash takes an older one's place."""

    def __init__(self, bits: int = REMEMBERED):
        self.mask = np.int64((1 << bits) - 1)
        self.keys = ~np.arange(1 << bits, dtype=np.int64)  # at its place no hash is its own complement
        self.values = np.zeros(1 << bits)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of those that are not here, and all values (of others: anything)."""
        slot = h & self.mask
        return np.flatnonzero(self.keys[slot] != h), self.values[slot]

    def put(self, h: np.ndarray, values: np.ndarray | None = None) -> None:
        """Of two hashes of one place the last stays, with its value."""
        slot = h & self.mask
        self.keys[slot] = h
        if values is not None:
            own = self.keys[slot] == h
            self.values[slot[own]] = values[own]


def gram_rows(docs: DataFrame) -> DataFrame:
    """lang, gram: the different runs of each worker's documents (some repeated)."""

    def rows(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            key = np.unique(np.concatenate(parts))
            for k in range(0, len(key), 1 << 17):
                part = key[k : k + (1 << 17)]
                name = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(part), np.int32)), pa.array([lang], pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([name, pa.array(part.astype(np.int64))], ["lang", "gram"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size, known = 0, Remembered()
        for b in K.chunks(batches, STEP_BYTES):
            g, first = grams(*K.buffer(K.column(b, "text")))
            names, code = languages(K.column(b, "lang"))
            of, code = np.array([lang_hash(x) for x in names], U), np.repeat(code, np.diff(first))
            h = hashed(of[code], 0, g)
            new, _ = known.find(h)
            known.put(h[new])
            g, code = g[new], code[new]
            for i, lang in enumerate(names):
                keys = np.unique(g[code == i])
                if len(keys):
                    held.setdefault(lang, []).append(keys)
                    size += len(keys)
            if size > HELD:
                yield from rows(held)
                held, size = {}, 0
        yield from rows(held)
        del held, known
        K.give_back()

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long")


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n: the runs of ORDER signs of each worker's documents and their places (some runs repeated)."""

    def rows(held: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            key, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([n for _, n in parts])).astype(np.int64)
            for k in range(0, len(key), 1 << 17):
                part = key[k : k + (1 << 17)]
                name = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(part), np.int32)), pa.array([lang], pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([name, pa.array(part.astype(np.int64)), pa.array(n[k : k + (1 << 17)])], ["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for b in K.chunks(batches, STEP_BYTES):
            g, first = grams(*K.buffer(K.column(b, "text")))
            g &= U((1 << BITS * ORDER) - 1)
            names, code = languages(K.column(b, "lang"))
            code = np.repeat(code, np.diff(first))
            for i, lang in enumerate(names):
                keys, n = np.unique(g[code == i], return_counts=True)
                if len(keys):
                    held.setdefault(lang, []).append((keys, n))
                    size += len(keys)
            if size > HELD:
                yield from rows(held)
                held, size = {}, 0
        yield from rows(held)
        del held
        K.give_back()

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")


def languages(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The names in a column, and the number of each row's name."""
    d = column.dictionary_encode()
    return d.dictionary.to_pylist(), d.indices.to_numpy().astype(np.int64)


def levels(runs: DataFrame, order: int = ORDER) -> DataFrame:
    """k, lang, gram, n: for each order k the runs of k signs and how many different signs stand before them."""
    low = lambda k: F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1))
    ends = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), low(k + 1).alias("gram")) for k in range(1, order + 1))))
    longer = runs.select("lang", ends.alias("e")).select("e.k", "lang", "e.gram").distinct()
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k") * BITS) - 1
    return longer.groupBy("k", "lang", F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.count(F.lit(1)).alias("n"))


def raw_levels(runs: DataFrame) -> DataFrame:
    """`levels` from counted runs of ORDER signs: the highest order has the runs' places, the lower ones the different signs before a run."""
    top = runs.select(F.lit(ORDER).alias("k"), "lang", "gram", "n")
    return top.unionByName(levels(runs.select("lang", "gram"), ORDER - 1))


def estimates(level: DataFrame) -> DataFrame:
    """kind, lang, gram, v of the interpolated modified Kneser-Ney model: for kind k the discounted share of a run of k
    signs among those with its context, for kind -k what the context `gram` leaves to the next lower order."""
    nn = level.groupBy("k", "lang").agg(*(F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in range(1, 5)))
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    d = lambda i: F.when((F.col(f"n{i}") > 0) & (y > 0), F.greatest(F.least(i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(f"n{i}", F.lit(1.0)), F.lit(i - 0.05)), F.lit(0.05))).otherwise(0.5 if i == 1 else 0.75 * i if i == 2 else 1.5)
    discounts = nn.select("k", "lang", *(d(i).alias(f"d{i}") for i in (1, 2, 3)))
    n = F.col("n")
    one = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
    # a context has at most 2^BITS runs
    rows = level.join(discounts, ["k", "lang"]).select("k", "lang", "gram", F.shiftright("gram", BITS).alias("ctx"), "n", one.alias("d"))
    own = rows.select("k", "lang", "gram", (F.greatest(n - F.col("d"), F.lit(0.0)) / F.sum("n").over(Window.partitionBy("k", "lang", "ctx"))).alias("v"))
    left = rows.groupBy("k", "lang", "ctx").agg((F.sum("d") / F.sum("n")).alias("v"))
    return own.select(F.col("k").alias("kind"), "lang", "gram", "v").unionByName(left.select((-F.col("k")).alias("kind"), "lang", F.col("ctx").alias("gram"), "v"))


def lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def hashed(lang: np.ndarray, kind: int | np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Hashes of the entries of a kind."""
    return K.splitmix(gram.astype(U) ^ K.splitmix(lang + np.asarray(kind + 64).astype(U))).view(np.int64)


class Model:
    """The estimates in files of sorted hashes; a worker opens them through the file system of their folder."""

    def __init__(self, files: list[tuple[str, int, int]], order: int = ORDER):
        self.files, self.order = sorted(files, key=lambda f: f[1]), order
        self.low = np.array([f[1] for f in self.files], np.int64)
        self.high = np.array([f[2] for f in self.files], np.int64)
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def store(cls, table: DataFrame) -> Model:
        """Writes the estimates as sorted arrays below the shared folder."""
        spark = table.sparkSession

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names, code = languages(K.column(b, "lang"))
                of = np.array([lang_hash(x) for x in names], U)[code]
                h = hashed(of, K.column(b, "kind").to_numpy().astype(np.int64), K.column(b, "gram").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(h), K.column(b, "v").cast(pa.float32())], ["h", "v"])

        path = fresh_path(spark, "kn-model")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        entries = cut(table.mapInArrow(run, "h long, v float"), "kn-entries")
        entries.repartitionByRange(n, "h").sortWithinPartitions("h").write.option("maxRecordsPerFile", SHARD_ROWS).parquet(path)
        files = spark.read.schema("h long, v float").parquet(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min("h").alias("low"), F.max("h").alias("high"))
        return cls([(r["f"], r["low"], r["high"]) for r in files.collect()])  # a row for SHARD_ROWS entries

    def arrays(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """A file's arrays; the first files of CACHE_ROWS entries stay, as each pass reads all in turn."""
        if i in self.held:
            return self.held[i]
        fs, path = pyarrow.fs.FileSystem.from_uri(self.files[i][0])
        t = pq.read_table(path, filesystem=fs, partitioning=None, use_threads=False)
        out = t["h"].to_numpy(), t["v"].to_numpy()
        if sum(len(h) for h, _ in self.held.values()) + len(out[0]) <= CACHE_ROWS:
            self.held[i] = out
        return out

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sorted hashes are stored, and their values."""
        seen, value = np.zeros(len(h), bool), np.zeros(len(h), np.float32)
        for i in range(len(self.files)):
            a, b = np.searchsorted(h, self.low[i]), np.searchsorted(h, self.high[i], side="right")
            if a < b:
                keys, values = self.arrays(i)
                at = np.minimum(np.searchsorted(keys, h[a:b]), len(keys) - 1)
                hit = keys[at] == h[a:b]
                seen[a:b] |= hit
                value[a:b][hit] = values[at[hit]]
        return seen, value

    def p(self, lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Probabilities of the last sign of each run; lang: the hashes of the languages. All orders' entries are looked up in one pass over the files."""
        steps = []
        for k in range(self.order, 0, -1):
            gram = gram & U((1 << BITS * k) - 1)
            h, one, back = distinct(hashed(lang, k, gram))
            lang, gram = lang[one], gram[one]
            ctx, _, of = distinct(hashed(lang, -k, gram >> U(BITS)))
            steps.append((h, back, ctx, of))
        value, _, at = distinct(np.concatenate([x for h, _, ctx, _ in steps for x in (h, ctx)]))
        seen, found = self.look(value)
        parts = np.split(at, np.cumsum([len(x) for h, _, ctx, _ in steps for x in (h, ctx)])[:-1])
        out = np.full(len(gram), 1.0 / (1 << BITS))
        for i in range(len(steps) - 1, -1, -1):
            _, back, _, of = steps[i]
            own, ctx = parts[2 * i], parts[2 * i + 1]
            left = np.where(seen[ctx], found[ctx], np.float32(1)).astype(float)
            out = (found[own].astype(float) + left[of] * out)[back]
        return out

    def logp(self, parts: Iterator[tuple[np.ndarray, np.ndarray]], known: Remembered) -> Iterator[np.ndarray]:
        """Natural log-probabilities of the last signs of the runs in each part (hashes of languages, runs)."""
        held, asked = list(parts), Asked(self, known)
        for lang, gram in held:
            asked.add(lang, gram)
        asked.find()
        for lang, gram in held:
            yield asked.logp(lang, gram)
        asked.remember()


class Asked:
    """The different runs of some texts that a worker does not remember, looked up together: the texts are met twice, their places are not kept."""

    def __init__(self, model: Model, known: Remembered):
        self.model, self.known = model, known
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = self.merged = 0

    def hashes(self, lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
        return hashed(lang, 0, gram & U((1 << BITS * self.model.order) - 1))

    def add(self, lang: np.ndarray, gram: np.ndarray) -> None:
        h = self.hashes(lang, gram)
        new, _ = self.known.find(h)
        value, one, _ = distinct(h[new])
        self.parts.append((value, lang[new[one]], gram[new[one]]))
        self.n += len(value)
        if self.n > 2 * self.merged + LOOK_RUNS // 2:
            self.merge()

    def merge(self) -> None:
        h, lang, gram = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        value, one, _ = distinct(h)
        self.parts, self.n = [(value, lang[one], gram[one])], len(value)
        self.merged = self.n

    def find(self) -> None:
        if self.parts:
            self.merge()
            self.value, lang, gram = self.parts[0]
            self.found = np.log(self.model.p(lang, gram))

    def logp(self, lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
        h = self.hashes(lang, gram)
        new, out = self.known.find(h)
        out[new] = self.found[np.searchsorted(self.value, h[new])]
        return out

    def remember(self) -> None:
        if self.parts:
            self.known.put(self.value, self.found)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values in order, a place of each, and the number of each place's value."""
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    one = order[new]
    return h[one], one, back


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def statistics(batch: pa.RecordBatch, h: K.Hash) -> dict[str, np.ndarray]:
    data, off = K.buffer(K.column(batch, "text"))
    space = K.is_space(data)
    starts, ends, first = K.runs(~space, off)
    value, at = K.windows(h, h.words(data, starts, ends), first, 8)
    doc = np.searchsorted(first, at, side="right") - 1
    order = np.argsort(value, kind="stable")  # windows of one text stay together
    same = (value[order][1:] == value[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(value), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    raw, o = data.tobytes(), off.tolist()
    return {
        "n_words": np.diff(first),
        "word_chars": K.per_doc(~space & ~K.in_class(data, (128, 191)), off),
        "n_symbols": K.per_doc(K.in_class(data, *((c, c) for c in b"#*$%&|<>")), off),
        "n_dup_lines": np.array([dup_lines(raw[a:b]) for a, b in zip(o[:-1], o[1:], strict=True)], np.int64),
        "n_repeat_words": K.per_doc(K.covered(len(starts), at[twice], 8), first),
    }


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def coded(lang: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of the language and the run of each code point, and each text's first."""
    g, first = grams(*K.buffer(text))
    names, code = languages(lang)
    return np.array([lang_hash(x) for x in names], U)[np.repeat(code, np.diff(first))], g, first


def means(logp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean negative log-probability of the signs of each text (0 without any); a text's value does not depend on its neighbours."""
    n = np.diff(first)
    nll, some = np.zeros(len(n)), n > 0
    if some.any():
        nll[some] = -np.add.reduceat(logp, first[:-1][some]) / n[some]
    return nll


def measured(docs: DataFrame, model: Model, added: dict[str, str]) -> DataFrame:
    """The rows of docs (columns text and lang among them) with bytes, the statistics and nll, under the names in `added`."""
    names = docs.columns
    kinds = {c: T.DoubleType() if c == "nll" else T.LongType() for c in ("bytes", *STATS, "nll")}
    schema = T.StructType([*docs.schema.fields, *(T.StructField(added[c], t) for c, t in kinds.items())])
    text, lang = added["text"], added["lang"]

    def answered(held: list[pa.RecordBatch], asked: Asked, h: K.Hash) -> Iterator[pa.RecordBatch]:
        asked.find()
        for b in held:
            of, g, first = coded(K.column(b, lang), K.column(b, text))
            nll = means(asked.logp(of, g), first)
            own = pa.RecordBatch.from_arrays([K.column(b, text)], ["text"])
            values = [pa.array(x.astype(np.int64)) for x in (np.diff(K.buffer(K.column(b, text))[1]), *statistics(own, h).values())]
            yield pa.RecordBatch.from_arrays([*(K.column(b, c) for c in names), *values, pa.array(nll)], [*names, *(added[c] for c in kinds)])
        asked.remember()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, known = K.Hash(K.fresh_key()), Remembered()
        held, size, asked = [], 0, Asked(model, known)
        for b in K.chunks(batches, STEP_BYTES, text):
            n = len(K.buffer(K.column(b, text))[0])
            if held and (size + n > LOOK_BYTES or asked.n > LOOK_RUNS):
                yield from answered(held, asked, h)
                held, size, asked = [], 0, Asked(model, known)
            asked.add(*coded(K.column(b, lang), K.column(b, text))[:2])
            held.append(b)
            size += n
        yield from answered(held, asked, h)
        del held, known, asked
        model.held.clear()
        K.give_back()

    return docs.mapInArrow(run, schema)


def model_of(docs: DataFrame, raw: bool = False) -> Model:
    """The model of the documents; raw: the highest order counts places, as the published method does, else different signs before a run."""
    bound_arrow(docs.sparkSession)
    rows = docs.select(language(F.col("lang")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    if raw:
        counts = cut(gram_counts(rows).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "kn-runs")
        return Model.store(estimates(cut(raw_levels(counts), "kn-levels")))
    runs = cut(gram_rows(rows).distinct(), "kn-runs")
    return Model.store(estimates(cut(levels(runs), "kn-levels")))


def language(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(UNKNOWN))


def bands(rows: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """lang, size, low, high: from a histogram of the classes' mean log-perplexities.

    A class of fewer than CLASS_ROWS texts takes its language's band over all lengths, a language of fewer the band over all texts."""
    histogram = rows.filter("n_words >= 20").groupBy("lang", "size", F.floor(F.col("nll") / STEP).alias("bin")).count()
    of = lambda level, lang, size: F.struct(F.lit(level).alias("level"), lang.alias("lang"), size.cast("long").alias("size"))
    levels = F.array(of(0, F.col("lang"), F.col("size")), of(1, F.col("lang"), F.lit(-1)), of(2, F.lit(""), F.lit(-1)))
    histogram = histogram.select(F.explode(levels).alias("of"), "bin", "count").groupBy("of.level", "of.lang", "of.size", "bin").agg(F.sum("count").alias("count"))
    by = Window.partitionBy("level", "lang", "size")
    upto = F.sum("count").over(by.orderBy("bin")).alias("upto")
    cum = histogram.select("*", upto, F.sum("count").over(by).alias("of"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("of"), (F.col("bin") + 0.5) * STEP))
    q = cum.groupBy("level", "lang", "size").agg(F.max("of").alias("of"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    deviation = F.greatest((F.col("q3") - F.col("q1")) / 1.349, F.lit(LEAST))
    band = F.struct((F.col("q2") - lower * deviation).alias("low"), (F.col("q2") + upper * deviation).alias("high"))
    every = cut(q.select("level", "lang", "size", "of", band.alias("band")), "band-levels")
    own, whole, texts = (every.filter(F.col("level") == k) for k in range(3))
    whole = whole.select("lang", F.col("of").alias("of_lang"), F.col("band").alias("of_whole"))
    rows = own.join(whole, "lang").crossJoin(F.broadcast(texts.select(F.col("band").alias("of_texts"))))
    taken = F.when(F.col("of") >= CLASS_ROWS, F.col("band")).when(F.col("of_lang") >= CLASS_ROWS, F.col("of_whole")).otherwise(F.col("of_texts"))
    return rows.select("lang", "size", taken.alias("b")).select("lang", "size", "b.low", "b.high")


def decided(rows: DataFrame, added: dict[str, str], lower: float, upper: float) -> DataFrame:
    """The measured, written rows with base_failed and kept, under the names in `added`."""
    of = {c: F.col(added[c]) for c in ("lang", "bytes", "nll", "n_words", "n_repeat_words")}
    size = F.floor(F.log2(F.greatest(of["bytes"], F.lit(1))))
    table = cut(bands(rows.select(of["lang"].alias("lang"), size.alias("size"), of["nll"].alias("nll"), of["n_words"].alias("n_words")), lower, upper), "bands")
    failed = (of["n_words"] < 20) | (100 * of["n_repeat_words"] > 30 * of["n_words"])
    # a row for each language and length class: broadcast behind a check, else each some times, for the rows of a class are many
    keys = [added["lang"], added["size"]]
    rows, table = rows.withColumn(added["size"], size), table.select(F.col("lang").alias(keys[0]), F.col("size").alias(keys[1]), F.struct("low", "high").alias(added["band"]))
    if table.count() <= BAND_ROWS:
        judged = rows.join(F.broadcast(table), keys, "left")
    else:
        salt = added["salt"]
        salted = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        judged = rows.withColumn(salt, F.pmod(F.xxhash64(added["nll"], added["doc_id"]), F.lit(SALTS)).cast("int")).join(salted, [*keys, salt], "left")
    band = F.col(added["band"])
    within = F.coalesce((of["nll"] >= band["low"]) & (of["nll"] <= band["high"]), F.lit(True))
    return judged.withColumns({added["base_failed"]: failed, added["kept"]: ~failed & within})


NAMES = ["text", "lang", "bytes", *STATS, "nll", "size", "band", "salt", "base_failed", "kept"]


def decisions(docs: DataFrame, lower: float = LOWER, upper: float = UPPER, raw: bool = False) -> DataFrame:
    """doc_id, lang, the statistics, nll, perplexity, base_failed and kept of every document."""
    model = model_of(docs, raw)
    added = {c: c for c in [*NAMES, "doc_id"]}
    ready = docs.select("doc_id", language(F.col("lang")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows = cut(measured(ready, model, added).drop("text"), "quality")
    return decided(rows, added, lower, upper).select("doc_id", "lang", *STATS, F.exp("nll").alias("perplexity"), "nll", "base_failed", "kept")


def report(docs: DataFrame) -> DataFrame:
    """What op5 returns."""
    return decisions(docs, raw=True).select("doc_id", *STATS, "base_failed", "kept", F.round("perplexity", 6).alias("perplexity"))


def keep(docs: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """The documents that the rules keep, with all their columns: verdicts are carried with the rows, not joined to them."""
    model = model_of(docs)
    names = docs.columns
    added = {c: free_name(docs, f"q_{c}") for c in NAMES} | {"doc_id": "doc_id"}
    ready = docs.withColumns({added["text"]: F.coalesce("text", F.lit("")), added["lang"]: language(F.col("lang"))})
    rows = cut(measured(ready, model, added).drop(added["text"]), "quality")
    return decided(rows, added, lower, upper).filter(F.col(added["kept"])).select(*names)
