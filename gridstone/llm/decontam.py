"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions alone.

A text and an item overlap where, on one diagonal, at least MATCH of the tokens of a
window of the item (WINDOW consecutive tokens; all tokens of a shorter item) are
equal. A mask names the token positions of a span that count; the others may
differ. Masks are chosen by the item's length so that every pattern of equal tokens
that counts as an overlap holds a whole mask: two masks of five tokens do for items
of 15 tokens or more. So the overlaps found are all overlaps, whatever the masks.

Each token is hashed once; the value of a masked span joins the hashes of its tokens
by rotation and exclusive or. The values of the benchmark's spans are the seeds. Of a
document's spans those that may be seeds go on with the tokens around them: a Bloom filter
tells, as a literal up to FILTER_MOST bits, else in shards of so many bits that reach the
rows as the value of a scalar subquery, PASS_SHARDS of them in each pass over the texts
(eleven million spans a pass). They are joined with the seeds and verified
token by token. Up to SEED_ROWS seeds are broadcast; more are dealt on the value and
one of SALTS numbers, so that no value's spans are one task's. The documents' texts
are not shuffled.

Edge cases: a null or empty text, and an item of separators alone, has no tokens and
no overlap; repeated rows of one doc_id give one row; rows without a doc_id or
item_id are left out of the report, but `clean` judges rows without a doc_id by their texts;
extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.llm.common import cut

#: By the item's greatest length: token positions that count.
MASKS = {
    1: [(0,)],
    2: [(0, 1)],
    3: [(0, 1, 2)],
    4: [(0, 1, 2, 3)],
    6: [(0, 1, 2), (0, 1, 3)],
    7: [(0, 1, 3, 4)],
    9: [(0, 1, 2, 4, 5), (0, 1, 2, 3, 4)],
    11: [(0, 1, 2, 4, 5), (0, 1, 3, 6, 7), (0, 1, 2, 3, 4)],
    12: [(0, 1, 2, 4, 6, 7), (0, 1, 3, 7, 8, 9), (0, 1, 2, 3, 4, 5)],
    13: [(0, 1, 3, 6, 7)],
    14: [(0, 1, 2, 3, 5)],
    16: [(0, 1, 2, 4, 5), (0, 1, 2, 3, 4)],
}
WINDOW, MATCH = 16, 0.8
#: Bits of the filter a seed, probes, and the largest filter.
FILTER_BITS, FILTER_PROBES, FILTER_MOST = 48, 3, 1 << 23
#: Shards of a filter beyond FILTER_MOST that one pass over the texts takes: 64 MB.
PASS_SHARDS = 64
#: Seeds that are broadcast (about 500 bytes each), and numbers that more seeds are dealt by.
SEED_ROWS, SALTS = 100_000, 16
#: Contaminated documents whose ids are broadcast, at 16 bytes each.
IDS_ROWS = 1_000_000
#: What separates tokens, as a class for Java's and DuckDB's expressions.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: All masks by number, and the numbers of the masks for items of at most n tokens.
EVERY = list(dict.fromkeys(m for masks in MASKS.values() for m in masks))
LENGTHS = [(n, [EVERY.index(m) for m in masks]) for n, masks in MASKS.items()]
REACH = max(m[-1] for m in EVERY)
#: Places around a hit that verification sees: so many before it and after the span.
SPAN = 2 * WINDOW + REACH + 1


def masks_of(n: int) -> list[int]:
    """Numbers of the masks that an item of n tokens is looked for by."""
    return next(numbers for most, numbers in LENGTHS if min(n, WINDOW) <= most)


def tokens(text: Column) -> Column:
    """The parts between separators, without empty ones."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def value(number: int) -> Column:
    """The hash of the masked span that starts at the row's place; null if it ends beyond the text. The mask's number is part of it."""
    out = F.lit(number + 1).cast("long")
    for k, p in enumerate(EVERY[number]):
        t, turn = F.get("h", F.col("place") + p), 11 * k + 1
        out = out.bitwiseXOR(F.shiftleft(t, turn).bitwiseOR(F.shiftrightunsigned(t, 64 - turn)))
    return out


def entries(rows: DataFrame, key: str, numbers: list[int], keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """key, n_tokens, mask, value, place, lead, near (the tokens from `lead` before the place on) of each span of the masks `numbers` that `keep` keeps.

    Places and values are exploded, so that hashing and filtering stay in generated code, each small enough to be compiled."""
    words = rows.filter(F.col(key).isNotNull()).select(key, tokens(F.col("text")).alias("w"))
    hashed = words.select(key, "w", F.transform("w", lambda t: F.xxhash64(t)).alias("h"))
    at = hashed.select(key, "w", "h", F.posexplode("h").alias("place", "t"))
    at = at.select(key, "w", "place", F.posexplode(F.array(*map(value, numbers))).alias("mask", "value")).filter("value is not null")
    if keep is not None:
        at = at.filter(keep(F.col("value")))
    lead = F.least("place", F.lit(WINDOW))
    near = F.slice("w", F.col("place") - lead + 1, lead + REACH + WINDOW + 1)
    return at.select(key, F.size("w").alias("n_tokens"), "mask", "value", "place", lead.alias("lead"), near.alias("near"))


def seeds(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """item_id and the entries of the benchmark, and the numbers of the masks used."""
    size = F.size(tokens(F.col("text")))
    items = benchmark.filter(F.col("item_id").isNotNull() & (size > 0))
    sizes = items.select(F.least(size, F.lit(WINDOW)).alias("n")).distinct().collect()  # at most WINDOW
    by_length = {r["n"]: masks_of(r["n"]) for r in sizes}
    numbers = sorted({k for of in by_length.values() for k in of})
    if not numbers:
        numbers = masks_of(WINDOW)
    rows = entries(items, "item_id", numbers).withColumn("mask", F.get(F.array(*map(F.lit, numbers)), F.col("mask")))
    own = F.lit(False)
    for n, of in by_length.items():
        own = own | ((F.least("n_tokens", F.lit(WINDOW)) == n) & F.col("mask").isin(of))
    return cut(rows.filter(own), "seeds"), numbers


def probes(value: Column, bits: int) -> list[Column]:
    """Places in a filter of a power of two bits."""
    return [F.shiftright(value, 20 * k).bitwiseAND(F.lit(bits - 1)) for k in range(FILTER_PROBES)]


def bit(p: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))


Test = Callable[[Column], Column]


def filters(known: DataFrame) -> list[Test]:
    """Tests of whether a value may be a seed's, one for each pass over the texts; each seed's value passes just one."""
    values = known.select("value").distinct()
    n = values.count()
    bits = 1 << max(10, (max(1, n) * FILTER_BITS - 1).bit_length())
    if bits <= FILTER_MOST:
        p = values.select(F.explode(F.array(*probes(F.col("value"), bits))).alias("p"))
        rows = p.groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(bit(F.col("p"))).alias("w")).collect()  # at most FILTER_MOST / 64
        words = ["0"] * (bits // 64)
        for r in rows:
            words[r["i"]] = str(r["w"])
        table = F.split(F.lit(",".join(words)), ",").cast("array<bigint>")
        return [lambda value: probed(table, value, bits)]
    shards = -(-n * FILTER_BITS // FILTER_MOST)
    laid = cut(sharded(values, shards), "sieve")

    def one(low: int) -> Test:
        some = laid.filter(F.col("shard").between(low, low + PASS_SHARDS - 1))
        words = some.agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "words"))), lambda x: x["words"]).alias("words")).scalar()
        return lambda value: shard_of(value, shards).between(low, low + PASS_SHARDS - 1) & F.coalesce(probed(F.get(words, shard_of(value, shards) - low), value, FILTER_MOST), F.lit(False))

    return [one(low) for low in range(0, shards, PASS_SHARDS)]


def probed(words: Column, value: Column, bits: int) -> Column:
    return reduce(lambda a, b: a & b, (F.get(words, F.shiftright(p, 6).cast("int")).bitwiseAND(bit(p)) != 0 for p in probes(value, bits)))


def shard_of(value: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(shards)).cast("int")


def sharded(values: DataFrame, shards: int) -> DataFrame:
    """shard, words: one filter of FILTER_MOST bits a shard. A zero for each word goes with the bits, so that no word is missing and the words need only be sorted."""
    size = FILTER_MOST // 64
    none = values.sparkSession.range(shards * size).select(F.floor(F.col("id") / size).cast("int").alias("shard"), (F.col("id") % size).cast("long").alias("i"), F.lit(0).cast("long").alias("w"))
    p = values.select(shard_of(F.col("value"), shards).alias("shard"), F.explode(F.array(*probes(F.col("value"), FILTER_MOST))).alias("p"))
    words = none.unionByName(p.select("shard", F.shiftright("p", 6).cast("long").alias("i"), bit(F.col("p")).alias("w"))).groupBy("shard", "i").agg(F.bit_or("w").alias("w"))
    return words.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("words"))


def verified(hits: DataFrame) -> DataFrame:
    """The hits with first, last (places in the text of the first and last token of windows that overlap) and most (equal tokens in the best one)."""
    one = F.lit(1).cast("long")
    # a bit for each place along the hit's diagonal where the tokens are equal
    equal = lambda i: F.get("near", F.col("lead") + i - WINDOW) == F.get("seed_near", F.col("seed_lead") + i - WINDOW)
    same = F.aggregate(F.sequence(F.lit(0), F.lit(SPAN - 1)), F.lit(0).cast("long"), lambda a, i: F.when(equal(i), a.bitwiseOR(F.call_function("shiftleft", one, i))).otherwise(a))
    # exploded, so that it is computed once a hit and not once a window
    rows = hits.select("*", F.explode(F.array(same)).alias("same")).withColumn("width", F.least(F.lit(WINDOW), F.col("item_tokens")))
    # windows that lie within the item, each by its place in the bits
    low = F.greatest(F.lit(WINDOW) - F.col("seed_place"), F.lit(0))
    high = F.least(F.lit(SPAN) - F.col("width"), F.col("item_tokens") - F.col("width") - F.col("seed_place") + WINDOW)
    ones = F.call_function("shiftleft", one, F.col("width")) - 1
    count = lambda k: F.bit_count(F.call_function("shiftright", F.col("same"), k).bitwiseAND(ones))
    rows = rows.withColumn("windows", F.transform(F.sequence(low, high), lambda k: F.struct(k.alias("k"), count(k).alias("n"))))
    rows = rows.withColumn("windows", F.filter("windows", lambda x: x["n"] >= F.ceil(F.col("width") * MATCH))).filter(F.size("windows") > 0)
    at = lambda k: F.col("place") - WINDOW + k
    return rows.select(
        "doc_id",
        "item_id",
        F.greatest(at(F.get("windows", F.lit(0))["k"]), F.lit(0)).alias("first"),
        F.least(at(F.element_at("windows", -1)["k"]) + F.col("width") - 1, F.col("n_tokens") - 1).alias("last"),
        F.array_max(F.transform("windows", lambda x: x["n"])).alias("most"),
    )


def overlaps(docs: DataFrame, benchmark: DataFrame, seed_rows: int = SEED_ROWS) -> DataFrame:
    """doc_id, item_id, first_word, last_word (places of the first and last token of windows that overlap), most (equal tokens in the best one)."""
    known, numbers = seeds(benchmark)
    found = reduce(DataFrame.unionByName, (entries(docs, "doc_id", numbers, keep) for keep in filters(known))).drop("mask")
    seed = known.select("value", "item_id", F.col("n_tokens").alias("item_tokens"), F.col("place").alias("seed_place"), F.col("lead").alias("seed_lead"), F.col("near").alias("seed_near"))
    if known.count() <= seed_rows:
        hits = found.join(F.broadcast(seed), "value")
    else:
        salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "place"), F.lit(SALTS)).cast("int"))
        hits = salted.join(seed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["value", "salt"])
    out = verified(hits).groupBy("doc_id", "item_id").agg(F.min("first").alias("first_word"), F.max("last").alias("last_word"), F.max("most").alias("most"))
    return out.select("doc_id", "item_id", *(F.col(c).cast("long").alias(c) for c in ("first_word", "last_word", "most")))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a contaminated document: doc_id, n_items, first_word, last_word, most."""
    return overlaps(docs, benchmark).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.max("most").alias("most"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without an overlap, with all their columns; rows without a doc_id are judged by their texts."""
    bad = cut(overlaps(docs, benchmark).select("doc_id").distinct(), "contaminated")
    few = bad.count() <= IDS_ROWS
    kept = docs.filter("doc_id is not null").join(F.broadcast(bad) if few else bad, "doc_id", "left_anti").select(*docs.columns)
    bare = docs.filter("doc_id is null")
    if bare.isEmpty():
        return kept
    texts = bare.select(F.col("text").alias("doc_id"), "text").distinct()
    found = overlaps(texts, benchmark).select(F.col("doc_id").alias("text")).distinct()
    return kept.unionByName(bare.join(found, "text", "left_anti").select(*docs.columns))


#: Every diagonal with three equal tokens in a row is looked at (two for items of fewer than 12 tokens, one below 6); no mask is used.
SQL = rf"""
    WITH d AS (
        SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{SEPARATORS}'), lambda t: t <> '') AS w FROM documents
    ), b AS (
        SELECT item_id, w, len(w) AS n, least({WINDOW}, len(w)) AS width, CASE WHEN len(w) >= 14 THEN 3 WHEN len(w) >= 6 THEN 2 ELSE 1 END AS run
        FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{SEPARATORS}'), lambda t: t <> '') AS w FROM benchmark WHERE item_id IS NOT NULL)
        WHERE len(w) > 0
    ), bs AS (
        SELECT item_id, run, k, array_to_string(w[k : k + run - 1], ' ') AS g FROM (SELECT item_id, w, run, unnest(range(1, n - run + 2)) AS k FROM b)
    ), ds AS (
        SELECT doc_id, run, k, array_to_string(w[k : k + run - 1], ' ') AS g
        FROM (SELECT doc_id, w, run, unnest(range(1, len(w) - run + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT run FROM b) r WHERE len(w) >= run AND doc_id IS NOT NULL)
    ), diagonals AS (
        SELECT DISTINCT doc_id, item_id, ds.k - bs.k AS shift FROM ds JOIN bs USING (run, g)
    ), windows AS (
        SELECT doc_id, item_id, shift, d.w AS dw, b.w AS bw, b.width, unnest(range(1, b.n - b.width + 2)) AS s
        FROM diagonals JOIN d USING (doc_id) JOIN b USING (item_id)
    ), counted AS (
        SELECT doc_id, item_id, width, s + shift - 1 AS place, len(dw) AS n_doc,
               len(list_filter(range(s, s + width), lambda i: i + shift >= 1 AND dw[i + shift] = bw[i])) AS n
        FROM windows
    )
    SELECT doc_id, count(DISTINCT item_id) AS n_items, CAST(min(greatest(place, 0)) AS BIGINT) AS first_word,
           CAST(max(least(place + width, n_doc) - 1) AS BIGINT) AS last_word, CAST(max(n) AS BIGINT) AS most
    FROM counted WHERE n >= ceil(width * {MATCH}) GROUP BY doc_id
"""
