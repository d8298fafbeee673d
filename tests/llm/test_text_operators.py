import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from gridstone.llm import bpe, decontam, licenses, quality, simhash, substring, tokens_orc, toxicity
from tests.llm.conftest import grouped

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_licenses(docs, rows, none):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def brute(i, t):
        w = word.findall(lower(t))
        hits = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in hits]
        return i, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))

    got = licenses.report(docs)
    assert bag(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == Counter(brute(r[0], r[1]) for r in rows)
    for r in got.collect():
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(","))
    assert licenses.report(none).count() == 0


def example(pattern):
    """A line that the pattern fits: the first choice of each group, all options taken."""
    x = re.sub(r"\[a-z0-9 \]\{\d+,\d+\}", "some name", pattern)
    while "(?:" in x:
        x = re.sub(r"\(\?:([^()]*)\)\??", lambda m: m[1].split("|")[0], x)
    return re.sub(r"\[(.)[^]]*\]", r"\1", x).replace("?", "")


def plain_detections(line):
    """Without keywords, each detection held against all that go before it."""
    found = [(r, m.start(), m.start() + len(example(r.pattern.pattern[4:-2])) + 1 if r.words else m.end()) for r in licenses.RULES for m in r.pattern.finditer(line)]
    order = sorted(range(len(found)), key=lambda i: (found[i][0].section, found[i][1] - found[i][2], found[i][1], found[i][0].label, i))
    kept = []
    for i in order:
        if not any(a <= found[i][1] and found[i][2] <= b for _, a, b in kept):
            kept.append(found[i])
    return [(r.label, a, b) for r, a, b in kept]


def test_every_signature_finds_its_sentence():
    assert len(licenses.RULES) > 300
    for r in licenses.RULES[3:]:
        text = example(r.pattern.pattern[1:-5])
        line = f" so {text} then "
        held = {k for k in licenses.KEYWORDS if k in line}
        assert r.keywords and held.issuperset(r.keywords), r
        assert r.pattern.search(line), (r, line)
        assert any(a <= 3 and b >= 3 + len(text) for _, a, b in licenses.detect(line, held)), (r, line)


def test_labels_equal_a_plain_search():
    import random

    rng = random.Random(2)
    texts = [example(r.pattern.pattern[1:-5]) for r in licenses.RULES[3:]] + list(licenses.BASE) + ["some words", "version 3", "or later"]
    for _ in range(150):
        line = " " + " ".join(rng.choice(texts) for _ in range(rng.randint(1, 12))) + " "
        held = {k for k in licenses.KEYWORDS if k in line}
        assert [(r.label, a, b) for r, a, b in licenses.detect(line, held)] == plain_detections(line)


def test_contained_detections_are_suppressed():
    line = " released under the gnu lesser general public license version 2 1 "
    held = {k for k in licenses.KEYWORDS if k in line}
    assert [r.label for r, _, _ in licenses.detect(line, held)] == ["lgpl-2.1"]


def test_a_long_text_of_notices():
    import time

    def took(n):
        line = " " + "under the mit license all rights reserved licensed under the gnu gpl version 2 " * n
        began = time.perf_counter()
        got = licenses.scan_text(line, {k for k in licenses.KEYWORDS if k in line})
        assert got["n_base"] == n and got["last_word"] == 14 * (n - 1)
        return time.perf_counter() - began

    took(100)
    assert took(16_000) < 8 * took(4_000)


def thue_morse(n, a, b):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


@pytest.fixture(scope="module")
def colliding(spark):
    """Words that share a polynomial hash modulo any power of two."""
    rows = [(2 * k + s, " ".join(f"w{i}" for i in range(49)) + " " + thue_morse(n, *("ab", "ba")[s])) for k, n in enumerate((512, 1024, 4096)) for s in (0, 1)]
    return rows, spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").coalesce(1)


def test_words_with_one_hash_stay_apart(colliding, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    rows, docs = colliding
    ids = {i: t.encode(x, add_special_tokens=False).ids for i, x in rows}
    got = {r["doc_id"]: r for r in bpe.digests(docs, tokenizer).collect()}
    assert {i: r["n_tokens"] for i, r in got.items()} == {i: len(x) for i, x in ids.items()}
    assert {i: r["ids_sha256"] for i, r in got.items()} == {i: hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for i, x in ids.items()}
    crc = {r["doc_id"]: r["ids_crc32"] for r in tokens_orc.report(docs, tokenizer).collect()}
    assert crc == {i: zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for i, x in ids.items()}
    assert {r["n_removed"] for r in substring.dedup(docs).collect()} == {0}
    assert {r["n_repeat_words"] for r in quality.report(docs).collect()} == {0}


def test_equal_hashes_of_pre_tokens_are_told_apart(tokenizer):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from gridstone.llm import kernel as K

    class One:
        """Gives every word one value."""

        def words(self, data, starts, ends):
            return np.ones(len(starts), np.uint64)

    t = Tokenizer.from_file(tokenizer)
    merges, _ = bpe.ready(tokenizer)
    encoder = bpe.Encoder(list(merges.specials), merges.encode)
    encoder.memo = bpe.Memo(merges.encode, hash_=One())
    texts = ["abcdefghij abcdefghik", "one two three", "", "x" * 9000 + " " + "x" * 8999 + "y"]
    for _ in range(2):
        ids, at = encoder(*K.buffer(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_bpe_equals_the_library(docs, rows, none, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)

    def brute(i, text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    got = bpe.digests(docs, tokenizer)
    assert bag(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == Counter(brute(r[0], r[1]) for r in rows)
    assert bpe.digests(none, tokenizer).count() == 0
    whole = bpe.with_ids(docs, tokenizer)
    # the input's own column of that name stays
    assert whole.columns == [*(c for c in docs.columns if c != "text"), "text", "_ids", "n_tokens"]
    assert {(r["doc_id"], tuple(r["_ids"]), r["n_tokens"]) for r in whole.filter("doc_id is not null").select("doc_id", "_ids", "n_tokens").collect()} == {(r[0], tuple(x := t.encode(r[1] or "", add_special_tokens=False).ids), len(x)) for r in rows if r[0] is not None}


def test_bpe_over_odd_strings(tokenizer):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from gridstone.llm import kernel as K

    rng, t = random.Random(1), Tokenizer.from_file(tokenizer)
    signs = "aAbstrveldm'  \n\t\r.,!?#1209éßñ×÷œжШ中文²½  \x1c\x85🙂"
    texts = ["", "it's we'll 'sx ''s !'s", "ab" * 700 + " " * 500, *("".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(2000))]
    _, encoder = bpe.ready(tokenizer)
    ids, at = encoder(*K.buffer(pa.array(texts)))
    for i, x in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_substring(docs, rows, none):
    words = [(r[0], WORDS.findall(r[1] or "")) for r in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 49):
            if i is not None:
                first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))

    def brute(i, w):
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        return i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()

    want = Counter(brute(i, w) for i, w in words)
    assert bag(substring.report(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert sum(x[2] > 0 for x in want) >= 4
    assert substring.report(none).count() == 0
    left = substring.cleaned(docs)
    assert left.columns == docs.columns
    assert left.count() == sum(n for x, n in want.items() if not (x[2] and x[1] == x[2]))


def test_statistics_and_base_rules(docs, rows, none):
    def brute(i, t):
        t = t or ""
        w = WORDS.findall(t)
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        count = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = [False] * len(w)
        for k in range(len(w) - 7):
            if count[tuple(w[k : k + 8])] > 1:
                again[k : k + 8] = [True] * 8
        return i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(again), len(w) < 20 or 100 * sum(again) > 30 * len(w)

    got = quality.report(docs)
    assert bag(got, "doc_id", *quality.STATS, "base_failed") == Counter(brute(r[0], r[1]) for r in rows)
    assert got.filter("base_failed and kept").count() == 0
    assert quality.report(none).count() == 0
    assert quality.keep(docs).columns == docs.columns


def brute_kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney by dictionaries, its highest order counted by the different signs before a run."""
    sign = lambda c: " " if c in " \t\n\r\x0b\x0c" else c.lower() if c.isascii() else c
    padded = [[" "] * order + [sign(c) for c in t] for t in texts]
    longer = {tuple(s[k : k + order + 1]) for s in padded for k in range(len(s) - order)}
    levels = {n: Counter(g[1:] for g in {x[-n - 1 :] for x in longer}) for n in range(1, order + 1)}

    def p(g):
        if not g:
            return 1 / 1024
        c = levels[len(g)]
        own = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        n = [sum(v == k for v in c.values()) for k in range(5)]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        d = [0.0, 0.5, 1.5, 1.5]
        for k in (1, 2, 3):
            if n[k] and y:
                d[k] = max(min(k - (k + 1) * y * n[k + 1] / n[k], k - 0.05), 0.05)
        total = sum(own.values())
        gamma = sum(d[min(v, 3)] for v in own.values()) / total
        return max(c[g] - d[min(c[g], 3)], 0) / total + gamma * p(g[1:])

    return lambda t: -sum(math.log(p(tuple(s[k : k + order]))) for s in [[" "] * (order - 1) + [sign(c) for c in t]] for k in range(len(s) - order + 1)) / max(len(t), 1)


def test_perplexity_and_verdict_equal_brute_force(spark):
    texts = ["the cat sat on the mat and the dog sat too", "a Rat ran\tat the cat", "zzz q1 ! the end", "été à la mer où l'œuf est", "the cat sat on the mat and the dog sat too", ""]
    texts += [" ".join(f"{a} {b}" for a in ("red", "blue", "old") for b in ("cat", "dog", "sea", "sun")) + f" {i} and so on {i * i}" for i in range(40)]
    rows = [(i, t, None if i % 5 == 1 else "en") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.decisions(docs).collect()}
    nll = {}
    for lang in ("en", None):
        value = brute_kneser_ney([t for _, t, x in rows if x == lang], quality.ORDER)
        nll |= {i: value(t) for i, t, x in rows if x == lang}
    for i, v in nll.items():
        assert got[i]["nll"] == pytest.approx(v, abs=1e-5), texts[i]
    # verdicts by the bands of the method, from the same values
    classed = {(r["lang"], r["size"]): (r["low"], r["high"]) for r in quality.bands(spark.createDataFrame([(x or "und", int(math.log2(max(len(t.encode()), 1))), len(t.split()), got[i]["nll"]) for i, t, x in rows], "lang string, size long, n_words long, nll double")).collect()}
    for i, t, x in rows:
        low, high = classed.get((x or "und", int(math.log2(max(len(t.encode()), 1)))), (0.0, 99.0))
        assert got[i]["kept"] == (not got[i]["base_failed"] and low <= got[i]["nll"] <= high)


def test_the_reports_highest_order_counts_places(spark):
    texts = ["the cat sat on the cat", "the cat sat on the cat", "a dog sat", "the dog and the cat"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = quality.raw_levels(quality.gram_counts(docs).groupBy("lang", "gram").agg(F.sum("n").alias("n"))).collect()
    padded = [" " * (quality.ORDER - 1) + t for t in texts]
    runs = Counter(s[k : k + quality.ORDER] for s in padded for k in range(len(s) - quality.ORDER + 1))
    assert sorted(r["n"] for r in got if r["k"] == quality.ORDER) == sorted(runs.values())
    shorter = Counter(g[1:] for g in runs)
    assert sorted(r["n"] for r in got if r["k"] == quality.ORDER - 1) == sorted(shorter.values())
    raw = {r["doc_id"]: r["perplexity"] for r in quality.report(docs).collect()}
    other = {r["doc_id"]: r["perplexity"] for r in quality.decisions(docs).collect()}
    assert raw[0] == raw[1] < other[0]


def test_values_do_not_depend_on_neighbours_or_shards(spark, monkeypatch):
    rows = [(i, f"text {i} of the {'cat dog sun sea'.split()[i % 4]} is about {i * 7}", "en") for i in range(60)]
    schema = "doc_id long, text string, lang string"
    want = {r["doc_id"]: r["nll"] for r in quality.decisions(spark.createDataFrame(rows, schema)).collect()}
    monkeypatch.setattr(quality, "SHARD_ROWS", 50)
    assert {r["doc_id"]: r["nll"] for r in quality.decisions(spark.createDataFrame(rows[::-1], schema).repartition(5)).collect()} == want


def test_a_worker_keeps_few_files(spark, monkeypatch):
    monkeypatch.setattr(quality, "SHARD_ROWS", 50)
    docs = spark.createDataFrame([(i, f"some words {i} here", "en") for i in range(30)], "doc_id long, text string, lang string")
    model = quality.model_of(docs)
    monkeypatch.setattr(quality, "CACHE_ROWS", 100)
    g, first = quality.grams(np.frombuffer(b"some other words", np.uint8), np.array([0, 16]))
    lang = np.full(len(g), quality.lang_hash("en"), np.uint64)
    p = model.p(lang, g)
    assert len(model.files) > 4 and len(model.held) <= 3 and np.all((p > 0) & (p < 1))
    seen = quality.Remembered(4)  # of few places: values are right whatever it forgets
    for _ in range(2):
        got = list(model.logp(iter([(lang[:5], g[:5]), (lang, g), (lang[:0], g[:0])]), seen))
        assert np.allclose(got[0], np.log(p[:5])) and np.allclose(got[1], np.log(p)) and len(got[2]) == 0


def test_keep_bears_its_own_names(spark):
    text = " ".join(f"word{i} and {i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "en", 3, "a"), (2, None, None, None, None)], "doc_id long, text string, lang string, q_nll int, __lang string")
    assert [tuple(r) for r in quality.keep(docs).collect()] == [(1, text, "en", 3, "a")]


def brute_fingerprint(t):
    w = WORDS.findall(lower(t))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash(docs, rows, none):
    fps = [brute_fingerprint(r[1]) for r in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    roots = grouped(len(rows), near)
    smallest = {}
    for r, row in zip(roots, rows, strict=True):
        if row[0] is not None:
            smallest[r] = min(row[0], smallest.get(r, row[0]))
    want = Counter((row[0], f"{fp:016x}", smallest.get(r)) for row, fp, r in zip(rows, fps, roots, strict=True))
    assert bag(simhash.report(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.report(none).count() == 0
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    # one row of each first document, but for the document with two texts
    several = Counter(i for i, _ in {(r[0], r[1]) for r in rows if r[0] in set(smallest.values())})
    assert Counter(r[0] for r in kept.select("doc_id").collect()) == several + Counter([None])


@pytest.mark.parametrize("hot", [20_000, 5])
def test_bit_sliced_links_by_hot_buckets(spark, hot):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fp = base[rng.integers(0, 20, 600)].copy()
    for i in range(600):
        for b in rng.integers(0, 64, rng.integers(0, 4)).tolist():
            fp[i] ^= np.uint64(1) << np.uint64(b)
    fp = np.unique(fp)
    near = np.argwhere(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3).tolist()
    rows = spark.createDataFrame([(int(x.view(np.int64)), i) for i, x in enumerate(fp)], "fp long, rep long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.all_links(rows, len(fp), hot)).collect()}
    assert [found.get(i, i) for i in range(len(fp))] == grouped(len(fp), near)


def test_orc_round_trip(docs, rows, none, tokenizer):
    from tokenizers import Tokenizer

    t, start, want = Tokenizer.from_file(tokenizer), 0, Counter()
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want[r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    assert bag(tokens_orc.report(docs, tokenizer), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert tokens_orc.report(none, tokenizer).count() == 0


def test_decontamination(spark, docs, rows, none):
    text = " ".join(f"token{i}" for i in range(30))
    swapped = " ".join("other" if i % 9 == 4 else f"token{i}" for i in range(30))
    extra = [(100, "before " + swapped + " after"), (101, text), (102, " ".join(f"token{i}" for i in range(9))), (103, None), (104, "so TOO, short!"), (None, text)]
    base = docs.select("doc_id", "text", "lang", "h").unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    bench = spark.createDataFrame([(1, text, "x"), (2, None, None), (3, "too short", None), (4, text, None), (None, text, None)], "item_id long, text string, h string")
    got = {r["doc_id"]: r["n_items"] for r in decontam.contaminated(base, bench).collect()}
    assert got == {100: 2, 101: 2, 104: 1}
    left = decontam.clean(base, bench)
    assert left.columns == base.columns and left.count() == base.count() - 4  # the row without doc_id has the text of an item
    assert {r["doc_id"] for r in decontam.overlaps(base, bench, seed_rows=0).collect()} == set(got)  # dealt, not broadcast
    assert decontam.contaminated(none, bench).count() == 0
    assert decontam.contaminated(base, bench.limit(0)).count() == 0


@pytest.mark.parametrize("shards_a_pass", [64, 3])
def test_decontamination_by_filters_in_shards(spark, monkeypatch, shards_a_pass):
    """A benchmark beyond the filter's bound: the same overlaps, and few spans but the seeds' own go into the join."""
    import random

    rng = random.Random(6)
    words = [f"word{i}" for i in range(4000)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, line(rng.randint(16, 60))) for i in range(60)]
    texts = [(i, line(300)) for i in range(80)]
    texts += [(100 + i, f"{line(50)} {items[i][1]} {line(50)}") for i in range(0, 60, 7)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {tuple(r) for r in decontam.overlaps(docs, bench).collect()}
    assert len(want) >= 9
    monkeypatch.setattr(decontam, "FILTER_MOST", 1 << 13)
    monkeypatch.setattr(decontam, "PASS_SHARDS", shards_a_pass)
    known, numbers = decontam.seeds(bench)
    keeps = decontam.filters(known)
    assert len(keeps) == 1 if shards_a_pass == 64 else len(keeps) > 3
    values = known.select("value").distinct()
    spans = [decontam.entries(docs, "doc_id", numbers, k).select("doc_id", "place", "value") for k in keeps]
    entering = [s.join(values, "value", how).count() for s in spans for how in ("left_anti", "left_semi")]
    every = decontam.entries(docs, "doc_id", numbers)
    assert sum(entering[1::2]) == every.join(values, "value", "left_semi").count() > 0  # each seed's span, once
    assert sum(entering[::2]) < 0.01 * every.count()  # of the others less than one in a hundred
    assert {tuple(r) for r in decontam.overlaps(docs, bench, seed_rows=0).collect()} == want
    assert decontam.overlaps(docs.limit(0), bench).count() == 0


def labelled(spark):
    rng = np.random.default_rng(3)
    plain = [f"word{chr(97 + i)}{chr(97 + i % 7)}" for i in range(26)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        w = rng.choice(plain, 40).tolist()
        if toxic:
            w[3], w[20] = "grumblefink", "snotwaffle" if i % 2 else "grumblefinks"
        rows.append((i, " ".join(w), "en"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, None), (1001, "", None), (None, "grumblefink", None), (1002, "grumblefink " * 3000, "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([*labels, (5, 1, 1), (None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")


def test_toxicity_finds_held_out_texts(spark, none):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in toxicity.report(docs, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(400))
    assert np.mean([got[i]["predicted"] == int(i % 5 == 0) for i in held]) > 0.97
    assert got[1000]["score"] == got[1001]["score"] < 0.5 and got[1002]["predicted"] == 1
    assert toxicity.report(none, labels).count() == 0
    assert {r["predicted"] for r in toxicity.report(docs, labels.limit(0)).collect()} == {0}


@pytest.mark.parametrize("block", [64, 16, 4])
def test_block_max_search_is_exact(block, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(60, rng.integers(1, 12), replace=False))
        w = rng.random(len(t))
        vectors.append((t, w / np.linalg.norm(w)))
    index = toxicity.Index(vectors, rng.integers(0, 2, 500), np.arange(500))
    dense = np.zeros((500, 60))
    for p, d in enumerate(index.ids):
        dense[p, vectors[d][0]] = vectors[d][1]
    for t, w in vectors[:100]:
        _, s = index.nearest(t, w, 15)
        want = np.sort(dense[:, t] @ w)[::-1][:15]
        assert np.allclose(s, want[want > 0], atol=1e-6)


@pytest.mark.parametrize("columns", [1024, 5, 0])
def test_many_texts_are_searched_at_once(columns, monkeypatch):
    for name, value in {"BLOCK": 8, "FIRST": 2, "COLUMNS": columns, "QUERIES": 7, "POSTINGS": 50}.items():
        monkeypatch.setattr(toxicity, name, value)
    rng = np.random.default_rng(4)
    vectors = []
    for i in range(400):
        common, rare = rng.choice(20, rng.integers(1, 8), replace=False), 20 + 50 * (i % 40) + rng.choice(6, 4, replace=False)
        t = np.sort(np.concatenate([common, rare]))
        w = np.where(t < 20, 0.2, 1.0) * rng.random(len(t))
        vectors.append((t, w / np.linalg.norm(w)))
    vectors += vectors[:60]  # ties
    index = toxicity.Index(vectors, rng.integers(0, 2, 460), np.arange(460))
    if columns == 1024:  # no list of more than one example in SHARE is read posting by posting
        assert np.diff(index.start).max() * toxicity.SHARE <= 460 < np.bincount(np.concatenate([t for t, _ in vectors])).max() * toxicity.SHARE
    dense = np.zeros((460, 2021))
    for p, d in enumerate(index.ids):
        dense[p, vectors[d][0]] = vectors[d][1].astype(np.float32)
    visited, add = [], toxicity.Index.add
    monkeypatch.setattr(toxicity.Index, "add", lambda self, score, q, visit: (visited.append(visit.mean()), add(self, score, q, visit)))
    nothing = (np.zeros(0, np.int64), np.zeros(0))
    asked = [*vectors[::3], nothing, (np.array([5000]), np.ones(1)), (np.arange(2000), np.full(2000, 2000**-0.5))]
    without = np.array([int(np.flatnonzero(index.ids == i)[0]) if i % 2 else -1 for i in range(0, 460, 3)] + [-1] * 3)
    first = np.cumsum([0, *(len(t) for t, _ in asked)])
    got = list(index.search(first, *(np.concatenate(x) for x in zip(*asked, strict=True)), 5, without))
    assert len(got) == len(asked) and sum(visited) < 0.7 * -(-len(asked) // 7)  # of the blocks
    for (t, w), gone, (docs, s) in zip(asked, without, got, strict=True):
        want = dense[:, t[t < 2021]] @ w[t < 2021]
        want[gone if gone >= 0 else []] = 0
        near = [i for i in np.lexsort((np.arange(460), -np.round(want, 9))) if want[i] > 0][:5]
        assert docs.tolist() == near and np.allclose(s, want[near], atol=1e-12)


def test_votes_hang_on_no_last_bit(monkeypatch):
    rng = np.random.default_rng(6)
    vectors = []
    for _ in range(300):
        t = np.sort(rng.choice(90, rng.integers(3, 40), replace=False))
        w = rng.random(len(t))
        vectors.append((t, w / np.linalg.norm(w)))

    def votes(labels, asked, queries):
        monkeypatch.setattr(toxicity, "QUERIES", queries)
        index = toxicity.Index(vectors, labels, np.arange(300))
        first, (t, w) = np.cumsum([0, *(len(t) for t, _ in asked)]), (np.concatenate(x) for x in zip(*asked, strict=True))
        return index.votes(first, t, w, np.full(len(asked), -1))[0], [(d.tolist(), s.tolist()) for d, s in index.search(first, t, w, 15, np.full(len(asked), -1))]

    assert set(votes(np.ones(300, int), vectors, 128)[0]) == {1.0}  # all neighbours are toxic
    labels = rng.integers(0, 2, 300)
    assert votes(labels, vectors, 128)[1] == votes(labels, vectors, 7)[1] == votes(labels, vectors, 1)[1]
    assert votes(labels, [*vectors, *vectors[::-1]], 11)[1] == [*(v := votes(labels, vectors, 300)[1]), *v[::-1]]


def test_votes_equal_brute_force_cosines(spark):
    docs, labels = labelled(spark)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    marks = {}
    for r in labels.filter("doc_id is not null and toxic is not null").collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 5:
            marks[r["doc_id"]] = max(r["toxic"], marks.get(r["doc_id"], 0))
    words = {i: Counter(re.findall(r"[0-9a-z]+", t.lower())) for i, t in texts.items()}
    n, df = len(texts), Counter(w for c in words.values() for w in c)
    known = sorted({w for i in marks for w in words[i]})
    rate = sum(marks.values()) / len(marks)
    held, toxic = Counter(w for i in marks for w in words[i]), Counter(w for i in marks if marks[i] for w in words[i])
    lift = {w: max(0.0, math.log2((toxic[w] + toxicity.SHRINK * rate) / (held[w] + toxicity.SHRINK) / rate)) for w in known}
    weight = {w: math.log((n + 1) / (df[w] + 1)) * (toxicity.FLOOR + lift[w]) for w in known}

    def unit(i):
        v = {w: (1 + math.log(k)) * weight[w] for w, k in words[i].items() if w in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}

    vectors = {i: unit(i) for i in marks}
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    for i in [*range(0, 400, 9), 1002]:
        v = unit(i)
        s = {j: sum(x * u.get(w, 0.0) for w, x in v.items()) for j, u in vectors.items()}
        near = sorted((x for x in s.values() if x > 0), reverse=True)[: toxicity.NEIGHBOURS]
        evidence = got[i]["evidence"]
        assert len(evidence) == len(near) and np.allclose([s[j] for j in evidence], near, atol=1e-5)
        w = [1 / (1.05 - min(s[j], 1.0)) for j in evidence]
        assert got[i]["vote"] == pytest.approx(sum(a * marks[j] for a, j in zip(w, evidence, strict=True)) / sum(w), abs=1e-4)
