"""The stages against versions of their own: no operator of the repository judges what they keep, but the perplexity verdict of `quality`, which has its own brute force."""

import random
import re
from math import ceil

import pytest

import corpus_pipeline
from gridstone.llm import decontam, quality
from gridstone.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone int, rank int, copied int, ids string, class_id int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, n=5):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def substring(rows):
    """(doc_id, text, whether cut) of the rows that keep a word: every word of a 50-word window that a smaller document has goes."""
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    windows = [[tuple(w[k : k + 50]) for k in range(len(w) - 49)] for w in words]
    for (i, _), ws in zip(rows, windows, strict=True):
        for x in ws:
            if i is not None:
                first[x] = min(first.get(x, i), i)
    out = []
    for (i, t), w, ws in zip(rows, words, windows, strict=True):
        gone = {k + j for k, x in enumerate(ws) if i is not None and first[x] < i for j in range(50)}
        if not gone:
            out.append((i, t, False))
        elif len(gone) < len(w):
            out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), True))
    return out


def contaminated(t, items):
    """Whether some 16 words in a row (a shorter item: all of it) agree with an item in 13 of 16 places (0.8 of a shorter one)."""
    tokens = decontam_words(t)
    for item in items:
        n = min(16, len(item))
        for s in range(len(item) - n + 1):
            part = item[s : s + n]
            for k in range(len(tokens) - n + 1):
                if sum(a == b for a, b in zip(part, tokens[k : k + n], strict=True)) >= ceil(decontam.MATCH * n):
                    return True
    return False


def decontam_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def planted():
    """Documents for each stage, with nulls, empty and long texts, repeated rows, and columns whose names operators use."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = {i: line(rng.randint(60, 160)) for i in range(1, 120)}
    texts |= {200: texts[3], 201: texts[3], 202: " ".join(["other", *texts[4].split()[1:]])}  # copies and a near copy
    texts |= {210: line(40) + " " + " ".join(texts[8].split()[:58]) + " " + line(30), 211: line(3000)}
    texts |= {220: None, 221: "", 222: "  \n\t ", 223: "too few words", 224: "one two three four five six seven eight " * 30}
    rows = [(i, t, "en" if i % 4 else None, None, len(t) if t else None, 1, 2, 3, "z", 4) for i, t in texts.items()]
    return rows + [rows[5], rows[5], (None, texts[9], "en", None, None, 1, 2, 3, "z", 4), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(planted(), SCHEMA).repartition(4).cache()


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "decontamination", "bpe_encoding"]


def test_quality_rules(spark, odd):
    got = corpus_pipeline.quality_rules(spark, odd, SF)
    assert got.columns == odd.columns
    failed = set()
    for r in planted():
        w = WORD.findall(r[1] or "")
        runs = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        again = {k + j for k, x in enumerate(runs) if runs.count(x) > 1 for j in range(8)} if len(w) < 1000 else set()
        if len(w) < 20 or 100 * len(again) > 30 * len(w):
            failed.add(r[0])
    kept = [r["doc_id"] for r in got.collect()]
    assert {220, 221, 222, 223, 224} <= failed and not failed - {None} & set(kept)
    judged = {r["doc_id"]: r["kept"] for r in quality.decisions(odd).collect() if r["doc_id"] is not None}
    assert set(kept) - {None} == {i for i, k in judged.items() if k} and sum(i < 120 for i in kept if i is not None) > 100


def test_near_dedup(spark, odd):
    got = corpus_pipeline.near_dedup(spark, odd, SF)
    assert got.columns == odd.columns
    rows = {}
    for r in planted():
        rows.setdefault(r[0], r[1])
    ids = sorted(i for i in rows if i is not None)
    sets = {i: shingles(rows[i]) for i in ids}
    first = {}
    for i in ids:
        first[i] = next((j for j in ids if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])), i)
    kept = [r["doc_id"] for r in got.collect()]
    assert sorted(i for i in kept if i is not None) == [i for i in ids if first[i] == i] and kept.count(None) == 2
    assert {200, 201, 202, 221, 222} & set(kept) == set()


def test_substring_dedup(spark, odd):
    got = corpus_pipeline.substring_dedup(spark, odd, SF)
    assert got.columns == odd.columns
    want = substring([(r[0], r[1]) for r in planted()])
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(((i, t) for i, t, _ in want), key=str)
    cut = {i: len(t) for i, t, changed in want if changed}
    assert 210 in cut and 200 not in {i for i, _, _ in want} and {r["doc_id"]: r["n_chars"] for r in got.collect() if r["doc_id"] in cut} == cut


def test_decontamination(spark, odd):
    items = [decontam_words(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    long_item = max(table(spark, SF, "benchmark").collect(), key=lambda r: len(r["text"]))["text"].split()
    leak = odd.filter("doc_id = 1").withColumns({"doc_id": odd.doc_id + 900, "text": decontam.F.lit("so it is said " + " ".join("changed" if k % 8 == 3 else w for k, w in enumerate(long_item)) + " and more words")})
    docs = odd.unionByName(leak)
    got = corpus_pipeline.decontamination(spark, docs, SF)
    assert got.columns == odd.columns
    bad = {r["doc_id"] for r in docs.filter("doc_id < 215 or doc_id > 220").filter("length(text) < 5000").collect() if contaminated(r["text"], items)}
    kept = [r["doc_id"] for r in got.collect()]
    assert 901 in bad and not bad & set(kept) and {r["doc_id"] for r in docs.collect()} - bad == set(kept)


def test_whole_runs_and_empty_tables(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    for name, docs in (("odd", odd), ("none", odd.filter("false")), ("nulls", odd.filter("text is null"))):
        where = tmp_path / name
        docs.write.parquet(str(where / "documents.parquet"))
        table(spark, SF, "benchmark").write.parquet(str(where / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(where))
        rows = out.collect()
        assert len(rows) == 0 if name != "odd" else len(rows) > 100
        for r in rows:
            assert list(r["_ids"]) == t.encode(r["text"], add_special_tokens=False).ids and r["n_tokens"] == len(r["_ids"])
    stages = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, stages, SF)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in stages.collect()) == sorted((r["doc_id"] or -1, r["text"]) for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect())
