"""Tests of what a reviewer found cut: each fails over the code before its change."""

from itertools import combinations
from math import ceil

import pytest

from gridstone.llm import decontam, quality
from gridstone.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def judged(spark):
    return [r.asDict() for r in quality.decisions(table(spark, SF, "documents")).filter("not base_failed").collect()]


def test_bands_reject_junk_and_keep_plain_texts(judged):
    junk = [r["kept"] for r in judged if r["n_symbols"] > r["n_words"]]
    plain = [r["kept"] for r in judged if not r["n_symbols"]]
    assert len(junk) > 20 and len(plain) > 500
    assert sum(junk) < 0.25 * len(junk)
    assert sum(plain) > 0.98 * len(plain)


def test_small_classes_take_a_wider_band(spark):
    of = lambda lang, size, n, at: [(lang, size, 50, at + 0.01 * (i % 11)) for i in range(n)]
    rows = of("en", 8, 40, 2.0) + of("en", 9, 40, 3.0) + of("en", 12, 3, 2.5) + of("xx", 8, 2, 9.0)
    rows = spark.createDataFrame(rows, "lang string, size long, n_words long, nll double")
    got = {(r["lang"], r["size"]): (r["low"], r["high"]) for r in quality.bands(rows).collect()}
    assert set(got) == {("en", 8), ("en", 9), ("en", 12), ("xx", 8)}
    assert got["en", 8][0] < 2 < got["en", 8][1] < got["en", 9][0] < 3
    # over all lengths of the language, and over all texts for a language of two
    assert got["en", 12][0] < 2 and got["en", 12][1] > 3
    assert got["xx", 8][0] < 2 and 3 < got["xx", 8][1] < 9


def test_every_text_that_passes_the_base_rules_has_a_band(spark):
    docs = table(spark, SF, "documents")
    text = " ".join("ab%%% cd%%%" for _ in range(1)) + " "
    junk = spark.createDataFrame([(-1, " ".join(f"{text}q{i}" for i in range(40)))], "doc_id long, text string").selectExpr("doc_id", "text", "'xx' AS lang")
    got = quality.decisions(docs.select("doc_id", "text", "lang").unionByName(junk)).filter("not base_failed")
    assert not got.filter("doc_id = -1").first()["kept"]


@pytest.mark.parametrize("n", range(1, decontam.WINDOW + 1))
def test_masks_cover_all_that_verification_accepts(n):
    masks = [decontam.EVERY[k] for k in decontam.masks_of(n)]
    for other in combinations(range(n), n - ceil(decontam.MATCH * n)):
        equal = set(range(n)) - set(other)
        assert any(all(s + p in equal for p in m) for m in masks for s in range(n - m[-1])), other


def test_accepted_overlaps_of_any_length_are_found(spark):
    texts = {n: [f"t{n}x{i}" for i in range(n)] for n in range(1, 17)}
    bench = [(n, " ".join(w)) for n, w in texts.items()] + [(50, "What is the capital of France?"), (51, "?!"), (52, ""), (53, "(Oslo)")]
    found = [(n, w, other) for n, w in texts.items() for other in ([], list(range(n))[4 % n :: 4][: n - ceil(0.8 * n)], list(range(n - ceil(0.8 * n))))]
    docs = [(k, "so " + " ".join("other" if i in other else x for i, x in enumerate(w)) + " and on") for k, (_, w, other) in enumerate(found)]
    missed = [(1000 + n, "so " + " ".join("other" if i <= n - ceil(0.8 * n) else x for i, x in enumerate(w)) + " and on") for n, w in texts.items()]
    docs += [*missed, (2000, "Asked: what is the capital of france Paris"), (2001, "in oslo today"), (2002, "? ! ...")]
    got = decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    want = {(k, n) for k, (n, _, _) in enumerate(found)} | {(2000, 50), (2001, 53)}
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
