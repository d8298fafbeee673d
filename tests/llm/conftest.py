import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone int, ids string, row_key int, h string"


def documents():
    """Nulls in any column, empty and very long texts, ties, repeated rows; later columns clash with names that operators use."""
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "of", "Mañana", "zürich", "ab", "q", "idiot", "run", "Éclair", "x1", "don't", "中文", "###"])
    line = lambda n: " ".join(word() for _ in range(n))
    passage = " ".join(f"w{i}" for i in range(70))
    texts = {i: line(rng.randint(1, 120)) for i in range(40)}
    texts |= {41: line(30) + " " + passage + "\n" + line(10), 42: passage, 43: line(5) + "\t" + passage.replace(" ", "\n"), 44: texts[3], 45: texts[3], 46: texts[5].upper()}
    texts |= {50: None, 51: "", 52: "   \n\t ", 53: "a" * 30_000, 54: line(20_000), 55: "a b " * 200, 56: "x<|endoftext|>y's  \n", 57: "one\ntwo\none\n\n one", 58: "Licensed under the Apache License, Version 2.0 and under the MIT license; CC-BY-NC 4.0"}
    rows = [(i, t, "en" if i % 3 else None, None, len(t) if t else None, 1, "z", 2, "w") for i, t in sorted(texts.items())]
    return rows + [rows[7], rows[7], (None, texts[41], None, None, None, None, None, None, None), (7, "another text of one doc_id", "fr", "s", 1, 0, "", 0, "")]


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def grouped(n, pairs):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]
