"""A worker's table of pre-tokens: bounded whatever texts come, right when it is full, and the worker gives back what it has freed."""

import random

import numpy as np
import pyarrow as pa

from gridstone.llm import bpe
from gridstone.llm import kernel as K
from gridstone.llm.queries import TOKENIZER


def encoded(encoder, texts):
    ids, at = encoder(*K.buffer(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_a_full_table_keeps_what_was_met_again():
    from tokenizers import Tokenizer

    t, merges, asked = Tokenizer.from_file(TOKENIZER), bpe.Merges(TOKENIZER), []
    encoder = bpe.Encoder(list(merges.specials), lambda pieces: asked.append(pieces) or merges.encode(pieces))
    encoder.memo = bpe.Memo(encoder.memo.encode, bits=9)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 12)))
    often = [word() for _ in range(60)]
    for k in range(40):
        texts = [" ".join(rng.sample(often, 60)), " ".join(word() for _ in range(40)), "" if k % 7 else "é" * 300 + word()]
        if k == 20:
            texts.append(" ".join(word() for _ in range(1500)))  # more than the table has room for
        assert encoded(encoder, texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert len(encoder.memo.keys) == 512 and encoder.memo.n <= 256
    pieces = [p for some in asked for p in some]
    assert max(pieces.count(b" " + w.encode()) for w in often) <= 5  # each once, some again around the long text; not once for each time that the table was full


def test_all_texts_lie_within_the_default_table():
    merges = bpe.Merges(TOKENIZER)
    memo = bpe.Encoder(list(merges.specials), merges.encode).memo
    assert memo.keys.nbytes + memo.slots.nbytes <= 16 << 20


def test_chunks_give_back_at_the_end(monkeypatch):
    calls = []
    monkeypatch.setattr(K, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10] * 5, pa.string())], ["text"])
    sizes = [b.num_rows for b in K.chunks(iter([batch, batch]), 20)]
    assert sum(sizes) == 10 and np.max(sizes) == 2 and calls == [1]
