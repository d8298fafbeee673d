from gridstone.llm import chat, chat_tokens
from tests.llm.test_chat_and_urls import CHATS, conversations


def test_every_node_has_ids_positions_and_intervals(spark, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    enc = lambda x: t.encode(x, add_special_tokens=False).ids
    rows = conversations() + [(i, 0, "user", "a first turn of all", 1, "n") for i in range(300, 420)] + [(i, 1, "assistant", f"answer {i % 7}", 1, "n") for i in range(300, 420)]
    nodes, leaves = chat.tree(chat.ordered(chat.conversations_of(chat.with_added(spark.createDataFrame(rows, CHATS)))))
    texts = {r["node"]: r for r in nodes.collect()}
    got = {r["node"]: r for r in chat_tokens.tokenized(nodes, leaves, tokenizer).collect()}
    assert got.keys() == texts.keys()
    end = 0
    for r in sorted(got.values(), key=lambda r: texts[r["node"]]["start"]):
        text = texts[r["node"]]["text"]
        head, body = text[: text.index("]") + 1], text[text.index("]") + 1 : -len(chat.CLOSE)]
        assert list(r["ids"]) == enc(head) + enc(body) + enc(chat.CLOSE)
        assert r["first"] == end and r["last"] == end + len(r["ids"])  # depth-first, nothing between
        end = r["last"]
        path, at = [r], r
        while at["parent"]:
            at = got[at["parent"]]
            path.insert(0, at)
        assert r["position"] == sum(len(p["ids"]) for p in path[:-1]) and r["depth"] == len(path) - 1
        places = [x for a, b in r["intervals"] for x in range(a, b)]
        assert places == [x for p in path for x in range(p["first"], p["last"])]
        assert all(a[1] < b[0] for a, b in zip(r["intervals"], r["intervals"][1:], strict=False))  # merged
        if text.startswith("<s>[assistant]"):
            assert list(r["ids"])[r["loss_first"] - r["first"] : r["loss_last"] - r["first"]] == enc(body)
        else:
            assert r["loss_first"] is None and r["loss_last"] is None
    shared = [r for r in got.values() if texts[r["node"]]["text"].startswith("<s>[user]a first turn")]
    assert len(shared) == 1
