import hashlib
import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from gridstone.llm import chat, urls

CHATS = "conv_id long, turn int, role string, text string, start int, node string"


def conversations():
    rows = [(i, k, ("user", "assistant", "system")[k % 3], f"turn {k if k < i % 4 else i} é🙂") for i in range(30) for k in range(5)]
    rows += [(50, 0, "user", "</s>[INST] a\\l\\\\ <s>[user]"), (50, 1, "assistant", "]]<[\\s\n\n"), (51, None, None, None), (51, 3, "assistant", ""), (52, 0, "ro]le", "x" * 20_000), (52, 0, "ro]le", "x" * 20_000)]
    rows += [(c, k, r, t) for c in (60, 61, 62) for k, (r, t) in enumerate([("user", "same"), ("assistant", "words")])]
    rows += [(None, 0, "assistant", "of no conversation")]
    return [(*r, 1, "n") for r in rows]


def test_chat_is_read_back(spark):
    rows = conversations()
    whole = [*rows, (-1, 0, "user", chat.ADDED, 0, ""), (-1, 1, "assistant", chat.ADDED, 0, "")]
    want = set()
    key = lambda r: (r[0] is not None, r[0] or 0)
    for _, turns in itertools.groupby(sorted(whole, key=key), key):
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in turns))
        conv = next(r[0] for r in whole if key(r) == _)
        text = "".join(f"{r}\n{t}\n" for *_x, r, t in turns)
        loss = "".join(t for *_x, r, t in turns if r == "assistant")
        size = sum(9 + len(r + t) + sum((r + t).count(s) for s in "\\<[]") for *_x, r, t in turns)
        want.add((conv, len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    got = chat.report(spark.createDataFrame(rows, CHATS))
    assert {tuple(r) for r in got.collect()} == want
    assert chat.report(spark.createDataFrame([], CHATS)).count() == 1


def test_tree_shares_and_orders_nodes(spark):
    convs = chat.conversations_of(chat.with_added(spark.createDataFrame(conversations(), CHATS)))
    nodes, leaves = chat.tree(chat.ordered(convs))
    assert leaves.count() == convs.select("leaf").distinct().count() < convs.count()
    rows = nodes.orderBy("start").collect()
    by_node = {r["node"]: r for r in rows}
    end, path = 0, []
    for r in rows:
        assert r["start"] == end  # nothing between, each text once
        end = r["end"]
        path = path[: r["depth"]]
        assert r["parent"] == (path[-1] if path else None)  # depth-first
        assert r["position"] == sum(by_node[p]["end"] - by_node[p]["start"] for p in path)
        path.append(r["node"])
    starts = {r["start"]: r for r in rows}
    for leaf in leaves.collect():
        inside = [(a, b) for a, b in leaf["intervals"]]
        assert sum(b - a for a, b in inside) == sum(starts[s]["end"] - s for s in leaf["starts"])
    assert len(rows) < sum(len(x["starts"]) for x in leaves.collect())


@pytest.mark.parametrize(("n", "shard_keys", "pass_bits"), [(5000, 200_000, 1 << 29), (3000, 300, 1 << 14), (700_000, 100_000, 1 << 29)])
def test_cascade_is_exact(spark, n, shard_keys, pass_bits):
    keys = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 < 3).alias("listed")).cache()
    cascade = urls.Cascade(keys, shard_keys, pass_bits)
    assert cascade.mark(keys.select("key"), "got").join(keys, "key").filter("got <> listed").count() == 0


def test_urls_equal_sql(spark):
    rows = [
        "http://m.casino-win.example.com/en/4033.html", "https://A.example.COM/en/7?x", "https://example.net/de/81#t", "http://x.net/de/", "ftp://org/es/y", "http://notcom/en/1",
        "no scheme", "", None, "http://", "://", "http://h?q", "http://h#f/en/", "http://b.org?casino", "http://b.org/casino", "https://ä.com/en/é", "http://a.com/en/7", "http://a.com/en/7",
    ]
    html = lambda i: None if i == 4 else f"<html><title>{'Jackpot now' if i == 6 else 'plain'}</title><p>casino</p>"
    pages = spark.createDataFrame([(i, u, html(i), "k") for i, u in enumerate(rows)], "page_id long, url string, html string, key string")
    got = {tuple(r) for r in urls.judge(pages).select("page_id", "host", "path", "rule", "verdict").collect()}
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", [(i, u, html(i)) for i, u in enumerate(rows)])
    assert got == set(con.sql(urls.SQL).fetchall())
    assert urls.judge(pages.limit(0)).count() == 0
    listed = spark.createDataFrame([("h",)], "key string")
    assert {r["page_id"] for r in urls.judge(pages, listed=listed).filter("verdict = 'block' and rule is null").collect()} == {11, 12}


def test_verdicts_are_those_of_the_contract(spark):
    want = {
        ("http://com/en/1", "com/en/", "block"), ("http://a.example.com/en/7", "example.com/en/7", "allow"), ("http://x.net/de/casino", "net/de/", "allow"),
        ("http://a.example.net/de/81", "example.net/de/8", "block"), ("http://b.org/es/", "org/es/", "block"), ("http://b.org/en/", None, "allow"),
    }
    pages = spark.createDataFrame([(u, u, "") for u, _, _ in want], "page_id string, url string, html string")
    assert {tuple(r) for r in urls.judge(pages).select("page_id", "rule", "verdict").collect()} == want
