"""Token ids of the prefix tree: each node's tokens once, with position ids and attention intervals.

A node's marks and its text are encoded apart, so the loss mask begins and ends
between tokens. Tokens stand depth-first, as the nodes do; a node's first token has
the number of its ancestors' tokens as position id, and its intervals, merged, are
the places of its ancestors' tokens and its own: what the node's tokens may attend to,
the last interval up to the token itself.

Edge cases: as in `chat`; an empty text has no tokens between its marks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridstone.llm import bpe, chat
from gridstone.llm import kernel as K
from gridstone.llm.common import bound_arrow, cut

MERGED = "cast(array() as array<struct<start:bigint,end:bigint>>)"


def encoded(nodes: DataFrame, path: str) -> DataFrame:
    """start, ids, n_tokens, n_head (tokens before the text), n_text of each node."""
    bound_arrow(nodes.sparkSession)
    mark = F.instr("text", chat.MIDDLE)
    pieces = F.array(F.substring("text", F.lit(1), mark), F.substring("text", mark + 1, F.length("text") - mark - len(chat.CLOSE)), F.lit(chat.CLOSE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = bpe.ready(path)
        for b in K.chunks(batches):
            ids, at = encoder(*K.buffer(K.column(b, "pieces").flatten()))
            sizes = np.diff(at).reshape(-1, 3).astype(np.int64)
            whole = pa.ListArray.from_arrays(pa.array(np.append(at[:-1:3], at[-1]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([K.column(b, "start"), whole, pa.array(sizes.sum(1)), pa.array(sizes[:, 0]), pa.array(sizes[:, 1])], ["start", "ids", "n_tokens", "n_head", "n_text"])

    return nodes.select("start", "text", pieces.alias("pieces")).mapInArrow(run, "start long, ids array<int>, n_tokens long, n_head long, n_text long")


def placed(rows: DataFrame) -> DataFrame:
    """The rows with first: the tokens of all nodes before, in ranges of the nodes' order; no task sees all nodes."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = cut(rows.repartitionByRange(n, "start").withColumn("part", F.spark_partition_id()), "chat-tokens")
    parts = laid.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a range
    bases = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("start")) - F.col("n_tokens")
    return laid.withColumn("within", within).join(F.broadcast(bases), "part").withColumn("first", F.col("base") + F.col("within")).drop("part", "base", "within")


def tokenized(nodes: DataFrame, leaves: DataFrame, path: str) -> DataFrame:
    """node, parent, depth, first, last (places of its tokens, the end excluded), position (of its first token), loss_first, loss_last
    (null without loss), ids, intervals of every node of `chat.tree`."""
    rows = cut(placed(encoded(nodes, path)), "chat-placed")
    spans = rows.select("start", "first", (F.col("first") + F.col("n_tokens")).alias("last"))
    paths = leaves.select("rank", F.posexplode("starts").alias("k", "start")).join(spans, "start")
    listed = paths.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("k", "start", "first", "last"))).alias("e"))
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    step = lambda got, x: F.when(
        (F.size(got) > 0) & (F.element_at(got, -1)["end"] == x["first"]),
        F.concat(F.slice(got, 1, F.size(got) - 1), F.array(pair(F.element_at(got, -1)["start"], x["last"]))),
    ).otherwise(F.concat(got, F.array(pair(x["first"], x["last"]))))
    upto = listed.select("rank", F.explode(F.sequence(F.lit(1), F.size("e"))).alias("n"), "e").select("rank", F.slice("e", F.lit(1), F.col("n")).alias("e"))
    intervals = F.aggregate("e", F.expr(MERGED), step)
    ahead = F.aggregate(F.slice("e", F.lit(1), F.size("e") - 1), F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"])
    own = upto.select(F.element_at("e", -1)["start"].alias("start"), F.struct("rank", ahead.alias("position"), intervals.alias("intervals")).alias("of"))
    # a node's ancestors are the same in all its conversations: the first one tells
    of = own.groupBy("start").agg(F.min_by("of", "of.rank").alias("of"))
    loss = lambda add: F.when(F.col("loss_start").isNotNull(), F.col("first") + F.col("n_head") + add)
    whole = nodes.select("start", "node", "parent", "depth", "loss_start").join(rows, "start").join(of, "start")
    return whole.select(
        "node", "parent", "depth", "first", (F.col("first") + F.col("n_tokens")).alias("last"), F.col("of.position").alias("position"), loss(F.lit(0)).alias("loss_first"), loss(F.col("n_text")).alias("loss_last"), "ids", F.col("of.intervals").alias("intervals")
    )
