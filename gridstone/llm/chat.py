"""Chat formatting in a prefix tree.

Conversations that begin with the same turns share those turns' nodes: a node is
the digest of a conversation's turns so far. Sorted by their lists of nodes, all
conversations of a node stand together, so the nodes in order of their first
conversation and depth are the tree depth-first. Each node's formatted text is
written once, with its place in the output (start, end), the position id of its
first character (the length of its ancestors) and its loss mask; each leaf has the
starts of its nodes and, merged, the intervals that its last turn attends to. A
reader needs no more than these two outputs and the conversations' leaves; equal
conversations have one leaf and are formatted once.

A turn is `<s>[ROLE]TEXT</s>`. In roles and texts `\\`, `<`, `[` and `]` are written
as `\\s`, `\\l`, `\\o` and `\\c`, so no mark can appear inside them. Positions count
code points; a worker holds one conversation at a time.

Edge cases: a null text or role is empty; turns are ordered by turn (null first),
role and text; repeated rows are repeated turns; rows with a null conv_id are one
conversation; extra columns are ignored; an empty table gives the added
conversation alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridstone.llm.common import cut

#: What op7 adds as a user's and an assistant's turn of conversation -1.
ADDED = "</s>[INST] ok [/INST]"
#: Signs and what stands for them, the escape sign first.
ESCAPES = [("\\", "\\s"), ("<", "\\l"), ("[", "\\o"), ("]", "\\c")]
OPEN, MIDDLE, CLOSE = "<s>[", "]", "</s>"


def escaped(text: Column) -> Column:
    for sign, code in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for sign, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def formatted(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(turn["role"]), F.lit(MIDDLE), escaped(turn["text"]), F.lit(CLOSE))


def with_added(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, with conversation -1."""
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    added = spark.createDataFrame([(-1, 0, "user", ADDED), (-1, 1, "assistant", ADDED)], rows.schema)
    return rows.unionByName(added)


def conversations_of(rows: DataFrame) -> DataFrame:
    """conv_id, leaf (its last node), nodes, parts (formatted turns)."""
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    own = lambda t: F.concat_ws("\n", F.length(t["role"]).cast("string"), t["role"], t["text"])
    chain = lambda path, t: F.concat(path, F.array(F.md5(F.concat(F.element_at(path, -1), own(t)))))
    nodes = F.slice(F.aggregate("turns", F.array(F.lit("")), chain), 2, 1 << 30)
    found = whole.select("conv_id", "turns", nodes.alias("nodes"))
    return cut(found.select("conv_id", F.element_at("nodes", -1).alias("leaf"), "nodes", F.transform("turns", formatted).alias("parts")), "chats")


def ordered(convs: DataFrame) -> DataFrame:
    """rank, leaf, nodes, parts of the different conversations, in order of the nodes; equal conversations are one before they are dealt."""
    n = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = convs.select("leaf", "nodes", "parts").dropDuplicates(["leaf"]).repartitionByRange(n, "nodes").sortWithinPartitions("nodes")
    return cut(laid.select(F.monotonically_increasing_id().alias("rank"), "leaf", "nodes", "parts"), "chat-paths")


def tree(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The outputs: nodes in depth-first order, and the leaves where different conversations end.

    Nodes: node, parent, depth, start, end, position, loss_start, loss_end (null without loss), text.
    Leaves: leaf, rank, starts (of its nodes in turn), intervals (what its last turn attends to)."""
    sizes = F.transform("parts", lambda p: F.length(p).cast("long"))
    ahead = lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n))
    placed = paths.withColumn("position", F.aggregate(sizes, F.array(F.lit(0).cast("long")), ahead))
    turns = placed.select("rank", "nodes", "position", F.posexplode("parts").alias("k", "text")).select(
        F.get("nodes", F.col("k")).alias("node"),
        F.struct("rank", "k", F.get("nodes", F.col("k") - 1).alias("parent"), F.get("position", F.col("k")).alias("position"), "text").alias("first"),
    )
    # the first conversation's entry stands for the node; ranks differ, so no texts are compared
    nodes = turns.groupBy("node").agg(F.min("first").alias("first")).select("node", "first.*")
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = nodes.repartitionByRange(n, "rank", "k").sortWithinPartitions("rank", "k")
    laid = cut(laid.select("*", F.spark_partition_id().alias("part"), F.length("text").cast("long").alias("size")), "chat-nodes")
    parts = laid.groupBy("part").agg(F.sum("size").alias("n"))  # one row a partition
    bases = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    within = F.sum("size").over(Window.partitionBy("part").orderBy("rank", "k")) - F.col("size")
    located = laid.withColumn("within", within).join(bases, "part")
    start = F.col("base") + F.col("within")
    mark = F.instr("text", MIDDLE).cast("long")
    loss = F.col("text").startswith(OPEN + "assistant" + MIDDLE)
    out = located.select(
        "node",
        "parent",
        F.col("k").alias("depth"),
        start.alias("start"),
        (start + F.col("size")).alias("end"),
        "position",
        F.when(loss, start + mark).alias("loss_start"),
        F.when(loss, start + F.col("size") - len(CLOSE)).alias("loss_end"),
        "text",
    )
    out = cut(out, "chat-tree")
    ends = paths.select("rank", "leaf", F.posexplode("nodes").alias("k", "node")).join(out.select("node", "start", "end"), "node")
    listed = ends.groupBy("rank", "leaf").agg(F.array_sort(F.collect_list(F.struct("k", "start", "end"))).alias("e"))
    joined = lambda got, x: F.when(
        (F.size(got) > 0) & (F.element_at(got, -1)["end"] == x["start"]),
        F.concat(F.slice(got, 1, F.size(got) - 1), F.array(F.struct(F.element_at(got, -1)["start"].alias("start"), x["end"].alias("end")))),
    ).otherwise(F.concat(got, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end")))))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    leaves = listed.select("rank", "leaf", F.transform("e", lambda x: x["start"]).alias("starts"), F.aggregate("e", none, joined).alias("intervals"))
    return out, cut(leaves, "chat-leaves")


def read_back(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """leaf, turns (k, role, text, loss, size) of each different conversation, from the outputs alone."""
    at = leaves.select("leaf", F.posexplode("starts").alias("k", "start")).join(nodes, "start")
    mark = F.instr("text", MIDDLE)
    part = lambda a, b: unescaped(F.substring("text", a, b))
    turn = F.struct(
        "k",
        part(F.lit(len(OPEN) + 1), mark - (len(OPEN) + 1)).alias("role"),
        part(mark + 1, F.length("text") - mark - len(CLOSE)).alias("text"),
        F.when(F.col("loss_start").isNotNull(), part((F.col("loss_start") - F.col("start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))).otherwise("").alias("loss"),
        F.length("text").cast("long").alias("size"),
    )
    return at.groupBy("leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def report(conversations: DataFrame) -> DataFrame:
    """What op7 returns, read back from the outputs."""
    convs = conversations_of(with_added(conversations))
    back = read_back(*tree(ordered(convs)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: t["loss"]), "")
    size = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["size"])
    texts = back.select("leaf", F.size("turns").cast("long").alias("n_turns"), whole.alias("whole"), loss.alias("loss"), size.alias("formatted_chars"))
    digests = texts.select(
        "leaf",
        "n_turns",
        F.sha2(F.encode("whole", "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
    return convs.select("conv_id", "leaf").join(digests, "leaf").drop("leaf")


SQL = rf"""
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{ADDED}' UNION ALL SELECT -1, 1, 'assistant', '{ADDED}'
    ), wholes AS (
        SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
               coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
               sum({len(OPEN + MIDDLE + CLOSE)} + 2 * (length(role) + length(text)) - length(translate(role || text, '\<[]', ''))) AS formatted_chars
        FROM rows GROUP BY conv_id
    )
    SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(whole) AS turns_sha256,
           CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
    FROM wholes
"""
