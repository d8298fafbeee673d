"""Token ids of a corpus in ORC files, in ascending doc_id order.

The ids of a document stand in one list column, written with the format's integer
run-length encoding; row indexes and a Bloom filter on doc_id let a reader skip
stripes and row groups, and stripes are read in parallel. Documents are dealt by
ranges of doc_id; a file's number gives its place. The tokenizers library encodes
each distinct pre-token of a worker once (bpe.Pieces cuts as the library does).

Edge cases: a null or empty text has the end id alone; rows without a doc_id come
first; repeated rows stand one after another, ordered by their texts; extra
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridstone.llm import kernel as K
from gridstone.llm.bpe import Encoder
from gridstone.llm.common import bound_arrow, cut, fresh_path, text_rows

#: ORC settings: rows between index entries, bytes of a stripe, columns with Bloom filters and their false positives.
OPTIONS = {
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "compression": "zstd",
}
SCHEMA = "part int, row long, doc_id long, ids array<int>"

_ready: dict[str, Encoder] = {}


def library_encoder(path: str) -> Encoder:
    if path not in _ready:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            ids = [e.ids for e in tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)]
            counts = np.array([len(x) for x in ids], np.int64)
            return counts, np.array([i for x in ids for i in x], np.int64)

        specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        _ready[path] = Encoder(specials, encode)
    return _ready[path]


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> str:
    """Writes the ids of all documents below `path`."""
    bound_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, row = library_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in K.chunks(batches):
            ids, at = encoder(*K.buffer(K.column(b, "text")))
            n = b.num_rows
            with_end = np.insert(ids, at[1:], end_id).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array((at + np.arange(n + 1)).astype(np.int32)), pa.array(with_end))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), K.column(b, "doc_id"), lists], ["part", "row", "doc_id", "ids"])
            row += n

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = text_rows(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SCHEMA).write.options(**OPTIONS).orc(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, row, doc_id, ids from the files."""
    return spark.read.schema(SCHEMA).orc(path)


def describe(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each stored document, from the stored ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = K.column(b, "ids")
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))
            at = lists.offsets.to_numpy()
            view = memoryview(values).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(K.column(b, c) for c in ("part", "row", "doc_id")), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["part", "row", "doc_id", "n_tokens", "ids_crc32"])

    rows = cut(stored.mapInArrow(run, "part int, row long, doc_id long, n_tokens long, ids_crc32 long"), "orc-rows")
    # one row a file: its ids are after those of the files before
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    return rows.withColumn("within", within).join(starts, "part").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def report(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """What op9 returns."""
    spark = docs.sparkSession
    return describe(read(spark, write(docs, tokenizer, end_id, fresh_path(spark, "orc"))))
