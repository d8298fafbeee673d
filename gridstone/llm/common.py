"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python hold at most so many rows and bytes.
ARROW_ROWS, ARROW_BYTES = 2000, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_arrow(spark: SparkSession) -> None:
    """Keeps one Arrow batch small however long the texts are: a JVM holds some of them for each task, outside its heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. Where the session names none, a local one for a local master, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("start the session with spark.checkpoint.dir: a folder that the driver and all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="gridstone-")
    return _local[context.applicationId]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended first
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: lineage ends there, and a lost executor costs no recomputation."""
    return table_cut(df, name)[0]


def table_cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`cut`, and the table's path: for `drop_cut` once nothing reads it any more."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_cut(spark: SparkSession, path: str) -> None:
    """Frees the room of a table that no later job reads."""
    _forget(spark, path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: A key with more rows is hot; so many hot keys are broadcast at once.
HOT_ROWS, HOT_KEYS = 200_000, 100_000


def join_by_counts(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Inner join with a written table of one row a key, whose column n counts the key's rows in `rows`.

    Hot keys are broadcast, so that their rows stay where they are; as each has HOT_ROWS rows or more,
    they are few. The others are shuffled."""
    hot = table.filter(F.col("n") > HOT_ROWS).drop("n")
    n = hot.count()
    if not n:
        return rows.join(table.drop("n"), on)
    keys = hot.select(*on)
    hint = F.broadcast if n <= HOT_KEYS else (lambda df: df)
    cold = rows.join(hint(keys), on, "left_anti").join(table.filter(F.col("n") <= HOT_ROWS).drop("n"), on)
    return cold.unionByName(rows.join(hint(hot), on))


def text_rows(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text is an empty one."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
