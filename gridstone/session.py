"""Session settings and the shipping of this package to executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; the cluster's own settings hold otherwise."""
    builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started; once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="gridstone-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def _folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. A local folder only where the session names none."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("start the session with spark.checkpoint.dir: a folder that the driver and all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="gridstone-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The rows, written to the session's checkpoint folder: what reads them twice does not compute them twice."""
    _folder(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession) -> str:
    """A path in the checkpoint folder; what is there goes with the session."""
    path = f"{_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    atexit.register(dropped, spark, path)
    return path


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """`settled` as Parquet, by the values of a column if one is named: readers take the columns that they need, and the size is known to joins. Rows have no order."""
    path = fresh_path(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Frees the room of a table that no later job reads."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended first
        pass
