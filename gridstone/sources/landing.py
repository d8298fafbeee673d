"""Fetched files, landed in any store that Hadoop's file systems reach, and the manifest that tells readers which of them count.

A file is streamed aside and renamed into a folder of its own time, so a running job
never sees it change. Only then a row goes to the manifest, a table below the same
root: a file that could not be fetched or read keeps its old state.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, path string, bytes long, fetched_at timestamp"
#: Files fetched at once; milliseconds without an answer after which a fetch has failed.
AT_ONCE, PATIENCE = 8, 60_000


@dataclass(frozen=True)
class Landed:
    name: str
    path: str
    fetched_at: datetime

    @property
    def season(self) -> int | None:
        found = re.search(r"_(\d{4})\.\w+$", self.name)
        return int(found[1]) if found else None


def _path(spark: SparkSession, path: str):  # noqa: ANN202  a Java object
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def open_address(spark: SparkSession, address: str):  # noqa: ANN202  a Java stream
    """A stream of a web address or of a path in any store."""
    if address.startswith(("http://", "https://")):
        to = spark._jvm.java.net.URI(address).toURL().openConnection()
        to.setConnectTimeout(PATIENCE)
        to.setReadTimeout(PATIENCE)
        return to.getInputStream()
    at, fs = _path(spark, address)
    return fs.open(at)


def land(spark: SparkSession, address: str, path: str) -> int:
    """Copies what is at the address to the path: streamed aside, then renamed. Returns its bytes."""
    to, fs = _path(spark, path)
    aside, _ = _path(spark, f"{path}.part")
    try:
        source = open_address(spark, address)
        fs.mkdirs(to.getParent())
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, fs.create(aside, True), 1 << 16, True)
        if not fs.rename(aside, to):
            raise OSError(f"{aside} could not be renamed")
        return fs.getFileStatus(to).getLen()
    except Py4JError as e:
        fs.delete(aside, False)
        raise OSError(f"{address}: {str(e).splitlines()[0]}") from e


def refresh(spark: SparkSession, address: str, root: str, names: Sequence[str], now: datetime | None = None) -> dict[str, str]:
    """Fetches the named files from below the address; name and what went wrong of those that keep their old state."""
    now = now or datetime.now(UTC)
    folder = f"{root.rstrip('/')}/landing/{now:%Y%m%dT%H%M%S%f}"

    def one(name: str) -> tuple[str, str, int, datetime] | str:
        path = f"{folder}/{name}"
        try:
            size = land(spark, f"{address.rstrip('/')}/{name}", path)
            spark.read.parquet(path)  # reads the footer
        except (OSError, PySparkException, Py4JError) as e:
            return str(e).splitlines()[0]
        return name, path, size, now

    with ThreadPoolExecutor(AT_ONCE) as pool:
        got = dict(zip(names, pool.map(one, names), strict=True))
    rows = [r for r in got.values() if isinstance(r, tuple)]
    if rows:
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/manifest")
    return {n: r for n, r in got.items() if isinstance(r, str)}


def current(spark: SparkSession, root: str) -> dict[str, Landed]:
    """By name the file that was fetched last; a row a file, as many as were ever asked for."""
    path = f"{root.rstrip('/')}/manifest"
    if not exists(spark, path):
        return {}
    last = spark.read.schema(MANIFEST).parquet(path).groupBy("name").agg(F.max_by("path", "fetched_at").alias("path"), F.max("fetched_at").alias("at"))
    return {r["name"]: Landed(r["name"], r["path"], r["at"].astimezone(UTC)) for r in last.collect()}


def prune(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes the landed files that the last `keep` fetches of their name have replaced; returns how many. Not while an older job still reads them."""
    path = f"{root.rstrip('/')}/manifest"
    if not exists(spark, path):
        return 0
    files = spark.read.schema(MANIFEST).parquet(path).groupBy("name").agg(F.sort_array(F.collect_set(F.struct("fetched_at", "path")), asc=False).alias("f"))
    gone = 0
    for r in files.select(F.explode(F.slice("f", keep + 1, 1 << 20)).alias("f")).collect():  # a row a fetch
        at, fs = _path(spark, r["f"]["path"])
        gone += bool(fs.exists(at) and fs.delete(at, False))
    return gone
