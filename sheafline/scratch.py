"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Rows of a narrow scratch table that one file is given about.
FILE_ROWS = 50_000
#: This driver's part of the shared folder, and the folders in use of it; they go when the driver ends.
RUN = uuid.uuid4().hex
_used: dict[str, SparkSession] = {}
#: Paths made in each settled() that is under way, the innermost last.
_making: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``. Only a local session, where driver and
    executors are one machine, may do without it and gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sheafline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, suffix: str = "") -> str:
    """A new path in the shared folder, below a folder that is deleted when the driver ends."""
    top = f"{shared_dir(spark)}/sheafline/{RUN}"
    if not _used:
        atexit.register(clear)
    _used[top] = spark
    path = f"{top}/{uuid.uuid4().hex}{suffix}"
    for made in _making[-1:]:
        made.append(path)
    return path


def clear() -> None:
    """Delete every scratch table of this driver; nothing may read them any more."""
    for top, spark in _used.items():
        with contextlib.suppress(Exception):  # the JVM may be gone at the driver's end
            delete(spark, top)
    _used.clear()


def materialize(df: DataFrame, rows: int | None = None, options: dict | None = None) -> DataFrame:
    """Write df once to the shared folder and return a scan of it.

    Cuts the lineage: a lost executor costs only the tasks it was running. rows: a bound
    of df's rows where one is known; it sets how many files are written, so that small
    tables do not become one file for each shuffle partition. options: of the writer.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = scratch_path(spark)
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def settled(spark: SparkSession, build: Callable[[], DataFrame], rows: int | None = None) -> DataFrame:
    """What build() gives as a scratch table; those that build() wrote on the way are deleted."""
    _making.append([])
    try:
        out = materialize(build(), rows)
    finally:
        made = _making.pop()
    for path in made:
        if path != out._scratch_path:
            delete(spark, path)
    for outer in _making[-1:]:
        outer.append(out._scratch_path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame | None) -> None:
    """Delete a scratch table that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        delete(df.sparkSession, path)
