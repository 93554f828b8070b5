"""Tables that are replaced as a whole by several writers.

A version is a folder of Parquet files that no one changes.  ``_versions`` holds a small file
per version, which names its folder; making that file is the commit.  Two writers that start
from one version cannot both make the next one, so the later one starts again from what the
first left, and no row is lost.  A writer that dies before its commit leaves a folder that no
one reads.

The file system must refuse to create a file that exists, as HDFS does, and object stores with
conditional writes; on a plain local disk a lock does it for the writers of one process.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_DIGITS = 10
_COMMIT = threading.Lock()


class VersionConflict(RuntimeError):
    """Another writer has made this version."""


def _folder(spark: SparkSession, root: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/_versions")
    return jvm, path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def newest_version(spark: SparkSession, root: str) -> int:
    """Number of the newest version, 0 where there is none yet."""
    _, path, fs = _folder(spark, root)
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return max((int(n) for n in names if n.isdigit()), default=0)


def read_version(spark: SparkSession, root: str, version: int | None = None, wait: float = 30.0) -> DataFrame:
    """A version, the newest by default.  It stays readable while others are written.

    A version whose file is still empty is being committed; it is waited for.
    """
    number = newest_version(spark, root) if version is None else version
    if number == 0:
        raise FileNotFoundError(f"no version in {root}")
    jvm, path, fs = _folder(spark, root)
    until = time.monotonic() + wait
    while True:
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(path, f"{number:0{_DIGITS}d}"))
        try:
            name = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if name.endswith("\n"):
            return spark.read.parquet(f"{root}/{name.strip()}")
        if time.monotonic() > until:
            raise TimeoutError(f"version {number} of {root} was begun and never committed; remove its file")
        time.sleep(0.1)


def commit_version(df: DataFrame, root: str, base: int) -> int:
    """Make ``df`` the version after ``base``; ``VersionConflict`` if there is one already."""
    spark = df.sparkSession
    name = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    jvm, path, fs = _folder(spark, root)
    number = base + 1
    with _COMMIT:
        if newest_version(spark, root) >= number:
            raise VersionConflict(f"{root} has version {number}")
        try:
            stream = fs.create(jvm.org.apache.hadoop.fs.Path(path, f"{number:0{_DIGITS}d}"), False)
        except Exception as e:
            if newest_version(spark, root) >= number:
                raise VersionConflict(f"{root} has version {number}") from e
            raise
        try:
            stream.write(f"{name}\n".encode())
        finally:
            stream.close()
    return number


def update_table(spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame], tries: int = 20) -> int:
    """Replace a table by ``change`` of its newest version, None where there is none yet.

    After a conflict the change is made anew, from what the other writer left.
    """
    for left in range(tries - 1, -1, -1):
        base = newest_version(spark, root)
        try:
            return commit_version(change(read_version(spark, root, base) if base else None), root, base)
        except VersionConflict:
            if not left:
                raise
    raise ValueError("tries must be positive")
