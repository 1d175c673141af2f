"""Tables written once below the folder that driver and executors share, so that nothing behind them is computed twice.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset, which a local master alone may do, a
temporary one is made. Written tables survive lost executors and hold no storage memory; they go when the driver's Python ends, or at the end of a
``released`` block.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lifegrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own, computed now."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/grid-{uuid.uuid4().hex[:16]}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def new_file(spark: SparkSession, content: bytes, suffix: str) -> str:
    """The path of a new file of these bytes."""
    folder = f"{shared_dir(spark)}/file-{uuid.uuid4().hex[:16]}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/content{suffix}")
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    _written.append((spark, folder))
    return at.toString()


def clear(since: int = 0) -> None:
    """Removes what has been written, or what has been since so many tables were; results that still read it can't be computed after that."""
    for spark, path in _written[since:]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del _written[since:]


@contextmanager
def released() -> Iterator[None]:
    """Removes, at the end of the block, what was written in it: for results that are collected or stored by then."""
    before = len(_written)
    try:
        yield
    finally:
        clear(before)


@atexit.register
def _remove() -> None:
    try:
        clear()
    except Exception:  # the JVM may be gone by now
        return
