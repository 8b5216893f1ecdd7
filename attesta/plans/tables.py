"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a fresh folder in local mode where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='attesta-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a file or folder that goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}/{name}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(where, True)
    fs.cancelDeleteOnExit(where)


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to the shared folder, in folders by the columns of by, and read it back: cuts the lineage, survives lost executors, goes when the driver ends.

    Within scope() it goes when the scope ends, unless its name is among those that the scope keeps.
    """
    spark = df.sparkSession
    path = place(spark, name)
    df.write.partitionBy(*by).parquet(path)
    held = _open.get()
    if held is not None:
        held.append((name, path.rpartition("/")[0]))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has executors drop the files of shuffles that no query reads any more. They do so when the driver's JVM has collected what names them, which it may not do for long by itself."""
    spark.sparkContext._jvm.System.gc()


_open: ContextVar[list[tuple[str, str]] | None] = ContextVar("open", default=None)


@contextmanager
def scope(spark: SparkSession, keep: tuple[str, ...] = ()) -> Iterator[None]:
    """Drops the tables that written() makes inside when it ends, but for those named in keep, which go on to the scope around it.

    What leaves the scope may read kept tables only.
    """
    outer = _open.get()
    token = _open.set([])
    try:
        yield
    finally:
        made = _open.get() or []
        _open.reset(token)
        for name, path in made:
            if name not in keep:
                _drop(spark, path)
            elif outer is not None:
                outer.append((name, path))
