"""Intermediate tables in the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors see; where it is unset in local mode (tests), a local one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lumenark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, result: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: it cuts the lineage and outlives the executors that made it.

    Inside ``passing`` it is removed at the end, unless it is a ``result``, which lives as long as what is around.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lumenark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    scopes = _SCOPES.get()
    for paths in scopes[: len(scopes) - result]:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: The open scopes of this context: another thread's tables are not removed.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that are written inside, at its end: nothing may read them later."""
    paths: list[str] = []
    outer = _SCOPES.set((*_SCOPES.get(), paths))
    try:
        yield
    finally:
        _SCOPES.reset(outer)
        remove(spark, *paths)


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
