"""Cutting lineage with a table written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Paths of the tables written in each open `temporary_tables`, the innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`; a temporary one, gone with the process, only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of every query that runs inside, as soon as that query has ended.

    Nothing reads them again once the rows are written; without it they stay until the driver's garbage collection.
    """
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that `cut` writes inside are deleted at the end, also when a step inside fails.

    What is needed after it is written with the function that this gives, `keep`; nothing else that is made inside may be
    read after it.
    """
    paths: list[str] = []
    around = _open.get()
    token = _open.set((*around, paths))
    try:
        yield lambda df: write_once(df, _new_path(spark, around))
    finally:
        _open.reset(token)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Writes the rows as Parquet, removes the shuffles it took, and reads them back."""
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _new_path(spark: SparkSession, scopes: tuple[list[str], ...]) -> str:
    path = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
    if scopes:
        scopes[-1].append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from Parquet: computed once, whatever is built on them."""
    return write_once(df, _new_path(df.sparkSession, _open.get()))
