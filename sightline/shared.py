"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application within spark.checkpoint.dir; in local mode, as in tests, a temporary one where that is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = os.path.join(tempfile.gettempdir(), "sightline-shared")
    return f"{given.rstrip('/')}/comparison-{spark.sparkContext.applicationId}"


#: Removes the files of a query's shuffles as soon as it has ended (Spark 4.1 on); without it they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Tables of the steps that are under way, the innermost last.
_UNDER_WAY: list[list[tuple[SparkSession, str]]] = []


def written(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """df, written as Parquet and read back: computed once, and no executor's disk is needed later; what it was shuffled with is removed at once.

    Within a step (see passing) the table goes when that ends; a kept one goes with the step around it, and stays where there is none.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    around = _UNDER_WAY[:-1] if kept else _UNDER_WAY
    if around:
        around[-1].append((spark, path))
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing() -> Iterator[None]:
    """A step whose tables are removed at its end, but for those written as kept: nothing that it returns may read the others."""
    _UNDER_WAY.append([])
    try:
        yield
    finally:
        for spark, path in _UNDER_WAY.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, queries that have ended leave no shuffle files. Only for those whose results are whole when they end, as written tables are."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
