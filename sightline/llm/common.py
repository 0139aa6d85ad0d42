"""Small helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """One folder an application within spark.checkpoint.dir, which driver and executors share; it can go when the application has ended.

    Only in local mode, as in tests, a temporary folder stands in where that option is unset.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = os.path.join(tempfile.gettempdir(), "sightline-shared")
    return f"{given.rstrip('/')}/sightline-{spark.sparkContext.applicationId}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage is cut, no executor's disk is needed later."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until df has no such column (in any case)."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def making_room(df: DataFrame, *names: str) -> DataFrame:
    """df whose columns of these names, which an operator is about to add, have `_input` (and underscores) behind their names."""
    for column in [c for c in df.columns if c.lower() in {n.lower() for n in names}]:
        df = df.withColumnRenamed(column, free_name(df, f"{column}_input"))
    return df


def words(text: Column) -> Column:
    """Words of a text as an array; null texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for a row, also where lambdas within use refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
