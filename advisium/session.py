"""Lets Python workers of a session find this package."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> SparkSession:
    """For folders that workers share with the driver; elsewhere hand the package over with --py-files."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    return spark


def shared(spark: SparkSession) -> str:
    """The folder for checkpoints and files that the cluster shares: spark.checkpoint.dir, or what the session was given.

    Without either one is made if the session is local; a cluster's executors would not share it.
    """
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Written once to the checkpoint folder that the cluster shares, and read from there by all that follows."""
    shared(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """As cut(), in compressed columns: for tables as long as the input, of which each reader needs a few columns."""
    path = f"{shared(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with the place of each row by a column, from 1, without one task that sorts them all.

    Rows are dealt out by ranges; a range's rows are numbered from the counts of the ranges before,
    which are one number each.
    """
    dealt = cut(df.repartitionByRange(by).withColumn("__range", F.spark_partition_id()))
    before, total = [], 0
    for at, n in sorted(dealt.groupBy("__range").count().collect()):
        before.append((at, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "__range int, __before long")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(by)) + F.col("__before")
    return dealt.join(F.broadcast(offsets), "__range").withColumn(name, place).select(*df.columns, name)  # a number for each range
