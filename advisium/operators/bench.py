"""An inventory of any size, for timing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replicate(assets: DataFrame, n: int) -> DataFrame:
    """n assets: the inventory's again and again, with ids of their own."""
    spark = assets.sparkSession
    base = assets.withColumn("k", F.row_number().over(Window.orderBy("asset_ord")) - 1).drop("asset_ord")  # a sample inventory is small
    size = base.count()
    if not size:
        return assets
    rows = spark.range(n).select(F.col("id").alias("asset_ord"), (F.col("id") % size).alias("k"))
    out = rows.join(F.broadcast(base) if size <= 100_000 else base, "k")
    return out.withColumn("asset_id", F.concat("asset_id", F.lit("-"), F.col("asset_ord").cast("string"))).select(*assets.columns)
