"""Runs on file, and what changed between the last two of a label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["asset_id", "advisory_id"]


def snapshot(findings: DataFrame) -> DataFrame:
    """(asset_id, advisory_id, tier, priority, cvss, kev, verdict): one row for each pair, the last of a run's order."""
    rest = ["tier", "priority", "cvss", "kev", "verdict"]
    rows = findings.select(*KEY, "tier", "priority", "cvss", F.col("in_kev").alias("kev"), "verdict", F.struct("prio_rank", "tier", -F.coalesce("cvss", F.lit(0.0)), "asset_ord").alias("o"))
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "o").alias("x")).select(*KEY, "x.*")


def _number(spark: SparkSession, folder: str) -> int:
    """A run's number, one above the last; a folder that only one writer can make claims it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/numbers")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    n = max((int(s.getPath().getName()) for s in fs.listStatus(path)), default=0) + 1
    while not fs.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(path, str(n))):
        n += 1
    return n


def record(spark: SparkSession, folder: str, label: str, ran_at: str, assets: int, findings: DataFrame) -> int:
    """Appends a run and its findings; its number is one above the last. The run's row comes last, so a run that is listed is whole."""
    run_id = _number(spark, folder)
    rows = snapshot(findings).withColumns({"label": F.lit(label), "run_id": F.lit(run_id).cast("long")})
    rows.write.mode("append").partitionBy("label", "run_id").parquet(f"{folder}/findings")
    n = findings.count()
    one = spark.createDataFrame([(run_id, label, ran_at, assets, n)], "run_id long, label string, ran_at string, assets int, findings long")
    one.coalesce(1).write.mode("append").parquet(f"{folder}/runs")
    return run_id


def last_runs(runs: DataFrame, label: str, n: int = 2) -> DataFrame:
    return runs.where(F.col("label") == label).orderBy(F.desc("run_id")).limit(n)


def diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(asset_id, advisory_id, change, before, now): added, resolved, or changed in priority."""
    b = before.select(*KEY, F.col("priority").alias("before"), F.lit(True).alias("was"))
    c = now.select(*KEY, F.col("priority").alias("now"), F.lit(True).alias("is"))
    both = b.join(c, KEY, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "resolved").when(F.col("before") != F.col("now"), "changed")
    return both.select(*KEY, change.alias("change"), "before", "now").where("change is not null")


def diff_last(spark: SparkSession, folder: str, label: str) -> DataFrame | None:
    """What changed between the last two runs of a label; None with fewer."""
    runs = [r.run_id for r in last_runs(spark.read.parquet(f"{folder}/runs"), label).collect()]
    if len(runs) < 2:
        return None
    rows = spark.read.parquet(f"{folder}/findings").where(F.col("label") == label)
    return diff(rows.where(F.col("run_id") == runs[1]), rows.where(F.col("run_id") == runs[0]))
