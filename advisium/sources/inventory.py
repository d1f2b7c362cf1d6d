"""Inventories, feeds, labels and alias files."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advisium.functions.expr import strip

#: Names of the columns, each with the headers that mean it, the first that is there counts.
HEADERS: dict[str, tuple[str, ...]] = {
    "asset_id": ("asset_id", "id", "tag", "hostname"),
    "vendor": ("vendor", "manufacturer", "make"),
    "product": ("product", "model_name", "device", "product_name"),
    "version": ("version", "firmware", "firmware_version", "fw"),
    "model": ("model", "model_number", "order_number", "part_number", "sku"),
    "cpe": ("cpe",),
    "purdue_level": ("purdue_level", "purdue", "level", "zone"),
    "site": ("site", "location", "plant", "facility"),
}
_CSV = {"header": True, "multiLine": True, "escape": '"', "quote": '"', "inferSchema": False, "encoding": "UTF-8"}


def named(rows: DataFrame) -> DataFrame:
    """Columns by the meaning of their headers; those that are missing are blank, asset_id is ?."""
    there: dict[str, str] = {}
    for c in rows.columns:
        there.setdefault(c.strip().lstrip("﻿").lower().replace(" ", "_"), c)

    def pick(names: tuple[str, ...], default: str) -> Column:
        found = next((there[n] for n in names if n in there), None)
        return F.lit(default) if found is None else strip(F.col(f"`{found}`"))

    return rows.select(*(pick(names, "?" if name == "asset_id" else "").alias(name) for name, names in HEADERS.items()), *(c for c in rows.columns if c == "asset_ord"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """An inventory file, with asset_ord: its rows in order. A file of quoted lines is one task's work."""
    rows = spark.read.options(**_CSV).csv(path)
    return named(rows.withColumn("asset_ord", F.monotonically_increasing_id()))


def read_all(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Inventories with their files' names as inventory; headers may differ."""
    out = None
    for n, path in enumerate(sorted(paths)):
        one = read(spark, path).withColumns({"inventory": F.lit(PurePosixPath(path).stem), "asset_ord": F.col("asset_ord") + F.lit(n << 48)})
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no inventories")
    return out


def unrecognised(assets: DataFrame) -> DataFrame:
    """Keyed assets that no vendor, product or model names."""
    return assets.where("not recognised")


def kev(spark: SparkSession, path: str | None) -> DataFrame:
    """(cve) of a feed of known exploited vulnerabilities; empty without a file. Nothing is fetched."""
    none = spark.createDataFrame([], "cve string")
    if path is None:
        return none
    rows = spark.read.schema("vulnerabilities array<struct<cveID:string>>").option("multiLine", True).json(path)
    return rows.select(F.explode("vulnerabilities.cveID").alias("cve")).where("cve <> ''").distinct()


def epss(spark: SparkSession, path: str | None) -> DataFrame:
    """(cve, epss) of a score feed; lines of # are comments; of repeated CVEs the last counts."""
    none = spark.createDataFrame([], "cve string, epss double")
    if path is None:
        return none
    rows = spark.read.schema("cve string, epss string").option("comment", "#").csv(path)
    rows = rows.select("cve", F.col("epss").try_cast("double").alias("epss"), F.monotonically_increasing_id().alias("n"))
    return rows.where("cve like 'CVE-%' and epss is not null").groupBy("cve").agg(F.max_by("epss", "n").alias("epss"))


def labels(rows: DataFrame) -> DataFrame:
    """(asset_id, advisory_id, affected) of rows with both ids; of repeated pairs the last counts."""
    r = rows.withColumn("n", F.monotonically_increasing_id())
    r = r.select(strip("asset_id").alias("asset_id"), strip("advisory_id").alias("advisory_id"), F.lower(strip("label")).isin("affected", "1", "true", "yes").alias("affected"), "n")
    return r.where("asset_id <> '' and advisory_id <> ''").groupBy("asset_id", "advisory_id").agg(F.max_by("affected", "n").alias("affected"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return labels(spark.read.options(**_CSV).csv(path))


def aliases(text: str) -> dict[str, list[str]]:
    """Vendor spellings of a YAML file's text; one that can't be read adds none."""
    try:
        import yaml

        found = (yaml.safe_load(text) or {}).get("vendor_aliases") or {}
        return {str(k): [str(x) for x in v or []] for k, v in found.items()}
    except Exception:  # no parser, or no such file: the fixed table stands alone
        return {}
