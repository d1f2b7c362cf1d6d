"""Assets and advisories made of the order tables, so that matching runs at any scale of them.

The statements are text that Spark and DuckDB both read; what differs between them is filled in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advisium.operators.corpus import Corpus, keyed_assets

#: How inventories and advisories spell the vendor of each brand, by number.
SPELLINGS = (
    ("Siemens AG", "Siemens"), ("Allen-Bradley", "Rockwell Automation"), ("Schneider Electric", "Schneider-Electric"), ("Hitachi Energy", "Hitachi ABB Power Grids"),
    ("GE", "General Electric"), ("ABB Ltd.", "ABB"), ("Acme Corp.", "ACME Inc"), ("Phoenix Contact GmbH", "Phoenix Contact"), ("MOXA", "Moxa Inc"), ("", "Nameless"),
)
BRAND = "CAST(replace(p_brand, 'Brand#', '') AS INT)"


def _spelled(side: int) -> str:
    cases = " ".join(f"WHEN {n} THEN '{names[side]}'" for n, names in enumerate(SPELLINGS))
    other = "concat('Maker ', {0}, ' Ltd')" if side else "concat('maker ', {0})"
    return f"CASE {BRAND} {cases} ELSE {other.format(BRAND)} END"


def _number(x: str) -> str:
    return f"concat(CAST(floor(({x}) / 10) AS INT), '.', ({x}) % 10)"


ASSET = f"""SELECT c_custkey AS asset_ord, c_name AS asset_id, {_spelled(0)} AS vendor, p_name AS product,
  CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN concat('V', {_number("p_size")}) WHEN 2 THEN concat({_number("p_size")}, 'a') ELSE {_number("p_size")} END AS version,
  CASE WHEN p_partkey % 4 = 0 THEN concat('sku-', p_partkey) ELSE '' END AS model,
  CASE WHEN p_partkey % 9 = 0 THEN concat('CPE:2.3:h:', {BRAND}, ':', p_partkey, ':1.0') ELSE '' END AS cpe,
  concat('', c_nationkey % 6) AS purdue_level, c_mktsegment AS site
FROM {{customer}} JOIN {{part}} ON p_partkey = c_custkey"""

_LINE = """SELECT l_orderkey, l_partkey, min(l_returnflag) AS flag, CAST(max(l_quantity) AS INT) AS q, min(l_suppkey) AS supp, max(l_discount) AS disc
FROM {lineitem} GROUP BY l_orderkey, l_partkey"""

LEAF = f"""SELECT concat('ADV-', l_orderkey) AS advisory_id, concat('P', l_partkey) AS product_id, {_spelled(1)} AS vendor,
  CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN concat('SIMATIC ', p_name) WHEN 2 THEN concat(p_name, ' series') WHEN 3 THEN concat({_spelled(1)}, ' ', p_name, 's') ELSE concat(p_name, ' (all of them)') END AS product_name,
  CASE WHEN q % 11 = 0 THEN 'serial no. 5' WHEN flag = 'R' THEN concat('<V', {_number("q")}) WHEN flag = 'A' THEN 'vers:all/*' WHEN q % 7 = 0 THEN {_number("q")}
       ELSE concat('vers:intdot/>=0.5|<=', {_number("q")}) END AS version_text,
  '' AS full_name, CASE WHEN p_partkey % 8 = 0 THEN {{one}} ELSE {{none}} END AS model_numbers, {{none}} AS skus,
  CASE WHEN p_partkey % 18 = 0 THEN concat('cpe:2.3:h:', {BRAND}, ':', p_partkey, ':2.0') ELSE '' END AS cpe, l_partkey AS prod_ord
FROM ({_LINE}) JOIN {{part}} ON p_partkey = l_partkey"""

VULN = f"""SELECT concat('ADV-', l_orderkey) AS advisory_id, concat('CVE-', 2000 + l_partkey % 25, '-', 1000 + supp) AS cve, '' AS cwe, '' AS title, round(disc * 100, 1) AS cvss_score,
  CASE supp % 4 WHEN 0 THEN 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N' WHEN 1 THEN 'CVSS:4.0/AV:N/AU:Y/S:P' WHEN 2 THEN 'CVSS:4.0/AU:N/MSI:S' ELSE '' END AS cvss_vector,
  concat('P', l_partkey) AS pid,
  CASE WHEN supp % 11 = 0 THEN 'known_not_affected' WHEN supp % 13 = 0 THEN 'under_investigation' WHEN supp % 17 = 0 THEN 'fixed' WHEN supp % 19 = 0 THEN 'recommended' ELSE 'known_affected' END AS stat,
  supp % 3 <> 0 AS has_remedy, l_partkey AS vuln_ord
FROM ({_LINE})"""

ADVISORY = """SELECT concat('ADV-', o_orderkey) AS advisory_id, concat('Order ', o_orderpriority, ' of ', o_custkey) AS title, substr(concat('', o_orderdate), 1, 10) AS published,
  substr(concat('', o_orderdate), 1, 10) AS revised, o_orderpriority AS severity, '' AS publisher, concat('Status ', o_orderstatus) AS summary, '' AS tlp, concat('/f/', o_orderkey, '.json') AS source_path,
  o_orderkey AS adv_ord
FROM {orders}"""

KEV = "SELECT DISTINCT cve FROM ({vuln}) WHERE vuln_ord % 31 = 0"
EPSS = "SELECT cve, max(round((vuln_ord % 40) / 200.0, 4)) AS epss FROM ({vuln}) WHERE vuln_ord % 3 = 0 GROUP BY cve"
RUN = """SELECT event_type AS label, CAST(floor(event_id / {size}) AS INT) AS run, concat('U', user_id) AS asset_id, concat('V', CAST(floor(value) AS INT) % 5) AS advisory_id,
  max(CASE WHEN value >= 50 THEN 'NOW' WHEN value >= 20 THEN 'NEXT' ELSE 'LATER' END) AS priority FROM {events} GROUP BY 1, 2, 3, 4"""
#: Events of a run.
RUN_SIZE = 400
TABLES = ("customer", "part", "lineitem", "orders", "events")


def spark_text(statement: str, sf_dir: str) -> str:
    names = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return statement.format(**names, one="array(concat('SKU ', p_partkey))", none="CAST(array() AS array<string>)", size=RUN_SIZE, vuln=VULN.format(**names))


def duck_text(statement: str) -> str:
    names = {t: t for t in TABLES}
    return statement.format(**names, one="[concat('SKU ', p_partkey)]", none="CAST([] AS VARCHAR[])", size=RUN_SIZE, vuln=VULN.format(**names))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(spark_text(ASSET, sf_dir))


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    vulns = spark.sql(spark_text(VULN, sf_dir))
    vulns = vulns.withColumn("known_affected", F.when(F.col("stat") == "known_affected", F.array("pid")).otherwise(F.array().cast("array<string>")))
    vulns = vulns.withColumn("status", F.create_map("stat", F.array("pid"))).drop("pid", "stat")
    advisories = spark.sql(spark_text(ADVISORY, sf_dir)).withColumn("sectors", F.array().cast("array<string>"))
    return Corpus(advisories, spark.sql(spark_text(LEAF, sf_dir)), vulns)


def feeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.sql(spark_text(KEV, sf_dir)), spark.sql(spark_text(EPSS, sf_dir))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision on some products: each key of an inventory as itself, or as the next part's."""
    rows = keyed_assets(assets(spark, sf_dir)).where("vendor_key <> ''")
    rows = rows.select("vendor_key", F.col("key.full").alias("asset_product_key"), F.col("product").alias("raw")).distinct()
    rows = rows.where(F.length("raw") % 3 == 0)
    verdict = F.when(F.length("vendor_key") % 2 == 0, "CONFIRMED").when(F.length("vendor_key") % 3 == 0, "DEFERRED").otherwise("REJECTED")
    return rows.select(
        "vendor_key", "asset_product_key", F.col("asset_product_key").alias("adv_product_key"), verdict.alias("decision"), F.lit("ann").alias("analyst"),
        F.lit("2024-05-01T10:00:00").alias("decided_at"), F.lit("").alias("note"), F.col("raw").alias("asset_product_raw"), F.col("raw").alias("adv_product_raw"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(spark_text(RUN, sf_dir))
