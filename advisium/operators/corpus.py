"""The advisory corpus as three tables, and what is derived from them once for all matching.

advisories: advisory_id, title, published, revised, severity, publisher, summary, sectors, tlp,
    source_path, adv_ord
leaves: advisory_id, product_id, vendor, product_name, version_text, full_name, model_numbers, skus,
    cpe, prod_ord
vulns: advisory_id, cve, cwe, title, cvss_score, cvss_vector, known_affected, status, has_remedy,
    vuln_ord
The ord columns are the order of input, which settles ties. Blank text stands for missing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from advisium.functions import keys, versions
from advisium.session import cut, kept

#: Distinct texts that are broadcast with what is derived of them; more are joined by a shuffle.
FEW = 200_000
#: Tables of another layout are not read.
LAYOUT = 1
TABLES = ("advisories", "leaves", "vulns")
#: What an advisory may state of a product.
STATUSES = ("first_affected", "first_fixed", "fixed", "known_affected", "known_not_affected", "last_affected", "recommended", "under_investigation")


@dataclass(frozen=True)
class Corpus:
    advisories: DataFrame
    leaves: DataFrame
    vulns: DataFrame

    def stored(self) -> Corpus:
        """What a store keeps: the last of repeated products and CVEs, and no blank CVE."""
        return Corpus(
            self.advisories,
            _last(self.leaves, ["advisory_id", "product_id"], "prod_ord"),
            _last(self.vulns.where("cve <> ''"), ["advisory_id", "cve"], "vuln_ord"),
        )

    def save(self, folder: str, mode: str = "errorifexists") -> None:
        for name in TABLES:
            getattr(self, name).write.mode(mode).parquet(f"{folder}/v{LAYOUT}/{name}")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Corpus:
        return Corpus(*(spark.read.parquet(f"{folder}/v{LAYOUT}/{name}") for name in TABLES))

    def upsert(self, new: Corpus) -> Corpus:
        """This corpus with the advisories of another put in place of those with the same id."""
        ids = new.advisories.select("advisory_id").distinct()
        merged = (getattr(self, t).join(ids, "advisory_id", "left_anti").unionByName(getattr(new, t)) for t in TABLES)
        return Corpus(*merged)


def _last(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row of each key, by a partial aggregate instead of a window."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("x"))
    return best.select(*(c if c in by else F.col(f"x.{c}").alias(c) for c in df.columns))


def worst(score: Column, vector: Column, order: Column) -> Column:
    """Aggregate: struct(score, vector) of the highest score, the first of equals."""
    top = F.max(F.when(score.isNotNull(), F.struct(score.alias("score"), (-order).alias("o"), F.coalesce(vector, F.lit("")).alias("vector"))))
    return F.struct(top["score"].alias("score"), F.coalesce(top["vector"], F.lit("")).alias("vector"))


def in_order(cve: Column, order: Column) -> Column:
    """Aggregate: the CVEs that are not blank, in order; of one advisory's, so the list is short."""
    found = F.array_sort(F.collect_list(F.when(cve != "", F.struct(order.alias("o"), cve.alias("cve")))))
    return F.transform(found, lambda x: x["cve"])


def advisory_facts(vulns: DataFrame) -> DataFrame:
    """(advisory_id, all_cves, all_worst, has_patch)."""
    c = F.col
    return vulns.groupBy("advisory_id").agg(
        in_order(c("cve"), c("vuln_ord")).alias("all_cves"), worst(c("cvss_score"), c("cvss_vector"), c("vuln_ord")).alias("all_worst"), F.bool_or("has_remedy").alias("has_patch")
    )


def leaf_facts(vulns: DataFrame) -> DataFrame:
    """(advisory_id, product_id, own_cves, own_worst) of products that a vulnerability names as affected."""
    c = F.col
    named = vulns.select("advisory_id", "vuln_ord", "cve", "cvss_score", "cvss_vector", F.explode(F.array_distinct("known_affected")).alias("product_id"))
    return named.groupBy("advisory_id", "product_id").agg(
        in_order(c("cve"), c("vuln_ord")).alias("own_cves"), worst(c("cvss_score"), c("cvss_vector"), c("vuln_ord")).alias("own_worst")
    )


def scores(pairs: DataFrame, vulns: DataFrame) -> DataFrame:
    """pairs(advisory_id, product_id, ...) with cves, cvss, cvss_vector and has_patch.

    Those of the product, or where nothing names it, or nothing that does has a score, the advisory's.
    """
    out = pairs.join(leaf_facts(vulns), ["advisory_id", "product_id"], "left").join(advisory_facts(vulns), "advisory_id", "left")
    none = F.array().cast("array<string>")
    own = F.col("own_worst.score").isNotNull()
    return out.select(
        *pairs.columns,
        F.when(F.size(F.coalesce("own_cves", none)) > 0, F.col("own_cves")).otherwise(F.coalesce("all_cves", none)).alias("cves"),
        F.when(own, F.col("own_worst.score")).otherwise(F.col("all_worst.score")).alias("cvss"),
        F.coalesce(F.when(own, F.col("own_worst.vector")).otherwise(F.col("all_worst.vector")), F.lit("")).alias("cvss_vector"),
        F.coalesce("has_patch", F.lit(False)).alias("has_patch"),
    )


def status_gate(vulns: DataFrame) -> DataFrame:
    """(advisory_id, product_id, keep, gate_note) by what the vendor states; a missing pair is kept."""
    stated = vulns.select("advisory_id", F.explode("status").alias("name", "ids")).where(F.col("name").isin(*STATUSES))
    stated = stated.select("advisory_id", F.array_position(F.array(*map(F.lit, STATUSES)), F.col("name")).cast("int").alias("n"), F.explode("ids").alias("product_id"))
    # one number for all that is stated of a product, as what an aggregate holds is what a task's memory holds
    flags = stated.groupBy("advisory_id", "product_id").agg(F.bit_or(F.expr("shiftleft(1, n - 1)")).alias("said"))
    said = lambda *names: F.col("said").bitwiseAND(sum(1 << STATUSES.index(x) for x in names)) != 0
    affected = said("known_affected", "first_affected", "last_affected")
    open_, clean, fixed = said("under_investigation"), said("known_not_affected"), said("fixed", "first_fixed")
    note = (
        F.when(affected, "")
        .when(open_, "vendor lists this product as under investigation")
        .when(clean, "vendor states not affected")
        .when(fixed, "vendor lists this product version as fixed")
        .otherwise("")
    )
    clear = ~affected & ~open_ & (clean | fixed)
    return flags.select("advisory_id", "product_id", (~clear).alias("keep"), note.alias("gate_note"))


def by_text(rows: DataFrame, texts: list[str], derived: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with what derived adds to the columns texts, made once for each distinct value of them.

    Products and version texts repeat, and patterns are what a key costs. Null texts are blank.
    """
    own = [F.coalesce(t, F.lit("")).alias(t) for t in texts]
    made = derived(rows.select(*own).distinct())
    new = [c for c in made.columns if c not in texts]
    table = cut(made.select(*(F.col(t).alias(f"text_{k}") for k, t in enumerate(texts)), *new))
    on = reduce(Column.__and__, (F.coalesce(rows[t], F.lit("")) == F.col(f"text_{k}") for k, t in enumerate(texts)))
    return rows.join(F.broadcast(table) if table.count() <= FEW else table, on).select(*(rows[c] for c in rows.columns), *new)


def with_ranges(rows: DataFrame) -> DataFrame:
    """rows with the range of version_text as rng."""
    return by_text(rows, ["version_text"], lambda d: d.withColumn("rng", versions.parse_range("version_text")))


def keyed_leaves(corpus: Corpus, aliases: dict[str, str] | None = None) -> DataFrame:
    """Leaves with adv_ord, vendor_key, key, rng, idents, cpe_key, keep and gate_note.

    They are joined as narrow as they come, and kept; keys and ranges are added where they are read.
    """
    vendors = lambda d: d.withColumn("vendor_key", keys.vendor_key("vendor", aliases))
    products = lambda d: vendors(d).withColumn("key", keys.product_key("product_name", F.col("vendor_key"), aliases))
    gate = status_gate(corpus.vulns).where("not keep or gate_note <> ''")  # the rest says what a missing pair does
    out = corpus.leaves.join(gate, ["advisory_id", "product_id"], "left").join(corpus.advisories.select("advisory_id", "adv_ord"), "advisory_id")
    out = kept(out.withColumns({"keep": F.coalesce("keep", F.lit(True)), "gate_note": F.coalesce("gate_note", F.lit(""))}))
    out = with_ranges(by_text(out, ["vendor", "product_name"], products))
    return out.withColumns({
        "idents": F.filter(F.array_distinct(F.transform(F.concat("skus", "model_numbers"), keys.ident_key)), lambda x: x != ""),
        "cpe_key": keys.cpe_key("cpe"),
    })


def keyed_assets(assets: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Assets with vendor_key, key, ver, model_key, cpe_key and recognised."""
    out = assets.withColumn("vendor_key", keys.vendor_key("vendor", aliases))
    out = out.withColumn("key", keys.product_key("product", F.col("vendor_key"), aliases))
    out = out.withColumns({"ver": versions.parse_version("version"), "model_key": keys.ident_key("model"), "cpe_key": keys.cpe_key("cpe")})
    return out.withColumn("recognised", (F.col("vendor_key") != "") | (F.col("model_key") != "") | (F.col("key.core") != ""))


def revisions(advisories: DataFrame) -> DataFrame:
    """One row for each advisory of files that may repeat an id.

    advisories: advisory_id, title, revised, published, source_path, ... Files of one title are
    revisions: the newest stays, the last path of equals. Files of different titles are different
    advisories: all stay, and all but the first get a ~n suffix. First is whose file name is the id,
    then whose folders have the id's family, then the path.
    """
    by = Window.partitionBy("advisory_id")
    parts = F.split(F.upper("source_path"), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    own = F.array_contains(parts, F.upper(F.substring_index("advisory_id", "-", 1)))
    titles = advisories.groupBy("advisory_id").agg(F.countDistinct("title").alias("titles"))
    out = advisories.join(titles, "advisory_id")
    newest = F.row_number().over(by.orderBy(F.desc("revised"), F.desc("published"), F.desc("source_path")))
    place = F.row_number().over(by.orderBy(stem != F.upper("advisory_id"), ~own, "source_path")) - 1
    out = out.withColumns({"newest": newest, "n": place}).where("titles > 1 or newest = 1")
    named = F.when((F.col("titles") > 1) & (F.col("n") > 0), F.concat("advisory_id", F.lit("~"), F.col("n").cast("string"))).otherwise(F.col("advisory_id"))
    return out.withColumn("advisory_id", named).select(*advisories.columns)
