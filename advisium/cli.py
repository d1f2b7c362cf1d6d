"""Commands over a corpus folder: python -m advisium.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advisium.functions import keys
from advisium.operators import bench, enrich, evaluate, feedback, history, match, reports, search
from advisium.operators.corpus import Corpus, keyed_assets
from advisium.session import cut, shared
from advisium.sources import csaf, inventory

DECISIONS = "vendor_key string, asset_product_key string, adv_product_key string, decision string, analyst string, decided_at string, note string, asset_product_raw string, adv_product_raw string"


def _decisions(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder}/decisions.csv"
    return spark.read.schema(DECISIONS).option("header", True).csv(path).fillna("") if Path(path).exists() else spark.createDataFrame([], DECISIONS)


def _decide(spark: SparkSession, a: argparse.Namespace, rows: list) -> None:
    """Puts decisions on file in place of those on the same pairs; the file is whole at any time."""
    path = Path(a.corpus, "decisions.csv")
    new = spark.createDataFrame(rows, DECISIONS)
    table = feedback.record(_decisions(spark, a.corpus), new).orderBy(*feedback.KEY).toPandas()  # as many rows as people wrote
    part = path.with_name(f".{path.name}.{os.getpid()}")
    table.to_csv(part, index=False)
    os.replace(part, path)


def _review(spark: SparkSession, a: argparse.Namespace, found: DataFrame) -> None:
    """Shows pairs that wait, the weightiest first, and records what is answered; the end of input ends it."""
    found = cut(found)
    pairs = feedback.examples(found, cut(feedback.queue(found, a.limit))).collect()  # as many as a person is asked for
    if not pairs:
        print("nothing waits for review")
        return
    said = {"y": "CONFIRMED", "n": "REJECTED", "d": "DEFERRED"}
    decided = []
    for k, r in enumerate(pairs, 1):
        print(f"[{k}/{len(pairs)}] tier {r.tier}, {r.findings} findings of {r.advisories} advisories, CVSS up to {r.cvss:.1f}")
        print(f"  asset    {r.asset_vendor} / {r.asset_product}, such as {r.asset_id}\n  advisory {r.vendor} / {r.product}, such as {r.advisory_id}\n  {r.basis}")
        try:
            answer = input("  the same product? y, n, d (decide later), s (skip), q (quit): ").strip().lower()
        except EOFError:
            print()
            break
        if answer == "q":
            break
        if answer in said:
            now = datetime.now(UTC).isoformat(timespec="seconds")
            decided.append((r.asset_vendor_key, r.asset_product_key, r.adv_product_key, said[answer], a.analyst, now, "", r.asset_product, r.product))
    if decided:
        _decide(spark, a, decided)
    print("on file: " + (", ".join(f"{r.n} {r.decision}" for r in feedback.counts(_decisions(spark, a.corpus)).orderBy("decision").collect()) or "nothing"))


def _feed(a: argparse.Namespace, given: str | None, name: str) -> str | None:
    """A feed's file: the one given, or the one kept beside the corpus, or none."""
    kept = f"{a.corpus}/feeds/{name}"
    return given or (kept if Path(kept).exists() else None)


def _findings(spark: SparkSession, a: argparse.Namespace, assets: DataFrame, corpus: Corpus, **kw) -> DataFrame:
    return match.match_assets(assets, corpus, a.max_tier, feedback.latest(_decisions(spark, a.corpus)), aliases=_aliases(a), **kw)


def _scored(spark: SparkSession, a: argparse.Namespace, assets: DataFrame, corpus: Corpus) -> DataFrame:
    kev, epss = _feed(a, a.kev, "known_exploited_vulnerabilities.json"), _feed(a, a.epss, "epss_scores.csv")
    return enrich.scored(_findings(spark, a, assets, corpus), inventory.kev(spark, kev), inventory.epss(spark, epss), corpus=corpus)


def _aliases(a: argparse.Namespace) -> dict[str, str] | None:
    return keys.alias_table(inventory.aliases(Path(a.vendor_aliases).read_text(encoding="utf-8"))) if a.vendor_aliases else None


def _warn(assets: DataFrame, aliases: dict[str, str] | None) -> None:
    n = inventory.unrecognised(keyed_assets(assets, aliases)).count()
    if n:
        print(f"warning: {n} rows have no vendor, product or model", file=sys.stderr)


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.command == "update":
        csaf.read(spark, a.source).stored().save(a.corpus, "overwrite")
        search.save(Corpus.load(spark, a.corpus), f"{a.corpus}/index")
    corpus = Corpus.load(spark, a.corpus)
    if a.command in ("update", "stats"):
        evaluate.percentages(evaluate.stats(corpus)).show(vertical=True)
        if getattr(a, "by_year", False):
            evaluate.by_year(corpus).show(100)
    elif a.command == "coverage":
        leaves = cut(csaf.read(spark, a.source).leaves) if a.source else corpus.leaves
        evaluate.coverage(leaves).show(a.limit, False)
        print(f"ranges that no version can be in: {evaluate.unsatisfiable(leaves).count()}")
    elif a.command == "search":
        stored = search.load(spark, f"{a.corpus}/index") if Path(a.corpus, "index").exists() else None
        search.search_corpus(corpus, a.query, a.limit, stored).show(a.limit, False)
    elif a.command == "match":
        assets = inventory.read(spark, a.assets)
        _warn(assets, _aliases(a))
        for r in match.near_misses(assets, corpus, _aliases(a)).collect():  # a row for each unknown vendor
            print(f"warning: no vendor {r.vendor_key}; meant {r.suggestion}?", file=sys.stderr)
        out = _scored(spark, a, assets, corpus)
        out = enrich.of_priority(out, a.priority.split(",")) if a.priority else out
        if a.out:
            reports.json_lines(out).write.mode("overwrite").text(a.out)
        else:
            print(reports.render_json(out)) if a.json else reports.flat(enrich.in_order(out)).show(a.limit, 90)
    elif a.command == "report":
        paths = sorted(map(str, Path(a.assets).glob("*.csv"))) if Path(a.assets).is_dir() else [a.assets]
        assets = inventory.read_all(spark, paths)
        if a.client and len(paths) == 1:
            assets = assets.withColumn("inventory", F.lit(a.client))
        scored = _scored(spark, a, assets, corpus).checkpoint()
        sizes = assets.groupBy("inventory").agg(F.count("*").alias("assets")).checkpoint()
        total, stamp = corpus.advisories.count(), datetime.now(UTC).isoformat(timespec="seconds")
        Path(a.out).mkdir(parents=True, exist_ok=True)
        for r in sizes.collect():  # a row for each inventory
            own = scored.where(F.col("inventory") == r.inventory)
            text = reports.render_markdown(own, r.inventory, r.assets, total)
            Path(a.out, f"{r.inventory}.md").write_text(text, encoding="utf-8")
            if a.print:
                print(text)
            history.record(spark, f"{a.corpus}/history", r.inventory, stamp, r.assets, own)
        links = {r.inventory: f"{r.inventory}.md" for r in sizes.collect()}
        Path(a.out, "portfolio.md").write_text(reports.render_portfolio(scored, sizes, a.org, links), encoding="utf-8")
    elif a.command == "vex":
        text = reports.render_vex(_findings(spark, a, inventory.read(spark, a.assets), corpus, include_not_affected=True), a.author)
        Path(a.out).write_text(text, encoding="utf-8") if a.out else print(text, end="")
    elif a.command == "diff":
        found = history.diff_last(spark, f"{a.corpus}/history", a.label)
        if found is None:
            print(f"fewer than two runs of {a.label!r}", file=sys.stderr)
            return 1
        found.orderBy("change", "asset_id", "advisory_id").show(a.limit, False)
    elif a.command == "eval":
        rows = evaluate.quality(evaluate.confusion(inventory.read_labels(spark, a.labels), _findings(spark, a, inventory.read(spark, a.assets), corpus))).checkpoint()
        rows.show()
        return 0 if evaluate.gate(rows, a.min_precision) else 1
    elif a.command == "bench":
        assets = inventory.read(spark, a.assets)
        for n in map(int, a.sizes.split(",")):
            began = time.time()
            _findings(spark, a, bench.replicate(assets, n), corpus).write.format("noop").mode("overwrite").save()
            print(f"{n} assets: {time.time() - began:.2f} s")
    elif a.command == "review":
        _review(spark, a, _findings(spark, a, inventory.read(spark, a.assets), corpus))
    elif a.command == "decide":
        row = (*a.pair, a.decision.upper(), a.analyst, datetime.now(UTC).isoformat(timespec="seconds"), a.note, a.pair[1], a.pair[2])
        _decide(spark, a, [row])
    elif a.command == "aliases":
        rows = feedback.aliases(_decisions(spark, a.corpus))
        print(json.dumps([r.asDict() for r in rows.collect()], indent=2)) if a.json else rows.show(10_000, False)  # as many as people wrote
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="advisium", description=__doc__)
    top.add_argument("--corpus", default="corpus", help="folder of the corpus, its history, feeds and decisions.csv")
    top.add_argument("--vendor-aliases", help="YAML file with more spellings of vendors, under vendor_aliases")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, tier: int | None = None, limit: int | None = None, assets: bool = False, feeds: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        if assets:
            p.add_argument("assets", help="inventory file" + " or folder of them" * (name == "report"))
        if tier is not None:
            p.add_argument("--max-tier", type=int, choices=(4, 5) if name == "review" else range(6), default=tier)
        if limit is not None:
            p.add_argument("--limit", type=int, default=limit)
        if feeds:
            p.add_argument("--kev", help="feed of known exploited vulnerabilities, a file")
            p.add_argument("--epss", help="feed of exploitation scores, a file")
        return p

    command("update", "read advisories").add_argument("source", help="folder of CSAF files")
    command("search", "search advisories", limit=25).add_argument("query")
    p = command("match", "match an inventory", 4, 50, True, True)
    p.add_argument("--json", action="store_true")
    p.add_argument("--priority", help="of NOW,NEXT,TRACK,LATER")
    p.add_argument("--out", help="folder for findings as JSON lines, written by all executors")
    p = command("report", "write reports and a rollup", 4, assets=True, feeds=True)
    p.add_argument("--out", default="reports")
    p.add_argument("--org", default="")
    p.add_argument("--client", help="name of a single inventory, in place of its file's")
    p.add_argument("--print", action="store_true", help="print the reports as well")
    p = command("vex", "write an OpenVEX document", 4, assets=True)
    p.add_argument("--author", default="advisium")
    p.add_argument("--out", help="file to write; else it is printed")
    command("diff", "changes since the last run", limit=20).add_argument("label")
    p = command("eval", "precision and recall", 5, assets=True)
    p.add_argument("labels")
    p.add_argument("--min-precision", type=float, default=0.0)
    command("bench", "time matching", 4, assets=True).add_argument("--sizes", default="100,1000,5000")
    command("review", "ask an analyst about pairs that wait", 4, 25, True).add_argument("--analyst", default="")
    p = command("decide", "put a decision on file")
    p.add_argument("pair", nargs=3, metavar=("VENDOR_KEY", "ASSET_KEY", "ADVISORY_KEY"))
    p.add_argument("decision", choices=[d.lower() for d in feedback.DECISIONS])
    p.add_argument("--analyst", default="")
    p.add_argument("--note", default="")
    command("aliases", "confirmed pairs").add_argument("--json", action="store_true")
    command("stats", "counts of the corpus").add_argument("--by-year", action="store_true")
    command("coverage", "how ranges are read", limit=12).add_argument("--source", help="folder of CSAF files, in place of the corpus")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("advisium").getOrCreate()
    shared(spark)
    return run(spark, a)


if __name__ == "__main__":
    sys.exit(main())
