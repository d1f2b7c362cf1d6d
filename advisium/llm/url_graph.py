"""URL filters: fixed rules, and trust and distrust that spread over the links between hosts.

Everything is DataFrame expressions. Pages under an allow rule are trusted seeds of their host,
pages under a block rule blocked seeds. Trust is a personalised PageRank from trusted seeds along
links; distrust is one from blocked seeds against them. Both are in pages, so that they compare. A
host is blocked if distrust is over THRESHOLD of its trust and distrust together.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advisium.llm.common import ascii_lower, ready


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)
DAMPING, ROUNDS, THRESHOLD = 0.85, 10, 0.5
#: Hosts of absolute links; relative links stay on their host and move no trust.
LINK = "(?i)href\\s*=\\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\\s>]+)"


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.call_function("substr", url, F.call_function("locate", F.lit("://"), url) + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _best(rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits host and path, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, summed over pages."""
    host, _ = host_path(F.col("url"))
    found = pages.select(host.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    found = found.select("src", ascii_lower(F.col("dst")).alias("dst"))
    return found.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) after some rounds. seeds: (host, kind t or d, seed); edges: (src, dst, n).

    An edge carries trust from src to dst by its share of the links out of src, and distrust from
    dst to src by its share of the links into dst. Without edges the seeds are the fixed point.
    """
    seeds = seeds.checkpoint()
    state = seeds.select("host", "kind", F.col("seed").cast("double").alias("score"))
    edges = edges.checkpoint()
    if not edges.isEmpty():
        # cut, so that a host with a third of all links can be split in the joins
        out = edges.groupBy("src").agg(F.sum("n").alias("total")).checkpoint()
        into = edges.groupBy("dst").agg(F.sum("n").alias("total")).checkpoint()
        share = (F.col("n") / F.col("total")).alias("share")
        moves = (
            edges.join(out, "src").select(F.col("src").alias("host"), F.lit("t").alias("kind"), F.col("dst").alias("to"), share)
            .union(edges.join(into, "dst").select(F.col("dst").alias("host"), F.lit("d").alias("kind"), F.col("src").alias("to"), share))
            .checkpoint()
        )
        back = seeds.select("host", "kind", (F.col("seed") * (1 - damping)).alias("score"))
        for k in range(rounds):
            moved = state.join(moves, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (F.col("score") * F.col("share") * damping).alias("score"))
            state = moved.union(back).groupBy("host", "kind").agg(F.sum("score").alias("score"))
            if k % 3 == 2:
                state = state.checkpoint()
    mass = lambda kind: F.round(F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)), 9)
    return state.groupBy("host").agg(mass("t").alias("trust"), mass("d").alias("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    A rule's verdict holds where one fits (the longest wins); else the host's: block if its distrust
    is over the threshold, else allow, also for hosts that no seed reaches. Urls that are null or
    without :// have an empty host and path, no rule, and are allowed. Null html has no links.
    Repeated rows give repeated rows and count as often; other columns are not read.
    """
    ready(pages.sparkSession)
    host, path = host_path(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    named = named.withColumn("best", _best(rules)).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"))
    seeds = (
        named.where("rule is not null")
        .groupBy("host", F.when(F.col("ruled") == "allow", "t").otherwise("d").alias("kind"))
        .agg(F.count("*").alias("seed"))
    )
    bad = propagate(seeds, host_edges(pages)).where(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")))
    bad = bad.where("host <> ''").select("host", F.lit("block").alias("spread")).checkpoint()  # cut: a host may have many pages
    return named.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "spread", F.lit("allow")).alias("verdict"))


def sql() -> str:
    cases = sorted(RULES, key=lambda r: (-len(r.name), r.name))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in cases) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in cases) + " END"
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = LINK.replace("'", "''")
    rounds = "".join(
        f""",
s{k + 1} AS (SELECT host, kind, sum(score) AS score FROM (
  SELECT m.dst AS host, kind, s.score * m.share * {DAMPING} AS score FROM s{k} s JOIN moves m USING (host, kind)
  UNION ALL SELECT host, kind, seed * {1 - DAMPING} FROM seeds) GROUP BY ALL)"""
        for k in range(ROUNDS)
    )
    return f"""
WITH u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, {low("regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1)")} AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
n AS (SELECT page_id, host, path, {rule} AS rule, {ruled} AS ruled FROM p),
seeds AS (SELECT host, CASE WHEN ruled = 'allow' THEN 't' ELSE 'd' END AS kind, count(*) AS seed FROM n WHERE rule IS NOT NULL GROUP BY ALL),
l AS (SELECT host AS src, {low("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst FROM p),
e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
moves AS (SELECT src AS host, 't' AS kind, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM e
          UNION ALL SELECT dst, 'd', src, n / sum(n) OVER (PARTITION BY dst) FROM e),
s0 AS (SELECT host, kind, seed::DOUBLE AS score FROM seeds){rounds},
last AS (SELECT * FROM s{ROUNDS} WHERE EXISTS (FROM e) UNION ALL SELECT * FROM s0 WHERE NOT EXISTS (FROM e)),
h AS (SELECT host, round(coalesce(sum(score) FILTER (kind = 't'), 0), 9) AS trust, round(coalesce(sum(score) FILTER (kind = 'd'), 0), 9) AS distrust FROM last GROUP BY host)
SELECT page_id, n.host, path, rule, coalesce(ruled, CASE WHEN n.host <> '' AND distrust > {THRESHOLD} * (trust + distrust) THEN 'block' END, 'allow') AS verdict
FROM n LEFT JOIN h ON n.host = h.host"""
