"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advisium.llm.common import ready, words_column

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for was on are as by this from or an at a he "
    "le la les de des du un une et en que qui dans par pour sur au aux est pas avec ce se "
    "der die das und den dem ein eine im in zu mit von auf ist nicht für als auch es "
    "el los las del que y en un una por con para su al lo como es se"
).split()
STOP_WORDS = tuple(dict.fromkeys(STOP_WORDS))


class Rule(NamedTuple):
    """Passes if at_least * of <= 100 * part <= at_most * of; None is no bound."""

    name: str
    part: str
    of: str
    at_least: int | None
    at_most: int | None


#: Percentages: word length in characters, symbols and stop words per word, repeated lines per line.
RULES = (
    Rule("word_length", "word_chars", "n_words", 150, 2000),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 5, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50),
)
MIN_WORDS, MAX_REPEATED = 50, 50


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """One Boolean expression of the table; counts are the columns that rules name."""
    out = F.lit(True)
    for r in rules:
        part, of = F.col(r.part) * 100, F.col(r.of)
        if r.at_least is not None:
            out = out & (part >= of * r.at_least)
        if r.at_most is not None:
            out = out & (part <= of * r.at_most)
    return out


def _covered(places: Column) -> Column:
    """Words that three-word windows at these ascending places cover."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + 3 - F.greatest(a["end"] - p, F.lit(0))).alias("n")),
        lambda a: a["n"],
    )


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules use, one row per row. Null text: no words, no lines."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("t"), words_column(F.col("text")).alias("w"))
    window = lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(3)))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        lines.alias("lines"),
        # windows are compared by a 64-bit hash of their three words
        F.when(F.size("w") < 3, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.size("w") - 3), window)).alias("h"),
    )
    d = d.withColumn("repeats", F.size(F.array_distinct("h")) < F.size("h"))
    d = d.withColumn("s", F.when(F.col("repeats"), F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: F.get("s", i)["h"].eqNullSafe(x["h"])
    places = F.transform(F.filter("s", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_stop_words",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("repeats"), _covered(F.array_sort(places))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and verdicts of whole texts, one row per row, in one projection without a shuffle.

    doc_id, n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept. Null and empty texts have zero counts, fail the base and are not kept; null
    doc_ids stay null; repeated rows give repeated rows; other columns are not read.
    """
    ready(docs.sparkSession)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return counts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & compiled(rules)).alias("kept"),
    )


def _sql_rule(r: Rule) -> str:
    bounds = [f"{r.part} * 100 >= {r.of} * {r.at_least}"] * (r.at_least is not None)
    bounds += [f"{r.part} * 100 <= {r.of} * {r.at_most}"] * (r.at_most is not None)
    return " AND ".join(bounds)


def sql() -> str:
    ws = "[\\x20\\x09-\\x0D]"
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) >= 3),
k AS (SELECT r, p, count(*) OVER (PARTITION BY r, w[p], w[p + 1], w[p + 2]) AS n FROM g),
c AS (SELECT r, count(DISTINCT q) AS n_repeat_words
      FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM k WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{ws}+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(map(_sql_rule, RULES))} AS kept FROM b"""
