"""Benchmark decontamination: rare n-gram seeds join documents to test items, Smith-Waterman scores them.

A seed is two words that follow each other in an item; a document holds it where it has them in that
order with at most one word between. One scan of the documents keeps, for each distinct text, the
seeds that it may hold; what follows are joins of that table with the items, whatever their number.

No leak is lost. Let an alignment match k words of an item of m, skip or change x of the item's and
insert i; it is a leak if 2k - x - i >= m. Of its k - 1 steps from match to match at least
ceil(m / 3) - 1, and at least one if m > 3, go from a word of the item to the next with at most one
word between in the document: steps with x cost x, others two or more of i, and k + x <= m. So of the
item's m - 1 pairs the most common may be passed over: any set of all but ceil(m / 3) - 1 - j of them
has j or more in each leak. SEEDS is the most that j is. Counts are of all distinct texts.

Items of more than 2 * SPAN words are also held in windows of that many, so a part of SPAN words in a
row is found in an item of any length. Items of 2 or 3 words are leaked by their words in a row, those
of one word by a text of just that word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from advisium.llm.common import BITS, bitmap, blocks, few, pair, passes, ready, signed, texts, word_hashes

#: Seeds that a document must hold of a long item, words of a part that counts as a leak, and words of an item that must be there whole.
SEEDS, SPAN, SHORT = 3, 20, 3
MATCH, MISMATCH, GAP = 2, -1, 1
#: Least alignment score as a share of the item's score against itself.
THRESHOLD = 0.5
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def hashes(text: str) -> np.ndarray:
    """A hash for each word; the words of a long text are never all held as strings."""
    return word_hashes(words(x) for x in blocks(text))


def alone(h: np.ndarray) -> np.ndarray:
    """The seed of a text of one word."""
    return pair(h, np.zeros_like(h))


def units(size: int) -> list[tuple[int, int]]:
    """What of an item of so many words is looked for: the whole, and windows of a long one."""
    wide = 2 * SPAN
    if size <= wide:
        return [(0, size)]
    return [(0, size), *((s, s + wide) for s in range(0, size - wide, SPAN)), (size - wide, size)]


def enough(size: int, most: int = SEEDS) -> tuple[int, int]:
    """(seeds to choose, seeds to hold) of a unit of so many words."""
    if size <= SHORT:
        return max(1, size - 1), max(1, size - 1)
    sure = max(1, math.ceil(size / 3) - 1)
    need = min(most, sure)
    return size - 1 - sure + need, need


def text_key(text: Column) -> list[Column]:
    """128 bits that tell texts apart; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2")]


class Items:
    """Test items as word ids."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        self.vocab: dict[str, int] = {}
        self.item_ids = [i for i, _ in rows]
        self.words = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], np.int64) for _, ws in rows]
        self.own = [np.unique(w) for w in self.words]

    def ids(self, text: str) -> np.ndarray:
        return np.concatenate([np.fromiter(map(self.vocab.get, words(x), repeat(0)), np.int64) for x in blocks(text)])

    def stretches(self, n: int, ids: np.ndarray) -> list[np.ndarray]:
        """Parts of a document's words outside of which item n has no alignment that is a leak.

        With MATCH for each word of the item and -1 for any other, no alignment is above the best sum of
        a stretch.
        """
        size, own = len(self.words[n]), self.own[n]
        held = own[np.searchsorted(own, ids).clip(max=len(own) - 1)] == ids
        total = np.cumsum(np.where(held, MATCH, -1))
        best = total - np.minimum(np.minimum.accumulate(total), 0)
        ends = np.flatnonzero(held & (best >= THRESHOLD * MATCH * min(size, 2 * SPAN)))
        if not len(ends):
            return []
        cut = np.flatnonzero(np.diff(ends) > 2 * size) + 1
        return [ids[max(0, int(x[0]) - 2 * size) : int(x[-1]) + 1] for x in np.split(ends, cut)]


def align(items: list[np.ndarray], parts: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each item with its part of a document; word 0 matches nothing."""
    best = np.zeros(len(items), np.int32)
    order = sorted(range(len(items)), key=lambda i: (len(parts[i]), len(items[i])))
    at = 0
    while at < len(order):
        longest, some = len(parts[order[at]]), []
        while at < len(order) and len(some) < 256 and (len(parts[order[at]]) <= 1.3 * longest + 16) and len(some) * len(parts[order[at]]) < 2_000_000:
            some.append(order[at])
            at += 1
        m, n = max(len(items[i]) for i in some), max(len(parts[i]) for i in some)
        a, b = np.full((len(some), m), -1, np.int32), np.zeros((len(some), n), np.int32)
        for r, i in enumerate(some):
            a[r, : len(items[i])] = items[i]
            b[r, : len(parts[i])] = parts[i]
        slope = (GAP * np.arange(1, n + 1)).astype(np.int32)
        row, top = np.zeros((len(some), n + 1), np.int32), np.zeros(len(some), np.int32)
        for i in range(m):
            score = np.where(a[:, i : i + 1] == b, MATCH, MISMATCH)
            cell = np.maximum(np.maximum(row[:, :-1] + score, row[:, 1:] - GAP), 0)
            row[:, 1:] = np.maximum.accumulate(cell + slope, axis=1) - slope
            top = np.maximum(top, row.max(axis=1))
        best[some] = top
    return best


def _whole(batch: list[tuple[list[str], str]]) -> list[tuple[float, bool]]:
    """(score, leaked) of each pair of an item's words and a text."""
    items = Items([(n, ws) for n, (ws, _) in enumerate(batch)])
    jobs: list[tuple[int, int, int, np.ndarray]] = []
    last, ids = None, np.empty(0, np.int64)
    for n, (ws, text) in enumerate(batch):
        if text is not last:
            last, ids = text, items.ids(text)
        if len(ws) == 1 and (len(ids) > 1 or not len(ids)):
            continue
        jobs += [(n, s, e, part) for part in items.stretches(n, ids) for s, e in units(len(ws))]
    out = [(0.0, False)] * len(batch)
    if jobs:
        best = align([items.words[n][s:e] for n, s, e, _ in jobs], [part for *_, part in jobs])
        for (n, s, e, _), top in zip(jobs, best.tolist(), strict=True):
            share = top / (MATCH * (e - s))
            score, leaked = out[n]
            out[n] = (max(score, share) if e - s == len(items.words[n]) else score, leaked or share >= (THRESHOLD if e - s > SHORT else 1))
    return out


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words, units): distinct items that have words; each unit as (size, choose, need, seeds)."""

    most = SEEDS

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = pa.struct([("n", pa.int32()), ("choose", pa.int32()), ("need", pa.int32()), ("seeds", pa.list_(pa.int64()))])
        for part in parts:
            ids, found, all_units = [], [], []
            for i, text in zip(part.column("item_id").to_pylist(), texts(part), strict=True):
                if not (ws := words(text)):
                    continue
                h = hashes(text)
                seeds = signed(pair(h[:-1], h[1:]) if len(h) > 1 else alone(h))
                ids.append(i)
                found.append(ws)
                own = [(n, *enough(e - s, most), seeds[s : max(e - 1, s + 1)]) for n, (s, e) in enumerate(units(len(ws)))]
                all_units.append([dict(zip(("n", "choose", "need", "seeds"), x, strict=True)) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(all_units, pa.list_(unit))], ["item_id", "words", "units"])

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    schema = "item_id long, words array<string>, units array<struct<n:int,choose:int,need:int,seeds:array<bigint>>>"
    return rows.mapInArrow(run, schema).withColumn("item", F.monotonically_increasing_id()).checkpoint()


def _held(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(t1, t2, seeds): the distinct seeds that each distinct text may hold; texts without any are left out."""
    bits, table = bitmap(seeds, "seed", BITS)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found, rows = [], []
            for r, text in enumerate(texts(part)):
                h = hashes(text)
                every = np.concatenate([pair(h[:-1], h[1:]), pair(h[:-2], h[2:])]) if len(h) > 1 else alone(h)
                every = every[passes(every, bits, sent.value)]
                if len(every):
                    rows.append(r)
                    found.append(np.unique(every))
            if rows:
                ends = np.cumsum([0, *map(len, found)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(np.concatenate(found))))
                yield pa.RecordBatch.from_arrays([part.column("t1").take(pa.array(rows)), part.column("t2").take(pa.array(rows)), lists], ["t1", "t2", "seeds"])

    rows = docs.select(*text_key(F.col("text")), "text").mapInArrow(run, "t1 long, t2 long, seeds array<long>")
    return rows.dropDuplicates(["t1", "t2"])


def _chosen(items: DataFrame, held: DataFrame) -> DataFrame:
    """(seed, item, n, w, need): the rarest seeds of each unit; w counts their places in it."""
    places = items.select("item", F.explode("units").alias("u")).select("item", "u.n", "u.choose", "u.need", F.explode("u.seeds").alias("seed"))
    own = places.groupBy("item", "n", "choose", "need", "seed").agg(F.count("*").alias("w"))
    counts = held.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count("*").alias("texts"))
    by = Window.partitionBy("item", "n").orderBy("texts", "seed").rowsBetween(Window.unboundedPreceding, -1)
    # a seed that no text holds takes its place among the rarest, but need not be joined
    ranked = own.join(counts, "seed", "left").withColumn("texts", F.coalesce("texts", F.lit(0))).withColumn("before", F.coalesce(F.sum("w").over(by), F.lit(0)))
    return ranked.where("before < choose and texts > 0").select("seed", "item", "n", "w", "need")


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(t1, t2, item_id, score, n_seeds): items that each distinct text holds."""
    ready(docs.sparkSession)
    items = _items(benchmark)
    seeds = items.select(F.explode("units.seeds").alias("s")).select(F.explode("s").alias("seed")).distinct()
    held = _held(docs, seeds).checkpoint()
    # both sides of the join are cut, so that adaptive execution can split a seed that many texts hold
    chosen = _chosen(items, held).checkpoint()
    hits = held.select("t1", "t2", F.explode("seeds").alias("seed")).join(chosen, "seed")
    near = hits.groupBy("t1", "t2", "item", "n", "need").agg(F.sum("w").alias("w"), F.count("*").alias("n_seeds")).where("w >= need")
    near = near.groupBy("t1", "t2", "item").agg(F.max("n_seeds").cast("int").alias("n_seeds")).checkpoint()
    keys = few(near.select("t1", "t2").distinct())
    whole = docs.select(*text_key(F.col("text")), "text").join(keys, ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    pairs = near.join(items.select("item", "item_id", "words"), "item").join(whole, ["t1", "t2"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            done = _whole(list(zip(part.column("words").to_pylist(), _shared(texts(part)), strict=True)))
            keep = pa.array([leaked for _, leaked in done], pa.bool_())
            columns = [part.column(c) for c in ("t1", "t2", "item_id")] + [pa.array([s for s, _ in done], pa.float64()), part.column("n_seeds")]
            yield pa.RecordBatch.from_arrays(columns, ["t1", "t2", "item_id", "score", "n_seeds"]).filter(keep)

    scored = pairs.mapInArrow(run, "t1 long, t2 long, item_id long, score double, n_seeds int")
    best = scored.groupBy("t1", "t2", "item_id").agg(F.max(F.struct("score", "n_seeds")).alias("x"))
    return best.select("t1", "t2", "item_id", "x.score", "x.n_seeds")


def _shared(found: list[str]) -> list[str]:
    """The same texts, equal neighbours as one object."""
    out: list[str] = []
    for text in found:
        out.append(out[-1] if out and out[-1] == text else text)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, n_seeds): items that a document holds, exact, edited or paraphrased.

    score: best local alignment over the item's score against itself, THRESHOLD to 1; under it where a
    window of a long item reaches THRESHOLD. n_seeds: chosen seeds that the document holds. Null texts
    hold nothing, and items that are null or without words match nothing. Ties: an item_id on several
    texts gives its best score. Repeated rows of documents give repeated rows, repeated items one.
    Null doc_ids stay null. Long texts are read whole, their words a block at a time. Other columns are
    not read. Without items or documents the result is empty.
    """
    found = few(_found(docs, benchmark))
    rows = docs.select(F.col("doc_id").cast("long"), *text_key(F.col("text")))
    return rows.join(found, ["t1", "t2"]).select("doc_id", "item_id", "score", "n_seeds")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item as leaks() tells, with all their columns, whatever their names.

    Null and empty texts hold nothing and stay, as do null doc_ids; equal texts stay or go together.
    """
    gone = few(_found(docs, benchmark).select("t1", "t2").distinct())
    t1, t2 = text_key(docs["text"])
    return docs.join(gone, (t1 == gone["t1"]) & (t2 == gone["t2"]), "left_anti")
