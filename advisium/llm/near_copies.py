"""Near copies by SimHash anchors, MinHash bands, and the exact Jaccard similarity of five-word shingles.

Texts link if the similarity of their shingle sets is 0.8 or more. Candidates come in two ways. The
anchors of simhash.py tie fingerprints of five-word shingles within two bits, which are the closest
copies. At similarity 0.8 fingerprints differ in about ten bits, and no covering code reaches those with
few anchors. So BANDS keys of each set tie the rest, each of the least values of ROWS permutations of
its shingles: two sets of similarity s share a key but with probability (1 - s ** ROWS) ** BANDS, which
is under 3e-7 at 0.8 and less above. Of the sets of a key, in order of size, each is tied to the one
before it if 0.8 of its size is reached, so a key makes fewer rows than it has texts.

The components of these ties hold every link. First each set is held against one that it is tied to: a
group that this joins already, such as one of close copies of any number, is done. What is left is
checked on whole sets: a component in one task if it has at most WEIGHT shingles, else in pairs of
blocks of about half of that, so a task's memory has a bound and a group of any size is checked whole.
Of the links that a task finds it returns a tree.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advisium.llm import simhash
from advisium.llm.common import blocks, few, remove, scratch, signed, texts, word_hashes
from advisium.llm.components import components

#: Similarity as a fraction: whole numbers have no rounding.
SHINGLE, OVER, UNDER = 5, 4, 5
#: Keys of a set, and permutations for each.
BANDS, ROWS = 50, 6
#: Shingles that are checked together at most, or two texts if they have more.
WEIGHT = 1_500_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MIX = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted; words as in simhash, and fewer than five are one shingle."""
    h = word_hashes(x.encode().lower().split() for x in blocks(text))
    if not len(h):
        return h
    width = min(SHINGLE, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : len(h) - width + 1 + k]) * _M1
        out ^= out >> np.uint64(32)
    out *= _M2
    return np.unique(out ^ (out >> np.uint64(29)))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets reach the similarity; two empty ones do."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * UNDER >= OVER * (len(a) + len(b) - both)


def prefix(found: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set by (rank, hash), as many as a similar set cannot all lack."""
    least = -(-OVER * len(found) // UNDER)
    return found[np.lexsort((found, rank))[: len(found) - least + 1]]


def bands(found: np.ndarray) -> np.ndarray:
    """The keys of a set; an empty set has none."""
    if not len(found):
        return found
    step = max(1, (1 << 17) // len(found))
    least = [(np.bitwise_xor.outer(_MIX[0, k : k + step], found) * _MIX[1, k : k + step, None]).min(axis=1) for k in range(0, BANDS * ROWS, step)]
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _M2
    for x in np.concatenate(least).reshape(BANDS, ROWS).T:
        out = (out ^ x) * _M1
        out ^= out >> np.uint64(32)
    return out


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, t, h, n, fp, keys): t a hash of the text, h and n of the shingle set, fp its fingerprint, keys its bands."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [shingles(text) for text in texts(part)]
            long = lambda x: pa.array(signed(np.array(x, np.uint64)))
            cols = [long([xxhash.xxh3_64_intdigest(x.tobytes()) for x in found]), pa.array([len(x) for x in found], pa.int32()), long([simhash.majority(x) for x in found])]
            keys = pa.array([signed(bands(x)) for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), *cols, keys], ["doc_id", "t", "h", "n", "fp", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text").mapInArrow(run, "doc_id long, t long, h long, n int, fp long, keys array<long>")


def _ties(rows: DataFrame) -> DataFrame:
    """(a, b) of sets that follow each other among those of a key, by size: rows(key, n, h).

    Rows are sorted over all partitions, so a key that many sets have is many tasks' work. A task does
    not see the row before its first: the first and last row of each partition meet on the driver.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, border = TaskContext.get().partitionId(), None, []
        for part in parts:
            if not part.num_rows:
                continue
            now = [part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "h")]
            if last is None:
                border.append((1, *(int(x[0]) for x in now)))
                last = [x[:0] for x in now]
            key, n, h = (np.concatenate(x) for x in zip(last, now, strict=True))
            last = [x[-1:] for x in now]
            on = (key[1:] == key[:-1]) & (h[1:] != h[:-1]) & (n[:-1].astype(np.int64) * UNDER >= n[1:].astype(np.int64) * OVER)
            pairs = np.unique(np.stack([h[1:][on], h[:-1][on]]), axis=1)
            none = np.zeros(pairs.shape[1], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((none, none, none, none, *pairs), kinds, strict=True)], names)
        if last is not None:
            border.append((2, *(int(x[0]) for x in last)))
        for kind, key, n, h in border:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((kind, at, key, n, h, 0), kinds, strict=True)], names)

    names, kinds = ["kind", "at", "key", "n", "a", "b"], [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    # cut, so that borders and ties are of one run
    found = rows.repartitionByRange("key", "n", "h").sortWithinPartitions("key", "n", "h").mapInArrow(run, "kind int, at int, key long, n int, a long, b long").checkpoint()
    edge = sorted((r.at, r.kind, r.key, r.n, r.a) for r in found.where("kind > 0").collect())
    met = [(y[4], x[4]) for x, y in zip(edge, edge[1:], strict=False) if x[1] == 2 and x[2] == y[2] and x[4] != y[4] and x[3] * UNDER >= y[3] * OVER]
    return found.where("kind = 0").select("a", "b").union(rows.sparkSession.createDataFrame(met, "a long, b long")).distinct()


def groups(found: dict[int, np.ndarray]) -> dict[int, int]:
    """The least hash that links lead to, for each of some sets."""
    order = sorted(found, key=lambda h: (len(found[h]), h))
    table, counts = np.unique(np.concatenate([found[h] for h in order]), return_counts=True)
    root = {h: h for h in order}

    def top(h: int) -> int:
        while root[h] != h:
            root[h] = h = root[root[h]]
        return h

    seen: dict[int, dict[int, list[int]]] = defaultdict(dict)  # by shingle, sets by their root of then
    for h in order:
        mine = found[h]
        rank = counts[np.searchsorted(table, mine)]
        first = prefix(mine, rank)
        first = first[counts[np.searchsorted(table, first)] > 1].tolist()  # others meet nothing
        failed = set()
        for k in first:
            for r in list(seen[k]):
                if top(r) == top(h):
                    continue
                for other in seen[k][r]:
                    if other not in failed and len(found[other]) * UNDER >= OVER * len(mine):
                        if alike(found[other], mine):
                            a, b = sorted((top(other), top(h)))
                            root[b] = a
                            break
                        failed.add(other)
        for k in first:
            for r in [r for r in seen[k] if top(r) != r]:
                seen[k].setdefault(top(r), []).extend(seen[k].pop(r))
            seen[k].setdefault(top(h), []).append(h)
    return {h: top(h) for h in order}


def _sets(rows: DataFrame) -> DataFrame:
    """(h, n, set) of rows(h, text); rows that repeat an h give it once."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [shingles(text) for text in texts(part)]
            yield pa.RecordBatch.from_arrays([part.column("h"), pa.array([len(x) for x in found], pa.int32()), pa.array(map(signed, found), pa.list_(pa.int64()))], ["h", "n", "set"])

    return rows.mapInArrow(run, "h long, n int, set array<long>").dropDuplicates(["h"])


def _first(ties: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links among one tie of each set."""
    one = ties.groupBy("a").agg(F.min("b").alias("b"))
    end = lambda x: sets.select(F.col("h").alias(x), F.col("n").alias(f"n_{x}"), F.col("set").alias(f"set_{x}"))
    both = one.join(end("a"), "a").join(end("b"), "b").withColumn("both", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(F.col("both") * UNDER >= OVER * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _links(rows: DataFrame) -> DataFrame:
    """(a, b): the checked links of each unit's sets, as trees; rows(root, i, j, h, set)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}

        def out() -> Iterator[pa.RecordBatch]:
            tied = [(h, r) for h, r in groups(held).items() if h != r] if len(held) > 1 else []
            if tied:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*tied, strict=True)], ["a", "b"])

        for part in parts:
            units = zip(*(part.column(c).to_pylist() for c in ("root", "i", "j")), strict=True)
            column = part.column("set")
            flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
            for k, (unit, h) in enumerate(zip(units, part.column("h").to_pylist(), strict=True)):
                if unit != at:
                    yield from out()
                    at, held = unit, {}
                held[h] = flat[ends[k] : ends[k + 1]].view(np.uint64).copy()
        yield from out()

    return rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(run, "a long, b long")


def _units(sets: DataFrame) -> DataFrame:
    """rows(root, h, n, ...) with i and j: the pair of blocks that a row is checked in, each pair of them once."""
    m = F.when(F.col("weight") <= WEIGHT, 1).otherwise(F.ceil(2 * F.col("weight") / WEIGHT)).cast("int")
    weights = sets.groupBy("root").agg(F.sum("n").alias("weight")).select("root", m.alias("m")).checkpoint()
    own = F.pmod(F.xxhash64("h"), F.col("m")).cast("int")
    spread = sets.join(weights, "root").withColumn("own", own).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return spread.withColumns({"i": F.least("own", "k"), "j": F.greatest("own", "k")})


def _anchored(sets: DataFrame) -> DataFrame:
    """(a, b) of sets whose fingerprints SimHash anchors tie, or that share one; sets(h, fp)."""
    least = sets.groupBy("fp").agg(F.min("h").alias("rep")).checkpoint()
    links = simhash.links(least.select("fp"))
    ends = [least.select(F.col("fp").alias(x), F.col("rep").alias(f"h_{x}")) for x in ("a", "b")]
    tied = links.join(ends[0], "a").join(ends[1], "b").select(F.col("h_a").alias("a"), F.col("h_b").alias("b"))
    return tied.union(sets.join(least, "fp").where("h <> rep").select(F.col("h").alias("a"), F.col("rep").alias("b")))


def _gone(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(d, t) of the rows that go, and whether any row is repeated."""
    spark = docs.sparkSession
    top = scratch(spark, "near")
    named = docs.where("doc_id is not null").select("doc_id", "text")
    # a table of columns: most of what follows does not read the keys, which are nearly all of it
    _marked(named).write.parquet(top)
    marked = spark.read.parquet(top)
    ties = _ties(marked.select(F.explode("keys").alias("key"), "n", "h")).union(_anchored(marked.select("h", "fp").distinct())).checkpoint()
    roots = components(ties).select(F.col("node").alias("h"), "root").checkpoint()

    least = marked.groupBy("h").agg(F.min("doc_id").alias("doc_id")).checkpoint()
    firsts = marked.select("h", "n", "doc_id", "t").join(least, ["h", "doc_id"]).groupBy("h", "n", "doc_id").agg(F.min("t").alias("t")).checkpoint()
    tied = few(firsts.join(roots, "h").select("h", F.col("doc_id").alias("d"), "t"))
    texts_of = named.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"), "text").join(tied, ["d", "t"]).select("h", "text")
    sets = _sets(texts_of).checkpoint()
    # a component that one tie of each set joins already is done
    found = _first(ties, sets).checkpoint()
    label = components(found).select(F.col("node").alias("h"), F.col("root").alias("label"))
    labelled = roots.join(label, "h", "left").withColumn("label", F.coalesce("label", "h")).checkpoint()
    left = labelled.groupBy("root").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("root").checkpoint()
    close = _units(firsts.select("h", "n").join(labelled.join(left, "root", "left_semi"), "h")).select("root", "i", "j", "h")
    links = found.union(_links(close.join(sets.select("h", "set"), "h")))
    final = components(links).select(F.col("node").alias("h"), F.col("root").alias("final"))

    firsts = firsts.join(final, "h", "left").select("h", F.coalesce("final", "h").alias("final"), F.struct("doc_id", "t").alias("first")).checkpoint()
    kept = firsts.groupBy("final").agg(F.min("first").alias("kept")).checkpoint()
    kept = firsts.join(kept, "final").select("h", "kept").checkpoint()
    gone = few(marked.select("h", "doc_id", "t").join(kept, "h").where(F.struct("doc_id", "t") != F.col("kept")).select(F.col("doc_id").alias("d"), "t").distinct())
    repeated = not marked.groupBy("doc_id", "t").count().where("count > 1").isEmpty()
    remove(top)
    return gone, repeated


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group that links join, with all its columns: of its smallest doc_id.

    Texts are words as in simhash, in any white space and ASCII case; those of under five words are one
    shingle, and null and empty ones are copies of each other. A doc_id on rows of several groups is
    looked at by row, so each group keeps one. Rows with a null doc_id have no group and stay. Long
    texts are whole sets: 8 bytes a word. An empty table stays empty; other columns, whatever their
    names, are kept and not read. Sets are told apart by 64 bits: of n sets two agree by chance with
    probability n^2 / 2^65.
    """
    gone, repeated = _gone(docs)
    left = docs.join(gone, (docs["doc_id"].cast("long") == gone["d"]) & (F.xxhash64(docs["text"]) == gone["t"]), "left_anti")
    if not repeated:
        return left
    return left.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(left.where("doc_id is null"))
