"""Near-duplicate groups by SimHash, found with anchor points.

Fingerprints are 64 bits: a bit is set if over half of the text's three-word shingles have it set
in their XXH64 (seed 42). Two fingerprints link at two differing bits or fewer.

Anchors are the words of a covering code: the perfect [63, 57] Hamming code on bits 1 to 63, with
bit 0 free. Its covering radius is 1. For fingerprints at distance 2 there is a point at distance 1
from both, and the anchor nearest to that point is within 1 + 1 of both: it is enough to replicate a
fingerprint to all anchors within the covering radius plus half the threshold (Afrati et al., 2014,
who sharpen the covering radius plus the whole threshold to this). There are 33 or fewer for each
fingerprint. An anchor sees at most the 2,081 fingerprints within two bits of it, however many
documents there are, so no group that is compared grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advisium.llm.common import few, ready, texts
from advisium.llm.components import components

SHINGLE, SEED, THRESHOLD = 3, 42, 2
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_AT = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    words = text.encode().lower().split()  # bytes: only A-Z and ASCII white space are meant
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in parts), np.uint64)


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text; 0 for one without words."""
    return majority(shingle_hashes(text, width))


def majority(h: np.ndarray) -> int:
    """The bits that over half of some hashes have."""
    if not len(h):
        return 0
    at = h.astype("<u8").view(np.uint8).reshape(-1, 8) + _BYTE_AT
    counts = np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(counts.ravel() * 2 > len(h), bitorder="little").view("<u8")[0])


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, t, fp): a hash of the text, and fp as a signed long. Null texts have no words."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = np.array([fingerprint(x, width) for x in texts(part)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), pa.array(fps)], ["doc_id", "t", "fp"])

    return docs.select(F.col("doc_id").cast("long"), _text_key(F.col("text")).alias("t"), "text").mapInArrow(run, "doc_id long, t long, fp long")


def anchors(fp: Column) -> Column:
    """All anchors within two bits of a fingerprint.

    With s the syndrome, the anchors are fp with bit s flipped, and fp with bits i and i xor s
    flipped for all 32 such pairs of 0 to 63 (bit 0, in no parity check, stands for the free bit).
    A fingerprint that is an anchor (s = 0) has itself and its neighbour across the free bit.
    """
    s = F.lit(0)
    for j in range(6):
        mask = sum(1 << i for i in range(64) if i >> j & 1)
        s = s.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseAND(F.lit(mask - (1 << 64 if mask >> 63 else 0)))) % 2, j))
    fp_s = F.struct(fp.alias("fp"), s.cast("int").alias("s"))
    return F.transform(F.array(fp_s), _around)[0]


def _around(x: Column) -> Column:
    fp, s = x["fp"], x["s"]
    one = F.lit(1).cast("long")
    bit = lambda i: F.call_function("shiftleft", one, i)
    pairs = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: i < i.bitwiseXOR(s))
    near = F.transform(pairs, lambda i: fp.bitwiseXOR(bit(i)).bitwiseXOR(bit(i.bitwiseXOR(s))))
    return F.when(s == 0, F.array(fp, fp.bitwiseXOR(one))).otherwise(F.concat(F.array(fp.bitwiseXOR(bit(s))), near))


def _stars(fps: np.ndarray, threshold: int) -> Iterator[tuple[int, int]]:
    """Links the fingerprints of one anchor: each to the least of its component in the group."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= threshold
    root = np.arange(len(fps))
    while True:
        new = np.where(near, root[None, :], len(fps)).min(axis=1)
        if (new == root).all():
            break
        root = new
    for i in np.flatnonzero(root != np.arange(len(fps))):
        yield int(fps[i]), int(fps[root[i]])


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) between distinct fingerprints, enough to join all that reach each other by links.

    Within an anchor each fingerprint is tied to one other, so there are at most 33 rows each.
    """
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"anchors cover thresholds up to {THRESHOLD}")
    spread = fps.select("fp", F.explode(anchors(F.col("fp"))).alias("anchor")).repartition("anchor").sortWithinPartitions("anchor")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_a, held_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def found(a: np.ndarray, f: np.ndarray) -> list[tuple[int, int]]:
            cut = np.flatnonzero(np.diff(a)) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(a)]
            many = ends - starts > 1
            return [x for s, e in zip(starts[many], ends[many], strict=True) for x in _stars(np.sort(f[s:e]), threshold)]

        for part in parts:
            a = np.concatenate([held_a, part.column("anchor").to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, part.column("fp").to_numpy(zero_copy_only=False)])
            last = int(np.searchsorted(a, a[-1])) if len(a) else 0
            held_a, held_f = a[last:], f[last:]
            if out := found(a[:last], f[:last]) if last else []:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
        if out := found(held_a, held_f) if len(held_a) else []:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return spread.mapInArrow(run, "a long, b long").distinct()


def _grouped(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """(doc_id, t, fp, component_id) of rows with a doc_id; t tells the texts of a doc_id apart."""
    ready(docs.sparkSession)
    marked = fingerprints(docs.where("doc_id is not null"), width).checkpoint()
    firsts = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(firsts.select("fp"), threshold)).select(F.col("node").alias("fp"), "root")
    firsts = firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")).checkpoint()
    # cut, so that a root or fingerprint that many have can be split
    least = firsts.groupBy("root").agg(F.min("first").alias("component_id")).checkpoint()
    classes = firsts.join(least, "root").select("fp", "component_id").checkpoint()
    return marked.join(classes, "fp")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fingerprint, component_id): groups of documents that links join.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id of the group, itself
    included. Rows with a null doc_id are dropped; repeated rows give repeated rows; null and empty
    texts have fingerprint zero and link as any other. Long texts are whole: a worker holds the words
    and shingle hashes of one. Bits that are tied at half of the shingles are zero. Other columns,
    whatever their names, are not read. An empty table gives an empty result.
    """
    return _grouped(docs, width, threshold).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each group, with all its columns: of the smallest doc_id, of its texts the one with the least hash.

    A doc_id on rows of several groups is looked at by row, so each group keeps one. Rows with a null
    doc_id have no group and stay.
    """
    found = _grouped(docs, width, threshold).checkpoint()
    own = found.where("doc_id = component_id").groupBy("component_id").agg(F.min("t").alias("kept")).checkpoint()
    # a group's smallest doc_id may stand on texts of other groups too: only its own count
    gone = found.join(own, "component_id").where("doc_id <> component_id or t <> kept").select(F.col("doc_id").alias("d"), "t").distinct()
    gone = few(gone)
    left = docs.join(gone, (docs["doc_id"].cast("long") == gone["d"]) & (_text_key(docs["text"]) == gone["t"]), "left_anti")
    if found.groupBy("doc_id", "t").count().where("count > 1").isEmpty():
        return left
    return left.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(left.where("doc_id is null"))
