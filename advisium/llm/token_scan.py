"""Token counts of flat files without an index, by a scan for end-of-document ids.

Files are raw little-endian ids, documents end with a separator id. A file is cut into blocks at
fixed places; each is searched on its own with vectorised comparisons. A prefix scan over the
blocks of a file then gives each block the ids and documents before it and the start of the
document that runs on into it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from advisium.llm.common import AtomicFile, listing, read_range, ready, remove, texts
from advisium.llm.tokens import encoder

SUFFIX, TOKENIZER, SEPARATOR = ".ids", "byte_bpe_50k.json", 50256
#: Bytes of a block.
BLOCK = 4 << 20


def write(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, separator: int = SEPARATOR) -> DataFrame:
    """Writes ids of whole texts to flat files, one for each partition; (file, seq, doc_id) of them.

    Each attempt of a task writes a file of its own name, and those of attempts that did not count are
    removed, so a task that runs twice gives its documents once. Strings of special tokens in a text are ordinary text, so the separator only ends documents.
    """
    ready(docs.sparkSession)
    path = public_tokenizers.path(tokenizer)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, plain=True)
        end = np.array([separator], enc.dtype).tobytes()
        name, seq, out = f"part-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex[:12]}{SUFFIX}", 0, None
        for part in parts:
            if not part.num_rows:
                continue
            out = out or AtomicFile(folder, name)
            out.add(end.join([*enc(texts(part)), b""]))
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(seq, seq + n), pa.int64()), part.column("doc_id")], ["file", "seq", "doc_id"])
            seq += n
        if out:
            out.close()

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "file string, seq long, doc_id long").checkpoint()
    kept = {x.file for x in out.where("seq = 0").select("file").collect()}  # a name for each partition
    for place, _ in listing(folder, SUFFIX):
        if place.rsplit("/", 1)[1] not in kept:
            remove(place)
    return out


def ends(ids: np.ndarray, separator: int) -> np.ndarray:
    return np.flatnonzero(ids == separator)


def scan(spark: SparkSession, folder: str, separator: int = SEPARATOR, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, seq, start, n_tokens): the documents of every flat file of a folder.

    file: the file's name; seq: the document's place in it, from 0; start: its first
    id's place; n_tokens: its ids without the separator. Ids after a file's last separator are a
    document as well. Empty files and folders have none.
    """
    ready(spark)
    if block % width:
        raise ValueError("blocks hold whole ids")
    found = [(p, size) for p, size in listing(folder, SUFFIX) if size]
    names = [p.rsplit("/", 1)[1] for p, _ in found]
    first = np.concatenate([[0], np.cumsum([-(-size // block) for _, size in found])]).astype(np.int64)
    n_blocks = int(first[-1])
    if not n_blocks:
        return spark.createDataFrame([], "file string, seq long, start long, n_tokens long")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for b in part.column("id").to_pylist():
                f = int(np.searchsorted(first, b, "right")) - 1
                k = b - int(first[f])
                path, size = found[f]
                ids = np.frombuffer(read_range(path, k * block, min(block, size - k * block)), f"<u{width}")
                at = ends(ids, separator)
                row = [k, len(ids), len(at), int(at[-1]) if len(at) else None]
                yield pa.RecordBatch.from_arrays([pa.array([names[f]]), *(pa.array([x], pa.int64()) for x in row), pa.array([at], pa.list_(pa.int64()))], ["file", "block", "n", "k", "last", "ends"])

    blocks = spark.range(0, n_blocks, 1, min(n_blocks, max(1, n_blocks // 4, spark.sparkContext.defaultParallelism)))
    blocks = blocks.mapInArrow(run, "file string, block long, n long, k long, last long, ends array<long>").checkpoint()
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.select("file", "block", "n", "k", "last")
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("docs", F.coalesce(F.sum("k").over(before), F.lit(0)))
    sums = sums.withColumn("carry", F.coalesce(F.max(F.col("base") + F.col("last") + 1).over(before), F.lit(0)))
    whole = (
        blocks.select("file", "block", "ends").join(sums, ["file", "block"])
        .select("file", "docs", "base", "carry", "ends", F.posexplode("ends").alias("i", "end"))
        .select(
            "file", (F.col("docs") + F.col("i")).alias("seq"),
            F.when(F.col("i") == 0, F.col("carry")).otherwise(F.col("base") + F.get("ends", F.col("i") - 1) + 1).alias("start"),
            (F.col("base") + F.col("end")).alias("stop"),
        )
    )
    tails = sums.groupBy("file").agg(F.sum("k").alias("seq"), F.coalesce(F.max(F.col("base") + F.col("last") + 1), F.lit(0)).alias("start"), F.sum("n").alias("stop")).where("stop > start")
    return whole.unionByName(tails).select("file", "seq", "start", (F.col("stop") - F.col("start")).alias("n_tokens"))


def count(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, separator: int = SEPARATOR) -> DataFrame:
    """(doc_id, file, seq, start, n_tokens): documents written to flat files, and counted from them.

    Null texts are empty and count 0; null doc_ids stay null; repeated rows are documents of their
    own; other columns are not read.
    """
    named = write(docs, folder, tokenizer, separator)
    return scan(docs.sparkSession, folder, separator).join(named, ["file", "seq"]).select("doc_id", "file", "seq", "start", "n_tokens")
