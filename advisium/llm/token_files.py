"""Token-ID files with a canonical length-limited Huffman code of global counts.

A file holds, in this order: MAGIC; blocks of BLOCK ids, each the bits of its ids; the footer; the
footer's length as eight bytes; MAGIC. The zlib-packed footer holds the code lengths of all ids,
for every block its place, its number of ids and the bit offset of each EVERY-th id, and for every
document its doc_id and number of ids. Blocks are decoded on their own; documents run on from block
to block. Files are named in ascending doc_id order.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advisium.llm import huffman
from advisium.llm.common import AtomicFile, filesystem, listing, read_range, ready, remove, texts
from advisium.llm.tokens import encoder

MAGIC, SUFFIX, SPOOL = b"ADVHUF01", ".huf", ".spool"
BLOCK, EVERY = 1 << 18, 256
#: Blocks that are decoded side by side.
NEXT = 8
END = 2
TOKENIZER = "byte_bpe_50k.json"


def _spool(docs: DataFrame, tokenizer: str, end: int, folder: str, size: int) -> np.ndarray:
    """Writes ids in ascending doc_id order to spool files, one for each partition, and counts them.

    Texts are sorted, not ids, so that ids leave the worker once. At most one row for each id and
    task goes to the sum, and one for each id of the vocabulary to the driver.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, n, out = encoder(tokenizer), np.zeros(size, np.int64), None
        tail, squeeze = np.array([end], enc.dtype).tobytes(), zstandard.ZstdCompressor(level=1)
        for part in parts:
            if not part.num_rows:
                continue
            out = out or AtomicFile(folder, f"part-{TaskContext.get().partitionId():08d}{SPOOL}")
            ids = [x + tail for x in enc(texts(part))]
            data = b"".join(ids)
            n += np.bincount(np.frombuffer(data, enc.dtype), minlength=size)
            doc_ids = part.column("doc_id")
            table = np.array([np.asarray(doc_ids.is_valid()), np.asarray(doc_ids.fill_null(0)), [len(x) // enc.dtype.itemsize for x in ids]], np.int64)
            frame = squeeze.compress(data)
            out.add(np.array([part.num_rows, len(frame)], np.int64).tobytes() + table.tobytes() + frame)
        if out:
            out.close()
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["id", "n"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    by = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by, "text")
    out = np.zeros(size, np.int64)
    for i, n in rows.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        out[i] = n
    return out


def _spooled(path: str, size: int, dtype: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of named, doc_id, number of ids; ids) of each frame of a spool file."""
    fs, p = filesystem(path)
    with fs.open_input_file(p) as f:
        while f.tell() < size:
            rows, length = np.frombuffer(f.read(16), np.int64).tolist()
            table = np.frombuffer(f.read(24 * rows), np.int64).reshape(3, rows)
            yield table, np.frombuffer(zstandard.decompress(f.read(length)), dtype)


class Writer:
    """One file, written block by block and put in place when it is whole."""

    def __init__(self, folder: str, name: str, lengths: np.ndarray):
        self.file = AtomicFile(folder, name)
        self.lengths, self.top = lengths, huffman.aligned(lengths)
        self.held = np.empty(0, np.uint16)
        self.blocks, self.offsets, self.tables = [], [], []
        self.file.add(MAGIC)

    def add(self, table: np.ndarray, ids: np.ndarray) -> None:
        """table: rows of named, doc_id and number of ids, which are joined in ids."""
        self.tables.append(table)
        held = np.concatenate([self.held, ids]) if len(self.held) else ids
        whole = len(held) // BLOCK * BLOCK
        for k in range(0, whole, BLOCK):
            self._block(held[k : k + BLOCK])
        self.held = held[whole:]

    def _block(self, ids: np.ndarray) -> None:
        bits, starts = huffman.pack(ids, self.top, self.lengths, EVERY)
        self.blocks.append((*self.file.add(bits), len(ids)))
        self.offsets.append(starts)

    def close(self) -> None:
        if len(self.held):
            self._block(self.held)
        buf = io.BytesIO()
        table = np.concatenate([np.empty((3, 0), np.int64), *self.tables], axis=1)
        offsets = np.concatenate([np.empty(0, np.uint32), *self.offsets])
        np.savez(buf, lengths=self.lengths, blocks=np.array(self.blocks, np.int64).reshape(-1, 3), offsets=offsets, documents=table)
        foot = zlib.compress(buf.getvalue(), 1)
        self.file.add(foot + len(foot).to_bytes(8, "little") + MAGIC)
        self.file.close()


def footer(path: str, size: int) -> dict[str, np.ndarray]:
    tail = len(MAGIC) + 8
    end = read_range(path, size - tail, tail)
    if end[8:] != MAGIC:
        raise ValueError(f"{path} is no whole token file")
    n = int.from_bytes(end[:8], "little")
    with np.load(io.BytesIO(zlib.decompress(read_range(path, size - tail - n, n)))) as x:
        return dict(x)


def blocks(path: str, foot: dict[str, np.ndarray], first: int = 0, last: int | None = None) -> Iterator[np.ndarray]:
    """Ids of the blocks first to last (exclusive) of a file; NEXT blocks are read and decoded at a time."""
    lookup = huffman.table(foot["lengths"])
    place, size, n = foot["blocks"].T
    runs = -(-n // EVERY)
    at = np.concatenate([[0], np.cumsum(runs)])
    last = len(n) if last is None else last
    for k in range(first, last, NEXT):
        some = slice(k, min(k + NEXT, last))
        bits = read_range(path, int(place[k]), int(size[some].sum()))
        starts = foot["offsets"][at[k] : at[some.stop]] + np.repeat(8 * (place[some] - place[k]), runs[some])
        rows = huffman.unpack(bits, starts, EVERY, lookup)
        # only the last run of a block may be short
        yield np.concatenate([rows[at[b] - at[k] : at[b + 1] - at[k]].reshape(-1)[: n[b]] for b in range(k, some.stop)])


def write(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end: int = END) -> None:
    """Writes the ids of all documents to files in a folder, in ascending doc_id order.

    Texts are whole; null is empty and has the end id only. Rows with a null doc_id come first;
    rows that repeat a doc_id all stay, in the order of a hash of their texts. Other columns are
    not read. An empty table gives no files.
    """
    spark = docs.sparkSession
    ready(spark)
    path = public_tokenizers.path(tokenizer)
    enc = encoder(path)
    dtype, spool = enc.dtype, f"{folder}-spool"
    lengths = huffman.code_lengths(_spool(docs, path, end, spool, max(len(enc.begins), end + 1)))
    found = listing(spool, SPOOL)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in part.column("id").to_pylist():
                place, size = found[i]
                writer = Writer(folder, place.rsplit("/", 1)[1].replace(SPOOL, SUFFIX), lengths)
                for table, ids in _spooled(place, size, dtype):
                    writer.add(table, ids)
                writer.close()
            yield part

    if found:
        spark.range(0, len(found), 1, len(found)).mapInArrow(run, "id long").agg(F.count("*")).collect()
    remove(spool)


def _walk(path: str, foot: dict[str, np.ndarray], start: int) -> Iterator[tuple[int | None, int, int, int]]:
    """(doc_id, start, n_tokens, ids_crc32) of a file's documents, some blocks at a time."""
    named, doc_ids, sizes = foot["documents"].tolist()
    k, left, crc = 0, 0, 0
    for ids in blocks(path, foot):
        data, at = memoryview(ids.astype("<u4").tobytes()), 0
        while at < len(ids):
            take = min(sizes[k] - left, len(ids) - at)
            crc = zlib.crc32(data[4 * at : 4 * (at + take)], crc)
            at, left = at + take, left + take
            if left == sizes[k]:
                yield doc_ids[k] if named[k] else None, start, left, crc
                start, k, left, crc = start + left, k + 1, 0, 0


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files of a folder.

    start counts the ids of all documents before; a file is one task's work. The driver holds one
    number a file.
    """
    found = listing(folder, SUFFIX)
    if not found:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def total(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([int(footer(*found[i])["documents"][2].sum()) for i in ids], pa.int64())], ["id", "n"])

    sizes = dict(spark.range(0, len(found), 1, len(found)).mapInArrow(total, "id long, n long").collect())
    starts = np.concatenate([[0], np.cumsum([sizes[i] for i in range(len(found))])]).tolist()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in part.column("id").to_pylist():
                path, size = found[i]
                rows = list(_walk(path, footer(path, size), starts[i]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(found), 1, len(found)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
