"""What the training-data operators share: scratch folders, atomic files, text batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advisium.session import shared, ship

#: Rows of text that one Arrow batch holds. Texts are whole, so this bounds a worker's memory.
TEXT_ROWS = 256
WS = "[\\x20\\x09-\\x0D]"
NOT_WS = "[^\\x20\\x09-\\x0D]"
#: Characters of a text whose words are held at once, and hashes of words that a worker keeps.
BLOCK, CACHE = 1 << 20, 1 << 17
#: A filter of hashes that tasks get has at most 2 ** BITS bits (8 MB); one that is too full lets more through to a join.
BITS = 26
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
#: Rows of a few numbers each that a broadcast may have (about 20 MB); more are joined by a shuffle.
SMALL = 300_000
_BREAK = re.compile("[\x20\x09-\x0D]")


def ready(spark: SparkSession) -> None:
    """Checkpoints have a folder, workers can import this package, and text batches are small."""
    shared(spark)
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the cluster shares (spark.checkpoint.dir)."""
    ready(spark)
    top = shared(spark)
    return f"{top.rstrip('/')}/advisium/{name}-{uuid.uuid4().hex[:12]}"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def remove(path: str) -> None:
    """A folder or file goes, if it is there."""
    fs, p = filesystem(path)
    kind = fs.get_file_info(p).type
    if kind == pafs.FileType.File:
        fs.delete_file(p)
    elif kind != pafs.FileType.NotFound:
        fs.delete_dir(p)


class AtomicFile:
    """A file that appears under its name when it is whole. The last of two attempts wins, so a name is
    for bytes that every attempt makes alike, or for one attempt alone."""

    def __init__(self, folder: str, name: str):
        self.fs, top = filesystem(folder)
        self.fs.create_dir(top, recursive=True)
        self.part, self.path, self.at = f"{top}/.{name}.{uuid.uuid4().hex}", f"{top}/{name}", 0
        self.out = self.fs.open_output_stream(self.part)

    def add(self, data: bytes) -> tuple[int, int]:
        """Place and length of what is added."""
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def read_range(path: str, start: int, length: int) -> bytes:
    fs, p = filesystem(path)
    with fs.open_input_file(p) as f:
        f.seek(start)
        return f.read(length)


def listing(folder: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder, by name."""
    fs, p = filesystem(folder)
    found = fs.get_file_info(pafs.FileSelector(p, allow_not_found=True))
    return sorted((f"{folder}/{x.base_name}", x.size) for x in found if x.base_name.endswith(suffix) and not x.base_name.startswith("."))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(rows: DataFrame) -> DataFrame:
    """rows, cut, and broadcast in joins if there are at most SMALL; so the texts that they are joined with stay where they are."""
    rows = rows.checkpoint()
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch; null is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def words_column(text: Column) -> Column:
    """Words of a text, parted by ASCII white space, as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{WS}+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of a stream of tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def blocks(text: str) -> Iterator[str]:
    """A text in parts that end before white space, so that no word is cut; one at least."""
    at = 0
    while len(text) - at > BLOCK and (cut := _BREAK.search(text, at + BLOCK)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Hashes(dict):
    """64-bit hashes of words, never zero, as many as CACHE kept."""

    def __missing__(self, word: str | bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) | 1
        return h


HASHES = Hashes()


def word_hashes(parts: Iterator[list]) -> np.ndarray:
    """Hashes of words that come in lists."""
    found = [np.fromiter(map(HASHES.__getitem__, x), np.uint64, len(x)) for x in parts]
    return np.concatenate(found) if len(found) > 1 else found[0]


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each two words, in order."""
    x = a * _M1 + (b ^ (b >> np.uint64(29))) * _M2
    x = (x ^ (x >> np.uint64(32))) * _M3
    return x ^ (x >> np.uint64(29))


def bitmap(rows: DataFrame, name: str, most: int = BITS, least: int = 12) -> tuple[int, np.ndarray]:
    """A filter that all 64-bit hashes of a column pass: its bits as a power of two, and the bits."""
    bits = min(most, max(least, (64 * rows.count()).bit_length()))
    place = F.shiftrightunsigned(name, 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    found = rows.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("x")).toPandas()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[found["at"].to_numpy(np.int64)] = found["x"].to_numpy(np.int64).view(np.uint64)
    return bits, table


def passes(hashes: np.ndarray, bits: int, table: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - bits)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
