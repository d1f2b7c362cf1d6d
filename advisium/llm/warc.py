"""WARC archives with a two-level capture index.

Archives are gzip members, a record each. The index has a line for each record, sorted by its URL
key (host reversed: net,example)/path) and page, cut into compressed blocks of LINES lines. A
sparse directory at the end of each index file has the first key and the place of every block; the
first key of each index file, a row a file, is the top of it. A lookup bisects the tops, then the
directory, unpacks one block, bisects its lines and reads the record's range of its archive.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advisium.llm.common import AtomicFile, ascii_lower, listing, read_range, ready

LINES, SUFFIX, INDEX = 512, ".warc.gz", ".cdx"
#: Payloads of fewer bytes are never revisits.
LEAST = 0
#: The tables have no capture time, so records carry this one.
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of neighbouring records that are read in one go.
SPAN = 1 << 20


def url_key(url: Column) -> Column:
    """Sort key of a URL: reversed host without port or user, then the rest. Null: empty."""
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = ascii_lower(F.regexp_replace(F.regexp_extract(rest, "^([^/?#]*)", 1), "^.*@|:[0-9]*$", ""))
    back = F.array_join(F.reverse(F.split(host, "\\.")), ",")
    return F.when(F.instr(u, "://") > 0, F.concat(back, F.lit(")"), F.regexp_extract(rest, "^[^/?#]*((?s:.*))", 1))).otherwise(u)


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _clean(url: str | None) -> str:
    """A header's value holds no line breaks."""
    return re.sub(r"[\r\n]+", " ", url or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; with refers_to a revisit, whose block has the HTTP head only."""
    name = lambda x: f"<urn:x-page:{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name(refers_to)}"]
    block = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers, http headers and payload of a record; the payload's digest is checked."""
    top, _, rest = data.partition(b"\r\n\r\n")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in top.decode().split("\r\n")[1:])
    block = rest[: int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])
    page = lambda x: int(x) if (x := x.removeprefix("<urn:x-page:").rstrip(">")) else None
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"{head['WARC-Record-ID']}: the payload has another digest")
    return {
        "page_id": page(head["WARC-Record-ID"]), "type": head["WARC-Type"], "digest": digest, "bytes": size, "url": head.get("WARC-Target-URI", ""),
        "refers_to": page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None, "payload": payload if head["WARC-Type"] == "response" else None,
    }


def _archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives; (key, page_id, file, offset, length) of every record.

    Equal payloads are found by their digest; each copy but the one with the largest page_id
    becomes a revisit. Counts come from a partial aggregate that is cut by a checkpoint, so the join
    is one of two plain shuffles that adaptive execution can split: a payload that a third of all
    pages share is no single task's work. Each attempt of a task writes a file of its own name, and
    the lines that are kept name the files of the attempts that they came from.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    keep = rows.where((F.octet_length("html") >= LEAST) & F.col("page_id").isNotNull())
    keep = keep.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("digest", "keep").checkpoint()
    rows = rows.join(keep, "digest", "left")
    rows = rows.select(url_key(F.col("url")).alias("key"), "page_id", "url", "html", F.when(F.col("page_id") < F.col("keep"), F.col("keep")).alias("refers_to"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, name, out = TaskContext.get().partitionId(), "", None
        for part in parts:
            if not part.num_rows:
                continue
            name = name or f"part-{number:08d}-{uuid.uuid4().hex[:12]}{SUFFIX}"
            out = out or AtomicFile(folder, name)
            cols = (part.column(x).to_pylist() for x in ("page_id", "url", "html", "refers_to"))
            placed = [out.add(_member(record(p, u, h.encode(), r))) for p, u, h, r in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("page_id"), pa.array([name] * len(placed)), *(pa.array(c, pa.int64()) for c in zip(*placed, strict=True))],
                ["key", "page_id", "file", "offset", "length"],
            )
        if out:
            out.close()

    return rows.mapInArrow(run, "key string, page_id long, file string, offset long, length long").checkpoint()


def _order(key: str | None, page_id: int | None) -> tuple[bytes, int]:
    """Lines sort by the key's bytes, as Spark's strings do, then by page; null pages come first."""
    return (key or "").encode(), -(1 << 63) - 1 if page_id is None else page_id


def _index(lines: DataFrame, folder: str) -> None:
    """Sorts the lines over all files and writes them as compressed blocks with a directory."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out, held, directory = TaskContext.get().partitionId(), None, [], []

        def block() -> None:
            data = "\n".join(json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in held).encode()
            directory.append([held[0][:2], *out.add(zlib.compress(data, 6))])
            held.clear()

        for part in parts:
            if not part.num_rows:
                continue
            out = out or AtomicFile(folder, f"part-{number:08d}{INDEX}")
            for row in zip(*(part.column(x).to_pylist() for x in ("key", "page_id", "file", "offset", "length")), strict=True):
                held.append(row)
                if len(held) == LINES:
                    block()
        if out:
            if held:
                block()
            foot = zlib.compress(json.dumps(directory, ensure_ascii=False).encode(), 6)
            out.add(foot + len(foot).to_bytes(8, "little"))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([len(directory)])], ["n"])

    by = [F.col("key"), F.col("page_id").asc_nulls_first()]
    lines.repartitionByRange(*by).sortWithinPartitions(*by, "file", "offset").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write(pages: DataFrame, folder: str) -> None:
    """Writes a record for every row to archives in folder/warc and their index to folder/index.

    Payloads are html in UTF-8, null is empty. Of records with equal payloads of LEAST bytes or more
    those with the largest page_id are responses, others revisits of it. Rows with a null page_id
    are responses; null urls are empty; repeated rows are records of their own; other columns are
    not read. An empty table writes no files.
    """
    ready(pages.sparkSession)
    _index(_archives(pages, f"{folder}/warc"), f"{folder}/index")


def directory(path: str, size: int) -> list:
    n = int.from_bytes(read_range(path, size - 8, 8), "little")
    return json.loads(zlib.decompress(read_range(path, size - 8 - n, n)))


def _records(folder: str, lines: list[tuple]) -> Iterator[dict]:
    """The records of some index lines; near ones of an archive come by one range read."""
    lines = sorted(lines, key=lambda x: x[2:])
    k = 0
    while k < len(lines):
        file, start = lines[k][2:4]
        end, last = start, k
        while last < len(lines) and lines[last][2] == file and lines[last][3] + lines[last][4] - start <= max(SPAN, lines[k][4]) and lines[last][3] - end <= 4096:
            end = max(end, lines[last][3] + lines[last][4])
            last += 1
        data = read_range(f"{folder}/warc/{file}", start, end - start)
        for x in lines[k:last]:
            yield parse(zlib.decompress(data[x[3] - start : x[3] - start + x[4]], 31))
        k = last


def lookup(spark: SparkSession, wanted: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of captures.

    wanted: (key, page_id), distinct; each finds all its captures. Wanted keys go to the index file
    that may hold them, and are sorted, so a task unpacks a block of the index once.
    """
    ready(spark)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    found = listing(f"{folder}/index", INDEX)
    if not found:
        return spark.createDataFrame([], schema)
    n = len(found)

    def top(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [(i, *directory(*found[i])[0][0]) for i in part.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)], ["id", "key", "page_id"])

    rows = spark.range(0, n, 1, n).mapInArrow(top, "id long, key string, page_id long").collect()  # one row for each index file
    tops = [_order(k, p) for _, k, p in sorted(rows)]

    def dealt(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys = list(map(_order, part.column("key").to_pylist(), part.column("page_id").to_pylist()))
            to = [max(0, bisect.bisect_right(tops, k) - 1) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), part.column("key"), part.column("page_id")], ["part", "key", "page_id"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block_at, lines, firsts = None, None, [], []
        for part in parts:
            hits = []
            for i, key, page_id in zip(*(part.column(x).to_pylist() for x in ("part", "key", "page_id")), strict=True):
                if i != at:
                    at, block_at, d = i, None, directory(*found[i])
                    firsts = [_order(*x[0]) for x in d]
                want = _order(key, page_id)
                b = max(0, bisect.bisect_left(firsts, want) - 1)
                while b < len(firsts) and firsts[b] <= want:
                    if b != block_at:
                        block_at = b
                        lines = [json.loads(x) for x in zlib.decompress(read_range(found[i][0], *d[b][1:])).decode().split("\n")]
                        keys = [_order(*x[:2]) for x in lines]
                    k = bisect.bisect_left(keys, want)
                    while k < len(keys) and keys[k] == want:
                        hits.append(lines[k])
                        k += 1
                    b += 1
            rows = [(r["page_id"], r["bytes"], r["digest"], r["type"], r["refers_to"], r["url"], r["payload"]) for r in _records(folder, hits)]
            if rows:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema.replace(" long", "").replace(" string", "").replace(" binary", "").split(", "))

    keys = wanted.select("key", F.col("page_id").cast("long"))
    keys = keys.mapInArrow(dealt, "part long, key string, page_id long")
    by = ["part", "key", F.col("page_id").asc_nulls_first()]
    return keys.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def captures(pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives of all pages, and looks every capture up in them again.

    (page_id, payload_bytes, payload_digest, record_type, refers_to), one row per row of pages.
    """
    write(pages, folder)
    wanted = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long")).distinct()
    return lookup(pages.sparkSession, wanted, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
