"""WARC archives with revisit records, and a two-level capture index over them.

Archives are plain WARC/1.1 files written by Spark's own text writer (record separator CR LF CR LF), so they land
in any store that Spark can write and commit like any other table.  The index sorts captures by reversed-host key
into compressed blocks, one to a line of its shards; a sparse directory holds each block's first and last key and its
byte range, and has a bounded number of entries.  A lookup searches the directory by bisection, reads one block's range,
searches that, and reads a byte range of an archive.  Ranges are read where the work is, through pyarrow's file
systems (local and mounted folders, S3, GCS, HDFS); no file is ever held whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut, in_batches, maybe_broadcast

SEPARATOR = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are always stored.
LEAST_REVISIT = 100
#: (records of a file at most, payload bytes of such a record at most): a file stays below about 256 MB, or holds one record.
FILES = ((2000, 1 << 17), (64, 1 << 22), (1, 1 << 31))
#: Captures of a block, unless the directory would have more than this many blocks.
LINES_PER_BLOCK, MOST_BLOCKS = 512, 1_000_000
#: Bytes that are read at once when records are scanned, or when ranges lie close together.
READ = 1 << 20
CAPTURE = "surt string, path string, offset bigint, length bigint, url string"


def surt(url: str | None) -> str:
    """Reversed-host key: ``http://www.b.org:80/x?q`` becomes ``org,b,www)/x?q``.  Null and hostless addresses sort first;
    the path keeps its case."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname or ""
    except ValueError:
        parts, host = urlsplit(""), ""
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(",".join(reversed(host.split("."))), safe=",:-_") + ")" + quote(tail, safe="/?&=%+,;:@!$'()*~#[]-._")


def escaped(url):
    """An address without the white space that would break a header or an index line."""
    for raw, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        url = F.replace(url, F.lit(raw), F.lit(code))
    return url


def opened(path: str):
    """A file of any store that pyarrow knows, for reads of byte ranges."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + unquote(rest if colon else path).lstrip("/"))
    system, plain = fs.FileSystem.from_uri(path)
    return system.open_input_file(plain)


def write_archives(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", files: tuple[tuple[int, int], ...] = FILES) -> None:
    """One record per row.  Among equal payloads of LEAST_REVISIT bytes or more, the smallest page_id is stored as a
    response and the others (null ids too) as revisits that refer to it; rows that repeat that page_id are responses
    too.  A null html is an empty payload; a null url leaves its header out; control characters in it are escaped.
    Records go to files by classes of payload size, so that the bytes of a file are bounded."""
    base = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("body"))
    base = base.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256)).withColumn("bytes", F.octet_length("body"))
    twice = cut(base.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first"))
    rows = base.join(maybe_broadcast(twice, 120), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    header = lambda k, v: F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit("\r\n"))
    optional = lambda k, v: F.coalesce(header(k, v), F.lit(""))
    ident = lambda v: F.concat(F.lit("<urn:loomtrace:page:"), v.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.when(again, "revisit").otherwise("response")),
        header("WARC-Record-ID", F.coalesce(ident(F.col("page_id")), F.lit("<urn:loomtrace:page:none>"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        optional("WARC-Target-URI", escaped(F.col("url"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        header("X-Payload-Length", F.col("bytes")),
        F.when(again, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\n"), header("WARC-Refers-To", ident(F.col("first"))))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        header("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("bytes"))),
        F.lit("\r\n"))
    value = F.concat(head, F.when(again, F.lit("")).otherwise(F.col("body")))
    size = F.coalesce(*(F.when(F.col("bytes") <= most, k) for k, (_, most) in enumerate(files)), F.lit(len(files) - 1))
    used = sorted(r.k for r in base.select(size.alias("k")).distinct().collect()) or [0]
    for n, k in enumerate(used):
        some = rows.where(size == k) if len(used) > 1 else rows
        some.select(value.alias("value")).write.mode("append" if n else "error").option("lineSep", SEPARATOR).option("maxRecordsPerFile", files[k][0]).text(folder)


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end (after the separator) of the record at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at byte {at}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    size = int(headers["Content-Length"])
    begin = stop + 4
    return headers, data[begin : begin + size], begin + size + len(SEPARATOR)


def record_heads(path: str, length: int) -> Iterator[tuple[int, int, str]]:
    """(offset, bytes without separator, address) of each record of an archive: headers are read, long payloads passed over."""
    with opened(path) as f:
        at, base, held = 0, 0, b""
        while at < length:
            stop = held.find(b"\r\n\r\n", at - base) if base <= at < base + len(held) else -1
            step = READ
            while stop < 0:
                base, held = at, f.read_at(min(step, length - at), at)
                stop = held.find(b"\r\n\r\n")
                if stop < 0 and at + len(held) >= length:
                    raise ValueError(f"no record at byte {at} of {path}")
                step *= 2
            head = held[at - base : stop].decode()
            if not head.startswith("WARC/1.1\r\n"):
                raise ValueError(f"no record at byte {at} of {path}")
            size = int(head.rpartition("Content-Length: ")[2])
            end = base + stop + 4 + size
            yield at, end - at, head.partition("\r\nWARC-Target-URI: ")[2].partition("\r\n")[0]
            at = end + len(SEPARATOR)


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out: list[tuple[int, int, str]] = []
            for record in record_heads(path, length):
                out.append(record)
                if len(out) == 4096:
                    yield _capture_rows(path, out)
                    out = []
            yield _capture_rows(path, out)


def _capture_rows(path: str, found: list[tuple[int, int, str]]) -> pa.RecordBatch:
    text, number = pa.string(), pa.int64()
    return pa.RecordBatch.from_arrays([pa.array([surt(u) for *_, u in found], text), pa.array([path] * len(found), text), pa.array([a for a, *_ in found], number), pa.array([n for _, n, _ in found], number), pa.array([u for *_, u in found], text)], ["surt", "path", "offset", "length", "url"])


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths and lengths below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "length")


def build_index(spark: SparkSession, archives: str, folder: str, lines: int = LINES_PER_BLOCK, most_blocks: int = MOST_BLOCKS) -> None:
    """Write ``folder/blocks``, shards whose every line is a block (first key, last key, compressed captures), and
    ``folder/directory``: first and last key, shard, offset and length of each block."""
    found = cut(in_batches(_files(spark, archives), _captures, CAPTURE))
    lines = max(lines, -(-found.count() // most_blocks))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []

        def block(some: list[str]) -> pa.RecordBatch:
            keys = [x.partition(" ")[0] for x in (some[0], some[-1])]
            data = base64.b64encode(zlib.compress("\n".join(some).encode(), 6)).decode()
            return pa.RecordBatch.from_arrays([pa.array(["\t".join((*keys, data))])], ["value"])

        for batch in batches:
            held += [f"{s} {o} {n} {p} {u}" for s, p, o, n, u in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)]
            while len(held) >= lines:
                yield block(held[:lines])
                held = held[lines:]
        if held:
            yield block(held)

    def directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                at, out = 0, []
                with opened(path) as f:
                    for line in _lines(f):
                        first, last, _ = line.split(b"\t", 2)
                        out.append((first.decode(), last.decode(), path, at, len(line)))
                        at += len(line) + 1
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["first_key", "last_key", "path", "offset", "length"])

    # ties of one key may be many: offsets and paths take part in the order, so that ranges can part them
    ordered = found.repartitionByRange("surt", "path", "offset").sortWithinPartitions("surt", "path", "offset")
    in_batches(ordered, pack, "value string", rows=4096).write.text(f"{folder}/blocks")
    in_batches(_files(spark, f"{folder}/blocks"), directory, "first_key string, last_key string, path string, offset bigint, length bigint").write.parquet(f"{folder}/directory")


def _lines(f) -> Iterator[bytes]:
    held = b""
    while data := f.read(READ):
        *whole, held = (held + data).split(b"\n")
        yield from whole
    if held:
        yield held


class Directory:
    """The sparse directory in memory: bisection gives the blocks that may hold a key."""

    def __init__(self, spark: SparkSession, folder: str):
        rows = spark.read.parquet(f"{folder}/directory").orderBy("first_key", "last_key", "path", "offset").collect()  # MOST_BLOCKS about
        self.first, self.last = [r.first_key for r in rows], [r.last_key for r in rows]
        self.where = [(r.path, r.offset, r.length) for r in rows]

    def blocks(self, key: str) -> Iterator[int]:
        k = bisect_left(self.last, key)
        while k < len(self.first) and self.first[k] <= key:
            yield k
            k += 1

    def read(self, block: int) -> list[str]:
        """The sorted lines of a block, by one range read."""
        path, offset, length = self.where[block]
        with opened(path) as f:
            line = f.read_at(length, offset)
        return zlib.decompress(base64.b64decode(line.rpartition(b"\t")[2])).decode().split("\n")


def in_block(lines: list[str], key: str) -> Iterator[tuple[str, int, int, str]]:
    """(path, offset, length, address) of a key's captures in a block, found by bisection."""
    for line in lines[bisect_left(lines, key + " ") :]:
        if not line.startswith(key + " "):
            return
        _, offset, length, path, url = line.split(" ", 4)
        yield path, int(offset), int(length), url


RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _parsed(data: bytes) -> tuple:
    number = lambda x: None if x in (None, "none") else int(x)
    headers, payload, _ = parse_record(data, 0)
    kind, digest, size = headers["WARC-Type"], headers["WARC-Payload-Digest"].partition(":")[2], int(headers["X-Payload-Length"])
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
    ident = lambda k: number(headers[k][1:-1].rpartition(":")[2]) if k in headers else None
    return ident("WARC-Record-ID"), headers.get("WARC-Target-URI"), size, digest, kind, ident("WARC-Refers-To")


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records by byte range; neighbouring ranges of a file are read together."""
    for batch in batches:
        rows = sorted(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        out, k = [], 0
        while k < len(rows):
            path, first, _ = rows[k]
            with opened(path) as f:
                while k < len(rows) and rows[k][0] == path:
                    first, end, n = rows[k][1], rows[k][1] + rows[k][2], k + 1
                    while n < len(rows) and rows[n][0] == path and rows[n][1] - end <= READ // 16 and rows[n][1] + rows[n][2] - first <= READ:
                        end, n = max(end, rows[n][1] + rows[n][2]), n + 1
                    data = f.read_at(end - first, first)
                    out += [_parsed(data[a - first : a - first + size]) for _, a, size in rows[k:n]]
                    k = n
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def lookup(urls: DataFrame, index: str, *, url: str = "url") -> DataFrame:
    """Every record captured at one of the addresses, read from its byte range: a response's size and digest come from
    its payload and must equal its headers.

    Addresses that repeat are one, and those of one key too; an address without captures gives none.  Keys search the
    directory where they are; a block is read once for all its keys, and a key of many captures is many blocks' work.
    """
    spark = urls.sparkSession
    shared = spark.sparkContext.broadcast(Directory(spark, index))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(k, key) for key in {surt(u) for u in batch.column(0).to_pylist()} for k in shared.value.blocks(key)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([key for _, key in found], pa.string())], ["block", "key"])

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lines = None, []
        for batch in batches:
            out = []
            for k, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != block:
                    block, lines = k, shared.value.read(k)
                out += in_block(lines, key)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], ["path", "offset", "length"])

    wanted = in_batches(urls.select(escaped(F.col(url).cast("string")).alias("u")), keys, "block bigint, key string", rows=4096).distinct()
    found = in_batches(wanted.repartition("block").sortWithinPartitions("block", "key"), captures, "path string, offset bigint, length bigint")
    near = found.repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")
    return in_batches(near, _read_ranges, RECORD, rows=2048)


class CaptureIndex:
    """Point lookups from the driver: directory, then one block, then one byte range."""

    def __init__(self, spark: SparkSession, folder: str):
        self.directory = Directory(spark, folder)

    def captures(self, url: str) -> list[tuple[str, int, int]]:
        """(path, offset, length) of every capture of an address."""
        key = surt(url)
        return sorted(x[:3] for k in self.directory.blocks(key) for x in in_block(self.directory.read(k), key) if x[3] == url)

    @staticmethod
    def fetch(capture: tuple[str, int, int]) -> tuple[dict[str, str], bytes]:
        """Headers and payload of one capture, by a range read."""
        path, offset, length = capture
        with opened(path) as f:
            headers, payload, _ = parse_record(f.read_at(length, offset), 0)
        return headers, payload


def archive(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write archives and index under ``folder`` (by default a new one in the shared checkpoint folder) and look
    every address up in the index: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``.

    A table without rows gives none.  Extra columns of ``pages`` are ignored.
    """
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/loomtrace-warc-{uuid.uuid4().hex}"
    write_archives(pages, f"{folder}/archives", **columns)
    build_index(spark, f"{folder}/archives", f"{folder}/index")
    return lookup(pages, f"{folder}/index", url=columns.get("url", "url"))
