"""WARC archives with a two-level capture index.

Writing: every page becomes a record, a gzip member of its own, in one archive per task. Records of
equal payloads of at least ``least`` bytes are one ``response`` (largest page id) and ``revisit`` records
that refer to it. An archive counts only if the task that wrote it succeeded (its name comes with the
task's rows), so retried or lost tasks leave no wrong records.

Index: captures sorted by reversed-host URL key are range-partitioned to shards; a shard is a file of
compressed blocks of lines and a sparse directory with each block's first key. Lookups find the shard
by its first key (at most ``MAX_SHARDS`` of them), search the shard's directory, range-read one block,
search its lines, and range-read the record in its archive.

Files are written and read through pyarrow.fs, at the shared folder's address (local or mounted,
hdfs, s3, gs).

Defined cases: null html is empty; null urls have the empty key; rows with null page id are responses;
rows with the same page id and payload are each written, and are all responses if theirs is the
largest id, and a page id and key are looked up once, however many urls have that key; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, materialize, new_folder

LEAST_BYTES = 1000
BLOCK_LINES, MAX_SHARDS = 1000, 4096
ENTRY = "key string, page_id long, file string, offset long, length long"


def surt(url: str | None) -> str:
    """Reversed-host key: ``com,example)/path?query``; user, port, scheme and fragment are dropped."""
    try:
        u = urlsplit(url or "")
        host = ",".join(reversed((u.hostname or "").split(".")))
    except ValueError:
        return url or ""
    return f"{host}){u.path or '/'}" + (f"?{u.query}" if u.query else "") if url else ""


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = _open(folder)
    task = TaskContext.get()
    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
    out, at = None, 0
    for b in batches:
        rows = []
        for i, url, html, digest, refers in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html"), b.column("digest").to_pylist(), b.column("refers_to").to_pylist(), strict=True):
            member = gzip_member(record(i, url, (html.as_py() or "").encode(), digest, refers))
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            out.write(member)
            rows.append((surt(url), i, name, at, len(member)))
            at += len(member)
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "offset", "length"])
    if out is not None:
        out.close()


def revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages whose payload another page answers for."""
    small = pages.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    groups = small.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to")
    groups = materialize(groups.select("digest", "refers_to"), "payload-groups")
    return small.join(checked(groups), "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES) -> DataFrame:
    """Write all pages; the index entries ``key, page_id, file, offset, length``, materialized."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha1("html"))
    old = materialize(revisits(pages, least), "revisits")
    rows = pages.join(checked(old), ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    return materialize(rows.mapInArrow(lambda b: _write(b, folder), ENTRY), "captures")


def _write_index(batches: Iterator[pa.RecordBatch], folder: str, lines: int) -> Iterator[pa.RecordBatch]:
    """Sorted entries of a shard: blocks, then the directory, then its place (16 digits)."""
    store, root = _open(folder)
    task = TaskContext.get()
    name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.idx"
    directory, block, first, at, out = [], [], None, 0, None

    def end() -> None:
        nonlocal at, out
        if out is None:
            store.create_dir(root, recursive=True)
            out = store.open_output_stream(f"{root}/{name}", compression=None)
        data = zlib.compress("\n".join(block).encode())
        out.write(data)
        directory.append(f"{block[0].rsplit(chr(9), 3)[0]}\t{at}\t{len(data)}")
        at += len(data)
        block.clear()

    for b in batches:
        for key, i, *place in zip(*(b.column(x).to_pylist() for x in ("key", "page_id", "file", "offset", "length")), strict=True):
            entry = "\t".join(map(str, (_line(key), "" if i is None else i, *place)))
            first = first or (key, -1 if i is None else i)
            block.append(entry)
            if len(block) == lines:
                end()
    if block:
        end()
    if out is not None:
        data = zlib.compress("\n".join(directory).encode())
        out.write(data)
        out.write(b"%016d" % at)
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first[0]]), pa.array([first[1]], pa.int64())], names=["shard", "key", "page_id"])


def _line(key: str) -> str:
    return re.sub(r"[\t\n\\]", lambda m: {"\t": "\\t", "\n": "\\n", "\\": "\\\\"}[m[0]], key)


def write_index(captures: DataFrame, folder: str, shards: int | None = None, lines: int = BLOCK_LINES) -> list[tuple[str, int, str]]:
    """Write the index; the shards' first (key, page id) and names, sorted: at most ``MAX_SHARDS``."""
    n = min(MAX_SHARDS, shards or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["key", F.coalesce("page_id", F.lit(-1))]
    rows = captures.repartitionByRange(n, *order).sortWithinPartitions(*order, "file", "offset")
    made = materialize(rows.mapInArrow(lambda b: _write_index(b, folder, lines), "shard string, key string, page_id long"), "shards")
    return sorted((r["key"].encode("utf-8", "surrogatepass"), r["page_id"], r["shard"]) for r in made.collect())


class Shard:
    """A shard's directory, and its blocks as they are needed (the last one is kept)."""

    def __init__(self, store: pafs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        at = int(self.file.read_at(16, size - 16))
        rows = [x.rsplit("\t", 3) for x in zlib.decompress(self.file.read_at(size - 16 - at, at)).decode().split("\n")]
        self.first = [self._order(k, i) for k, i, _, _ in rows]
        self.place = [(int(o), int(n)) for _, _, o, n in rows]
        self.at, self.entries = -1, {}

    @staticmethod
    def _order(key: str, i: str) -> tuple[bytes, int]:
        return re.sub(r"\\(.)", lambda m: {"t": "\t", "n": "\n"}.get(m[1], m[1]), key).encode("utf-8", "surrogatepass"), int(i) if i else -1

    def find(self, key: str, page_id: int | None) -> list[tuple[str, int, int]]:
        """All captures of a key and page id (repeated rows may go on in the blocks after)."""
        wanted = (key.encode("utf-8", "surrogatepass"), -1 if page_id is None else page_id)
        k = max(0, bisect_right(self.first, wanted) - 1)
        while k > 0 and self.first[k] == wanted:
            k -= 1
        out = []
        while k < len(self.first) and self.first[k] <= wanted:
            if self.at != k:
                lines = [x.rsplit("\t", 4) for x in zlib.decompress(self.file.read_at(self.place[k][1], self.place[k][0])).decode().split("\n")]
                self.keys = [self._order(x[0], x[1]) for x in lines]
                self.entries, self.at = lines, k
            i = bisect_right(self.keys, wanted) - 1
            while i >= 0 and self.keys[i] == wanted:
                out.append((self.entries[i][2], int(self.entries[i][3]), int(self.entries[i][4])))
                i -= 1
            k += 1
        return out


def _find_shards(batches: Iterator[pa.RecordBatch], shards: list) -> Iterator[pa.RecordBatch]:
    starts = [(k, i) for k, i, _ in shards]
    for b in batches:
        ids, keys = b.column("page_id").to_pylist(), [surt(u) for u in b.column("url").to_pylist()]
        at = [max(0, bisect_right(starts, (k.encode("utf-8", "surrogatepass"), -1 if i is None else i)) - 1) for k, i in zip(keys, ids, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(keys, pa.string()), b.column("page_id")], names=["shard", "key", "page_id"])


def _look_up(batches: Iterator[pa.RecordBatch], shards: list, folder: str) -> Iterator[pa.RecordBatch]:
    store, root = _open(folder)
    at, shard = -1, None
    for b in batches:
        rows = []
        for s, key, i in zip(*(b.column(x).to_pylist() for x in ("shard", "key", "page_id")), strict=True):
            if s != at:
                at, shard = s, Shard(store, f"{root}/{shards[s][2]}")
            rows += shard.find(key, i)
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "offset", "length"])


def look_up(queries: DataFrame, shards: list, folder: str) -> DataFrame:
    """``file, offset, length`` of the captures of ``queries`` (``page_id, url``), each once."""
    if not shards:
        return queries.sparkSession.createDataFrame([], "file string, offset long, length long")
    found = queries.mapInArrow(lambda b: _find_shards(b, shards), "shard int, key string, page_id long").distinct()  # several urls may have one key
    found = found.repartition(len(shards), "shard").sortWithinPartitions("shard", "key", "page_id")
    return found.mapInArrow(lambda b: _look_up(b, shards, folder), "file string, offset long, length long")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read(batches: Iterator[pa.RecordBatch], folder: str, with_payload: bool) -> Iterator[pa.RecordBatch]:
    store, root = _open(folder)
    at, f = None, None
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    for b in batches:
        rows = []
        for file, offset, length in zip(*(b.column(x).to_pylist() for x in ("file", "offset", "length")), strict=True):
            if file != at:
                at, f = file, store.open_input_file(f"{root}/{file}")
            fields, http, payload = parse_record(zlib.decompress(f.read_at(length, offset), 31))
            number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
            digest, kind, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], int(http["Content-Length"])
            if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                raise ValueError(f"damaged record in {file} at {offset}")
            rows.append((number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, kind, number(fields.get("WARC-Refers-To", "")), payload if with_payload else None))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])


def read_records(places: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Range-read records at ``file, offset, length``, in the order of the archives; payloads are checked."""
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = places.repartition(n, "file", F.expr("offset div 1000000")).sortWithinPartitions("file", "offset")
    return places.mapInArrow(lambda b: _read(b, folder, with_payload), READ)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archives, index = new_folder(spark, "warc"), new_folder(spark, "warc-index")
    shards = write_index(write_archives(pages, archives), index)
    queries = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").distinct()
    records = read_records(look_up(queries, shards, index), archives, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 1000) END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM g
"""
