"""WARC archives with a two-level capture index (operator 6).

Pages are range-partitioned by reversed-host URL key, and each task appends its pages to an archive, one gzip member a
record. Of pages with equal payloads the one with the smallest page_id is a response, the others are revisits of it. The
captures' index lines, in key order, are packed into gzip blocks; a sparse directory has the first key and the place of
each block and its first and last key. A look-up takes the directory's rows that may hold its keys (Parquet's statistics
keep the others unread), bisects them, reads a block's range, bisects its lines and reads the record's range. Looking up
many pages is the same, in key order, so that neighbours share blocks and ranges.

Files go to the shared folder through pyarrow's file systems, which know local paths, HDFS, S3 and GCS. Each task attempt
writes files of its own name, and the directory lists those of the attempts that counted, so repeated tasks do no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from nearfield.sources.scratch import shared_path, written

BLOCK_LINES = 1000
#: A task begins a new archive beyond this size.
ARCHIVE_BYTES = 1 << 30
_READ_BYTES = 16 << 20
_URL = re.compile(r"^(?:([a-z][a-z0-9+.\-]*):)?//(?:[^/?#@]*@)?([^/?#]*)([^#]*)", re.I)
_DATE = "2024-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """The URL's key: its host's labels reversed, then the port, path and query; scheme, user and fragment are dropped.
    Anything that isn't a URL with a host is kept behind a "!"."""
    m = _URL.match(url or "")
    if not m or not m[2]:
        return "!" + (url or "")
    host, _, port = m[2].lower().partition(":")
    return ",".join(reversed(host.strip(".").split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + (m[3] or "/")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _place(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root if ":" in root.split("/")[0] else f"file://{root}")


def _header(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(url: str, page_id: int | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, again: int = 0) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head of the response without its payload. Its id has the page, the
    payload's digest and, where both occurred before, how often (``again``)."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}:{digest}{f':{again}' if again else ''}>", f"WARC-Target-URI: {_header(url)}", f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes) -> dict:
    """The fields of one gzip member: headers, page_id, record_type, refers_to, payload_bytes, payload_digest and, for a
    response, payload; its digest is computed from the payload read and must be the one recorded."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda name: None if (v := re.search(r"<urn:page:(-?\d+|None):", headers[name])[1]) == "None" else int(v)
    out = {"headers": headers, "page_id": number("WARC-Record-ID"), "record_type": headers["WARC-Type"], "refers_to": None, "payload_bytes": size, "payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha1:")}
    if out["record_type"] == "revisit":
        return out | {"refers_to": number("WARC-Refers-To")}
    if len(payload) != size or payload_digest(payload) != out["payload_digest"]:
        raise ValueError(f"record {out['page_id']} is damaged")
    return out | {"payload": payload}


class _Writer:
    """Archives and index blocks of one task."""

    def __init__(self, root: str, block_lines: int):
        self.block_lines = block_lines
        self.fs, self.base = _place(root)
        self.fs.create_dir(self.base, recursive=True)
        self.name = uuid.uuid4().hex
        self.archive, self.part, self.at = None, 0, 0
        self.index = self.fs.open_output_stream(f"{self.base}/{self.name}.cdx.gz", compression=None)
        self.index_at, self.lines, self.first, self.last = 0, [], ("", 0), ("", 0)
        self.page, self.seen = None, Counter()

    def add(self, key: str, url: str, page_id: int | None, payload: bytes, refers_to: int | None, revisit: bool) -> list[tuple]:
        digest = payload_digest(payload)
        if self.archive is None or self.at > ARCHIVE_BYTES:
            if self.archive:
                self.archive.close()
                self.part += 1
            self.archive, self.at = self.fs.open_output_stream(f"{self.base}/{self.name}-{self.part}.warc.gz", compression=None), 0
        if self.page != page_id:
            self.page, self.seen = page_id, Counter()
        member = gzip.compress(record(url, page_id, payload, digest, refers_to, revisit, self.seen[digest]), 6, mtime=0)
        self.seen[digest] += 1
        self.archive.write(member)
        more = {"url": url, "digest": digest, "bytes": len(payload), "type": "revisit" if revisit else "response", "refers_to": refers_to, "file": f"{self.name}-{self.part}.warc.gz", "offset": self.at, "length": len(member)}
        self.at += len(member)
        if not self.lines:
            self.first = (key, page_id)
        self.last = (key, page_id)
        self.lines.append(f"{json.dumps(key)}\t{page_id}\t{json.dumps(more)}")
        return self.block() if len(self.lines) >= self.block_lines else []

    def block(self) -> list[tuple]:
        if not self.lines:
            return []
        data = gzip.compress("\n".join(self.lines).encode(), 6, mtime=0)
        self.index.write(data)
        out = [(*self.first, *self.last, f"{self.name}.cdx.gz", self.index_at, len(data), len(self.lines))]
        self.index_at += len(data)
        self.lines = []
        return out

    def close(self) -> list[tuple]:
        out = self.block()
        self.index.close()
        if self.archive:
            self.archive.close()
        return out


_DIRECTORY = "first_key string, first_page long, last_key string, last_page long, file string, offset long, length long, n_lines long"


def _order(key: str, page: int | None) -> tuple[str, bool, int]:
    """Null page_ids come first, as in Spark."""
    return key, page is not None, page or 0


class _Search:
    """Look-ups in one index by whoever makes them: the driver, or a task."""

    def __init__(self, root: str, at: str):
        self.fs, self.base = _place(root)
        fs, base = _place(at)
        self.directory = pads.dataset(base, filesystem=fs, format="parquet", schema=_DIRECTORY_ARROW)
        self.held: tuple = ((), [])

    def blocks(self, low: str, high: str) -> list[dict]:
        """The directory's rows whose blocks may hold keys from ``low`` to ``high``, in order."""
        may = (pads.field("last_key") >= low) & (pads.field("first_key") <= high)
        return sorted(self.directory.to_table(filter=may).to_pylist(), key=lambda b: _order(b["first_key"], b["first_page"]))

    def lines(self, block: dict) -> list[tuple[str, int | None, dict]]:
        """A block's lines; those of the last block asked about are kept."""
        place = block["file"], block["offset"], block["length"]
        if self.held[0] != place:
            self.held = place, read_block(self.fs, self.base, *place)
        return self.held[1]

    def entries(self, keys: list[tuple[str, int | None]]) -> Iterator[dict]:
        """The entries of each (key, page_id) of ``keys``, which are sorted: bisect the directory, then the block."""
        blocks = self.blocks(keys[0][0], keys[-1][0])
        lasts = [_order(b["last_key"], b["last_page"]) for b in blocks]
        for key in keys:
            own = _order(*key)
            at = bisect_left(lasts, own)
            while at < len(blocks) and _order(blocks[at]["first_key"], blocks[at]["first_page"]) <= own:
                lines = self.lines(blocks[at])
                by = lambda x: _order(x[0], x[1])
                for k, page, more in lines[bisect_left(lines, own, key=by) : bisect_right(lines, own, key=by)]:
                    yield {"key": k, "page_id": page} | more
                at += 1

    def records(self, entries: Iterable[dict]) -> Iterator[dict]:
        """The records of ``entries``; neighbours in an archive are read by one range of some MB."""
        part: list[dict] = []
        for e in entries:
            if part and (e["file"] != part[0]["file"] or e["offset"] != part[-1]["offset"] + part[-1]["length"] or e["offset"] + e["length"] - part[0]["offset"] > _READ_BYTES):
                yield from self._range(part)
                part = []
            part.append(e)
        if part:
            yield from self._range(part)

    def _range(self, part: list[dict]) -> Iterator[dict]:
        start = part[0]["offset"]
        with self.fs.open_input_file(f"{self.base}/{part[0]['file']}") as f:
            data = f.read_at(part[-1]["offset"] + part[-1]["length"] - start, start)
        for e in part:
            yield read_record(data[e["offset"] - start : e["offset"] - start + e["length"]]) | {"url": e["url"]}


_DIRECTORY_ARROW = pa.schema(
    [("first_key", pa.string()), ("first_page", pa.int64()), ("last_key", pa.string()), ("last_page", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("n_lines", pa.int64())]
)


@dataclass
class CaptureIndex:
    """Archives below ``root``, and the directory of their index blocks, a Parquet table at ``at``."""

    root: str
    at: str
    directory: DataFrame

    def scan(self, url: str) -> Iterator[dict]:
        """The index entries of a URL by page_id, block by block: a URL with any number of captures is never held whole."""
        key, search = surt(url), _Search(self.root, self.at)
        for block in search.blocks(key, key):
            lines = search.lines(block)
            for k, page, more in lines[bisect_left(lines, key, key=lambda x: x[0]) : bisect_right(lines, key, key=lambda x: x[0])]:
                yield {"key": k, "page_id": page} | more

    def captures(self, url: str) -> list[dict]:
        """The index entries of a URL, by page_id."""
        return list(self.scan(url))

    def fetch(self, url: str) -> list[dict]:
        """The records of a URL, read by range."""
        return list(_Search(self.root, self.at).records(self.scan(url)))


def read_block(fs: pafs.FileSystem, base: str, file: str, offset: int, length: int) -> list[tuple[str, int | None, dict]]:
    """The (key, page_id, entry) lines of one index block."""
    with fs.open_input_file(f"{base}/{file}") as f:
        lines = gzip.decompress(f.read_at(length, offset)).decode().split("\n")
    return [(json.loads(k), None if p == "None" else int(p), json.loads(m)) for k, p, m in (x.split("\t") for x in lines)]


_ID, _URL_TEXT, _HTML = (f"{v} AS {c}" for c, v in (("page_id", "cast(page_id AS bigint)"), ("url", "coalesce(cast(url AS string), '')"), ("html", "coalesce(cast(html AS string), '')")))


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (with url) with their URL's key in front."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column("url").to_pylist()], pa.string()), *batch.columns], ["key", *batch.schema.names])

    return rows.mapInArrow(run, StructType([StructField("key", StringType()), *rows.schema.fields]))


def write_archives(pages: DataFrame, min_bytes: int = 0, root: str | None = None, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Write a record for each row of ``pages`` (page_id, url, html), and the capture index, ``block_lines`` to a block.

    Null html is the empty payload and a null url the empty string. Of rows with equal payloads of at least ``min_bytes``
    bytes those with the smallest page_id are responses, the others revisits; a null page_id is larger than any other.
    Repeated rows make records of their own. An empty table makes an empty index.
    """
    spark = pages.sparkSession
    root = root or shared_path(spark, "warc")
    rows = _keyed(pages.selectExpr(_ID, _URL_TEXT, _HTML))
    # Who revisits whom is settled without the payloads, and meets them in the sort by key.
    known = written(rows.select("key", "page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha"), F.octet_length("html").alias("bytes")), "payloads")
    groups = known.where(F.col("bytes") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    revisits = known.join(groups, "sha").where("NOT page_id <=> first").select("key", "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "sha", "first").distinct()
    both = rows.select("*", F.lit(None).cast("string").alias("sha"), F.lit(None).cast("long").alias("first")).unionByName(revisits)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id", F.col("sha").desc_nulls_last(), "url", "html")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, own, to = None, (None, None), {}
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                out = out or _Writer(root, block_lines)
                if own != (row["key"], row["page_id"]):
                    own, to = (row["key"], row["page_id"]), {}
                if row["sha"] is not None:
                    to[row["sha"]] = row["first"]
                    continue
                payload = row["html"].encode()
                sha = hashlib.sha256(payload).hexdigest() if to else ""
                found += out.add(row["key"], row["url"], row["page_id"], payload, to.get(sha), sha in to)
            yield _blocks(found)
        if out:
            yield _blocks(out.close())

    at = shared_path(spark, "directory")
    both.mapInArrow(write, _DIRECTORY).write.parquet(at)
    return CaptureIndex(root, at, spark.read.schema(_DIRECTORY).parquet(at))


def _blocks(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(_DIRECTORY_ARROW)], schema=_DIRECTORY_ARROW)


def _record_schema(payloads: bool) -> tuple[str, pa.Schema]:
    spark = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + (", payload binary" if payloads else "")
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]
    return spark, pa.schema(kinds + ([("payload", pa.binary())] if payloads else []))


def _batches(records: Iterable[dict], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for r in records:
        rows.append({n: r.get(n) for n in arrow.names})
        size += len(r.get("payload") or b"") if "payload" in arrow.names else 100
        if size > _READ_BYTES:
            yield pa.RecordBatch.from_pylist(rows, arrow)
            rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, arrow)


def read_archives(index: CaptureIndex, payloads: bool = False) -> DataFrame:
    """Every record, block by block of the index: page_id, payload_bytes, payload_digest, record_type, refers_to, url and, if
    ``payloads``, payload (binary; null for revisits). A block's records are read by ranges of some MB."""
    root, at = index.root, index.at
    schema, arrow = _record_schema(payloads)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(root, at)
        for batch in batches:
            for b in batch.to_pylist():
                yield from _batches(search.records(m for _, _, m in search.lines(b)), arrow)

    blocks = index.directory.select("file", "offset", "length")
    return blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, schema)


def look_up(index: CaptureIndex, pages: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of ``pages`` (page_id, url), found by bisecting the directory and the index blocks; columns as in
    ``read_archives``. A page's records are all captures of that page_id at its URL's key, once however often ``pages``
    names it; pages that were never captured give no row."""
    root, at = index.root, index.at
    schema, arrow = _record_schema(payloads)
    wanted = _keyed(pages.selectExpr(_ID, _URL_TEXT)).select("key", "page_id").distinct()
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = wanted.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(root, at)
        for batch in batches:
            keys = list(zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist(), strict=True))
            if keys:
                yield from _batches(search.records(search.entries(keys)), arrow)

    return ordered.mapInArrow(run, schema)


def lookup(spark: SparkSession, index: CaptureIndex, urls: list[str]) -> dict[str, list[dict]]:
    """The records of each URL."""
    return {u: index.fetch(u) for u in urls}


def op6_warc_index(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives, then looked up by its URL and page_id in their index and read by range."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return look_up(write_archives(pages), pages).drop("url")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(string_split(sha1(html), ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS b FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""
