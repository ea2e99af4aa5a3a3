"""WARC archives with a two-level capture index.

Archives: gzip members of one record each, so any record can be read by its byte range. The index:
lines sorted by reversed-host URL key, cut into compressed blocks; of each block the directory keeps
its first and last key and byte range. A lookup binary-searches the directory, reads the blocks
whose keys can match, and reads just the records' ranges.

All files lie in a folder that driver and executors share, and get a new name for each attempt of a
task. Only what a finished task has reported is ever read, so a lost executor leaves at most a file
that nothing refers to.

A null payload is empty; a null url has the empty key. Of at least min_bytes long records with
equal payloads, those with the largest page_id are responses and the others revisit it; rows whose
page_id is null count as smallest. Control characters of a url are percent-encoded in its record.
Page ids are whole numbers. Repeated rows are records of their own, and rows that share a url are all
found by it. Payloads of any length are written whole. An empty table gives an empty one; columns other
than page_id, url and the payload, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections import OrderedDict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize, scratch

DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES = 1 << 30
BLOCK_LINES = 2000
#: Directory entries that are broadcast at a time; a larger directory is searched in ranges of so many.
DIRECTORY_CHUNK = 500_000
#: Index blocks that one task of a lookup reads on average.
TASK_BLOCKS = 8
#: Records that one task reads on average.
TASK_RECORDS = 5_000
SLICE = 4 << 20
#: Recurring digests that are sent to the pages at most, about 100 bytes each.
SENT_DIGESTS = 500_000

LOCATION = "urlkey string, page_id bigint, file string, offset bigint, length bigint"
DIRECTORY = "first string, last string, file string, offset bigint, length bigint, lines bigint"
RECORD = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, then `)` and the rest without the fragment; spaces encoded."""
    if not url:
        return ""
    url = url.partition("#")[0]
    _, mark, rest = url.partition("://")
    rest = rest if mark else url
    m = re.match(r"([^/?]*)(.*)", rest, re.S)
    host = ",".join(reversed(m[1].lower().split(".")))
    return _visible(f"{host}){m[2]}")


def _visible(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, not yet compressed; digest in hexadecimal digits. A revisit keeps the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if refers_to is None else http
    head = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_visible(url)}")
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """A record's fields; the digest and size of a response are those of the payload itself."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    f = dict(x.split(": ", 1) for x in lines)
    body = rest[: int(f["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    stated = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    out = {"page_id": _page(f["WARC-Record-ID"]), "url": f.get("WARC-Target-URI"), "record_type": f["WARC-Type"], "refers_to": _page(f.get("WARC-Refers-To", ""))}
    if f["WARC-Type"] == "revisit":
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        return out | {"payload_digest": stated, "payload_bytes": size, "payload": None}
    if (found := hashlib.sha1(payload).hexdigest()) != stated:
        raise ValueError(f"payload digest of page {out['page_id']} is {found}, not {stated}")
    return out | {"payload_digest": found, "payload_bytes": len(payload), "payload": payload}


def _page(urn: str) -> int | None:
    m = re.search(r"urn:page:(-?\d+)", urn)
    return int(m[1]) if m else None


class _Roller:
    """Appends byte strings to files of a folder, a new one after ROLL_BYTES."""

    def __init__(self, folder: str, stem: str, suffix: str):
        self.fs, self.path = _file_system(folder)
        self.folder, self.stem, self.suffix, self.out, self.at = folder, f"{stem}-{uuid.uuid4().hex}", suffix, None, 0
        self.n = 0

    def append(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at >= ROLL_BYTES:
            self.close()
            name = f"{self.stem}-{self.n:05d}{self.suffix}"
            self.out, self.uri, self.at, self.n = self.fs.open_output_stream(f"{self.path}/{name}", compression=None), f"{self.folder}/{name}", 0, self.n + 1
        where = (self.uri, self.at)
        self.out.write(data)
        self.at += len(data)
        return where

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def _rows(batch: pa.RecordBatch):
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def with_revisits(pages: DataFrame, html: str, min_bytes: int) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for a response)."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    # Only digests that recur join, from a narrow scan that is summed before it is dealt out.
    digests = pages.select("page_id", F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("p")).where(F.octet_length("p") >= min_bytes).select("page_id", F.sha1("p").alias("_d"))
    again = materialize(digests.groupBy(F.col("_d").alias("digest")).agg(F.max("page_id").alias("_to"), F.count("*").alias("_n")).where("_n > 1"), "recurring")
    if again.count() <= SENT_DIGESTS:  # payloads stay where they are
        rows = rows.join(F.broadcast(again.drop("_n")), "digest", "left")
    else:
        rows = join_hot(rows, again, "digest", "_n", pages.count(), "left")
    is_copy = F.col("_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_to"))
    return rows.select("page_id", "url", "payload", "digest", F.when(is_copy, F.col("_to")).alias("refers_to"))


def write_archives(pages: DataFrame, html: str = "html", min_bytes: int = 1000, folder: str | None = None) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html); returns the written table of locations."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    fs, path = _file_system(folder)
    fs.create_dir(path, recursive=True)

    def write(batches):
        roller = _Roller(folder, "part", ".warc.gz")
        try:
            for batch in batches:
                cols: list[list] = [[], [], [], [], []]
                for page_id, url, payload, digest, refers_to in _rows(batch):
                    z = zlib.compressobj(5, zlib.DEFLATED, 31)
                    data = z.compress(record_bytes(page_id, url, payload, digest, refers_to)) + z.flush()
                    for c, v in zip(cols, (url_key(url), page_id, *roller.append(data), len(data)), strict=True):
                        c.append(v)
                yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["urlkey", "page_id", "file", "offset", "length"])
        finally:
            roller.close()

    return materialize(with_revisits(pages, html, min_bytes).mapInArrow(write, LOCATION), "warc-locations")


def build_index(locations: DataFrame, folder: str | None = None) -> DataFrame:
    """Sort locations by key into compressed blocks; returns the written block directory."""
    spark = locations.sparkSession
    folder = folder or scratch(spark, "cdx")
    fs, path = _file_system(folder)
    fs.create_dir(path, recursive=True)

    def write(batches):
        roller = _Roller(folder, "cdx", ".gz")
        lines: list[str] = []

        def flush():
            data = zlib.compress("\n".join(lines).encode(), 5)
            file, offset = roller.append(data)
            out = [lines[0].partition("\t")[0]], [lines[-1].partition("\t")[0]], [file], [offset], [len(data)], [len(lines)]
            lines.clear()
            return pa.record_batch([pa.array(v, pa.string()) for v in out[:3]] + [pa.array(v, pa.int64()) for v in out[3:]], names=["first", "last", "file", "offset", "length", "lines"])

        try:
            for batch in batches:
                for key, page_id, file, offset, length in _rows(batch):
                    lines.append(f"{key}\t{'' if page_id is None else page_id}\t{file}\t{offset}\t{length}")
                    if len(lines) >= BLOCK_LINES:
                        yield flush()
            if lines:
                yield flush()
        finally:
            roller.close()

    order = ["urlkey", "page_id", "file", "offset"]
    return materialize(locations.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, DIRECTORY), "cdx-directory")


class BlockDirectory:
    """Sorted block bounds; blocks are read by range and a few kept."""

    def __init__(self, rows: list[tuple]):
        self.rows = sorted(rows)
        self.lasts = [r[1] for r in self.rows]

    def find(self, key: str) -> list[tuple]:
        at = bisect.bisect_left(self.lasts, key)
        out = []
        while at < len(self.rows) and self.rows[at][0] <= key:
            out.append(self.rows[at])
            at += 1
        return out


class _Ranges:
    """Range reads, with open files and the last blocks kept."""

    def __init__(self):
        self.files: OrderedDict = OrderedDict()
        self.blocks: OrderedDict = OrderedDict()

    def read(self, file: str, offset: int, length: int) -> bytes:
        if file not in self.files:
            fs, path = _file_system(file)
            self.files[file] = fs.open_input_file(path)
            if len(self.files) > 16:
                self.files.popitem(last=False)[1].close()
        return self.files[file].read_at(length, offset)

    def block(self, file: str, offset: int, length: int) -> list[list[str]]:
        where = (file, offset)
        if where not in self.blocks:
            self.blocks[where] = [x.split("\t") for x in zlib.decompress(self.read(file, offset, length)).decode().split("\n")]
            if len(self.blocks) > 4:
                self.blocks.popitem(last=False)
        return self.blocks[where]


def lookup(directory: DataFrame, urls: DataFrame, url: str = "url") -> DataFrame:
    """Locations of the captures of urls, each distinct key once.

    The directory is broadcast if it has at most DIRECTORY_CHUNK blocks; else it is searched range
    by range, so its size isn't bounded. Blocks found are dealt out before they are read, so the
    captures of one url, however many, come out of many tasks.
    """
    keys = urls.select(_key_udf()(F.col(url)).alias("urlkey")).distinct()
    n = directory.count()
    if n <= DIRECTORY_CHUNK:
        return _read_blocks(_find_blocks(directory, keys), n)
    cuts = _cuts(directory, n)
    out = None
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        within = [(F.col(c) >= lo) if lo is not None else F.lit(True) for c in ("urlkey", "last")]
        before = [(F.col(c) < hi) if hi is not None else F.lit(True) for c in ("urlkey", "first")]
        part = _find_blocks(directory.where(within[1] & before[1]), keys.where(within[0] & before[0]))
        out = part if out is None else out.unionByName(part)
    return _read_blocks(out, n)


def _cuts(directory: DataFrame, n: int) -> list[str]:
    """First keys that split the directory into ranges of about DIRECTORY_CHUNK blocks."""
    parts = -(-n // DIRECTORY_CHUNK)
    ranged = directory.select("first").repartitionByRange(parts, "first").groupBy(F.spark_partition_id().alias("p")).agg(F.min("first").alias("first"))
    return sorted({r["first"] for r in ranged.collect()})[1:]


def _key_udf():
    @F.pandas_udf("string")
    def key(urls: pd.Series) -> pd.Series:
        return pd.Series([url_key(u) for u in urls])

    return key


def _find_blocks(directory: DataFrame, keys: DataFrame) -> DataFrame:
    """urlkey and the range of each index block that can have it, by binary search in the directory."""
    found = directory.sparkSession.sparkContext.broadcast(BlockDirectory([tuple(r) for r in directory.select("first", "last", "file", "offset", "length").collect()]))

    def packed(rows):
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["urlkey", "file", "offset", "length"])

    def search(batches):
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                rows += [(key, *where) for _, _, *where in found.value.find(key)]
                if len(rows) >= 50_000:
                    yield packed(rows)
                    rows = []
            yield packed(rows)

    return keys.mapInArrow(search, "urlkey string, file string, offset bigint, length bigint")


def _read_blocks(wanted: DataFrame, blocks: int) -> DataFrame:
    """The lines of each wanted key in each wanted block, of `blocks` in all; a block is read once."""

    def read(batches):
        ranges = _Ranges()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, *where in _rows(batch):
                lines = ranges.block(*where)
                at = bisect.bisect_left(lines, key, key=lambda x: x[0])
                while at < len(lines) and lines[at][0] == key:
                    k, page, file, offset, length = lines[at]
                    for c, v in zip(out, (k, int(page) if page else None, file, int(offset), int(length)), strict=True):
                        c.append(v)
                    at += 1
                if len(out[0]) >= 50_000:
                    yield _location_batch(out)
                    out = [[], [], [], [], []]
            yield _location_batch(out)

    parts = max(1, -(-blocks // TASK_BLOCKS))
    return wanted.repartition(parts, "file", "offset").sortWithinPartitions("file", "offset", "urlkey").mapInArrow(read, LOCATION)


def _location_batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["urlkey", "page_id", "file", "offset", "length"])


def read_records(locations: DataFrame, records: int = 0) -> DataFrame:
    """The records at locations, by range reads in the order in which they lie; records: about how many there are."""

    def read(batches):
        ranges = _Ranges()
        names = [x.split(" ")[0] for x in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

        def packed(rows):
            return pa.record_batch([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True)], names=names)

        for batch in batches:
            rows, held = [], 0
            for file, offset, length in _rows(batch):
                rows.append(parse_record(zlib.decompress(ranges.read(file, offset, length), 31)))
                held += rows[-1]["payload_bytes"]
                if held > 16 << 20:
                    yield packed(rows)
                    rows, held = [], 0
            yield packed(rows)

    # Slices of an archive, so that a large one is read by many tasks.
    cut = F.floor(F.col("offset") / SLICE)
    return locations.withColumn("_cut", cut).repartition(max(1, records // TASK_RECORDS), "file", "_cut").sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInArrow(read, RECORD)


def capture(pages: DataFrame, html: str = "html", min_bytes: int = 1000) -> DataFrame:
    """Write pages to archives, index them, look every url up in the index and read the records back."""
    locations = write_archives(pages, html, min_bytes)
    directory = build_index(locations)
    return read_records(lookup(directory, pages.select("url")), directory.agg(F.sum("lines")).first()[0] or 0)
