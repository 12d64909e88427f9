"""WARC files: a writer of one gzip member per record, and a splittable reader as a Spark data source."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import fresh_path, written

MAGIC, PLAIN = b"\x1f\x8b\x08", b"WARC/1."
SPLIT_BYTES = 32 << 20
READ_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
SCHEMA = "page_id long, url string, html string, warc_type string, path string, offset long"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """One WARC record as a gzip member; the same row always gives the same bytes.

    A null html is a metadata record without content. A null url or page_id leaves its header out. CR and LF within a
    url are written, and come back, percent-encoded.
    """
    head = [b"WARC/1.0", b"WARC-Type: " + (b"metadata" if html is None else b"response"), b"WARC-Date: 1970-01-01T00:00:00Z"]
    body = b"" if html is None else html.encode("utf-8", "surrogatepass")
    name = f"urn:page:{page_id}" if page_id is not None else "urn:sha1:" + hashlib.sha1((url or "").encode() + body).hexdigest()
    head.append(f"WARC-Record-ID: <{name}>".encode())
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "surrogatepass"))
    if html is not None:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
        head.append(b"Content-Type: application/http; msgtype=response")
    head.append(b"Content-Length: %d" % len(body))
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A name of its own for each attempt: what a failed or repeated attempt leaves behind is in no manifest.
        path, n, out = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, None
        for b in batches:
            if out is None:
                system, place = _open(path)
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(place, compression=None)
            for row in zip(*(c.to_pylist() for c in b.columns)):
                out.write(record(*row))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

    return run


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes page_id, url and html as WARC files, one per task; returns the manifest (path, records) of the tasks that succeeded."""
    rows = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_write(folder), "path string, records long")
    return written(rows, "warc-manifest")


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def _header(data: bytes, at: int) -> tuple[dict[bytes, bytes], int, int] | None:
    """(headers, start and size of the block) of the record at ``at``; None where it has no end, or no length."""
    end = data.find(b"\r\n\r\n", at)
    if data[at : at + 7] != b"WARC/1." or end < 0:
        return None
    lines = data[at:end].split(b"\r\n")[1:]
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
    size = head.get(b"content-length", b"0")
    return (head, end + 4, int(size)) if size.isdigit() else None


def _records(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(headers, block) of each record in one member, up to what is no record."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        got = _header(data, at)
        if got is None:
            return
        head, start, size = got
        yield head, data[start : start + size]
        at = start + size


class Members:
    """Gzip members of a file, read piecemeal from ``start``."""

    def __init__(self, file, start: int, size: int) -> None:
        self.file, self.base, self.size, self.buf = file, start, size, b""

    def _more(self) -> bool:
        at = self.base + len(self.buf)
        if at >= self.size:
            return False
        self.file.seek(at)
        piece = self.file.read(min(max(READ_BYTES, len(self.buf)), self.size - at))  # at least doubled: a long member isn't copied over and over
        self.buf += piece
        return bool(piece)

    def at(self, offset: int) -> bytes | None:
        """Drops what precedes ``offset``; None at the file's end."""
        while offset - self.base > len(self.buf) and self._more():
            pass
        self.buf = self.buf[offset - self.base :]
        self.base = offset
        while len(self.buf) < 4 and self._more():
            pass
        return self.buf if self.buf else None

    def candidate(self, offset: int, end: int, magic: bytes = MAGIC) -> int | None:
        """The first ``magic``, that of gzip, at or after ``offset`` and before ``end``."""
        while True:
            found = self.buf.find(magic, offset - self.base)
            if 0 <= found:
                return self.base + found if self.base + found < end else None
            offset = max(offset, self.base + len(self.buf) - len(magic) + 1)
            if offset >= end or not self._more():
                return None

    def decode(self, offset: int, header_only: bool = False) -> tuple[bytes, int] | None:
        """(content, offset after it) of the member at ``offset``; None where it is none, or holds no WARC record."""
        if self.at(offset) is None or self.buf[:3] != MAGIC or len(self.buf) < 4 or self.buf[3] & 0xE0:
            return None
        unpack, parts, fed, seen = zlib.decompressobj(31), [], 0, b""
        try:
            while not unpack.eof:
                if fed == len(self.buf) and not self._more():
                    return None
                piece = self.buf[fed : fed + READ_BYTES] if seen else self.buf[fed : fed + 512]
                fed += len(piece)
                parts.append(unpack.decompress(piece))
                if len(seen) < 7:
                    seen += parts[-1]
                    if not b"WARC/1.".startswith(seen[:7]):
                        return None
        except zlib.error:
            return None
        return (b"".join(parts), offset + fed - len(unpack.unused_data)) if seen[:7] == b"WARC/1." else None


    def plain(self, offset: int) -> tuple[dict[bytes, bytes], bytes, int] | None:
        """(headers, block, offset after it) of the uncompressed record at ``offset``; None where it is none, or no record nor the file's end follows it."""
        if self.at(offset) is None:
            return None
        while self.buf.find(b"\r\n\r\n") < 0 and len(self.buf) < READ_BYTES and self._more():
            pass
        got = _header(self.buf, 0)
        if got is None or not {b"warc-type", b"warc-record-id", b"content-length"} <= got[0].keys():
            return None
        head, start, size = got
        while len(self.buf) < start + size + 4 + len(PLAIN) and self._more():
            pass
        rest = self.buf[start + size : start + size + 4 + len(PLAIN)]
        if len(self.buf) < start + size or rest.strip(b"\r\n")[: len(PLAIN)] not in (PLAIN, b""):
            return None
        return head, self.buf[start : start + size], offset + start + size


def read_plain(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict[bytes, bytes], bytes]]:
    """``read_range`` of a file that isn't compressed."""
    members, at = Members(file, start, size), start
    while at < end:
        place = members.candidate(at, end, PLAIN)
        if place is None:
            return
        got = members.plain(place)
        if got is None:
            at = place + 1
            continue
        head, block, at = got
        yield place, head, block


def read_range(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict[bytes, bytes], bytes]]:
    """(offset, headers, block) of the records whose member starts in [start, end); the last may end beyond."""
    members, at = Members(file, start, size), start
    while at < end:
        place = members.candidate(at, end)
        if place is None:
            return
        got = members.decode(place)
        if got is None:
            at = place + 1
            continue
        content, at = got
        for head, block in _records(content):
            yield place, head, block


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = options["path"].split(",")
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        out = []
        for uri in self.paths:
            system, place = _open(uri)
            info = system.get_file_info(place)
            files = system.get_file_info(fs.FileSelector(place, recursive=True)) if info.type == fs.FileType.Directory else [info]
            for f in files:
                if f.type == fs.FileType.File and f.size:
                    name = uri if f.path == place else uri.rstrip("/") + f.path[len(place.rstrip("/")) :]
                    out += [Range(name, s, min(s + self.split, f.size)) for s in range(0, f.size, self.split)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, place = _open(partition.path)
        size = system.get_file_info(place).size
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
        rows, held = [], 0
        with system.open_input_file(place) as file:
            reads = read_plain if file.read(len(PLAIN)) == PLAIN else read_range
            for offset, head, block in reads(file, size, partition.start, partition.end):
                kind = head.get(b"warc-type", b"").decode("utf-8", "replace")
                name = head.get(b"warc-record-id", b"").strip(b"<>")
                html = None
                if kind == "response":
                    _, _, payload = block.partition(b"\r\n\r\n")
                    html = payload.decode("utf-8", "replace")
                url = head.get(b"warc-target-uri")
                page = name[9:] if name.startswith(b"urn:page:") else b""
                rows.append((int(page) if page.lstrip(b"-").isdigit() else None, None if url is None else url.decode("utf-8", "replace"), html, kind, partition.path, offset))
                held += len(block)
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class WarcSource(DataSource):
    """``spark.read.format("warc").option("splitBytes", n).load(path)``: files or folders, cut into byte ranges."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})


def read_warc(spark: SparkSession, paths: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(page_id, url, html, warc_type, path, offset) of every record under ``paths``, comma-separated.

    A task looks in its byte range for gzip magic, takes a candidate for a member where it decodes to a WARC
    header, and owns the records whose member starts inside, so every record is read once whatever the ranges. Bytes that are no
    member are passed over, as is what is left of a member from a record without end or length on. A file that begins with
    a record is read uncompressed in the same way: a record must have the headers that all have and be followed by another or the file's end
    (a whole record quoted within another's block, in a range that begins inside that block, can't be told from one).
    Missing headers are null; repeated records are read each; a long record is held whole by its task; a file without records gives no rows.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("splitBytes", split_bytes).load(paths)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = fresh_path(spark, "warc")
    files = [r.path for r in write_warc(pages, folder).select("path").collect()]
    if not files:
        return pages.limit(0).select(F.col("page_id").cast("long"), "url", "html")
    return read_warc(spark, ",".join(files)).select("page_id", "url", "html")


SQL = "select page_id, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') as url, html from pages"
