"""WARC archives: a writer that stores equal payloads once, and a sequential reader that checks what it reads.

Each record is a gzip member of its own. The writer's tasks write archives of bounded size below a shared folder and
report them in a manifest; what a lost or repeated task leaves behind isn't listed there, so it is never read. The
reader takes an archive a task: it inflates member after member in pieces of 1 MB, frames the block by its
Content-Length and holds block and payload against their digests, without ever holding a payload whole unless it is
asked for. Python's part opens archives with ``pyarrow.fs``: local and mounted folders, HDFS, S3, GCS.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwise.llm.common import let_workers_import, materialise, work_dir

VERSION, GZIP, MAGIC = "WARC/1.1", 31, b"\x1f\x8b\x08"
#: Bytes that are read from a file, and that are inflated, in one piece.
READ, CHUNK = 1 << 16, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed when it has grown to so many bytes; a header block has to end within so many.
ARCHIVE_BYTES, HEADER_BYTES = 64 << 20, 1 << 20
#: At most so many tasks read archives at once; each then reads several.
MOST_READERS = 20_000
MANIFEST = "path string, records long, bytes long"
RECORD = "path string, offset long, record_type string, record_id string, target_uri string, record_date string, refers_to string, payload_bytes long, payload_digest string, status string"
_RECORD_ARROW = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("record_date", pa.string()), ("refers_to", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("status", pa.string()),
])


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, as Hadoop writes it (``file:/x``) or as usual (``file:///x``)."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


# ---------------------------------------------------------------- writing


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): of equal payloads of ``least`` bytes and more, all but that of the
    smallest page_id refer to it.

    Rows that share both payload and smallest id are all responses. A null id comes after all others; if all copies
    have none, all are responses. Null html is the empty payload. Only digests of payloads that stand more than once
    are joined, as a written table, so Spark sees their true size and sends them to the pages while they are few.
    """
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    digest = F.sha2(F.col("payload"), 256)
    copies = keyed.filter(F.octet_length("payload") >= least).groupBy(F.unhex(digest).alias("d")).agg(F.min("page_id").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    copies = materialise(copies, f"{work_dir(pages.sparkSession)}/copies")
    keyed = keyed.withColumn("digest", digest)
    refers = F.when(F.col("leader").isNotNull() & ~F.col("leader").eqNullSafe(F.col("page_id")), F.col("leader")).alias("refers_to")
    return keyed.join(copies, F.unhex(keyed["digest"]) == copies["d"], "left").select("page_id", "url", "payload", "digest", refers)


def _head(fields: list[tuple[str, str | None]]) -> bytes:
    return "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in fields if v is not None), "", ""]).encode()


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response or revisit record as one gzip member; a revisit has the HTTP header only.

    Control characters, blanks and anything beyond ASCII in the address are percent-encoded.
    """
    http = http_head(len(payload))
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", page_urn(page_id)), ("WARC-Date", date), ("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else None),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Refers-To", None if refers_to is None else page_urn(refers_to)), ("WARC-Profile", None if refers_to is None else PROFILE),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return member(_head(fields), block)


def member(head: bytes, block: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return b"".join((packer.compress(head), packer.compress(block), packer.compress(b"\r\n\r\n"), packer.flush()))


def warcinfo(name: str, date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return member(_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]), block)


def write_warc(pages: DataFrame, path: str, least: int = 100, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write pages (page_id, url, html) as archives below ``path``, a folder that all nodes share; returns the manifest
    (path, records, bytes), which is written first of all into ``path``. Other columns are left out; an empty table
    gives an empty manifest.
    """
    spark = pages.sparkSession
    let_workers_import(spark)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = store(root)
        system.create_dir(folder, recursive=True)
        out, name, written, records = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{root}/{name}"], "records": pa.array([records], pa.int64()), "bytes": pa.array([written], pa.int64())})

        for batch in batches:
            ids, urls, payloads, digests, refers = batch.columns
            for i in range(batch.num_rows):
                if out is None:
                    name, written, records = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{folder}/{name}", compression=None)
                    written += out.write(warcinfo(name, date))
                payload = payloads[i].as_buffer()
                written += out.write(record(ids[i].as_py(), urls[i].as_py(), payload.to_pybytes() if payload is not None else b"", digests[i].as_py(), refers[i].as_py(), date))
                records += 1
                if written >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return materialise(with_revisits(pages, least).mapInArrow(run, MANIFEST), f"{path.rstrip('/')}/manifest")


# ---------------------------------------------------------------- reading


class Broken(Exception):
    """What is wrong with a record."""


class Members:
    """A stream of gzip members: ``read`` gives inflated bytes of the present one, ``next_member`` goes on."""

    def __init__(self, raw):
        self.raw, self.held, self.base = raw, b"", 0
        self.ended, self.failed, self.inflate, self.plain = False, False, None, b""

    def _fill(self) -> bool:
        if not self.held and not self.ended:
            self.held = self.raw.read(READ)
            self.ended = not self.held
        return bool(self.held)

    def next_member(self) -> int | None:
        """Begin the member that stands here; its place in the file, or none at the end."""
        if not self._fill():
            return None
        self.inflate, self.plain, self.failed = zlib.decompressobj(GZIP), b"", False
        return self.base

    def more(self) -> bool:
        """Inflate another piece; false when the member is at its end."""
        while not self.inflate.eof:
            if not self.inflate.unconsumed_tail and not self._fill():
                self.failed = True
                raise Broken("the file ends within a record")
            self.held = before = self.inflate.unconsumed_tail or self.held
            try:
                got = self.inflate.decompress(before, CHUNK)
            except zlib.error as e:
                self.failed = True
                raise Broken(f"not a sound gzip member: {e}") from None
            left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.base += len(before) - len(left)
            self.held = left if self.inflate.eof else b""
            if got:
                self.plain += got
                return True
        return False

    def until(self, mark: bytes, most: int) -> bytes:
        """Bytes up to and with ``mark``."""
        at = 0
        while (found := self.plain.find(mark, at)) < 0:
            at = max(0, len(self.plain) - len(mark) + 1)
            if len(self.plain) > most or not self.more():
                raise Broken("a header without an end")
        found += len(mark)
        got, self.plain = self.plain[:found], self.plain[found:]
        return got

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces."""
        while n:
            if not self.plain and not self.more():
                raise Broken("a block shorter than its Content-Length")
            got, self.plain = self.plain[:n], self.plain[n:]
            n -= len(got)
            yield got

    def recover(self) -> None:
        """After a broken record: to the end of its member or, if that can't be inflated, to where the next one seems to begin."""
        try:
            self.plain = b""
            while not self.failed and self.more():
                self.plain = b""
        except Broken:
            pass
        if self.failed:
            self._skip_to_magic()

    def _skip_to_magic(self) -> None:
        at = 1
        while self._fill():
            found = self.held.find(MAGIC, at)
            if found >= 0:
                self.base, self.held = self.base + found, self.held[found:]
                return
            keep = self.held[-2:] if len(self.held) > 2 else b""
            more = self.raw.read(READ)
            self.base, self.held, self.ended, at = self.base + len(self.held) - len(keep), keep + more if more else b"", not more, 0


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise Broken("no WARC version line")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _digest(said: str | None):
    """The hash that a labelled digest names, or none if there is none that can be checked here."""
    algorithm = (said or "").partition(":")[0].lower().replace("-", "")
    return hashlib.new(algorithm) if algorithm in ("sha256", "sha1", "sha512", "md5") else None


def _agrees(made, said: str) -> bool:
    value = said.partition(":")[2]
    return value.lower() == made.hexdigest() or value.upper().rstrip("=") == base64.b32encode(made.digest()).decode().rstrip("=")


def read_record(members: Members, keep: bool) -> tuple[dict[str, str], int | None, str | None, bytes | None]:
    """(fields, payload_bytes, payload_digest, payload) of the record that is the present member.

    The payload of an HTTP message is what follows its header, that of any other record the whole block. A revisit's
    length is the one its HTTP header tells, its digest the recorded one.
    """
    fields = _fields(members.until(b"\r\n\r\n", HEADER_BYTES))
    said, whole = fields.get("warc-payload-digest"), fields.get("warc-block-digest")
    if not fields.get("content-length", "").isdigit():
        raise Broken("no Content-Length")
    length, kind = int(fields["content-length"]), fields.get("warc-type")
    block, payload = _digest(whole), _digest(said) or hashlib.sha256()
    http = fields.get("content-type", "").startswith("application/http")
    before, n, kept, head = b"", 0, [], not http
    for piece in members.pieces(length):
        if block:
            block.update(piece)
        if not head:
            before += piece
            end = before.find(b"\r\n\r\n")
            if end < 0 and len(before) > HEADER_BYTES:
                raise Broken("a header without an end")
            if end < 0:
                continue
            head, piece, before = True, before[end + 4 :], before[: end + 4]
        n += len(piece)
        payload.update(piece)
        if keep:
            kept.append(piece)
    if b"".join(members.pieces(4)) != b"\r\n\r\n" or members.plain or members.more():
        raise Broken("more than one record in a member")
    if block and not _agrees(block, whole):
        raise Broken("the block's digest differs")
    if kind == "revisit":
        told = re.search(rb"(?im)^content-length:\s*(\d+)", before)
        return fields, int(told[1]) if told else None, (said or "").partition(":")[2] or None, None
    if said and _digest(said) and not _agrees(payload, said):
        raise Broken("the payload's digest differs")
    return fields, n, payload.hexdigest(), b"".join(kept) if keep else None


def _rows(path: str, keep: bool) -> Iterator[tuple]:
    system, name = store(path)
    with system.open_input_stream(name, compression=None) as raw:
        members = Members(raw)
        while (offset := members.next_member()) is not None:
            try:
                fields, n, digest, payload = read_record(members, keep)
            except Broken as e:
                yield (path, offset, None, None, None, None, None, None, None, str(e), None)
                members.recover()
                continue
            get = fields.get
            yield (path, offset, get("warc-type"), get("warc-record-id"), get("warc-target-uri"), get("warc-date"), get("warc-refers-to"), n, digest, "ok", payload)


def read_warc(archives: DataFrame, payload: bool = False, rows: int = 1000) -> DataFrame:
    """The records of archives (path): where each stands, its fields, its payload's length and digest, and ``status``:
    ok or what is wrong. With ``payload`` its bytes too (null for revisits).

    A broken member is one row with a status and nulls, and reading goes on at the next member. Files that end
    within a record and empty files are no errors of the job.
    """
    let_workers_import(archives.sparkSession)
    schema = pa.schema([*_RECORD_ARROW, ("payload", pa.binary())]) if payload else _RECORD_ARROW

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=False)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                for row in _rows(path, payload):
                    held.append(row)
                    size += len(row[-1] or b"")
                    if len(held) >= rows or size >= CHUNK:
                        yield batch(held)
                        held, size = [], 0
        if held:
            yield batch(held)

    readers = max(1, min(archives.count(), MOST_READERS))
    return archives.select("path").repartition(readers).mapInArrow(run, RECORD + (", payload binary" if payload else ""))


def page_of(urn: str) -> F.Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, status) of every page, from the archives that
    are written of them and read back."""
    manifest = write_warc(pages, path or f"{work_dir(pages.sparkSession)}/archives")
    found = read_warc(manifest).filter("record_type is null or record_type != 'warcinfo'")
    return found.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"), "status")


def list_archives(spark: SparkSession, pattern: str) -> DataFrame:
    """(path) of the files that a Hadoop glob pattern names: only names pass through the driver."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return spark.createDataFrame([(x.getPath().toUri().toString(),) for x in found], "path string")
