"""Archives against plain Python: what is written, what is read back, and what is found broken."""

import base64
import gzip
import hashlib
import pathlib
import zlib

from weftwise.llm import warc

PAGES = "page_id long, url string, html string, payload string, digest string, status string"


def odd_rows():
    big = "ß" * 700_000 + "\r\n\r\nWARC/1.1\r\n" + "x" * 2_000_000
    rows = [(7, "http://a/ü b?x=1#y", "copy " * 30), (3, None, "copy " * 30), (9, "http://b", "copy " * 30), (4, "http://c\r\nWARC-Type: fake", "short"), (5, "", "short")]
    rows += [(1, "u", None), (2, "u", ""), (11, "u", big), (12, "u", big), (13, "u", "a" * 99), (14, "u", "a" * 99), (15, "u", "b" * 100), (16, "u", "b" * 100)]
    rows += [(20, "u", "again " * 40), (20, "u", "again " * 40), (21, "u", "again " * 40), (None, "u", "again " * 40), (None, "u", "none " * 40), (None, "u", "none " * 40), (-3, "u", "é" * 50), (-2, "u", "é" * 50)]
    return [(*r, "mine", "mine", "mine") for r in rows]


def brute(rows, least=100):
    leaders = {}
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        if len(data) >= least:
            old = leaders.get(data)
            leaders[data] = page if old is None else old if page is None else min(old, page)
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        lead = leaders.get(data)
        to = lead if lead is not None and lead != page else None
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to, "ok"))
    return sorted(map(str, out))


def test_round_trip(spark):
    rows = odd_rows()
    got = warc.archive_round_trip(spark.createDataFrame(rows, PAGES).repartition(3))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)
    assert dict(got.dtypes) == {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint", "status": "string"}


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def written(spark, tmp_path, rows, **more):
    manifest = warc.write_warc(spark.createDataFrame(rows, PAGES).coalesce(1), f"file://{tmp_path}/set", **more)
    return manifest, [pathlib.Path(r["path"].removeprefix("file:").replace("//", "/")) for r in manifest.orderBy("path").collect()]


def members(data):
    """(member, inflated) of a file, by the standard library."""
    while data:
        d = zlib.decompressobj(31)
        text = d.decompress(data)
        yield data[: len(data) - len(d.unused_data)], text
        data = d.unused_data


def test_archives_are_bounded_and_one_record_is_one_member(spark, tmp_path):
    rows = [(i, "http://x", f"{i} " * 2000, "", "", "") for i in range(40)]
    manifest, files = written(spark, tmp_path, rows, archive_bytes=2_000)
    assert len(files) > 1 and manifest.groupBy().sum("records").first()[0] == 40
    seen = 0
    for f in files:
        parts = list(members(f.read_bytes()))
        assert b"".join(t for _, t in parts) == gzip.decompress(f.read_bytes())
        assert b"WARC-Type: warcinfo" in parts[0][1]
        for _, text in parts:
            head, _, rest = text.partition(b"\r\n\r\n")
            length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")).split()[1])
            assert head.startswith(b"WARC/1.1\r\n") and len(rest) == length + 4 and rest.endswith(b"\r\n\r\n")
        seen += len(parts) - 1
    assert seen == 40
    # a file that no manifest names, as a lost task leaves it, is never read
    (files[0].parent / "pages-lost.warc.gz").write_bytes(b"half")
    assert warc.read_warc(manifest).filter("record_type = 'response'").count() == 40
    assert warc.list_archives(spark, f"file://{tmp_path}/set/*.warc.gz").count() == len(files) + 1


def test_payload_bytes_come_back(spark, tmp_path):
    rows = odd_rows()
    manifest, _ = written(spark, tmp_path, rows)
    got = {bytes(r["payload"]) for r in warc.read_warc(manifest, payload=True).filter("record_type = 'response'").collect()}
    assert got == {(r[2] or "").encode() for r in rows}
    revisits = warc.read_warc(manifest, payload=True).filter("record_type = 'revisit'")
    assert revisits.filter("payload is not null").isEmpty() and revisits.count() == 7


def rows_of(path):
    return [(r[1], r[2], r[7], r[9]) for r in warc._rows(f"file://{path}", False)]


def test_broken_members_are_told_and_passed(spark, tmp_path):
    rows = [(i, "http://x", hashlib.sha256(str(i).encode()).hexdigest() * 40, "", "", "") for i in range(6)]
    _, (f,) = written(spark, tmp_path, rows)
    parts = [m for m, _ in members(f.read_bytes())]
    flipped = bytearray(parts[3])
    flipped[len(flipped) // 2] ^= 0xFF
    plain = zlib.decompress(parts[2], 31)
    swapped = gzip.compress(plain.replace(b"<", b"(", 1).replace(hashlib.sha256(b"1").hexdigest().encode(), b"0" * 64, 1))
    two = gzip.compress(zlib.decompress(parts[4], 31) + zlib.decompress(parts[5], 31))
    bare = gzip.compress(b"WARC/1.1\r\nWARC-Type: x\r\n\r\nno length")
    other = gzip.compress(b"hello\r\n\r\n")
    path = tmp_path / "broken.warc.gz"
    path.write_bytes(b"".join([parts[0], parts[1], bytes(flipped), swapped, two, bare, other, parts[6], parts[5][:-9]]))
    got = rows_of(path)
    assert [r[1] for r in got if r[3] == "ok"] == ["warcinfo", "response", "response"]
    said = [r[3] for r in got if r[3] != "ok"]
    assert "digest" in " ".join(said) and "more than one record in a member" in said and "no Content-Length" in said and "no WARC version line" in said and "the file ends within a record" in said
    assert [r[0] for r in got] == sorted(r[0] for r in got) and path.read_bytes()[next(r[0] for r in got if r[1] == "response" and r[0] > 700) :].startswith(parts[6])
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    assert rows_of(tmp_path / "empty.warc.gz") == []
    frame = spark.createDataFrame([(f"file://{path}",), (f"file://{tmp_path}/empty.warc.gz",)], "path string")
    assert warc.read_warc(frame, rows=2).count() == len(got)


def test_records_of_other_writers(tmp_path):
    """SHA-1 in base 32, no payload digest, a metadata record, folded case in field names."""
    body = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\nhello"
    sha1 = base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    one = f"WARC/1.0\r\nwarc-type: response\r\nWARC-Payload-Digest: sha1:{sha1}\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Type: text/plain\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    path = tmp_path / "x.warc.gz"
    path.write_bytes(gzip.compress(one) + gzip.compress(two))
    got = [(r[2], r[7], r[8], r[9]) for r in warc._rows(f"file://{path}", False)]
    assert got == [("response", 5, hashlib.sha1(b"hello").hexdigest(), "ok"), ("metadata", 3, hashlib.sha256(b"abc").hexdigest(), "ok")]
