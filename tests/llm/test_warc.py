from __future__ import annotations

import gzip
import hashlib

import numpy as np
import pytest

from shelfmark.llm import warc as W
from shelfmark.llm.common import scratch_path

SCHEMA = "page_id long, url string, html string, refers_to string, same int"


def test_members_are_plain_gzip_and_records_come_back():
    archive = W.write_record(7, "http://a/\r\nb c", "häß\r\n\r\n".encode(), None, False) + W.write_record(8, None, b"x" * 2000, 7, True) + b"\0\0"
    assert gzip.decompress(archive).count(b"WARC/1.1\r\n") == 2
    (first, one), (second, two) = W.read_records(archive)
    assert one == "häß\r\n\r\n".encode() and first["x-row-key"] == "7" and "\n" not in first["warc-target-uri"]
    assert two == b"" and second["warc-type"] == "revisit" and second["warc-refers-to"] == W.record_id(7, W.digest_of(b"x" * 2000))


def test_large_members_and_small_steps():
    import os

    big = os.urandom(17 << 20)
    ((_, payload),) = W.read_records(W.write_record(1, "u", big, None, False))
    assert payload == big


@pytest.mark.parametrize("harm", ["cut", "flip", "length", "junk"])
def test_broken_archives_are_refused(harm):
    whole = W.write_record(1, "http://a/", b"payload" * 50, None, False)
    if harm == "cut":
        bad = whole[:-9]
    elif harm == "flip":
        raw = bytearray(gzip.decompress(whole))
        raw[-20] ^= 1
        bad = gzip.compress(bytes(raw))
    elif harm == "length":
        bad = gzip.compress(gzip.decompress(whole).replace(b"Content-Length: ", b"Content-Length: 1"))
    else:
        bad = whole + b"junk"
    with pytest.raises(W.WarcError):
        list(W.read_records(bad))


def _round_trip(spark, rows):
    pages = spark.createDataFrame(rows, SCHEMA)
    path = scratch_path(spark, "warc-test")
    W.write(W.choose_revisits(pages), path, records_per_file=3)
    return W.resolve(W.read(spark, path)).collect()


def test_round_trip_with_revisits_nulls_and_repeats(spark):
    big, other = "é" * 600, "z" * 1000
    rows = [(1, "u1", big, "x", 1), (5, "u2", big, "x", 1), (3, None, big, "x", 1), (2, "u", "small", "x", 1), (4, "u", "small", "x", 1), (6, "", None, "x", 1), (7, "u", "", "x", 1), (8, "u", other, "x", 1), (8, "u", other, "x", 1), (None, "u", other, "x", 1), (9, "u", "q" * 999, "x", 1), (10, "u", "q" * 999, "x", 1)]
    got = _round_trip(spark, rows)
    assert len(got) == len(rows)
    for r in got:
        page = next(p for p in rows if p[0] == r.key)
        payload = (page[2] or "").encode()
        assert r.payload_digest == hashlib.sha1(payload).hexdigest() and r.payload_bytes == len(payload)
        assert r.record_type == "revisit" or bytes(r.payload) == payload
    kinds = {r.key: (r.record_type, r.refers_to) for r in got}
    assert kinds[1] == kinds[3] == ("revisit", 5) and kinds[None] == ("revisit", 8)
    assert all(kinds[k] == ("response", None) for k in (2, 4, 5, 6, 7, 8, 9, 10))


def test_empty_table(spark):
    assert _round_trip(spark, []) == []


def test_records_of_other_writers(spark, tmp_path):
    import gzip
    import hashlib

    def record(headers, block):
        head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
        return gzip.compress(head.encode() + block + b"\r\n\r\n")

    body = b"HTTP/1.1 200 OK\r\n\r\n<p>x</p>"
    records = [
        record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:a>"), ("Content-Type", "application/warc-fields")], b"software: other\r\n"),
        record([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:b>"), ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\n\r\n"),
        record([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(b"<p>x</p>").hexdigest()), ("X-Long", "one\r\n two"), ("Content-Type", "application/http")], body),
        record([("WARC-Type", "metadata"), ("WARC-Block-Digest", "sha1:" + hashlib.sha1(b"m").hexdigest())], b"m"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(records))
    got = {r.record_type: r for r in W.read(spark, str(tmp_path)).collect()}
    assert set(got) == {"warcinfo", "request", "response", "metadata"}
    assert bytes(got["response"].payload) == b"<p>x</p>" and got["response"].payload_digest == hashlib.sha1(b"<p>x</p>").hexdigest()
    for wrong in (record([("WARC-Type", "response"), ("WARC-Block-Digest", "sha1:" + "0" * 40)], b"m"), gzip.compress(b"WARC/1.0\r\nX: \xff\r\nContent-Length: 0\r\n\r\n\r\n\r\n")):
        with pytest.raises(W.WarcError):
            list(W.read_records(wrong))


def test_archives_are_bounded_by_bytes_and_by_records(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, f"http://a/{i}", rng.bytes(20_000).hex()) for i in range(60)]
    chosen = W.choose_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")).coalesce(1)
    for folder, bounds, most in (("bytes", {"archive_bytes": 100_000}, 5), ("records", {"records_per_file": 7}, 7)):
        W.write(chosen, f"file://{tmp_path}/{folder}", **bounds)
        files = [f for f in (tmp_path / folder).iterdir() if f.name.startswith("part-")]
        found = [sum(1 for _ in W.read_records(f.read_bytes())) for f in files]
        assert sum(found) == 60 and max(found) <= most and len(files) >= 60 / most
        if folder == "bytes":
            assert max(f.stat().st_size for f in files) < 100_000 + 30_000
        back = W.read(spark, f"file://{tmp_path}/{folder}").select("key", "payload").collect()
        assert {r.key: bytes(r.payload).decode() for r in back} == {k: html for k, _, html in rows}
