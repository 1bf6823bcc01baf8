import gzip
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from climaspark.llm import warc as W
from climaspark.llm.queries import op8_warc, table


@given(st.lists(st.binary(max_size=300), min_size=1, max_size=6), st.integers(1, 50))
@settings(max_examples=60, deadline=None)
def test_members_at_any_chunk_size(payloads, size):
    data = b"".join(W.member(i, "http://x/", p, None) for i, p in enumerate(payloads))
    chunks = [data[i : i + size] for i in range(0, len(data), size)]
    got = [W.record(c) for c in W.members(chunks)]
    assert [r[-1] for r in got] == payloads and [r[0] for r in got] == list(range(len(payloads)))
    assert gzip.decompress(data).count(b"WARC/1.1") >= len(payloads)


def test_broken_archives():
    good = W.member(1, "u", b"body", None)
    with pytest.raises(W.BrokenArchive):
        list(W.members([good[:-5]]))
    content = next(W.members([good]))
    for bad in (content.replace(b"body", b"bodx"), content[:-1], b"x" + content, content.replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:A")):
        with pytest.raises(W.BrokenArchive):
            W.record(bad)
    with pytest.raises(zlib.error):
        list(W.members([b"not gzip at all"]))


def expected(rows):
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(i, last.get(h or "", -(2**62)))
    return sorted((i, len((h or "").encode()), W.base32_sha1((h or "").encode()), "response" if last[h or ""] == i else "revisit", None if last[h or ""] == i else last[h or ""]) for i, _, h in rows)


def through(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return W.read(W.written(W.archives(pages), "archives"))


def test_copies_nulls_and_long_pages(spark):
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(["a", "b", "a", None, "", "é🎉" * 200_000, "a", None])] + [(-3, None, "neg"), (9, "two\r\nlines", "neg")]
    got = through(spark, rows)
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()) == expected(rows)
    assert got.where("record_type = 'response' and length(payload) != payload_bytes").count() == 0
    assert through(spark, []).count() == 0


def test_repeated_rows_and_null_ids(spark):
    got = through(spark, [(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (None, None, None)]).collect()
    assert len(got) == 4 and sorted(str(r["record_type"]) for r in got) == ["response", "response", "response", "revisit"]


def test_least_size(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r["page_id"]: r["refers_to"] for r in W.with_reference(pages, least=3).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "pages").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, op8_warc(spark, sf).collect())) == expected(rows)


def test_files(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(W.member(1, "u", b"one", None) + W.member(2, "u", b"one", 1))
    got = W.read_files(spark, str(tmp_path)).orderBy("page_id").collect()
    assert [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got] == [(1, "response", None, 3), (2, "revisit", 1, 3)]


def foreign(kind, headers, block, http=True):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"Content-Length: {len(block)}", *headers]
    if http:
        head.append("Content-Type: application/http;msgtype=response")
    return gzip.compress("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n")


def test_records_of_other_writers(spark, tmp_path):
    body = b"<html>x</html>"
    sha, hexed = W.base32_sha1(body), __import__("hashlib").sha256(body).hexdigest()
    urn = "WARC-Record-ID: <urn:uuid:5e1b2f5a-0000-4000-8000-0123456789ab>"
    data = (
        foreign("warcinfo", [urn, "Content-Type: application/warc-fields"], b"software: x\r\n", http=False)
        + foreign("request", [urn, "WARC-Target-URI: http://a/"], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n")
        + foreign("response", [urn, "WARC-Target-URI: http://a/", f"WARC-Payload-Digest: sha1:{sha}"], b"HTTP/1.1 200 OK\r\nServer: y\r\n\r\n" + body)
        + foreign("response", [urn, f"WARC-Payload-Digest: sha256:{hexed}", "WARC-Block-Digest: blake3:abc"], b"HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\n" + body)
        + foreign("response", [urn, "WARC-Payload-Digest: sha1:AAAA"], b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n0\r\n\r\n")
        + foreign("revisit", [urn, "WARC-Refers-To: <urn:uuid:1>"], b"HTTP/1.1 304 Not Modified\r\n\r\n")
        + foreign("resource", [urn, "WARC-Target-URI: dns:a"], b"1.2.3.4", http=False)
    )
    (tmp_path / "b.warc.gz").write_bytes(data)
    got = W.read_files(spark, str(tmp_path)).collect()
    assert [r["record_type"] for r in got] == ["warcinfo", "request", "response", "response", "response", "revisit", "resource"]
    assert bytes(got[2]["payload"]) == bytes(got[3]["payload"]) == body and got[2]["payload_digest"] == sha and got[3]["payload_bytes"] == len(body)
    assert got[5]["payload"] is None and got[5]["refers_to_id"] == "<urn:uuid:1>" and got[6]["payload_digest"] == W.base32_sha1(b"1.2.3.4")
    assert all(r["page_id"] is None for r in got)


def test_archives_roll_over(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", " ".join(str(hash((i, j))) for j in range(20_000))) for i in range(12)], "page_id long, url string, html string").coalesce(1)
    want = sorted((r["page_id"], r["payload_bytes"]) for r in W.read(W.written(W.archives(pages), "one")).collect())
    one = W.archives(pages).select("archive").distinct().count()
    monkeypatch.setattr(W, "ROLL", W.CHUNK)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(W)
    try:
        rolled = W.written(W.archives(pages), "rolled")
        assert rolled.select("archive").distinct().count() > one == 1
        assert sorted((r["page_id"], r["payload_bytes"]) for r in W.read(rolled).collect()) == want
    finally:
        cloudpickle.unregister_pickle_by_value(W)


def test_members_inflate_in_steps():
    bomb = W.member(1, "u", b"a" * 5_000_000, None)
    assert len(bomb) < 20_000 and len(W.record(next(W.members([bomb])))[-1]) == 5_000_000
