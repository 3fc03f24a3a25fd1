"""Exact round trips, roles, and records that are broken."""

import hashlib
import zlib

import pytest

from lumenark.llm.warc import BrokenRecord, archived, indexed, members, read_archives, record, records, roles

PAGES = "page_id long, url string, html string"


def test_round_trip_and_roles(spark):
    long, other = "é" * 600, "x" * 1000
    rows = [(1, "http://a", long), (5, "http://b", long), (3, None, long), (2, "u", other), (4, "u\r\nX: y", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", other), (9, "u", "y" * 999), (10, "u", "y" * 999), (5, "http://b", long)]
    got = archived(spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as refers_to", "'d' as digest")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for page_id, _, html in rows:
        payload = (html or "").encode()
        for r in by[None if page_id is None else str(page_id)]:
            assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
            if r.record_type == "response":
                assert bytes(r.payload) == payload
    kinds = {k: {(r.record_type, r.refers_to) for r in v} for k, v in by.items()}
    assert kinds["1"] == kinds["3"] == {("revisit", "5")} and kinds["5"] == {("response", None)} and kinds[None] == {("revisit", "2")}
    assert all(kinds[k] == {("response", None)} for k in ("2", "4", "6", "7", "8", "9", "10"))


def test_empty_table_and_shuffled_roles(spark, monkeypatch):
    from lumenark.llm import warc

    assert archived(spark.createDataFrame([], PAGES)).count() == 0
    rows = spark.createDataFrame([(i, "u", "z" * 1000 if i % 2 else str(i) * 1000) for i in range(40)], PAGES)
    want = sorted(roles(rows).collect())
    monkeypatch.setattr(warc, "MAX_BROADCAST", 0)
    assert sorted(roles(rows).collect()) == want and sum(r.refers_to is not None for r in want) == 19


def test_reader_is_incremental_and_strict():
    made = [record(str(i), "u", bytes([65 + i]) * 3000, None) for i in range(5)]
    data = b"".join(made)
    for step in (1, 7, len(data)):
        assert [r["page_id"] for r in records(iter([data[i : i + step] for i in range(0, len(data), step)]))] == list("01234")
    with pytest.raises(BrokenRecord):
        list(members(iter([data[:-5]])))

    def again(change):
        return zlib.compress(change(zlib.decompress(made[0], 31)), 3, 31)

    for change in (lambda b: b.replace(b"AAAA", b"AAAB", 1), lambda b: b[:-4], lambda b: b + b"x", lambda b: b.replace(b"WARC/1.1", b"WARC/9.9")):
        with pytest.raises(BrokenRecord):
            list(records(iter([again(change)])))


def member(kind, block, *, content="application/http; msgtype=response", version="WARC/1.0", **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:x:{kind}>", "Content-Type": content, "Content-Length": str(len(block))} | {k.replace("_", "-"): v for k, v in more.items()}
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = version + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def test_records_of_other_writers():
    body = b"<p>hello</p>"
    ok = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"
    made = [
        member("warcinfo", b"software: x\r\n", content="application/warc-fields"),
        member("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", content="application/http; msgtype=request", WARC_Target_URI="http://a/"),
        member("response", ok + b"\r\n" + body, WARC_Target_URI="http://a/", WARC_Payload_Digest="sha1:" + hashlib.sha1(body).hexdigest()),
        member("response", ok + b"Transfer-Encoding: chunked\r\n\r\n5\r\n<p>he\r\n7;x\r\nllo</p>\r\n0\r\n\r\n", WARC_Payload_Digest="sha256:" + hashlib.sha256(body).hexdigest()),
        member("metadata", b"via: x", content="application/warc-fields", WARC_Block_Digest="md5:" + hashlib.md5(b"via: x").hexdigest()),
        member("resource", b"\x00\xff", content="image/png", WARC_Block_Digest="blake9:zzz", WARC_Target_URI="file:///a\r\n b"),
        member("revisit", ok + b"\r\n", WARC_Refers_To="<urn:x:response>"),
        member("response", ok + b"Content-Length: 900\r\n\r\ncut", WARC_Truncated="length"),
    ]
    got = list(records(iter([b"".join(made)])))
    assert [r["record_type"] for r in got] == ["warcinfo", "request", "response", "response", "metadata", "resource", "revisit", "response"]
    assert got[2]["payload"] == got[3]["payload"] == body and got[2]["payload_digest"] == got[3]["payload_digest"] == hashlib.sha1(body).hexdigest() and got[2]["payload_bytes"] == len(body)
    assert got[5]["payload"] == b"\x00\xff" and got[5]["url"] == "file:///a b" and (got[6]["payload_bytes"], got[6]["refers_to_record"]) == (None, "<urn:x:response>")
    broken = [
        member("response", b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nabc"), member("response", b"HTTP/1.1 200 OK\r\nContent-Length: x\r\n\r\nabc"), member("response", b"no header"),
        member("resource", b"abc", content="text/plain", WARC_Payload_Digest="sha1:" + "0" * 40), member("resource", b"abc", content="text/plain", WARC_Block_Digest="sha1:!!"),
        member("response", ok + b"Transfer-Encoding: chunked\r\n\r\n5\r\nabc"), member("resource", b"abc", Content_Length="-3"), member("resource", b"abc", version="WARC/2.0"),
    ]
    for bad in broken:
        with pytest.raises(BrokenRecord):
            list(records(iter([made[0] + bad + made[2]])))


def test_a_record_is_never_lost_in_silence(spark, tmp_path):
    pages = [record(str(i), "u", b"p%d" % i, None) for i in range(4)]
    pages[1] = member("response", b"HTTP/1.1 200 OK\r\n\r\nno length")
    (tmp_path / "a.warc.gz").write_bytes(b"".join(pages))
    files = spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "path string")
    assert [bytes(r.payload) for r in read_archives(files).collect()] == [b"p0", b"no length", b"p2", b"p3"]
    assert indexed(files).count() == 4 and "payload" not in indexed(files).columns
    body = b"x" * 2000
    (tmp_path / "b.warc.gz").write_bytes(record("1", "u", body, None) + record("2", "u", b"y" * 2000, "1") + record("3", "u", body, "1") + record("4", "u", body, "unknown"))
    with pytest.raises(BrokenRecord):
        indexed(files.union(spark.createDataFrame([(str(tmp_path / "b.warc.gz"),)], "path string")))
    (tmp_path / "b.warc.gz").write_bytes(record("1", "u", body, None) + record("3", "u", body, "1") + record("4", "u", body, "unknown"))
    assert indexed(spark.createDataFrame([(str(tmp_path / "b.warc.gz"),)], "path string")).where("record_type = 'revisit'").count() == 2


def test_a_page_named_null_and_a_long_payload(spark):
    rows = [("null", "u", "a"), (None, "u", "b"), ("x", "u", "é" * 3_000_000)]
    got = {r.page_id: bytes(r.payload).decode() for r in archived(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert got == {r[0]: r[2] for r in rows}
