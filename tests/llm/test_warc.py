import base64
import gzip
import hashlib
import io

import pytest

from maploom.llm import warc

PAGES = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, "http://c/\r\nX: y", "ünïcode"), (4, None, None), (5, "u", ""), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "n", "null id"), (7, "u", "long " * 100_000), (2, "http://b/", "same")]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], "page_id long, url string, html string, record_type string, salt int").repartition(3)


@pytest.mark.parametrize("level", [0, 1])
def test_round_trip(spark, tmp_path, level):
    path = f"file://{tmp_path}/out"
    warc.write_archives(warc.as_records(frame(spark)), path, level=level, max_bytes=1000)
    rows = warc.read_archives(spark, path).collect()
    assert len(rows) == len(PAGES)
    by = {}
    for r in rows:
        by.setdefault(r.record_id, []).append(r)
    for page, _, html in PAGES:
        body = (html or "").encode()
        digest = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        for r in by[f"<urn:x-row:{'null' if page is None else page}>"]:
            assert (r.payload_digest, r.payload_length) == (digest, len(body))
            if page == max(same, default=None):
                assert (r.record_type, bytes(r.payload), r.refers_to) == ("response", body, None)
            else:
                assert (r.record_type, r.payload, r.refers_to) == ("revisit", None, f"<urn:x-row:{max(same)}>")
    assert by["<urn:x-row:3>"][0].target_uri == "http://c/%0D%0AX: y"


def test_filters_reach_the_headers(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    warc.write_archives(warc.as_records(frame(spark)), path)
    found = warc.read_archives(spark, path).where("record_type = 'revisit' AND target_uri LIKE 'http://a%'")
    assert [r.record_id for r in found.collect()] == ["<urn:x-row:1>"]
    assert "Filter" not in found._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert warc.read_archives(spark, path, payload="false").where("payload IS NOT NULL").count() == 0


def test_small_payloads_are_all_responses(spark):
    assert warc.as_records(frame(spark), min_bytes=5).where("record_type = 'revisit'").count() == 0


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    warc.write_archives(warc.as_records(frame(spark, [])), path)
    assert warc.read_archives(spark, path).count() == 0


def test_members_are_gzip_and_are_passed_over(tmp_path):
    row = {"record_id": "<a>", "record_type": "response", "target_uri": None, "date": "d", "refers_to": None, "payload_digest": "x", "payload": b"z" * 99_999, "payload_length": 99_999}
    ours = warc.gzipped(warc.record_bytes(row), 6)
    assert gzip.decompress(ours) == warc.record_bytes(row)
    other = gzip.compress(warc.record_bytes(row | {"record_id": "<b>"}))
    data = ours + other + ours
    every = list(warc.records(io.BytesIO(data), 0, len(data), lambda r: True, True))
    assert [r["record_id"] for r in every] == ["<a>", "<b>", "<a>"] and {len(r["payload"]) for r in every} == {99_999}
    assert [r["position"] for r in warc.records(io.BytesIO(data), 0, len(data), lambda r: r["record_id"] == "<b>", False)] == [len(ours)]
    starts = {at: warc.first_record(io.BytesIO(data), at, len(data)) for at in (1, len(ours), len(ours) + 1, len(ours) + len(other) + 1)}
    assert list(starts.values()) == [len(ours), len(ours), len(ours) + len(other), len(data)]


def test_records_of_other_writers(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\ncontent-type: text/plain\r\n\r\nno length here"

    def record(kind, block, *lines):
        return b"WARC/1.0\r\n" + b"".join(x + b"\r\n" for x in (b"warc-type:" + kind, *lines)) + b"CONTENT-LENGTH:%d\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    data = record(b"warcinfo", b"software: x\r\n", b"WARC-Record-ID: <1>") + record(b"response", http, b"WARC-Record-ID:<2>", b"Content-Type: application/http;msgtype=response", b"WARC-Target-URI: http://caf\xe9/")
    data += record(b"conversion", b"plain text", b"warc-record-id: <3>", b"Content-Type: text/plain", b"WARC-Target-URI: http://a/\r\n  b") + record(b"resource", b"", b"WARC-Record-ID: <4>")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(data)
    (tmp_path / "in" / "b.warc.gz").write_bytes(b"".join(gzip.compress(record(b"resource", b"r%d" % n, b"WARC-Record-ID: <%d>" % n)) for n in range(10, 60)))
    found = {r.record_id: r for r in warc.read_archives(spark, f"file://{tmp_path}/in", partition_bytes=300).collect()}
    assert len(found) == 54
    assert [(found[f"<{n}>"].record_type, bytes(found[f"<{n}>"].payload), found[f"<{n}>"].payload_length) for n in (1, 2, 3, 4)] == [("warcinfo", b"software: x\r\n", 13), ("response", b"no length here", 14), ("conversion", b"plain text", 10), ("resource", b"", 0)]
    assert found["<2>"].target_uri == "http://caf\ufffd/" and found["<3>"].target_uri == "http://a/ b"
    assert {bytes(found[f"<{n}>"].payload) for n in range(10, 60)} == {b"r%d" % n for n in range(10, 60)}
    plain = warc.read_archives(spark, f"file://{tmp_path}/in").where(f"source = '{tmp_path}/in/a.warc'")
    assert plain.count() == 4


def test_overwriting_replaces_and_leaves_other_jobs_alone(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    warc.write_archives(warc.as_records(frame(spark, PAGES[:2])), path)
    (tmp_path / "out" / "_part-other-000000-0-0000.warc.gz").write_bytes(b"of another job")
    warc.write_archives(warc.as_records(frame(spark, PAGES[2:5])), path, mode="overwrite")
    assert {r.record_id for r in warc.read_archives(spark, path).collect()} == {"<urn:x-row:3>", "<urn:x-row:4>", "<urn:x-row:5>"}
    assert (tmp_path / "out" / "_part-other-000000-0-0000.warc.gz").exists()
