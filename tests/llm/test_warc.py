"""Archives of other writers, and odd rows of our own."""

import gzip
import io
import zlib

import pytest

from stowcheck.llm import warc
from stowcheck.llm.queries import registered

FOREIGN = (
    b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\nContent-Type: application/warc-fields\r\nContent-Length: 13\r\n\r\nsoftware: x\r\n\r\n\r\n"
    b"WARC/1.0\r\nwarc-type: request\r\nWARC-Record-ID: <q>\r\nContent-Type: application/http; msgtype=request\r\ncontent-length: 32\r\n\r\n"
    b"POST / HTTP/1.1\r\nHost: x\r\n\r\nbody\r\n\r\n\r\n"
    b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\nWARC-Target-URI: http://x.org/a%20b%2Fc?q=%41&r==?s?\r\n"
    b"X-Long: one\r\n two\r\nWARC-Concurrent-To: <a>\r\nWarc-Concurrent-To: <b>\r\nX-Word: =?utf-8?Q?caf=C3=A9?=\r\nX-Bad: =?nope?Q?a?=\r\nContent-Length: SIZE\r\n\r\n"
)
HTTP = b"HTTP/1.1 200 OK\r\ntransfer-encoding: Chunked\r\n\r\n4\r\nspam\r\n5;x=1\r\n eggs\r\n0\r\n\r\n"


def foreign() -> bytes:
    return FOREIGN.replace(b"SIZE", b"%d" % len(HTTP)) + HTTP + b"\r\n\r\n"


def records(data: bytes, accept=lambda r: True, payload: bool = True) -> list[dict]:
    return list(warc.read_records(io.BytesIO(data), accept, payload))


def test_foreign_archive_is_read_as_written(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(foreign())
    # one gzip member a record, as crawlers write
    second = foreign().index(b"WARC/1.0\r\nwarc-type")
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(foreign()[:second]) + gzip.compress(foreign()[second:]))
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert len(rows) == 6
    for info, request, response in (rows[:3], rows[3:]):
        assert (info.record_type, bytes(info.payload)) == ("warcinfo", b"software: x\r\n")
        assert (request.record_type, bytes(request.payload)) == ("request", b"body")
        assert response.target_uri == "http://x.org/a%20b%2Fc?q=%41&r==?s?" and bytes(response.payload) == b"spam eggs"
        assert response.headers == {"X-Long": "one two", "WARC-Concurrent-To": "<a>, <b>", "X-Word": "café", "X-Bad": "=?nope?Q?a?="}
    found = warc.read_warc(spark, str(tmp_path)).where("target_uri = 'http://x.org/a%20b%2Fc?q=%41&r==?s?'")
    assert found.count() == 2


@pytest.mark.parametrize("payload", [True, False])
def test_truncation_is_always_an_error(payload):
    whole = foreign()
    assert len(records(whole, payload=payload)) == 3
    for cut in (len(whole) - 5, len(whole) - len(HTTP), whole.index(b"X-Long") + 3, whole.index(b"software") + 4):
        for accept in (lambda r: True, lambda r: False):
            with pytest.raises(ValueError, match="truncated"):
                records(whole[:cut], accept, payload)
    with pytest.raises(ValueError, match="Content-Length"):
        records(b"WARC/1.0\r\nWARC-Type: x\r\n\r\n")


def test_bodies_that_do_not_decode_stay():
    def body(head: bytes, data: bytes) -> bytes:
        return warc._payload(b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + data, "application/http")

    assert body(b"Content-Encoding: gzip", b"plain") == b"plain"
    assert body(b"Content-Encoding: gzip", gzip.compress(b"a") + gzip.compress(b"b")) == b"ab"
    assert body(b"Content-Encoding: deflate", zlib.compress(b"a")) == b"a"
    assert body(b"Transfer-Encoding: chunked", b"joined before") == b"joined before"
    assert body(b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip", b"%x\r\n%b\r\n0\r\n\r\n" % (len(gzip.compress(b"z")), gzip.compress(b"z"))) == b"z"
    assert warc._payload(b"HTTP", "text/plain") == b"HTTP"


def test_odd_rows_round_trip(spark, tmp_path):
    odd = ["", " edges ", "a\r\nb", "=?utf-8?B?eA==?=", "100 %41", "é \x00", "x" * 10_000]
    rows = [("metadata", f"<{i}>", v, b"block %d" % i, {"X-V": v, "X-None": None}) for i, v in enumerate(odd)]
    rows += [(None, None, None, None, None)] * 2 + [("response", "<r>", "u", b"HTTP/1.1 inner", {"Content-Type": "text/html"})]
    kind = "record_type string, record_id string, target_uri string, payload binary, headers map<string,string>"
    warc.write_warc(spark.createDataFrame(rows, kind), str(tmp_path / "a"))
    got = warc.read_warc(spark, str(tmp_path / "a")).collect()
    by_id = {r.record_id: r for r in got}
    for i, value in enumerate(odd):
        r = by_id[f"<{i}>"]
        assert (r.target_uri, r.headers, bytes(r.payload)) == (value, {"X-V": value}, b"block %d" % i)
    assert sum(r.record_id is None and r.payload is None for r in got) == 2 and bytes(by_id["<r>"].payload) == b"HTTP/1.1 inner"
    warc.write_warc(spark.createDataFrame([], kind), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0
    for name in ("Content-Length", "warc-type", "a:b", ""):
        with pytest.raises(ValueError, match="not a name"):
            warc.record_bytes({"record_type": "metadata"}, [(name, "v")], None)


def test_query_on_odd_pages(spark, tmp_path):
    long = "ü" * 200
    rows = [(1, "u", long, 9), (2, None, long, 9), (3, "a\nb", None, 9), (4, "", "short", 9), (5, "%41", "short", 9), (None, "n", long, 9), (1, "u", long, 9)]
    schema = "page_id long, url string, html string, payload long"
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name / "pages.parquet"))
    got = [tuple(r) for r in registered()["op5_warc"](spark, str(tmp_path / "some")).select("page_id", "payload_bytes", "record_type", "refers_to").collect()]
    want = [(1, 400, "response", None)] * 2 + [(2, 400, "revisit", 1), (3, 0, "response", None), (4, 5, "response", None), (5, 5, "response", None), (None, 400, "revisit", 1)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert registered()["op5_warc"](spark, str(tmp_path / "none")).count() == 0
