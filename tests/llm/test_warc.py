import gzip
import io
import json

import pyarrow as pa
import pytest

from millrace.llm import warc as w


def monolithic(rows):
    return gzip.compress(b"".join(w.response_record(i, u, p, w.sha1_base32(p)) for i, u, p in rows))


def test_normaliser_rewrites_each_record_as_a_member():
    rows = [(1, "http://a/", b"<p>x</p>"), (2, "http://b/\r\nX: y", b""), (3, None, b"\r\n\r\nWARC/1.1\r\n" * 50), (4, "u", b"<p>x</p>")]
    target = io.BytesIO()
    lines = list(w.normalise(pa.BufferReader(monolithic(rows)), target, {3: (1,)}.get))
    data = target.getvalue()
    assert sum(x["length"] for x in lines) == len(data) and [x["type"] for x in lines] == ["response"] * 3 + ["revisit"]
    for x, (i, _, payload) in zip(lines, rows):
        head, block = next(w.records(pa.BufferReader(data[x["offset"] : x["offset"] + x["length"]])))
        assert head["X-Page-ID"] == str(i) and gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]).startswith(b"WARC/1.1\r\n")
        body = block.partition(b"\r\n\r\n")[2]
        assert body == (b"" if x["type"] == "revisit" else payload)
    whole = list(w.records(pa.BufferReader(data)))  # members one after another are one readable file
    assert len(whole) == 4 and whole[3][0]["WARC-Refers-To"] == w.record_id(1) and f"Content-Length: {len(rows[3][2])}".encode() in whole[3][1]


def test_inflater_reads_members_in_any_pieces(monkeypatch):
    monkeypatch.setattr(w, "PIECE", 7)
    data = gzip.compress(b"one\ntwo") + gzip.compress(b"\nthree\n") + gzip.compress(b"")
    stream = w.Inflater(pa.BufferReader(data))
    assert [stream.line() for _ in range(4)] == [b"one\n", b"two\n", b"three\n", b""]
    with pytest.raises(EOFError):
        w.Inflater(pa.BufferReader(gzip.compress(b"abc"))).exactly(9)
    with pytest.raises(ValueError, match="no record"):
        list(w.records(pa.BufferReader(gzip.compress(b"hello\r\n"))))


ROWS = [(1, "u1", "<p>a</p>", 0), (2, "u2", None, 0), (3, None, "", 0), (4, "u4", "<p>a</p>", 1), (0, "u0", "é" * 9, 1), (5, "u5", "é" * 9, 2), (5, "u5", "é" * 9, 2), (None, None, "<p>a</p>", 3), (6, "u6", "long " * 90_000, 4)]


@pytest.mark.parametrize("least", [0, 9])
def test_archive_and_read_back(spark, tmp_path, least):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, file int").repartition(3)
    folder = f"file://{tmp_path}/arc"
    index = w.archive(pages, folder, least)
    found = w.read_back(index, folder).collect()
    assert len(found) == len(ROWS)
    first = {}
    for i, _, h, _ in ROWS:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    by_payload = {}
    for r in found:
        payload = next((h or "").encode() for i, _, h, _ in ROWS if i == r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), w.sha1_base32(payload))
        by_payload.setdefault(payload, []).append(r)
    for payload, own in by_payload.items():
        responses = [r for r in own if r["record_type"] == "response"]
        if len(payload) < least:
            assert len(responses) == len(own)
        else:
            assert len(responses) == 1 and responses[0]["page_id"] == first[payload.decode()] and all(r["refers_to"] == responses[0]["page_id"] for r in own if r is not responses[0])
        assert all(bytes(r["payload"]) == payload for r in responses)
    sides = list((tmp_path / "arc").glob("part-*.index.jsonl"))
    lines = [json.loads(x) for f in sides for x in f.read_text().splitlines()]
    assert len(lines) == len(ROWS) and not list((tmp_path / "arc").glob(".part*.gz.*"))
    archives = sum(len(list(w.records(pa.BufferReader(f.read_bytes())))) for f in (tmp_path / "arc").glob("part-*.warc.gz"))
    assert archives == len(ROWS)


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/none"
    assert w.read_back(w.archive(none, folder), folder).count() == 0


def test_the_sidecars_are_the_index(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}", f"<p>{i % 7}</p>") for i in range(200)], "page_id long, url string, html string").repartition(5)
    index = w.archive(df, str(tmp_path / "a"))
    side = w.sidecar_index(spark, str(tmp_path / "a"))
    assert sorted(map(tuple, side.collect())) == sorted(map(tuple, index.collect())) and side.select("file").distinct().count() == 5
    back = w.read_back(side, str(tmp_path / "a"), 5)
    assert back.rdd.getNumPartitions() == 5 and back.filter("record_type = 'response'").count() == 7 and back.count() == 200
