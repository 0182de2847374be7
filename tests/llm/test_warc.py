import gzip
import hashlib
import pathlib
import random
from collections import Counter

import pytest

from tidegrid.llm.warc import archive_round_trip, chunked, dechunk, members, parse_records, read_warc, write_warc

SCHEMA = "page_id long, url string, html string, record_id int, segment string, payload int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x", 2) for i, u, h in rows], SCHEMA)


def brute(rows):
    first = {}
    for i, _, h in rows:
        body = (h or "").encode()
        if i is not None and len(body) >= 100:
            first[body] = min(i, first.get(body, i))
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        again = body in first and first[body] != i
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None))
    return Counter(out)


def found(df):
    return Counter(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


@pytest.fixture
def rows():
    draw = random.Random(4)
    big = "".join(draw.choice("<p>é日 \r\n\x00x") for _ in range(30_000))
    return [
        (1, "http://a/1", None), (2, None, ""), (3, "http://a/\r\nX: y", "<p>short</p>"), (4, "u", "<p>short</p>"),
        (5, "u", big), (6, "u", big), (7, "u", "e" * 100), (8, "u", "e" * 100), (9, "u", "e" * 99), (10, "u", "e" * 99),
        (None, "u", big), (None, "u", "no id" * 30), (None, "u", "no id" * 30), (7, "u", "e" * 100), (11, "u", "z" * 250_000),
        (12, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n0\r\n\r\n"), (-5, "u", "q" * 300), (13, "u", "q" * 300),
    ]


@pytest.mark.parametrize("segment_bytes,records_per_file", [(64 << 10, 512), (1000, 3), (37, 1000)])
def test_round_trip(spark, tmp_path, rows, segment_bytes, records_per_file):
    got = archive_round_trip(
        pages(spark, rows).repartition(3), str(tmp_path / "w"), segment_bytes=segment_bytes, records_per_file=records_per_file
    )
    assert found(got) == brute(rows)


def test_payloads_come_back_whole(spark, tmp_path, rows):
    write_warc(pages(spark, rows), str(tmp_path / "w"), segment_bytes=500)
    read = read_warc(spark, str(tmp_path / "w")).where("type = 'response'").select("payload").collect()
    assert {bytes(r["payload"]) for r in read} == {(h or "").encode() for _, _, h in rows}


def test_missing_segment_is_told(spark, tmp_path):
    pair = pages(spark, [(1, "u", "a" * 5000), (2, "u", "b" * 50)]).coalesce(1)
    write_warc(pair, str(tmp_path / "w"), segment_bytes=1000)
    file = next(p for p in pathlib.Path(tmp_path / "w").iterdir() if p.name.endswith(".gz") and p.stat().st_size > 100)
    data = gzip.decompress(file.read_bytes())
    assert sum(1 for _ in parse_records(data)) == 7
    at = data.index(b"WARC-Segment-Number: 3")
    start = data.rindex(b"WARC/1.1", 0, at)
    end = data.index(b"WARC/1.1", at)
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc.gz").write_bytes(gzip.compress(data[:start] + data[end:]))
    got = {r["record_id"].split(":")[2]: r["payload"] for r in read_warc(spark, str(tmp_path / "cut")).collect()}
    assert got["1"] is None and bytes(got["2"]) == b"b" * 50


def test_chunks():
    for n in (0, 1, 8191, 8192, 8193, 50_000):
        body = bytes(random.Random(n).randrange(256) for _ in range(n))
        assert dechunk(chunked(body)) == body
    assert dechunk(b"5\r\nab") is None and dechunk(b"zz\r\n") is None and dechunk(b"") is None


def test_empty_table(spark, tmp_path):
    assert archive_round_trip(pages(spark, []), str(tmp_path / "w")).count() == 0


def plain_record(k, body):
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:r:{k}>\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("share", [1, 2, 7])
def test_archives_of_many_members(spark, tmp_path, share):
    """A member for each record, as most archives have, for some records, or for all of them."""
    records = [plain_record(k, random.Random(k).randbytes(50_000 * (k % 3))) for k in range(7)]
    packed = b"".join(gzip.compress(b"".join(records[i : i + share])) for i in range(0, 7, share))
    assert b"".join(members(packed)) == b"".join(records)
    (tmp_path / "a.warc.gz").write_bytes(packed)
    got = read_warc(spark, str(tmp_path)).collect()
    assert sorted(r["record_id"] for r in got) == sorted(f"<urn:r:{k}>" for k in range(7))
    for broken in (packed[:-9], packed + b"tail"):
        with pytest.raises(Exception):
            list(members(broken))
