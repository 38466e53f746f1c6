"""Archives: written, split anywhere and read back."""

import base64
import hashlib
import tempfile
import zlib
from collections import Counter

import pyarrow.fs
import pytest

from docdrift.llm import warc as W

ROWS = [
    (1, "http://a/1", "same"), (9, "http://a/9", "same"), (4, None, "same"), (9, "http://a/9", "same"),
    (2, "", None), (3, "http://b/ü x\r\ny", ""), (5, "http://c", "é" * 5000), (None, "http://d", "same"),
    (None, "http://e", "only nulls"), (None, "http://e", "only nulls"), (6, "x", "WARC/1.1\r\n\r\n" * 50),
]


def expected(rows, min_bytes=0):
    body = [(t or "").encode() for _, _, t in rows]
    out = []
    for (i, _, _), b in zip(rows, body):
        ids = [j for (j, _, _), c in zip(rows, body) if c == b and j is not None]
        revisit = len(b) >= min_bytes and body.count(b) > 1 and bool(ids) and i != max(ids)
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out.append((i, len(b), digest, "revisit" if revisit else "response", max(ids) if revisit else None))
    return Counter(out)


@pytest.mark.parametrize("range_bytes,min_bytes,most_tasks", [(64, 0, 5), (1000, 5, 1 << 16), (1 << 20, 0, 1)])
def test_round_trip(llm, range_bytes, min_bytes, most_tasks):
    df = llm.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as payload", "'x' as sha")
    folder = tempfile.mkdtemp(prefix="docdrift-warc-")
    back = W.warc_round_trip(df.repartition(3), folder, range_bytes=range_bytes, min_bytes=min_bytes, file_bytes=500, most_tasks=most_tasks)
    got = back.collect()
    assert all(r.intact for r in got)
    assert Counter((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(ROWS, min_bytes)
    texts = {r.record_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
    assert texts[9] == "same" and texts[5] == "é" * 5000 and texts[3] == ""
    assert {r.target_uri for r in got} >= {"http://b/ü x\r\ny", None}
    assert W.warc_round_trip(df.limit(0), folder).collect() == []


def test_every_cut_of_a_file_reads_each_record_once(tmp_path):
    nested = W.record_member(7, "u", b"inner", None, False, "2020-01-01T00:00:00Z", "D")
    payloads = [b"a" * 300, nested, b"", bytes(range(256)) * 4, b"\x1f\x8b\x08" * 20]
    members = [W.record_member(i, "u", p, None, False, "2020-01-01T00:00:00Z", "D") for i, p in enumerate(payloads)]
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)  # an uncompressed member shows the member inside it
    raw = zlib.decompress(members[1], 31)
    members[1] = stored.compress(raw) + stored.flush()
    body = b"".join(members)
    path = tmp_path / "x.warc.gz"
    path.write_bytes(body)
    with pyarrow.fs.LocalFileSystem().open_input_file(str(path)) as source:
        for size in range(1, len(body) + 1, 7):
            data = W._Bytes(source, len(body))
            found = [r for s in range(0, len(body), size) for r in W._records(data, s, s + size)]
            assert [W._fields(*r)[6] for r in found] == payloads, size


def test_damaged_members_are_passed_over(tmp_path):
    good = [W.record_member(i, "u", b"x" * 50 * i, None, False, "2020-01-01T00:00:00Z", "D") for i in range(4)]
    broken = bytearray(good[1])
    broken[len(broken) // 2] ^= 0xFF
    body = good[0] + bytes(broken) + b"garbage" + good[2] + good[3]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(body)
    with pyarrow.fs.LocalFileSystem().open_input_file(str(path)) as source:
        found = list(W._records(W._Bytes(source, len(body)), 0, len(body)))
    assert [W._fields(*r)[0] for r in found] == ["0", "2", "3"]


def test_query_matches_a_plain_count(llm):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in llm.read.parquet(f"{sf}/pages.parquet").collect()]
    got = Counter(tuple(r) for r in W.op4_warc(llm, sf).collect())
    assert got == expected(rows)
