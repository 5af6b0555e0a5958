import hashlib

import pytest
import zstandard
from pyarrow import fs

from riskweave.llm import warc_bundles as W
from riskweave.llm.common import new_folder

BIG = "é" * 700


def rows():
    out = [(i, f"http://a/{i}", f"<p>{i}</p>" * 50) for i in range(40)]
    out += [(100, "http://a/x\r\nX-Page-Id: 7", BIG), (101, None, BIG), (101, None, BIG), (99, "u", BIG), (None, "n", BIG), (102, "e", None), (103, "e", ""), (104, "s", "a" * 999), (105, "s", "a" * 999), (106, "b", "x" * 3_000_000)]
    return out


def expected(data):
    groups = {}
    for page, _, html in data:
        if page is not None:
            groups[html] = max(page, groups.get(html, page))
    out = []
    for page, _, html in data:
        body = (html or "").encode()
        same = sum((h or "") == (html or "") for _, _, h in data)
        revisit = len(body) >= 1000 and same > 1 and page != groups[html]
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", groups[html] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [100_000, 0])
def test_round_trip_and_index(spark, few):
    data = [*rows(), (700, "twice", "<p>7</p>"), (700, "twice", "<p>7</p>"), (None, "n", BIG)]
    pages = spark.createDataFrame([(*r, 1, 2, 3) for r in data], "page_id long, url string, html string, payload int, digest int, number int").repartition(3)
    index = W.write_bundles(pages, new_folder(spark, "warc-test"), few=few)
    back = W.read_bundles(index).collect()
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back], key=str)
    assert got == expected(data)
    bodies = {p: (h or "").encode() for p, _, h in data}
    assert all(r.payload == bodies[r.page_id] for r in back if r.record_type == "response")
    one = W.fetch(index).collect()
    assert sorted((r.record_id, r.payload_digest) for r in one) == sorted((r.record_id, r.payload_digest) for r in back)
    places = index.collect()
    assert len({r.record_id for r in places}) == len(places) == len(data) and {r.record_id for r in places} == {r.record_id for r in back}
    names = {r.record_id for r in back}
    assert all(W.record_id(r.refers_to, r.payload_digest) in names for r in back if r.record_type == "revisit")
    assert W.read_bundles(index).rdd.getNumPartitions() > 1
    for uri in {r.bundle for r in index.collect()}:  # any zstd reader gets the plain file
        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_file(path) as f:
            plain = zstandard.ZstdDecompressor().stream_reader(f.read(), read_across_frames=True).read()
        assert plain.startswith(b"WARC/1.1\r\n") and plain.count(b"WARC-Record-ID: ") == sum(r.bundle == uri for r in index.collect())


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.read_bundles(W.write_bundles(pages, new_folder(spark, "warc-test"))).count() == 0
