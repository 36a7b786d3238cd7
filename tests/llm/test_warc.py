import base64
import hashlib
import io

import pytest
from strandloom.llm import warc


def test_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>page {i % 5} é</p>" * 30) for i in range(40)]
    rows += [(100, None, None), (101, "u\r\nv", ""), (102, "u", ""), (None, "n", "only"), (103, "big", "z" * 3_000_000), (7, "again", rows[7][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    out = warc.round_trip(df, f"file://{tmp_path}/a", payloads=True).collect()
    assert len(out) == len(rows)
    best = {}
    for i, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
    want = []
    for i, url, html in rows:
        p = (html or "").encode()
        revisit = best[html or ""] != -1 and i != best[html or ""]
        sha = base64.b32encode(hashlib.sha1(p).digest()).decode()
        want.append((i, url and url.replace("\r\n", "%0D%0A"), "revisit" if revisit else "response", len(p), sha, best[html or ""] if revisit else None, None if revisit else p))
    key = lambda t: tuple(map(str, t))
    assert sorted([tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in out], key=key) == sorted(want, key=key)
    assert warc.round_trip(df.limit(0), f"file://{tmp_path}/b").count() == 0


def test_rejects_what_is_broken(tmp_path):
    good = warc.record(1, "u", b"abc", base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), "response", None)
    assert warc.parse(good)["payload"] == b"abc"
    for bad in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date: ", b"X: "), good.replace(b"Length: 3", b"Length: 4"), b""):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(b"12345678")))


def test_revisits_are_checked_and_frequent_pages_fetched_once(spark):
    pages = spark.createDataFrame([(i, "http://x", "<p>same page</p>" * 30) for i in range(500)] + [(900, None, None), (900, None, None)], "page_id long, url string, html string")
    assert len(warc.train(pages)) > 0
    read = warc.round_trip(pages)
    assert read.where("record_type = 'response'").count() == 3 and read.count() == 502
    lost = read.where("not (record_type = 'response' and page_id = 499)")
    with pytest.raises(Exception, match="no response"):
        warc.verified(lost).collect()
