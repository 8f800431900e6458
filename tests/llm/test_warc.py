import hashlib
from collections import defaultdict

from lattica.llm import common, warc


def brute(rows):
    first = {}
    for p, _, h in rows:
        if len((h or "").encode()) >= 100 and p is not None:
            first[h] = min(p, first.get(h, p))
    n = defaultdict(int)
    for _, _, h in rows:
        n[h] += 1
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        to = first.get(h) if n[h] > 1 and h in first and first[h] != p else None
        out.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=repr)


def test_round_trip(spark):
    long = "<p>é" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(5, "http://a/ b", long), (3, None, long), (9, "http://a", long), (9, "http://a", long), (None, "u", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u\r\nX: y", ""), (7, "u", "y" * 100_000), (8, "u", "z" * 99), (10, "u", "z" * 99), (11, "u", "w" * 100), (12, "u", "w" * 100), (None, "u", "n" * 300), (None, "v", "n" * 300), (3, None, long)]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, salt string, original int").repartition(3)
    path = common.new_path(spark, "warc-test")
    warc.write_archives(pages, path)
    records = warc.read_archives(spark, path)
    got = warc.resolve(records)
    assert sorted([tuple(r)[:5] for r in got.collect()], key=repr) == brute(rows)
    # a revisit carries no payload
    assert {r.payload_bytes for r in records.filter("record_type = 'revisit'").collect()} == {None}


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = common.new_path(spark, "warc-test")
    warc.write_archives(pages, path)
    assert warc.resolve(warc.read_archives(spark, path)).collect() == []


def test_many_originals_and_a_missing_response(spark, monkeypatch):
    monkeypatch.setattr(warc, "SMALL", 0)
    rows = [(k, "u", f"{k % 7}" * 150) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = common.new_path(spark, "warc-test")
    warc.write_archives(pages, path)
    records = warc.read_archives(spark, path)
    assert sorted([tuple(r)[:5] for r in warc.resolve(records).collect()], key=repr) == brute(rows)
    # revisits whose response is missing keep their digest and nothing to refer to
    alone = warc.resolve(records.filter("record_type = 'revisit'")).collect()
    assert len(alone) == 53 and {(r.payload_bytes, r.refers_to, r.record_type) for r in alone} == {(None, None, "revisit")} and all(r.payload_digest for r in alone)
