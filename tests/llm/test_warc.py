import hashlib

from pyspark.sql import functions as F

from tessera.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"
BIG = "é" * 600


def brute(rows):
    top, count = {}, {}
    for page, _, html, _ in rows:
        b = (html or "").encode()
        if len(b) >= 1000:
            count[b] = count.get(b, 0) + 1
            if page is not None:
                top[b] = max(top.get(b, page), page)
    out = []
    for page, _, html, _ in rows:
        b = (html or "").encode()
        best = top.get(b) if count.get(b, 0) > 1 else None
        refers = None if best is None or best == page else best
        out.append((page, len(b), hashlib.sha1(b).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def report(frame):
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.archive_report(frame).collect()), key=str)


def test_against_brute_force(spark):
    rows = [(i, f"http://a.org/{i}\r\nX: y", [BIG, "short", BIG + str(i % 3), None, ""][i % 5], "clash") for i in range(60)]
    rows += [(None, None, BIG, None), (3, "u", BIG, None), (59, "u", BIG, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert report(frame) == brute(rows)


def test_edges(spark):
    for rows in ([], [(1, None, None, None)], [(None, None, BIG, None)] * 3, [(5, "u", BIG, None)] * 3):
        assert report(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_selected_records_are_read_by_range(spark):
    rows = [(i, f"http://a.org/{i}", f"<p>{i}</p>" * 200, None) for i in range(200)]
    index = warc.write_archives(spark.createDataFrame(rows, SCHEMA), file_bytes=2_000).cache()
    assert index.select("path").distinct().count() > 4
    some = index.where(F.col("url").endswith("7"))
    found = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(some, gap=0).collect()}
    assert found == {i: html for i, _, html, _ in rows if i % 10 == 7}
    assert warc.read_archives(some, gap=1 << 20).count() == len(found)


def test_record_fields():
    raw = warc.record(4, "http://a b/", b"xyz", "d", None)
    fields, head, payload = warc.parse(raw)
    assert payload == b"xyz" and fields["WARC-Target-URI"] == "http://a%20b/" and b"Content-Length: 3" in head
    fields, head, payload = warc.parse(warc.record(4, None, b"xyz", "d", 9))
    assert payload == b"" and fields["WARC-Refers-To"] == "<urn:page:9>" and b"Content-Length: 3" in head


def test_records_longer_than_a_read(spark):
    import random

    r = random.Random(1)
    noise = "".join(chr(r.randint(32, 5000)) for _ in range(3_000_000))  # hardly shrinks
    rows = [(1, "u", noise, None), (2, "v", noise, None), (3, "w", noise + "!", None), (4, "x", "small", None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert report(frame) == brute(rows)
    index = warc.write_archives(frame)
    assert index.agg(F.max("length")).first()[0] > 4 << 20
    found = {r["page_id"]: r["payload"] for r in warc.read_archives(index, most=1 << 20).collect()}
    assert bytes(found[2]).decode() == noise and found[1] is None and bytes(found[4]) == b"small"


def test_many_groups_meet_the_pages_in_a_shuffle(spark, monkeypatch):
    rows = [(i, "u", BIG + str(i % 20), None) for i in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(warc, "MOST_BROADCAST", 3)
    assert report(frame) == brute(rows)
