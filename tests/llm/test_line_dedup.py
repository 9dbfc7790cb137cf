import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import line_dedup as L

SCHEMA = "doc_id long, text string, extra string, keep string"
LONG = "This line is certainly longer than forty characters, number "


def brute(rows):
    """(doc_id, lines, dropped, text) in order of rows."""
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    docs = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 40:
                docs[key(line)].add(doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(docs[key(x)]) < 5 or doc == max(docs[key(x)])]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def check(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in L.dedup_report(frame).collect())
    assert got == sorted((d is None, d or 0, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in want)
    out = L.dedup_lines(frame)
    assert out.columns == frame.columns
    kept = [(d or 0, None if row[1] is None else t, row[3] or "") for (d, _, _, t), row in zip(want, rows)]
    assert sorted(((r["doc_id"] or 0, r["text"], r["keep"] or "") for r in out.collect()), key=str) == sorted(kept, key=str)


def test_random_corpus(spark):
    r = random.Random(1)
    pool = [LONG + str(i) for i in range(12)] + ["short", "", "  ", "\tÄ" + LONG.upper() + "Ä \r"]
    rows = [(i, "\n".join(r.choice(pool) + r.choice(["", " ", "\r"]) for _ in range(r.randint(0, 9))), "x", "k") for i in range(120)]
    check(spark, rows)


def test_one_line_in_all_documents(spark):
    check(spark, [(i, f"{LONG}hot\n{LONG}{i}", None, None) for i in range(200)])


def test_four_documents_are_too_few_and_repeats_count_once(spark):
    check(spark, [(i, f"{LONG}x\n{LONG}x\n{LONG}x", None, None) for i in range(4)])
    check(spark, [(i, f"{LONG}x\n{LONG}x", None, None) for i in range(5)])


def test_nulls_empties_and_repeated_ids(spark):
    rows = [(i, LONG, None, None) for i in range(6)] + [(None, LONG, None, None), (7, None, "a", "b"), (8, "", None, None), (3, LONG, None, None), (3, "a\n" + LONG, None, None), (None, None, None, None)]
    check(spark, rows)


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert L.dedup_report(frame).collect() == []
    assert L.dedup_lines(frame).collect() == []


def test_very_long_text(spark):
    check(spark, [(i, "\n".join(f"{LONG}{k % 3000}" for k in range(5000)), None, None) for i in range(5)])


@given(st.sets(st.integers(0, 70), min_size=1))
def test_bitmap_round_trip(places):
    import pyarrow as pa

    rows = sorted(places)
    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(rows)), pa.array([2] * len(rows)), pa.array(rows)], names=["doc_id", "row_key", "pos"])
    (out,) = [b for b in L._pack(iter([batch])) if b.num_rows]
    bits = L.unpack_keep(out.column(2)[0].as_py())
    assert [i for i, b in enumerate(bits) if not b] == rows


@pytest.mark.parametrize("cut", [1, 2, 3, 7])
def test_runs_over_partition_edges(spark, cut):
    """Runs that go on in the next partition are settled together."""
    rows = [(i, f"{LONG}a\n{LONG}b", None, None) for i in range(4 + cut)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_many_bitmaps_are_joined_by_a_shuffle(spark, monkeypatch):
    rows = [(i, f"a line that stands in each of the documents, number one\nown {i}", "x", "y") for i in range(30)]
    frame = spark.createDataFrame(rows, SCHEMA)
    few = L.dedup_report(frame)
    monkeypatch.setattr(L, "MOST_BROADCAST", 3)
    many = L.dedup_report(frame)
    assert "BroadcastHashJoin" in few._jdf.queryExecution().toString() and "ShuffledHashJoin" in many._jdf.queryExecution().toString()
    assert sorted(few.collect()) == sorted(many.collect())


def test_names_of_its_own_columns_are_free(spark):
    rows = [(i, f"{LONG}hot\n{i}", "x", "k", 1, 2, "own") for i in range(6)]
    frame = spark.createDataFrame(rows, SCHEMA + ", __ld_doc_id long, __ld_row_key long, __LD_KEEP string")
    out = L.dedup_lines(frame)
    assert out.columns == frame.columns
    got = {r["doc_id"]: (r["text"], *r[2:]) for r in out.collect()}
    assert got == {i: (str(i) if i < 5 else f"{LONG}hot\n5", "x", "k", 1, 2, "own") for i in range(6)}


def test_very_long_text(spark):
    long = "\n".join(f"{LONG}{i % 50_000}" for i in range(200_000))
    check(spark, [(1, long, None, None), *[(10 + i, f"{LONG}7\nx", None, None) for i in range(4)]])
