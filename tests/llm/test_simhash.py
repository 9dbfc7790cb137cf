import random

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string, component_id string"


def print_of(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, distance=4):
    """Index of each print to the smallest index that it reaches."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def brute(rows):
    prints = [print_of(t) for _, t, *_ in rows]
    roots = groups(prints)
    lowest = {}
    for (doc, *_), g in zip(rows, roots):
        if doc is not None:
            lowest[g] = min(lowest.get(g, doc), doc)
    return sorted(((doc, f"{p:016x}", lowest.get(g)) for (doc, *_), p, g in zip(rows, prints, roots)), key=str)


def corpus(n=150, seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioubdfgl") for _ in range(r.randint(2, 5)))
    rows = []
    for i in range(n):
        if i % 3 and rows:
            words = rows[r.randrange(len(rows))][1].split(" ")
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = word()
        else:
            words = [word() for _ in range(r.choice([1, 3, 4, 40, 200, 400]))]
        rows.append((i * 7 % 1000, " ".join(words), "c", "c"))
    return rows


def test_against_brute_force(spark):
    rows = corpus() + [(2000, None, None, None), (1999, "", None, None), (1998, " \t\n", None, None), (None, "", None, None), (None, "lonely text without any id here", None, None), (5, "UPPER lower", None, None), (6, "upper LOWER", None, None), (6, "upper LOWER", None, None), (7, "no break space stays in the word", None, None)]
    got = S.near_duplicate_report(spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_empty_table_long_text_and_one_group(spark):
    assert S.near_duplicate_report(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(i, "word%d " % (i % 2) * 200_000 if i < 2 else "same text for all of these", None, None) for i in range(50)]
    assert sorted((tuple(r) for r in S.near_duplicate_report(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)


def near(n, flips, seed):
    """Prints around a few centres, so that buckets are hot and chains long."""
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        p = r.choice(centres)
        for _ in range(r.randint(0, flips)):
            p ^= 1 << r.randrange(64)
        out.add(p)
    return sorted(out)


@pytest.mark.parametrize(("flips", "block"), [(4, 20_000), (9, 20_000), (6, 10), (9, 3)])
def test_links_keep_all_components(spark, flips, block):
    prints = near(400, flips, flips)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    links = S.links(spark.createDataFrame([(p,) for p in signed], "fp long"), block=block)
    roots = {r["node"]: r["root"] for r in S.components(links).collect()}
    want = groups(prints)
    ours = [roots.get(p, p) for p in signed]
    assert all((want[i] == want[j]) == (ours[i] == ours[j]) for i in range(400) for j in range(i))


@pytest.mark.parametrize("distance", [1, 2, 3, 4, 5, 7])
def test_chains_find_every_pair(distance):
    prints = np.array(near(300, distance + 1, distance), np.uint64)
    want = {(i, j) for i in range(300) for j in range(300) if i < j and int(prints[i] ^ prints[j]).bit_count() <= distance}
    got = set()
    for at, part in enumerate(S.segments(distance)):
        bucket = S._segment(prints, *part)
        for a, b in S.chain_pairs(prints, prints, bucket, bucket, at, distance, step=50):
            got |= {(i, j) for i, j in zip(a.tolist(), b.tolist()) if i < j}
    assert got == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 560)] + [(900, 901), (901, 900), (950, 950)]
    roots = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert roots == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(500, 560), 500), 900: 900, 901: 900}
    assert S.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_keep_one(spark):
    rows = corpus(90, 6) + [(None, "same", None, None), (None, "same", None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    kept = S.keep_one(frame)
    want = {d for d, _, c in brute(rows) if d is not None and d == c}
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == frame.columns and {i for i in ids if i is not None} == want and ids.count(None) == 2
