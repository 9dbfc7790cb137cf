import random

import numpy as np
import pytest

from tessera.llm import ngram_join as N

SCHEMA = "doc_id long, text string, id long, n long, rep string"


def shingles(text, words=3):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def brute(rows, words=3, least=90):
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    lowest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            lowest[find(i)] = min(lowest.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), lowest.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def corpus(n=200, seed=3):
    """Two of three texts are others with up to a dozen words changed; half hold a phrase that many share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioubdfgl") for _ in range(r.randint(2, 5)))
    phrase = [word() for _ in range(12)]
    rows = []
    for i in range(n):
        if i % 3 and rows:
            words = rows[r.randrange(len(rows))][1].split(" ")
            for _ in range(r.randint(0, 12)):
                words[r.randrange(len(words))] = word()
        else:
            words = [word() for _ in range(r.choice([1, 2, 3, 4, 40, 200, 400]))] + (phrase if i % 2 else [])
        rows.append((i * 7 % 1000, " ".join(words)))
    return rows


def boilerplate(n=60, seed=5):
    """One text of 300 words whose end differs: similarities lie around the bound."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(300)]
    return [(3000 + i, " ".join(base[: r.randint(255, 300)] + [f"x{i}y{k}" for k in range(r.randint(0, 25))])) for i in range(n)]


EDGES = [(2000, None), (1999, ""), (1998, " \t\n"), (None, ""), (None, "lonely text without any id here"), (5, "UPPER lower"), (6, "upper  LOWER"), (6, "upper LOWER"), (7, "no break space stays in the word"), (8, "repeated row of some words"), (8, "repeated row of some words"), (None, "shared by a row that has an id"), (9, "shared by a row that has an id")]


@pytest.mark.parametrize("options", [{}, {"hot": 4}, {"limit": 400}, {"hot": 4, "limit": 3000, "frequent": 5}, {"words": 5, "least": 80}, {"words": 5, "least": 80, "limit": 500}])
def test_against_brute_force(spark, options):
    rows = corpus() + boilerplate() + EDGES
    frame = spark.createDataFrame([(*r, 0, 0, "x") for r in rows], SCHEMA).repartition(4)
    got = sorted((tuple(r) for r in N.ngram_report(frame, **options).collect()), key=str)
    assert got == brute(rows, options.get("words", 3), options.get("least", 90))


def test_exactly_the_bound_links(spark):
    base = [f"w{i}" for i in range(11)]
    # 9 of 10 shingles shared by two sets of 9 and 10: 90 of 100
    rows = [(1, " ".join(base)), (2, " ".join([*base, "more"])), (3, " ".join([*base, "more", "again"]))]
    frame = spark.createDataFrame([(*r, 0, 0, "x") for r in rows], SCHEMA)
    assert sorted((r["doc_id"], r["component_id"]) for r in N.ngram_report(frame).collect()) == [(1, 1), (2, 1), (3, 1)]


@pytest.mark.parametrize("least", [60, 80, 90])
def test_search_finds_all_links(least):
    r = np.random.default_rng(least)
    sets = []
    for _ in range(120):
        own = sets[r.integers(len(sets))] if sets and r.random() < 0.7 else r.integers(0, 5000, r.integers(1, 80))
        own = own[r.random(len(own)) < 0.97] if len(own) > 5 else own
        sets.append(np.unique(np.concatenate([own, r.integers(0, 5000, r.integers(0, 4))])))
    sets = sorted((s for s in sets if len(s)), key=len)
    alike = lambda a, b: 100 * len(np.intersect1d(a, b)) >= least * len(np.union1d(a, b))
    for side in (None, r.integers(0, 2, len(sets))):
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                if alike(sets[i], sets[j]) and (side is None or side[i] != side[j]):
                    label = [label[j] if x == label[i] else x for x in label]
        got = list(range(len(sets)))
        u, v = N.occurrence_links(sets, side, least)
        for a, b in zip(u, v):
            assert alike(sets[a], sets[b]) and got[a] != got[b]
            got = [got[b] if x == got[a] else x for x in got]
        assert len(set(got)) == len(set(label)) and all((got[i] == got[j]) == (label[i] == label[j]) for i in range(len(sets)) for j in range(i))


def test_very_long_text(spark):
    long = " ".join(f"w{i * 7919 % 90_001}" for i in range(400_000))
    rows = [(1, long), (2, long + " one more word"), (3, "short text here")]
    frame = spark.createDataFrame([(*r, 0, 0, "x") for r in rows], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in N.ngram_report(frame, limit=1000).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_empty(spark):
    assert N.ngram_report(spark.createDataFrame([], SCHEMA)).collect() == []
