import random

import pytest

from tessera.llm import near_copies as N

SCHEMA = "doc_id long, text string"


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def alike(a, b, least=0.8):
    return a == b or len(a & b) >= least * len(a | b) - 1e-9


def brute(rows, least=0.8):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j], least):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    lowest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            lowest[find(i)] = min(lowest.get(find(i), doc), doc)
    return sorted(((doc, lowest.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def corpus(n=160, seed=3):
    """Texts of a few to some hundred words, two of three with one to a dozen words changed."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioubdfgl") for _ in range(r.randint(2, 5)))
    phrase = " ".join(word() for _ in range(12))  # stands in many texts
    rows = []
    for i in range(n):
        if i % 3 and rows:
            words = rows[r.randrange(len(rows))][1].split(" ")
            for _ in range(r.randint(0, 12)):
                words[r.randrange(len(words))] = word()
        else:
            words = [word() for _ in range(r.choice([1, 4, 5, 6, 40, 200, 400]))] + (phrase.split() if i % 2 else [])
        rows.append((i * 7 % 1000, " ".join(words)))
    return rows


EDGES = [(2000, None), (1999, ""), (1998, " \t\n"), (None, ""), (None, "lonely text without any id here"), (5, "UPPER lower"), (6, "upper  LOWER"), (6, "upper LOWER"), (7, "no break space stays in the word")]


@pytest.mark.parametrize("options", [{}, {"block": 3}, {"frequent": 2}])
def test_against_brute_force(spark, options):
    rows = corpus() + EDGES
    got = N.near_copies(spark.createDataFrame(rows, SCHEMA), **options)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_stage_links_what_four_bits_miss(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tessera.llm import simhash

    r = random.Random(1)
    rows = []
    for i in range(20):  # each text and a copy with four of 300 words changed: some 0.88 alike
        words = ["".join(r.choice("aeioubdfgl") for _ in range(5)) for _ in range(300)]
        copy = list(words)
        for at in r.sample(range(300), 4):
            copy[at] = "changed"
        rows += [(i, " ".join(words)), (100 + i, " ".join(copy))]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert {r["doc_id"] for r in kept.collect()} == set(range(20))
    apart = [(simhash.fingerprint(a[1], 5) ^ simhash.fingerprint(b[1], 5)).bit_count() for a, b in zip(rows[::2], rows[1::2])]
    assert max(apart) > 4


def test_empty(spark):
    assert N.near_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def family(n, seed=2):
    """Texts of 300 words, 262 of them the same: some 0.78 alike in pairs, so none is a link."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(262)]
    return [(i, " ".join(base + [f"u{i}x{k}y{r.randint(0, 9)}" for k in range(38)])) for i in range(n)]


def test_families_just_under_the_bound_write_no_pairs(spark, monkeypatch):
    from tessera.llm import ngram_join

    assert 0.75 < len(shingles(family(2)[0][1]) & shingles(family(2)[1][1])) / len(shingles(family(2)[0][1]) | shingles(family(2)[1][1])) < 0.8
    written = []
    plain = ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda frame, tag: written.append((tag, out := plain(frame, tag))) or out)
    for n in (150, 600):
        written.clear()
        rows = family(n) + [(5000, family(1)[0][1] + " one more"), (5001, family(3)[2][1].replace("b9 ", "c9 "))]
        got = {r["doc_id"]: r["component_id"] for r in N.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == {i: i for i in range(n)} | {5000: 0, 5001: 2}
        sizes = {tag: frame.count() for tag, frame in written}
        assert sizes and max(sizes.values()) <= 2 * (n + 2), sizes


def test_stage_searches_fingerprints_by_pigeonring(spark, monkeypatch):
    """Pairs within four bits come from simhash.links over the five-word fingerprints of all texts and are checked exactly."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tessera.llm import simhash

    rows = corpus(120) + EDGES
    given, checked = [], []
    search, verify = simhash.links, N._verified
    monkeypatch.setattr(simhash, "links", lambda prints, **kw: given.append({r["fp"] % 2**64 for r in prints.collect()}) or search(prints, **kw))
    monkeypatch.setattr(N, "_verified", lambda pairs, *rest: checked.append({tuple(r) for r in pairs.collect()}) or verify(pairs, *rest))
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert {r["doc_id"] for r in kept.collect()} - {None} == {d for d, first in brute(rows) if d == first} - {None}
    prints = {N.shingles(t)[0]: simhash.fingerprint(t, 5) for _, t in rows}
    assert given == [set(prints.values())]
    joined = {u: u for u in prints}

    def find(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for u, v in checked[0]:
        joined[find(u)] = find(v)
    near = [(u, v) for u in prints for v in prints if u < v and (prints[u] ^ prints[v]).bit_count() <= 4]
    assert near and all(find(u) == find(v) for u, v in near)


def test_fingerprint_pairs(spark):
    prints = [(1, 0), (2, 0), (3, 0b1111), (4, 0b11111), (5, -1), (6, 1 << 40), (7, -1), (8, 0xFF << 20)]
    got = {tuple(r) for r in N.print_pairs(spark.createDataFrame(prints + prints[:2], "id long, fp long")).collect()}
    joined = {i: i for i, _ in prints}
    for u, v in sorted(got):
        assert u < v
        joined[v] = min(joined[u], joined[v])
    assert joined == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 1, 7: 5, 8: 8}
