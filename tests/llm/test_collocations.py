import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pyarrow as pa
import pytest

from tessera.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, words string, n long"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, max_n=3, min_count=10, cover=50, top=2000):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, max_n + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= cover * a for b in longer):
                continue
            cuts = [(Fraction(10**6 * a * a, own[p[:k]] * own[p[k:]]).__floor__(), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def corpus(n=150, seed=2):
    r = random.Random(seed)
    vocabulary = ["of", "the", "The", "new", "york", "state", "émile", "a\x01", "a", "b\x00c", "É", "漢字", "x-y"]
    signs = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b", "\x0c", " ; "]
    rows = []
    for i in range(n):
        text = "".join(r.choice(vocabulary) + r.choice(signs) for _ in range(r.choice([0, 1, 3, 40, 120])))
        if i % 3 == 0:
            text += " New York State " * 3
        rows.append((text, r.choice(["en", "en", "en", "de", None, "und"])))
    return rows


EDGES = [(None, "en"), ("", None), (" .,;", "fr"), ("one", "fr"), ("same row twice of the new", "en"), ("same row twice of the new", "en")]


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i % 7 or None, t, x, "own", 0) for i, (t, x) in enumerate(rows)], SCHEMA).repartition(parts)


@pytest.mark.parametrize("options", [{}, {"top": 7}, {"max_n": 4, "min_count": 3, "cover": 80}, {"max_n": 2, "min_count": 2}])
def test_against_brute_force(spark, options):
    rows = corpus() + EDGES
    got = sorted(tuple(r) for r in C.collocations(frame(spark, rows), **options).collect())
    assert got == brute(rows, **options) and got


def test_counts_do_not_depend_on_cuts_of_partitions_tasks_or_texts(spark):
    rows = corpus(60) + [("very hot pair " * 4000, "en")]
    for text, _ in rows:
        for chunk in (1, 7, 1000):
            assert [w for part in C.word_runs(text or "", chunk) for w in part] == [w for part in C.word_runs(text or "") for w in part]
    docs = frame(spark, rows, 9)
    few = {(r["lang"], *r["words"]): r["f"] for r in C.phrase_counts(docs, held=50, min_count=2)[0].collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "41")
    try:
        counts, totals = C.phrase_counts(docs, min_count=2)
        many = {(r["lang"], *r["words"]): r["f"] for r in counts.collect()}
        n = {r["lang"]: r["n"] for r in totals.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert few == many and many["en", "hot", "pair", "very"] == 3999
    assert n["en"] == sum(len(re.findall("[^.,;:!?\x0a-\x0d\x20\x09]+", t)) for t, x in rows if x == "en")


@pytest.mark.parametrize("rows", [1, 2, 5, 1000])
def test_stack_over_any_cuts(rows):
    r = random.Random(rows)
    made = Counter()
    for _ in range(300):
        size = r.randint(1, 3)
        made[(r.choice("xy"), *[r.choice("ab") for _ in range(size)], *[None] * (3 - size))] += r.randint(1, 4)
    key = {"\x00".join(w for w in k if w is not None): n for k, n in made.items()}
    order = sorted(key, reverse=True)
    table = pa.table({"key": order, "n": pa.array([key[k] for k in order], pa.int64())})
    want = Counter()
    for (lang, *words), n in made.items():
        for size in range(4):
            if None not in words[:size]:
                want[lang, *words[:size]] += n
    for cut in (0, 1, 9, len(order)):  # as if two partitions
        got, opened = Counter(), 0
        for part in (table.slice(0, cut), table.slice(cut)):
            for batch in C._stack(3, 1, rows)(iter(part.to_batches(max_chunksize=rows))):
                for path, n, is_open in zip(*(c.to_pylist() for c in batch.columns)):
                    got[tuple(path)] += n
                    opened += is_open
        assert got == want and opened <= 16


def test_long_vocabularies_of_longer_phrases():
    words = [f"w{i}".encode() for i in range(3000)]
    keys, counts = C.counted_suffixes("x", words, 6, len(words))
    keys = [k.split("\x00") for k in keys.to_pylist()]
    assert len(counts) == 3000 and keys == sorted(keys) and sum(7 - len(k) for k in keys) == 15


def test_scores_of_counts_whose_products_pass_64_bits(spark):
    counts = [("en", ["a", "b"], 3_000_000_000), ("en", ["a"], 7_000_000_001), ("en", ["b"], 5_000_000_003)]
    found = spark.createDataFrame(counts, "lang string, words array<string>, f long")
    got = C.score_cuts(found).first()
    assert (got["score"], got["l"], got["r"]) == (10**6 * 9 * 10**18 // (7_000_000_001 * 5_000_000_003), 7_000_000_001, 5_000_000_003)


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
