import random

from tessera.llm import decontam as D

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def sentence(r, k):
    return " ".join("".join(r.choice("aeioubdfglmnrst") for _ in range(r.randint(2, 8))) for _ in range(k)).capitalize() + "."


def held(item, text, n=5):
    """The share of the item's shingles in the text, whatever its sentences."""
    own, there = set(D.shingles(D.words(item), n)), set(D.shingles(D.words(text), n))
    return len(own & there) / len(own)


def distance(part, tokens):
    """The least edit distance of ``part`` to any run of ``tokens``, by the table."""
    row = [0] * (len(tokens) + 1)
    for i, w in enumerate(part, 1):
        now = [i]
        for j, t in enumerate(tokens, 1):
            now.append(min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (w != t)))
        row = now
    return min(row)


def test_one_word_edits_in_the_last_sentence(spark):
    r = random.Random(4)
    items = [(i, f"{sentence(r, r.randint(30, 60))} {sentence(r, 1 + i % 9)}") for i in range(27)]
    docs = []
    for i, text in items:
        words = text.split()
        for back in range(1, 2 + i % 9):
            edited = [*words[:-back], "changed", *words[len(words) - back + 1 :]]
            docs.append((len(docs), " ".join([sentence(r, 20), *edited, sentence(r, 20)])))
        docs.append((len(docs), " ".join(words[: len(words) // 2])))
    want = {(d, i) for d, t in docs for i, x in items if held(x, t) >= 0.8}
    found = D.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert len(want) == len(docs) - len(items)
    assert {(x["doc_id"], x["item_id"]) for x in found.collect()} == want


def test_short_parts_with_one_edit(spark):
    r = random.Random(5)
    items = [(i, f"{sentence(r, 12)} {sentence(r, 6)}") for i in range(10)]
    docs = []
    for i, text in items:  # under 0.8 of all shingles, but of the last six words five are there
        words = text.split()
        words[14] = "changed"
        docs.append((i, " ".join(words)))
        words[16] = "again"
        docs.append((100 + i, " ".join(words)))  # four of six aren't enough
    assert all(held(items[i % 100][1], t) < 0.8 for i, t in docs)
    found = D.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert {(x["doc_id"], x["item_id"]) for x in found.collect()} == {(i, i) for i in range(10)}


def test_aligned_against_the_table():
    r = random.Random(6)
    for _ in range(500):
        part = [r.choice("abcd") for _ in range(r.randint(1, 9))]
        tokens = [r.choice("abcde") for _ in range(r.randint(0, 30))]
        assert abs(D.aligned(part, tokens) - (1 - distance(part, tokens) / len(part))) < 1e-9
