import random

from tessera.llm import decontam as D

DOCS, ITEMS = "doc_id long, text string, item_id string, score string", "item_id long, text string, shard string"


def brute(docs, items, least=0.8, n=5):
    out = set()
    for doc, text, *_ in docs:
        tokens = D.words(text)
        for item, q, *_ in items:
            if not D.words(q):
                continue
            ok = bool(tokens)
            for part in D.question_and_answer(q):
                size = min(n, len(part)) if part else n
                own, there = set(D.shingles(part, size)), set(D.shingles(tokens, size))
                ok &= not own or len(own & there) >= least * len(own)
            if ok:
                out.add((doc, item))
    return out


def corpus(seed=5, n=150):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioubdfglmnrst") for _ in range(r.randint(2, 8))) for _ in range(600)] + ["the", "of"] * 40
    sentence = lambda k: " ".join(r.choice(vocabulary) for _ in range(k)).capitalize() + "."
    items = [(i, " ".join(sentence(r.randint(6, 20)) for _ in range(r.randint(1, 3))), "s") for i in range(30)]
    docs = []
    for i in range(n):
        body = [sentence(r.randint(5, 30)) for _ in range(r.randint(0, 40))]
        if i % 5 == 0:
            planted = items[i % 30][1]
            if i % 10 == 0:
                planted = planted.upper().replace(".", " !").replace(" ", "  ")
            body.insert(r.randint(0, len(body)), planted)
        if i % 7 == 0:  # half an item isn't a leak
            body.append(" ".join(items[i % 30][1].split()[: len(items[i % 30][1].split()) // 2]))
        docs.append((i, "\n".join(body), "clash", "clash"))
    return docs, items


def pairs(frame):
    return {(r["doc_id"], r["item_id"]) for r in frame.collect()}


def test_against_brute_force(spark):
    docs, items = corpus()
    want = brute(docs, items)
    assert len(want) >= 30
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert pairs(D.find_leaks(d, b)) == want
    assert pairs(D.find_leaks(d, b, most_words=100)) == want  # many shards
    kept = D.drop_contaminated(d, b)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, *_ in docs} - {i for i, _ in want}


def test_search_finds_all_that_reach_their_threshold():
    docs, items = corpus(9, 60)
    texts = [(i, t) for i, t, _ in items]
    df = {}
    for _, t in texts:
        for w in set(D.words(t)):
            df[w] = df.get(w, 0) + 1
    mean = sum(len(D.words(t)) for _, t in texts) / len(texts)
    index = D.build_index(texts, (len(texts), mean), df, 0.3, 5)
    for _, text, *_ in docs:
        terms = sorted({index.vocabulary[w] for w in D.words(text) if w in index.vocabulary})
        scores = [sum(s for t in terms for i, s in zip(index.postings[t], index.scores[t]) if i == n) for n in range(len(texts))]
        want = {n for n, s in enumerate(scores) if s >= index.thresholds[n]}
        blocks = list(range(index.block_max.shape[1]))
        assert {n for n, _ in index.search(terms, blocks)} == want


def test_edges(spark):
    docs, items = corpus(6, 20)
    docs += [(None, items[0][1], None, None), (700, None, None, None), (701, "", None, None), (702, items[3][1], None, None), (702, items[3][1], None, None), (703, ("word " * 50_000) + items[4][1], None, None)]
    items += [(None, "Only here once. Never seen before or after.", None), (90, None, None), (91, "", None), (92, "...", None), (93, "Two words.", None)]
    docs.append((704, "only here once, NEVER seen before or after", None, None))
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert pairs(D.find_leaks(d, b)) == brute(docs, items)
    assert D.find_leaks(d, b.limit(0)).count() == 0 and D.find_leaks(d.limit(0), b).count() == 0
    # a row without an id is judged like any other, and so are rows that share one
    assert D.drop_contaminated(d, b).where("doc_id is null").count() == 0
    both = spark.createDataFrame([(1, items[0][1]), (1, "clean"), (None, "clean too"), (None, None)], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["text"]) for r in D.drop_contaminated(both, b).collect()), key=str) == [(1, "clean"), (None, "clean too"), (None, None)]


def test_seams_between_passages(spark):
    docs, items = corpus(8, 1)
    filler = " ".join(f"filler{i}" for i in range(400)).split()
    placed = [(k, " ".join(filler[:k]) + " " + items[2][1] + " " + " ".join(filler[k:]), None, None) for k in range(0, 130)]
    found = pairs(D.find_leaks(spark.createDataFrame(placed, DOCS), spark.createDataFrame(items, ITEMS)))
    assert {i for i, item in found if item == 2} == set(range(130))


def test_decomposed_letters_are_counted_as_they_are_searched(spark):
    spelt = "Un e\u0301te\u0301 tre\u0300s chaud. Les e\u0301te\u0301s passent vite, e\u0301videmment!"
    items = [(0, spelt, "s"), (1, "Un other plain item. With its own answer te te te.", "s")]
    docs = [(0, "before " + spelt + " after", "c", "c"), (1, "te te tre chaud", "c", "c")]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    (leak,) = D.find_leaks(d, b).collect()
    df = {}
    for _, t, _ in items:
        for w in set(D.words(t)):
            df[w] = df.get(w, 0) + 1
    index = D.build_index([(0, spelt)], (2, sum(len(D.words(t)) for _, t, _ in items) / 2), df, 0.6, 5)
    assert (leak["doc_id"], leak["item_id"]) == (0, 0) and abs(leak["score"] * 0.6 - index.thresholds[0]) < 1e-6


def test_one_long_item_does_not_widen_the_passages_of_others(spark):
    docs, items = corpus(11, 100)
    items = [*items, (77, "\n".join(t for _, t, *_ in docs[:60]), "s")]
    assert [max(len(D.words(t)) for _, t in c) >= 500 for c in D.classes([(i, t) for i, t, _ in items])].count(True) == 1
    docs = [*docs, (500, "intro " + items[-1][1] + " end", "c", "c")]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert pairs(D.find_leaks(d, b)) == brute(docs, items)
