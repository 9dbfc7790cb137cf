import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm import language_id as L

WORDS = {"en": "the of and that with have this from they would there their what about which when make like time".split(), "de": "der die und nicht mit sich auch werden aus hat dass nach wird bei einer noch wie über einen".split(), "fr": "les des est dans pour une que pas sur plus par avec tout faire mais comme être cette été où".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ll string, declared string"


def corpus(n=300, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        text = " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(8, 60)))
        rows.append((i, text, lang, f"s{i % 7}", len(text), "x", "y"))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    shown = [(a, b, None if a % 5 == 0 else c, *rest) for a, b, c, *rest in rows]
    found = {r["doc_id"]: r["lang"] for r in L.document_report(spark.createDataFrame(shown, SCHEMA)).collect()}
    hidden = [(a, c) for a, _, c, *_ in rows if a % 5 == 0]
    assert sum(found[a] == c for a, c in hidden) >= 0.97 * len(hidden)


def test_wrong_declarations_lose_against_long_texts(spark):
    rows = corpus()
    rows[3] = (3, " ".join(WORDS["de"] * 8), "en", *rows[3][3:])
    found = {r["doc_id"]: r["lang"] for r in L.document_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[3] == "de"


def test_junk_goes_and_short_clean_texts_stay(spark):
    rows = corpus() + [(900, None, "en", "s1", 0, None, None), (901, "", "en", None, 0, None, None), (902, "$$$ 123 ###", None, "s1", 0, None, None), (903, "Of.", "en", "s1", 0, None, None), (None, "", "en", "s1", 0, None, None), (None, "what they would have about that time", "en", "s1", 0, None, None), (2, "?? !!", "fr", "s1", 0, None, None), (904, "the and of " * 40_000, "en", "s1", 0, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    report = {r["doc_id"]: r for r in L.document_report(frame).collect()}
    assert [report[i]["lang"] for i in (900, 901, 902)] == ["und"] * 3 and not report[900]["accepted"]
    assert report[903]["accepted"] and report[904]["lang"] == "en"
    kept = L.filter_language(frame)
    assert kept.columns == frame.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # rows without an id, or with one that others have, are judged each by itself
    assert sorted(i for i in ids if i is not None) == [*range(300), 903, 904] and ids.count(None) == 1


def test_no_labels_and_empty_table(spark):
    rows = [(i, t, None, None, 0, None, None) for i, t, *_ in corpus(12)]
    assert {r["lang"] for r in L.document_report(spark.createDataFrame(rows, SCHEMA)).collect()} == {"und"}
    assert L.document_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_rows_are_all_returned(spark):
    rows = corpus(60) * 2
    assert L.document_report(spark.createDataFrame(rows, SCHEMA)).count() == 120


def test_host_prior_decides_where_the_text_says_nothing(spark):
    rows = [(a, b, c, c, *rest) for a, b, c, _, *rest in corpus()] + [(900, "x", None, "fr", 1, None, None), (901, "x", None, "de", 1, None, None)]
    found = {r["doc_id"]: r["lang"] for r in L.document_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (found[900], found[901]) == ("fr", "de")


def test_pages_use_markup_and_suffix(spark):
    rows = [(i, f"http://h{i % 4}.example.{ {'en': 'com', 'de': 'de', 'fr': 'fr'}[c] }/x", f'<html lang="{c}-XX"><head><style>p {{ }}</style></head><body>{t}</body></html>') for i, t, c, *_ in corpus()]
    rows += [(900, None, None), (901, "nothing", '<html lang="de"><script>the of and</script></html>')]
    found = {r["key"]: r for r in L.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert sum(found[i]["lang"] == c for i, _, c, *_ in corpus()) >= 295 and found[0]["declared"] == "en" and found[900]["declared"] == "other"


def test_trigrams_do_not_cross_rows(monkeypatch):
    texts = ["abcd", "ab", "", "xyz9xyz", "the and of " * 50]
    values = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    language, bucket = np.repeat(np.arange(3), 4), np.arange(12) * 1000 % L.BUCKETS
    model = L.TextModel.fit(["a", "b", "c"], language, bucket, np.arange(1, 13), 1.0)
    whole = L.likelihoods(model, values, offsets)
    assert np.allclose(whole[:, 3] / -np.log(L.BUCKETS), [2, 0, 0, 2, 50 * 11 - 2]) and (whole[2, :3] == L.NOTHING).all()
    one = [L.likelihoods(model, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts]
    np.testing.assert_allclose(whole, one)
    for name, value in (("STEP", 7), ("ROWS", 2), ("WIDE", 2)):  # in whatever parts
        monkeypatch.setattr(L, name, value)
    np.testing.assert_allclose(L.likelihoods(model, values, offsets), whole)


def test_two_hundred_tags_write_no_more(spark, tmp_path, monkeypatch):
    """Made-up tags on a tenth of the rows: what is written doesn't grow with them, and real languages stay."""
    r = random.Random(9)
    tags = [a + b for a in "abcdefghijklmn" for b in "opqrstuvwxyzabc"][:200]
    plain = corpus(600)
    tagged = [(a, b, r.choice(tags) if a % 10 == 0 else c, *rest) for a, b, c, *rest in plain]
    sizes = []
    for rows in (plain, tagged):
        folder = tmp_path / str(len(sizes))
        monkeypatch.setattr(common, "shared_dir", lambda spark, folder=folder: f"file://{folder}")
        found = {x["doc_id"]: x["lang"] for x in L.document_report(spark.createDataFrame(rows, SCHEMA)).collect()}
        sizes.append(sum(f.stat().st_size for f in folder.rglob("language-votes*/*.parquet")))
    assert sizes[1] < 3 * sizes[0] + 20_000
    assert sum(found[a] == c for a, _, c, *_ in plain if a % 10) >= 0.9 * 540


def brute(rows, sample=500, temper=0.2, strength=10.0, und_prior=0.001):
    """(key, lang, probability) of rows (key, text, declared, suffix, domain, host), one number after the other."""
    import math
    from collections import Counter

    signs = set(range(9, 14)) | set(range(33, 48)) | set(range(58, 65)) | set(range(91, 97)) | set(range(123, 127))

    def trigrams(text):
        raw = [32 if b in signs else b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()]
        letter = lambda b: 97 <= b <= 122 or b >= 128
        for three in zip(raw, raw[1:], raw[2:]):
            if all(b == 32 or letter(b) for b in three) and any(map(letter, three)):
                yield ((three[0] << 16 | three[1] << 8 | three[2]) * 2654435761 % 2**32) >> 18

    letters = lambda text: any(97 <= b <= 122 or 65 <= b <= 90 or b >= 128 for b in (text or "").encode())
    languages = sorted({r[2] for r in rows if r[2]})
    counts = {x: Counter(b for r in rows if r[2] == x and r[0] is not None for b in trigrams(r[1])) for x in languages}
    everything, buckets = sum((sum(c.values()) for c in counts.values())), 2**14
    share = lambda b: (sum(c[b] for c in counts.values()) + 0.5) / (everything + 0.5 * buckets)
    names = [*languages, "und"]
    table = {}

    def score(x, b):
        if (x, b) not in table:
            table[x, b] = -math.log(buckets) if x == "und" else math.log((counts[x][b] + 500 * share(b)) / (sum(counts[x].values()) + 500))
        return table[x, b]

    ll = [[-50.0 if x != "und" and not letters(r[1]) else temper * sum(score(x, b) for b in trigrams(r[1])) for x in names] for r in rows]
    votes = [x.index(max(x)) for x in ll]
    total = Counter(votes)
    by = lambda *at: Counter((*(rows[i][a] or "" for a in at), v) for i, v in enumerate(votes))
    hosts, domains, suffixes, declared = by(3, 4, 5), by(3, 4), by(3), Counter((rows[i][2] or "other", v) for i, v in enumerate(votes))
    size = lambda c, *k: sum(c[(*k, i)] for i in range(len(names)))
    out = []
    for r, own, vote in zip(rows, ll, votes):
        s, d, h = (r[i] or "" for i in (3, 4, 5))
        terms = []
        for i, x in enumerate(names):
            mean = (total[i] + 1) / (len(rows) + len(names))
            mean = (suffixes[s, i] + strength * mean) / (size(suffixes, s) + strength)
            mean = (domains[s, d, i] + strength * mean) / (size(domains, s, d) + strength)
            prior = (hosts[s, d, h, i] - (i == vote) + strength * mean) / (size(hosts, s, d, h) - 1 + strength)
            said = (declared[r[2] or "other", i] + 1) / (total[i] + len(names))
            terms.append(own[i] + (math.log(und_prior / len(names)) if x == "und" else math.log(prior) + math.log(said)))
        top = max(terms)
        out.append((r[0], names[terms.index(top)], 1 / sum(math.exp(t - top) for t in terms)))
    return out


def same(got, want):
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    np.testing.assert_allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-4)


EVIDENCE = "key long, text string, declared string, suffix string, domain string, host string"


def test_posterior_is_that_of_brute_force(spark):
    r = random.Random(8)
    rows = [(i, t[: r.choice([5, 20, 400])], r.choice([c, c, c, "en", None]), {"en": "com", "de": "de", "fr": "fr"}[c], f"d{i % 3}.{c}", f"h{i % 9}.d{i % 3}.{c}") for i, t, c, *_ in corpus(150)]
    rows += [(900, None, "en", None, None, None), (901, "", None, "", "", ""), (902, "ok", "fr", "com", "d0.en", "h0.d0.en"), (None, "der und the and", "de", "de", "x", "y"), (903, "same", "aa", "x", "x", "x"), (904, "same", "bb", "x", "x", "x"), *[(7, rows[7][1], *rows[7][2:])] * 2]
    frame = spark.createDataFrame(rows, EVIDENCE).withColumn("row_key", F.lit(0).cast("long"))
    same([(x["key"], x["lang"], x["probability"]) for x in L.identify(frame).collect()], brute(rows))


def test_seventy_languages_and_one_of_three_rows(spark):
    r = random.Random(2)
    rows = []
    for k in range(70):
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8))) for _ in range(20)]
        code = "abcdefghij"[k // 10] + "klmnopqrst"[k % 10]
        rows += [(1000 * k + i, " ".join(r.choice(words) for _ in range(60)), code, f"s{i}", 0, None, None) for i in range(3 if k == 13 else 6)]
    found = {x["doc_id"]: x["lang"] for x in L.document_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len({*found.values()}) == 70 and sum(found[i] == c for i, _, c, *_ in rows) >= 0.99 * len(rows)
    assert [found[13_000 + i] for i in range(3)] == ["bn"] * 3


def test_sample_is_bounded_also_where_rows_repeat(spark):
    rows = [(i % 10, f"text {i}", "en" if i % 2 else "de") for i in range(400)] + [(None, "x", "fr")]
    picked = L.sampled(spark.createDataFrame(rows, "key long, text string, declared string"), 7).groupBy("declared").count().collect()
    assert {r["declared"]: r["count"] for r in picked} == {"en": 7, "de": 7}
