import hashlib
import random
import re

from tessera.llm import fill_middle as M

SCHEMA = "doc_id long, text string, fim_n long, form string"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50 else "spm" if h4 % 100 < 80 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return (doc, n, form, *((None, None) if form == "plain" else (len(p), len(m))), hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def texts(n=400, seed=4):
    r = random.Random(seed)
    return [(i, "".join(r.choice(["a", "é", "漢", "😀", " ", "\n", "\t", "\x0b", "\x85", " ", "\x00", "<", "P>", "<S", ">"]) for _ in range(r.choice([0, 1, 2, 9, 60])))) for i in range(n)]


EDGES = [(None, "no id here"), (1000, None), (1001, ""), (1002, " \t\r\n"), (1003, "word"), (1004, " lead and trail "), (1005, "has <P> inside"), (1006, "<M>"), (1007, "ends in <"), (7, "same id"), (7, "same id"), (2**62, "large id " * 50), (-3, "negative id " * 20)]


def test_against_brute_force(spark):
    rows = texts() + EDGES + [(5000 + i, f"w{i} " * 300_000) for i in range(6)]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    got = [tuple(r) for r in M.middle_report(frame).collect()]
    assert sorted(got, key=str) == sorted((brute(*r) for r in rows), key=str)
    assert {g[2] for g in got} == {"plain", "spm", "psm"}


def test_extra_columns_stay_and_names_give_way(spark):
    frame = spark.createDataFrame([(i, f"some words of text {i}", 7, "own") for i in range(40)], SCHEMA)
    made = M.transform(frame, rate=100)
    assert made.columns == [*frame.columns, "fim_n_", "fim_form", "fim_prefix", "fim_middle", "fim_output"]
    rows = made.withColumn("back", M.restored()).collect()
    assert all((r["fim_n"], r["form"], r["fim_n_"]) == (7, "own", 5) and r["back"] == r["text"] and r["fim_form"] != "plain" for r in rows)


def test_empty_table(spark):
    assert M.middle_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_selected_bits_are_the_ranked_ones():
    r = random.Random(1)
    for width in (1, 2, 7, 64, 1000):
        bits = r.getrandbits(width) | 1
        places = [i for i in range(width) if bits >> i & 1]
        assert [M.select_bit(bits, k, width) for k in range(1, len(places) + 1)] == places
