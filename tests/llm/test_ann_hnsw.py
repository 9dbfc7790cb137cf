import math

import numpy as np

from tessera.llm import ann_hnsw as A

SCHEMA = "vec_id long, embedding array<float>, score string"


def exact(rows, every=100, k=10):
    ok = [(i, np.array(v, np.float32).astype(np.float64)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)]
    sizes = [len(v) for _, v in ok]
    dim = max(sorted(set(sizes)), key=sizes.count) if sizes else 0
    ok = [(i, v) for i, v in ok if len(v) == dim]
    out = {}
    for i, v in ok:
        if i % every == 0:
            out[i] = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in ok if j != i)[:k]
    return out


def found(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def clusters(n, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dim))
    return [(i, (centres[i % 10] + 0.4 * rng.normal(size=dim)).tolist(), "clash") for i in range(n)]


def test_recall_against_brute_force(spark):
    rows = clusters(3000)
    want, got = exact(rows), found(A.nearest(spark.createDataFrame(rows, SCHEMA), shard_rows=700))
    assert want.keys() == got.keys()
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    vectors = {i: np.array(v, np.float32).astype(np.float64) for i, v, _ in rows}
    for q, hits in got.items():
        assert hits == sorted(hits) and q not in {i for _, i in hits}
        assert all(abs(s - np.sqrt(((vectors[i] - vectors[q]) ** 2).sum())) < 1e-12 for s, i in hits)


def test_many_equal_vectors_tie_by_id(spark):
    rows = [(i, [1.0, 2.0, 3.0], None) for i in range(600)] + [(i, [1.0, 2.0, 3.0 + i / 1e4], None) for i in range(600, 900)]
    want, got = exact(rows), found(A.nearest(spark.createDataFrame(rows, SCHEMA), shard_rows=250))
    assert got[0] == want[0] and got[500] == want[500] and got.keys() == want.keys()


def test_bad_vectors_take_no_part(spark):
    bad = [(100, None, None), (200, [0.0] * 4, None), (300, [1.0, None, 2.0, 3.0], None), (400, [float("nan"), 1.0, 1.0, 1.0], None), (500, [float("inf"), 1.0, 1.0, 1.0], None), (600, [1.0, 2.0], None), (None, [1.0] * 4, None), (700, [], None)]
    rows = [(i, [float(i % 7), 1.0, float(i % 3), 2.0], None) for i in range(0, 90)] + bad
    got, want = found(A.nearest(spark.createDataFrame(rows, SCHEMA), every=10)), exact(rows, 10)
    assert got.keys() == want.keys() and all([s for s, _ in got[q]] == [s for s, _ in want[q]] for q in want)


def test_few_rows_repeated_ids_and_empty_table(spark):
    rows = [(0, [1.0, 0.0], None), (1, [1.0, 0.5], None), (1, [1.0, 0.5], None), (2, [3.0, 0.0], None)]
    assert found(A.nearest(spark.createDataFrame(rows, SCHEMA))) == {0: [(0.5, 1), (0.5, 1), (2.0, 2)]}
    assert A.nearest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert A.nearest(spark.createDataFrame([(0, [1.0], None)], SCHEMA)).collect() == []


def test_queries_in_blocks_give_the_same(spark):
    rows = clusters(800, 8)
    frame = spark.createDataFrame(rows, SCHEMA)
    index, shards = A.build_index(frame, shard_rows=300)
    queries = A.usable(frame)[0].where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "v AS q")
    assert found(A.search(index, shards, queries, block_rows=7)) == found(A.search(index, shards, queries))
    assert all(len(r["neighbours"]) >= 1 for r in index.collect())


def test_nodes_keep_the_ids_that_any_query_needs(spark):
    ids = [1] * 20 + [2, 2, 3, 5, 8, 9]
    (node,) = A.nodes_of(spark.createDataFrame([(i, [1.0, 2.0]) for i in ids], "vec_id long, v array<float>"), 4).collect()
    held = [i for i, n in zip(node["ids"], node["copies"]) for _ in range(n)]
    for own in (1, 2, 3, 99):
        assert [i for i in held if i != own][:4] == [i for i in ids if i != own][:4]


def test_one_id_with_many_vectors(spark):
    rows = [(0, [1.0 + i / 50, 1.0], None) for i in range(30)] + [(i, [2.0, 1.0 + i / 8], None) for i in range(1, 20)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in A.nearest(frame.where("embedding[0] < 1.01 or vec_id > 0"), k=3).collect()}
    assert got == {(0, i, i) for i in (1, 2, 3)}
    (one,) = {tuple(r["vec_id"] for r in A.nearest(frame, every=7, k=5).where("query_id = 7").orderBy("rank").collect())}
    assert one == (6, 8, 5, 9, 4)


def test_recall_over_many_shards_of_clustered_and_of_plain_noise(spark):
    rng = np.random.default_rng(5)
    noise = [(i, rng.normal(size=16).tolist(), None) for i in range(4000)]
    for rows in (clusters(6000), noise):
        frame = spark.createDataFrame(rows, SCHEMA)
        index, route = A.build_index(frame, shard_rows=500)
        assert index.count() >= 8
        queries = A.usable(frame)[0].where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "v AS q")
        want, got = exact(rows), found(A.search(index, route, queries))
        hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
        assert hits >= 0.95 * sum(map(len, want.values()))


def test_huge_components(spark):
    rows = [(i, [1e200 * (1 + i % 10), 1e200 * (i // 10), 1.0], None) for i in range(101)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = found(A.nearest(frame, k=2))
    assert [i for _, i in got[100]] == [90, 91] and np.allclose([s / 1e200 for s, _ in got[100]], [1.0, 2**0.5]) and [i for _, i in got[0]] == [1, 10]
    far = spark.createDataFrame([(0, [1.7e308], None), (1, [-1.7e308], None)], "vec_id long, embedding array<double>, score string")
    assert found(A.nearest(far)) == {0: [(math.inf, 1)]}


def test_leaves_that_cannot_be_cut_are_dealt_out_in_parts(spark):
    rows = [(i, [1.0, float(i % 2), 1e-9 * i], None) for i in range(900)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    router = A.Router(np.zeros((4, 3)), 4)  # fitted on nothing that tells rows apart
    assert router.depth == 2 and set(router.assign(np.array([r[1] for r in rows]))) <= set(range(4))
    want, got = exact64(rows), found(A.nearest(frame, shard_rows=200))
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-12 for q in want for (a, _), (b, _) in zip(got[q], want[q]))


def exact64(rows, every=100, k=10):
    data = {i: np.array(v) for i, v, _ in rows}
    return {i: sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in data.items() if j != i)[:k] for i, v in data.items() if i % every == 0}
