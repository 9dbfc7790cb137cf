"""Approximate nearest neighbours with a navigable small-world graph per shard.

Equal vectors become one node that keeps its smallest ids, so copies cost nothing after
the first aggregation. A tree of hyperplanes, each at the median of the rows that reach
it, deals nodes out into shards of about ``shard_rows``; it is fitted on a bounded sample
(``sample`` distinct vectors, those with the smallest hashes), and every node is dealt and
indexed. A shard that comes out larger than twice that size is dealt out in parts.

A task builds its shard's hierarchical graph and stores it as flat arrays: one row per
shard with vectors, ids and, per level, an array of neighbours. Nodes are numbered by
level from the top, so a level's array has rows for its own nodes only. Insertion and
search handle blocks of nodes in lockstep: each step expands the best open candidates of
every query of the block by array operations.

A query visits the ``probes`` shards whose regions lie nearest. Unless given, that number
is measured: for ``calibrate`` vectors the true neighbours are found over all nodes, and
``probes`` is the fewest shards that hold ``target`` of them. Vectors with structure need
few shards however many there are; vectors without any (isotropic noise) need most of them, at
a cost of queries times shards, as nothing else would keep the recall. Shard results are
merged by exact distance and id.

Distances are Euclidean in double precision on the original vectors.

Defined cases
- vectors that are null, zero, hold null or non-finite components, or have another length
  than most: they take no part, neither as queries nor as candidates.
- null vec_id: takes no part. Rows with one vec_id: each is a candidate of its own, except
  for a query with that vec_id; as queries, equal rows are one query.
- components whose squares overflow: distances are taken on scaled vectors and scaled
  back; a distance above the largest double is infinite.
- ties go to the smaller vec_id. Fewer candidates than k: all that there are.
- empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

SHARD = "shard long, vectors binary, ids binary, copies binary, id_ends binary, neighbours array<binary>, dim int, single boolean"
_KINDS = pa.schema([("shard", pa.int64()), ("vectors", pa.binary()), ("ids", pa.binary()), ("copies", pa.binary()), ("id_ends", pa.binary()), ("neighbours", pa.list_(pa.binary())), ("dim", pa.int32()), ("single", pa.bool_())])
#: More shards than this aren't made; then shards grow, at some kilobyte a row.
MOST_SHARDS = 8192
#: The most that a block of queries may mark as visited, in bytes.
MARKS = 1 << 25


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` and ``b``, also where squares would overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        apart = a.astype(np.float64) - b.astype(np.float64)
        plain = np.sqrt((apart**2).sum(axis=-1))
        if np.isfinite(plain).all():
            return plain
        most = np.abs(apart).max(axis=-1, keepdims=True)
        scaled = most[..., 0] * np.sqrt(((apart / most) ** 2).sum(axis=-1))
        return np.where(np.isfinite(plain), plain, np.where(np.isfinite(most[..., 0]), scaled, np.inf))


# -- the graph of a shard --------------------------------------------------------------


class Graph:
    """A graph over the rows of ``data``; tables[level] has a row of neighbours, padded with -1,
    for each of its nodes, which are the first ones."""

    def __init__(self, data: np.ndarray, tables: list[np.ndarray]) -> None:
        self.data, self.tables = data, tables

    def near(self, nodes: np.ndarray, queries: np.ndarray) -> np.ndarray:
        apart = self.data[nodes] - queries
        return np.einsum("ij,ij->i", apart, apart)

    def beam(self, queries: np.ndarray, starts: np.ndarray, level: int, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(distances, nodes) of the ``width`` closest that a best-first search finds for each query.

        Ascending, padded with infinity and -1. All queries advance together, ``step``
        candidates at a time each.
        """
        table, n = self.tables[level], len(queries)
        step = min(step, width)
        room = table.shape[1]
        found, nodes = np.full((n, width), np.inf, queries.dtype), np.full((n, width), -1, np.int32)
        closed = np.ones((n, width), bool)
        found[:, 0], nodes[:, 0], closed[:, 0] = self.near(starts, queries), starts, False
        seen = np.zeros((n, len(table)), bool)
        seen[np.arange(n), starts] = True
        active = np.arange(n)
        while len(active):
            d, open_ = found[active], ~closed[active]
            d = np.where(open_, d, np.inf)
            best = np.argpartition(d, step - 1, axis=1)[:, :step] if step < width else np.broadcast_to(np.arange(width), d.shape)
            fine = np.isfinite(np.take_along_axis(d, best, axis=1))
            alive = fine.any(axis=1)
            if not alive.all():
                active, best, fine = active[alive], best[alive], fine[alive]
                if not len(active):
                    break
            rows = np.broadcast_to(active[:, None], best.shape)
            closed[rows[fine], best[fine]] = True
            around = table[np.where(fine, nodes[rows, best], 0)]
            around = np.where(fine[:, :, None], around, -1).reshape(len(active), -1)
            held, place = np.nonzero(around >= 0)
            what = around[held, place]
            fresh = ~seen[active[held], what]
            held, what = held[fresh], what[fresh]
            # a node may come from several of the candidates
            key = held.astype(np.int64) * len(table) + what
            _, first = np.unique(key, return_index=True)
            held, what = held[first], what[first]
            if not len(held):
                continue
            own = active[held]
            seen[own, what] = True
            near = self.near(what, queries[own])
            closer = near < found[active].max(axis=1)[held]
            held, what, near = held[closer], what[closer], near[closer]
            if not len(held):
                continue
            counts = np.bincount(held, minlength=len(active))
            slot = np.arange(len(held)) - np.repeat(np.cumsum(counts) - counts, counts)
            touched = np.flatnonzero(counts)
            at = np.cumsum(counts > 0) - 1
            new_d = np.full((len(touched), int(counts.max())), np.inf, queries.dtype)
            new_n = np.full(new_d.shape, -1, np.int32)
            new_d[at[held], slot], new_n[at[held], slot] = near, what
            own = active[touched]
            all_d = np.concatenate([found[own], new_d], axis=1)
            keep = np.argpartition(all_d, width - 1, axis=1)[:, :width]
            found[own] = np.take_along_axis(all_d, keep, axis=1)
            nodes[own] = np.take_along_axis(np.concatenate([nodes[own], new_n], axis=1), keep, axis=1)
            closed[own] = np.take_along_axis(np.concatenate([closed[own], np.zeros(new_d.shape, bool) | (new_n < 0)], axis=1), keep, axis=1)
        order = np.argsort(found, axis=1, kind="stable")
        return np.take_along_axis(found, order, axis=1), np.take_along_axis(nodes, order, axis=1)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """beam() on the lowest level, from where a greedy descent of the others ends."""
        starts = np.zeros(len(queries), np.int32)
        for level in range(len(self.tables) - 1, 0, -1):
            starts = self.beam(queries, starts, level, 1)[1][:, 0]
        return self.beam(queries, starts, 0, width)


def diverse(data: np.ndarray, found: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, sorted by distance, up to ``most``: those closer to the row's node
    than to the ones picked before; the closest others fill up. Padded with -1."""
    n, k = nodes.shape
    valid = nodes >= 0
    if k <= most:
        return np.pad(nodes, ((0, 0), (0, most - k)), constant_values=-1)
    part = data[np.maximum(nodes, 0)]
    square = np.einsum("ijk,ijk->ij", part, part)
    between = square[:, :, None] + square[:, None, :] - 2 * (part @ part.transpose(0, 2, 1))
    closest, picked = np.full((n, k), np.inf, found.dtype), np.zeros((n, k), bool)
    left = np.full(n, most)
    for i in range(k):
        take = valid[:, i] & (found[:, i] < closest[:, i]) & (left > 0)
        picked[take, i] = True
        left[take] -= 1
        closest[take] = np.minimum(closest[take], between[take, i])
    order = np.where(valid, np.arange(k) + k * ~picked, 3 * k)
    order = np.argsort(order, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(nodes, order, axis=1)


def _ranked(data: np.ndarray, owners: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of candidate nodes (-1: none) to the owners of their rows, both sorted."""
    apart = data[np.maximum(nodes, 0)] - data[owners][:, None, :]
    found = np.where(nodes >= 0, np.einsum("ijk,ijk->ij", apart, apart), np.inf)
    order = np.argsort(found, axis=1, kind="stable")
    return np.take_along_axis(found, order, axis=1), np.take_along_axis(nodes, order, axis=1)


def _link_back(graph: Graph, level: int, own: np.ndarray, others: np.ndarray, used: np.ndarray, part: int = 512) -> None:
    """Adds own[i] to the neighbours of others[i]; where there is no room the diverse ones stay."""
    table = graph.tables[level]
    room = table.shape[1]
    order = np.argsort(others, kind="stable")
    own, others = own[order], others[order]
    target, start, counts = np.unique(others, return_index=True, return_counts=True)
    slot = np.arange(len(others)) - np.repeat(start, counts)
    fits = np.repeat(used[target] + counts <= room, counts)
    table[others[fits], used[others[fits]] + slot[fits]] = own[fits]
    full = used[target] + counts > room
    used[target[~full]] += counts[~full]
    full = np.flatnonzero(full)
    full = full[np.argsort(counts[full], kind="stable")]  # rows of like width together
    for begin in range(0, len(full), part):
        few = full[begin : begin + part]
        wide = np.full((len(few), room + int(counts[few].max())), -1, np.int32)
        wide[:, :room] = table[target[few]]
        for i, f in enumerate(few):
            wide[i, room : room + counts[f]] = own[start[f] : start[f] + counts[f]]
        found, nodes = _ranked(graph.data, target[few], wide)
        most = 2 * room + 16
        table[target[few]] = diverse(graph.data, found[:, :most], nodes[:, :most], room)
        used[target[few]] = (table[target[few]] >= 0).sum(axis=1)


def build(data: np.ndarray, *, links: int = 12, width: int = 48, block: int = 256, seed: int = 7) -> tuple[Graph, np.ndarray]:
    """The graph and the order in which it numbers the rows of ``data``.

    Levels are drawn at random. Rows are inserted in blocks; a row's candidates are what a
    search finds among earlier blocks, and the earlier rows of its own block.
    """
    n = len(data)
    rng = np.random.default_rng(seed)
    levels = np.minimum((-np.log(1.0 - rng.random(n)) / math.log(links)).astype(np.int64), 12)
    order = np.lexsort((rng.random(n), -levels))
    levels = levels[order]
    data = np.ascontiguousarray(data[order])
    sizes = [int((levels >= level).sum()) for level in range(int(levels.max(initial=0)) + 1)]
    graph = Graph(data, [np.full((k, 2 * links if level == 0 else links), -1, np.int32) for level, k in enumerate(sizes)])
    used = [np.zeros(k, np.int64) for k in sizes]
    begin = 0
    while begin < n:
        end = min(n, begin + (max(16, min(block, begin)) if begin else 1))
        new = np.arange(begin, end)
        queries = data[begin:end]
        starts = np.zeros(len(new), np.int32)
        within = ((queries[:, None, :] - queries[None, :, :]) ** 2).sum(axis=2)
        within = np.where(np.tri(len(new), k=-1, dtype=bool), within, np.inf)
        for level in range(len(sizes) - 1, -1, -1):
            inside = int(np.clip(sizes[level] - begin, 0, len(new)))  # of the block, the first ones
            if begin:
                if inside < len(new):
                    starts[inside:] = graph.beam(queries[inside:], starts[inside:], level, 1)[1][:, 0]
            if not inside:
                continue
            if begin:
                found, nodes = graph.beam(queries[:inside], starts[:inside], level, width)
                starts[:inside] = nodes[:, 0]
            else:
                found, nodes = np.full((inside, 1), np.inf, data.dtype), np.full((inside, 1), -1, np.int32)
            near = within[:inside, :inside]
            found = np.concatenate([found, near], axis=1)
            nodes = np.concatenate([nodes, np.where(np.isfinite(near), new[None, :inside], -1).astype(np.int32)], axis=1)
            keep = np.argsort(found, axis=1, kind="stable")[:, :width]
            found, nodes = np.take_along_axis(found, keep, axis=1), np.take_along_axis(nodes, keep, axis=1)
            chosen = diverse(data, found, nodes, links)
            graph.tables[level][new[:inside], :links] = chosen
            used[level][new[:inside]] = (chosen >= 0).sum(axis=1)
            held, place = np.nonzero(chosen >= 0)
            _link_back(graph, level, new[held].astype(np.int32), chosen[held, place], used[level])
        begin = end
    return graph, order


# -- nodes and shards ---------------------------------------------------------------------


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, v as stored (float or double), and their length."""
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    v = F.col("embedding").cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fine)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = common["n"] if common else 0
    return rows.where(F.size("v") == dim), dim


def nodes_of(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids, copies): distinct vectors with as many of their ids as a result of ``k`` rows can hold.

    Equal rows are counted before they move, and ids are cut to the first before they meet.
    """
    counted = rows.groupBy("v", "vec_id").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    first = counted.withColumn("__place", place).where(F.col("__place") <= k + 1)
    held = first.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", F.least("n", F.lit(k)).alias("n")))).alias("held"))
    return held.select("v", F.col("held.vec_id").alias("ids"), F.col("held.n").alias("copies"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)


class Router:
    """A complete binary tree of hyperplanes; leaves are numbered by the bits of the way to them."""

    def __init__(self, sample: np.ndarray, shards: int, seed: int = 11) -> None:
        self.depth = max(0, math.ceil(math.log2(max(1, shards))))
        self.normals: list[np.ndarray] = []
        self.cuts: list[np.ndarray] = []
        rng = np.random.default_rng(seed)
        self.scale = float(np.abs(sample).max(initial=1.0)) or 1.0
        sample = sample / self.scale
        parts = [sample]
        for _ in range(self.depth):
            normals, cuts, after = [], [], []
            for part in parts:
                normal, cut = self._plane(part, sample.shape[1], rng)
                side = part @ normal >= cut
                normals.append(normal)
                cuts.append(cut)
                after += [part[~side], part[side]]
            self.normals.append(np.array(normals))
            self.cuts.append(np.array(cuts))
            parts = after

    @staticmethod
    def _plane(part: np.ndarray, dim: int, rng: np.random.Generator) -> tuple[np.ndarray, float]:
        """The main direction (some steps of power iteration) and the median along it."""
        normal = rng.standard_normal(dim)
        if len(part) > 1:
            centred = part - part.mean(axis=0)
            for _ in range(12):
                again = centred.T @ (centred @ normal)
                size = np.linalg.norm(again)
                if size <= 1e-300:
                    break
                normal = again / size
        normal = normal / max(np.linalg.norm(normal), 1e-300)
        return normal, float(np.median(part @ normal)) if len(part) else 0.0

    def assign(self, data: np.ndarray) -> np.ndarray:
        data = data.astype(np.float64) / self.scale
        leaf = np.zeros(len(data), np.int64)
        for normals, cuts in zip(self.normals, self.cuts):
            leaf = 2 * leaf + (np.einsum("ij,ij->i", data, normals[leaf]) >= cuts[leaf])
        return leaf

    def nearest(self, query: np.ndarray, most: int) -> list[int]:
        """Leaves in order of their regions' distance from ``query``: the squared margins of the crossed planes."""
        query = query.astype(np.float64) / self.scale
        out, heap = [], [(0.0, 0, 0)]
        while heap and len(out) < most:
            far, level, at = heapq.heappop(heap)
            if level == self.depth:
                out.append(at)
                continue
            margin = float(query @ self.normals[level][at] - self.cuts[level][at])
            side = int(margin >= 0)
            heapq.heappush(heap, (far, level + 1, 2 * at + side))
            heapq.heappush(heap, (far + margin * margin, level + 1, 2 * at + 1 - side))
        return out


def fit_router(nodes: DataFrame, total: int, dim: int, *, shard_rows: int, sample: int) -> Router:
    shards = min(MOST_SHARDS, math.ceil(total / shard_rows))
    if shards < 2:
        return Router(np.zeros((0, max(1, dim))), 1)
    picked = nodes.select("v").orderBy(F.xxhash64("v")).limit(sample).toArrow()
    return Router(_matrix(picked.column(0).combine_chunks(), dim), shards)


def _dealt(router: Router, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = router.assign(_matrix(batch.column(0), dim)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    return run


def _shard(dim: int, links: int, width: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        data = _matrix(rows.column("v").combine_chunks(), dim)
        order = np.lexsort(data.T[::-1])  # the same graph wherever and whenever it is made
        rows, data = rows.take(pa.array(order)), data[order]
        most = float(np.abs(data).max())
        limit = 1e15 if data.dtype == np.float32 else 1e150
        graph, order = build(np.ldexp(data, -math.frexp(most)[1]) if most > limit else data, links=links, width=width)
        ids, copies = rows.column("ids").combine_chunks().take(pa.array(order)), rows.column("copies").combine_chunks().take(pa.array(order))
        row = {
            "shard": key[0].as_py(),
            "vectors": np.ascontiguousarray(data[order]).tobytes(),
            "ids": ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
            "copies": copies.flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
            "id_ends": np.cumsum(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False)).astype(np.int64).tobytes(),
            "neighbours": [t.tobytes() for t in graph.tables],
            "dim": dim,
            "single": data.dtype == np.float32,
        }
        return pa.Table.from_pylist([row], schema=_KINDS)

    return run


@dataclass(frozen=True)
class Route:
    """How queries find their shards: the tree, the shards of each leaf that has more than one, and how many leaves to visit."""

    router: Router
    parts: dict[int, list[int]]
    dim: int
    probes: int


def build_index(vectors: DataFrame, *, k: int = 10, shard_rows: int = 16_384, links: int = 12, width: int = 48, probes: int | None = None, sample: int = 100_000, calibrate: int = 64, target: float = 0.98) -> tuple[DataFrame, Route]:
    """The index, a row of flat arrays per shard in the shared folder, and the way to its shards."""
    rows, dim = usable(vectors)
    dim = max(1, dim)
    nodes = materialize(nodes_of(rows, k), "vector-nodes")
    router = fit_router(nodes, nodes.count(), dim, shard_rows=shard_rows, sample=sample)
    if probes is None:
        probes = measured_probes(nodes, dim, router, k=k, calibrate=calibrate, target=target) if router.depth else 1
    kind = nodes.schema["v"].dataType.simpleString()
    dealt = materialize(nodes.mapInArrow(_dealt(router, dim), f"v {kind}, ids array<long>, copies array<long>, leaf long"), "vector-leaves")
    leaves = 1 << router.depth
    sizes = dealt.groupBy("leaf").count()  # a row per leaf, of which there are MOST_SHARDS at most
    usual = max(shard_rows, math.ceil(sizes.agg(F.sum("count").alias("n")).first()["n"] / leaves) if leaves >= MOST_SHARDS else 0)
    parts = {r["leaf"]: math.ceil(r["count"] / usual) for r in sizes.where(F.col("count") > 2 * usual).collect()}
    shard = F.col("leaf")
    for leaf, n in parts.items():
        shard = F.when(F.col("leaf") == leaf, F.col("leaf") + leaves * F.pmod(F.xxhash64("v"), F.lit(n))).otherwise(shard)
    index = dealt.withColumn("shard", shard).drop("leaf").groupBy("shard").applyInArrow(_shard(dim, links, width), SHARD)
    return materialize(index, "vector-index"), Route(router, {leaf: [leaf + leaves * i for i in range(n)] for leaf, n in parts.items()}, dim, probes)


def measured_probes(nodes: DataFrame, dim: int, router: Router, *, k: int, calibrate: int, target: float) -> int:
    """The fewest leaves that hold ``target`` of the ``k`` nearest nodes of ``calibrate`` vectors."""
    picked = nodes.select("v").orderBy(F.hash("v"), F.xxhash64("v")).limit(calibrate).toArrow()
    asked = _matrix(picked.column(0).combine_chunks(), dim).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data = _matrix(batch.column(0), dim)
            leaf = router.assign(data)
            for q, query in enumerate(asked):
                far = distances(data, query[None, :])
                best = np.argsort(far, kind="stable")[: k + 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), q)), pa.array(far[best]), pa.array(leaf[best])], names=["q", "far", "leaf"])

    found = nodes.select("v").mapInArrow(run, "q long, far double, leaf long")
    place = F.row_number().over(Window.partitionBy("q").orderBy("far", "leaf"))
    best = found.withColumn("place", place).where(F.col("place").between(2, k + 1)).select("q", "leaf").collect()  # the first is the vector itself
    ways = [{leaf: i for i, leaf in enumerate(router.nearest(q, 1 << router.depth))} for q in asked]
    needed = sorted(ways[r["q"]][r["leaf"]] + 1 for r in best)
    return needed[max(0, math.ceil(target * len(needed)) - 1)] if needed else 1


# -- search ---------------------------------------------------------------------------------


def _unpack(row: dict) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(row["vectors"], np.float32 if row["single"] else np.float64).reshape(-1, row["dim"])
    first = np.frombuffer(row["neighbours"][0], np.int32)
    links = len(first) // len(data) // 2
    tables = [first.reshape(len(data), -1), *(np.frombuffer(t, np.int32).reshape(-1, links) for t in row["neighbours"][1:])]
    ends = np.frombuffer(row["id_ends"], np.int64)
    return Graph(data, tables), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["copies"], np.int64), np.concatenate([[0], ends])


def _ways(route: Route):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = _matrix(batch.column(1), route.dim) if batch.num_rows else []
            ways = [[s for leaf in route.router.nearest(q, route.probes) for s in route.parts.get(leaf, [leaf])] for q in data]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ways, pa.list_(pa.int64()))], names=[*batch.schema.names, "ways"])

    return run


def _search(k: int, beam: int, dim: int):
    schema = pa.schema([("asked", pa.int64()), ("vec_id", pa.int64()), ("copies", pa.int64()), ("score", pa.float64())])

    def few(graph: Graph, ids: np.ndarray, copies: np.ndarray, ends: np.ndarray, asked: np.ndarray, queries: np.ndarray) -> Iterator[pa.Table]:
        most = float(max(np.abs(graph.data).max(), np.abs(queries).max()))
        limit = 1e15 if queries.dtype == np.float32 else 1e150
        walk, own = graph, queries
        if most > limit:
            shift = -math.frexp(most)[1]
            walk, own = Graph(np.ldexp(graph.data, shift), graph.tables), np.ldexp(queries, shift)
        _, nodes = walk.search(own, beam)
        held, place = np.nonzero(nodes >= 0)
        what = nodes[held, place]
        far = distances(graph.data[what], queries[held])
        lengths = ends[what + 1] - ends[what]
        at = np.repeat(ends[what] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        held, far = np.repeat(held, lengths), np.repeat(far, lengths)
        order = np.lexsort((ids[at], far, held))
        held, far, at = held[order], far[order], at[order]
        # the first of k + 1 distinct ids: any one of them may be the query's own
        start = np.searchsorted(held, held)
        cut = np.arange(len(held)) - start < k + 1
        repeated = len(np.unique(np.column_stack([held, ids[at]]), axis=0)) < len(held)
        if repeated:
            first = np.zeros(len(held), bool)
            first[np.unique(held * np.int64(len(ids) + 1) + np.unique(ids, return_inverse=True)[1].ravel()[at], return_index=True)[1]] = True
            run_ = np.cumsum(first)
            cut = run_ - np.where(start > 0, run_[start - 1], 0) <= k + 1
        held, far, at = held[cut], far[cut], at[cut]
        yield pa.table([pa.array(asked[held]), pa.array(ids[at]), pa.array(copies[at]), pa.array(far)], schema=schema)

    def run(key: tuple, shard: pa.Table, queries: pa.Table) -> pa.Table:
        if not shard.num_rows or not queries.num_rows:
            return schema.empty_table()
        graph, ids, copies, ends = _unpack(shard.to_pylist()[0])
        asked = queries.column("asked").to_numpy()
        data = _matrix(queries.column("v").combine_chunks(), dim)
        block = max(16, min(512, MARKS // len(graph.data)))
        out = [t for i in range(0, len(asked), block) for t in few(graph, ids, copies, ends, asked[i : i + block], data[i : i + block])]
        return pa.concat_tables(out)

    return run


def search(index: DataFrame, route: Route, queries: DataFrame, *, k: int = 10, beam: int = 320, block_rows: int = 1 << 16) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each of ``queries`` (query_id, q).

    Equal query vectors are searched once. A task holds one shard and a block of queries.
    """
    kind = queries.schema["q"].dataType.simpleString()
    queries = queries.select("query_id", F.col("q").alias("v")).distinct()
    distinct = materialize(queries.groupBy("v").agg(F.lit(1).alias("__one")).select(F.monotonically_increasing_id().alias("asked"), "v"), "distinct-queries")
    ways = distinct.mapInArrow(_ways(route), f"asked long, v {kind}, ways array<long>")
    blocks = max(1, math.ceil(distinct.count() * route.probes / (block_rows * (1 << route.router.depth))))
    asked = ways.select("asked", "v", F.explode("ways").alias("shard"), F.pmod(F.xxhash64("asked"), F.lit(blocks)).cast("int").alias("block"))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_search(k, beam, route.dim), "asked long, vec_id long, copies long, score double")
    # of all shards' hits the first of k + 1 distinct ids
    first = F.row_number().over(Window.partitionBy("asked", "vec_id").orderBy("score")) == 1
    so_far = F.sum(F.col("__first").cast("int")).over(Window.partitionBy("asked").orderBy("score", "vec_id").rowsBetween(Window.unboundedPreceding, 0))
    found = found.repartition("asked").withColumn("__first", first).withColumn("__so_far", so_far).where(F.col("__so_far") <= k + 1).drop("__first", "__so_far")
    found = materialize(found, "vector-hits")
    hits = queries.join(distinct, "v").select("query_id", "asked").join(found, "asked").where("vec_id <> query_id")
    hits = hits.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, *, every: int = 100, k: int = 10, shard_rows: int = 16_384, beam: int = 320, **options) -> DataFrame:
    """Queries are the rows whose vec_id ``every`` divides, candidates all rows but the query's own."""
    index, route = build_index(vectors, k=k, shard_rows=shard_rows, **options)
    queries = usable(vectors)[0].where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return search(index, route, queries, k=k, beam=beam)
