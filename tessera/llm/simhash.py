"""SimHash near-duplicate groups by pigeonring filtering.

Fingerprints are made where the texts lie; from there on only (document, fingerprint)
rows move, and equal fingerprints collapse by a map-side combine before anything is
compared, so a group of exact copies costs one row however large it is.

Fingerprints within ``distance`` bits are found by the pigeonring principle: cut 64 bits
into m = distance + 1 segments on a ring. If two fingerprints differ in at most
``distance`` bits, some segment starts a chain in which, for every length l, the first l
segments differ in at most l * distance / m bits in sum. So the first segment of the
chain is equal (the bucket key), and the first two differ in at most one bit, which a
sorted array of second segments answers without comparing all pairs of a bucket. What
passes the whole chain gets the full Hamming check.

A bucket with more than ``block`` fingerprints is dealt out in blocks and each pair of
blocks becomes a task of its own: bounded memory, no pair lost. Every task returns a
spanning forest of the links it found, not all pairs. Components come from alternating
large-star and small-star steps over those links, each step written to the shared folder.

Defined cases
- null or empty text, or no words: fingerprint zero, linked like any other.
- fewer words than a shingle: the whole sequence is the one shingle.
- null doc_id: takes part in linking, never names a component unless the whole component
  has none (then component_id is null).
- repeated rows: each is returned, with the same component.
- ties: the smallest doc_id names a component; equal fingerprints are one.
- extra columns are not read; keep_one() passes them through. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, row_key, tidy, without

BITS = 64


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint of a text: per bit, 1 if over half of the shingle hashes have it."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    hashed = xxhash.xxh64_intdigest
    if len(found) <= words:
        hashes = np.array([hashed(joined, seed)], np.uint64)
    else:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: 1 - words].tolist()
        hashes = np.array([hashed(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64)
    return folded(hashes)


def folded(hashes: np.ndarray) -> int:
    """The unsigned fingerprint of shingle hashes; zero if there are none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # long texts in parts
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), words) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["doc_id", "row_key", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, row_key, fp) with fp the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text").mapInArrow(_fingerprints(words), "doc_id long, row_key long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of distance + 1 segments that cover 64 bits."""
    m = distance + 1
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segment(fp: np.ndarray, shift: int, width: int) -> np.ndarray:
    return (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)


def chain_pairs(left: np.ndarray, right: np.ndarray, left_bucket: np.ndarray, right_bucket: np.ndarray, at: int, distance: int, step: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into left, into right) of fingerprints of one bucket within ``distance``.

    A bucket's fingerprints have an equal segment ``at``. ``right`` is sorted by bucket and
    next segment, which is probed with at most the one bit that the chain allows;
    survivors take the rest of the chain, whose last step is the full check.
    """
    parts = segments(distance)
    m = len(parts)
    chain = [parts[(at + i) % m] for i in range(m)]
    shift, width = chain[1 % m]
    keys = (right_bucket.astype(np.uint64) << np.uint64(width)) | _segment(right, shift, width)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    own = (left_bucket.astype(np.uint64) << np.uint64(width)) | _segment(left, shift, width)
    # with distance + 1 segments two of them may differ in one bit together
    for flip in [0, *(1 << b for b in range(width))]:
        want = own ^ np.uint64(flip)
        low, high = np.searchsorted(keys, want, "left"), np.searchsorted(keys, want, "right")
        counts = high - low
        edges = np.concatenate([[0], np.cumsum(counts)])
        begin = 0
        while begin < len(left):  # about ``step`` candidates at once
            end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + step, "right")) - 1)
            n = counts[begin:end]
            total = int(n.sum())
            if total:
                a = np.repeat(np.arange(begin, end), n)
                b = order[np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[begin:end], n)]
                differ = left[a] ^ right[b]
                fits = np.ones(total, bool)
                spent = np.zeros(total, np.int64)
                for length, (s, w) in enumerate(chain, 1):
                    spent += np.bitwise_count(_segment(differ, s, w))
                    fits &= spent <= length * distance // m
                if fits.any():
                    yield a[fits], b[fits]
            begin = end


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a spanning forest of the links among n nodes."""
    label = np.arange(n)
    us, vs = [], []
    for a, b in pairs:
        while True:
            differ = label[a] != label[b]
            if not differ.any():
                break
            a, b = a[differ], b[differ]
            upper, lower = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
            roots, first = np.unique(upper, return_index=True)  # each root hooks to one smaller root
            us.append(a[first])
            vs.append(b[first])
            parent = np.arange(n)
            parent[roots] = lower[first]
            while (parent[parent] != parent).any():
                parent = parent[parent]
            label = parent[label]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def _bucket_links(distance: int, least: int):
    """Streams rows sorted by (at, seg, low, high); handles whole buckets, about ``least`` rows at once."""

    def solve(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for at in np.unique(rows[:, 0]):
            part = rows[rows[:, 0] == at]
            bucket = np.cumsum(np.r_[False, (part[1:, 1:4] != part[:-1, 1:4]).any(axis=1)])
            fps = np.ascontiguousarray(part[:, 4]).view(np.uint64)
            left, right = np.flatnonzero(part[:, 5] == part[:, 2]), np.flatnonzero(part[:, 5] == part[:, 3])
            pairs = ((left[a], right[b]) for a, b in chain_pairs(fps[left], fps[right], bucket[left], bucket[right], int(at), distance))
            pairs = ((a[a != b], b[a != b]) for a, b in pairs)
            u, v = forest(len(fps), pairs)
            found.append((fps[u].view(np.int64), fps[v].view(np.int64)))
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 6), np.int64)
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            held = np.concatenate([held, rows]) if len(held) else rows
            if len(held) < least:
                continue
            same = (held[:, :4] == held[-1, :4]).all(axis=1)
            cut = int(np.argmax(same))  # the last bucket may go on
            if cut:
                u, v = solve(held[:cut])
                held = held[cut:]
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        u, v = solve(held)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def links(prints: DataFrame, *, distance: int = 4, block: int = 20_000) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of ``prints.fp`` within ``distance``.

    ``prints`` has distinct fingerprints.
    """
    shifts = segments(distance)
    keys = F.array(*[F.struct(F.lit(i).alias("at"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)).alias("seg")) for i, (s, w) in enumerate(shifts)])
    rows = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.at", "k.seg")
    # 5 * 2^13 buckets at distance 4, whatever the data, so their sizes can be broadcast.
    sizes = rows.groupBy("at", "seg").count().where("count > 1").select("at", "seg", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(sizes), ["at", "seg"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("at", "seg", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp", "own")
    key = ["at", "seg", "low", "high"]
    return rows.select(*key, "fp", "own").repartition(*key).sortWithinPartitions(*key).mapInArrow(tidy(_bucket_links(distance, block)), "u long, v long").distinct()


def components(edges: DataFrame, *, tag: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of the component.

    Alternates large-star and small-star until no link changes, which takes about the
    logarithm of the longest path. Each round's links are written to the shared folder.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = materialize(edges, tag)
    before = None
    while True:
        # large-star: u's neighbours above u go to u's smallest neighbour (or u)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: u and its neighbours below u go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), tag)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (state["n"], state["s"]) == before:
            break
        before = (state["n"], state["s"])
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _grouped(docs: DataFrame, distance: int, words: int, block: int) -> DataFrame:
    """(doc_id, row_key, fp, first) for each row of ``docs``; first is the (without, doc_id, row_key) of the
    component's first row: the smallest doc_id, and rows without one last."""
    rows = materialize(fingerprints(docs, words), "fingerprints")
    own = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row_key")
    distinct = materialize(rows.groupBy("fp").agg(F.min(own).alias("low")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), distance=distance, block=block))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "roots")
    lowest = named.groupBy("root").agg(F.min("low").alias("first"))
    return rows.join(named.join(lowest, "root").select("fp", "first"), "fp").select("doc_id", "row_key", "fp", "first")


def near_duplicates(docs: DataFrame, *, distance: int = 4, words: int = 4, block: int = 20_000) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``."""
    return _grouped(docs, distance, words, block).select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def near_duplicate_report(docs: DataFrame, *, distance: int = 4, words: int = 4) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id)."""
    return near_duplicates(docs, distance=distance, words=words).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, distance: int = 4, words: int = 4) -> DataFrame:
    """One document of each component of ``docs``: that with the smallest doc_id.

    Rows without a doc_id come last; rows that share it are told apart by a hash of their text,
    of which the smallest stays. Rows equal in both are one document and stay together.
    """
    found = _grouped(docs, distance, words, 20_000)
    here = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row_key")
    return without(docs, found.where(here != F.col("first")).select("doc_id", "row_key"))
