"""Near-duplicate groups by SimHash pigeonring and the exact Jaccard similarity of word shingles, for the pipeline.

Documents are linked if their sets of ``words``-word shingles (64-bit hashes) have a Jaccard
similarity of ``least`` or more. SimHash fingerprints of the same shingles, repeats included, give the first candidates: those
within ``distance`` bits are found by op10's pigeonring chains (``simhash.links``), and an exact check follows.
Pairs that are ``least`` alike lie up to some 17 of 64 bits apart, though. Pigeonring
segments for so many bits are three or four bits wide, so a bucket would be an eighth of the corpus;
the other candidates come by prefix filtering, which loses no pair: sets of a and b shingles that
are ``least`` alike share one of the first a - ceil(least * a) + 1 of the one and of the first
b - ceil(least * b) + 1 of the other, in any one order of all shingles.

That order puts frequent shingles last. Which are frequent is counted on the prefixes that the
order of hashes gives to a quarter of the texts, and only the ``frequent`` most frequent are told to the tasks: a shingle
left out costs candidates, never a pair. Prefix rows whose shingle no other text has are dropped
where they meet; what is left is small.

Inside a group of texts that share a prefix shingle, pairs are dropped whose sizes, positions or
marks can't give ``least``. Marks are the parities of a set's shingles in as many cells as it has
shingles, about: two sets differ in at least as many shingles as their marks differ in cells. Groups
of copies would still have pairs in the square of their size, so links are found in two rounds.
First each group gives a spanning forest of its possible pairs, the likeliest first, and these and
the fingerprints' pairs get the exact similarity. Only groups in which one of them isn't ``least`` alike are searched again, in blocks with
whole sets (``ngram_join``), for links between texts that the first round hasn't joined: no pair is written that isn't a link.
``least`` counts in whole percent there.

Texts with equal words in equal order are one before anything is compared, under a 64-bit hash.

Defined cases
- words are separated by white space and lower-cased as in ``simhash``.
- null or empty text, or no words: alike among themselves, unlike all others.
- fewer words than a shingle: the whole sequence is the one shingle.
- null doc_id: takes part in linking, never names a component unless the whole component
  has none (then component_id is null).
- repeated rows: each is returned, with the same component.
- ties: a similarity of exactly ``least`` links; the smallest doc_id names a component.
- very long texts: whole; a task holds one text's set, and of a block's sets up to ``limit`` shingles.
- extra columns are not read; keep_one() passes them through. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import MOST_BROADCAST, materialize, row_key, tidy, without
from tessera.llm.ngram_join import StoredJoin
from tessera.llm.shingles import SEED, shingles
from tessera.llm.simhash import components, forest


def _sets(words: int):
    """Rows (doc_id, row_key, id, shingles, fp), fp the fingerprint; both are null where the task has already given those of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                few = batch.slice(at, 256)
                ids, sets, prints = [], [], []
                for text in few.column(2):
                    own, hashes = shingles(text.as_py(), words)
                    ids.append(own)
                    sets.append(None if own in seen else np.unique(hashes.view(np.int64)).tobytes())
                    prints.append(None if own in seen else int(np.uint64(simhash.folded(hashes)).view(np.int64)))
                    seen.add(own)
                made = [pa.array(ids, pa.int64()), pa.array(sets, pa.binary()), pa.array(prints, pa.int64())]
                yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), *made], names=["doc_id", "row_key", "id", "shingles", "fp"])

    return run


def needed(n: int, least: float) -> int:
    """The fewest of n shingles that a set shares with one that is ``least`` alike."""
    return int(np.ceil(least * n - 1e-9))


def _prefixes(least: float, frequent: np.ndarray, counts: np.ndarray):
    """Rows (h, id, n, at): the shingles of each set's prefix with their positions. ``frequent`` ascends."""

    def of(own: np.ndarray) -> np.ndarray:
        size = len(own) - needed(len(own), least) + 1
        if len(frequent):
            place = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
            own = own[np.lexsort((own, np.where(frequent[place] == own, counts[place], 0)))]
        return own[:size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                few = batch.slice(start, 256)
                held = [(i.as_py(), np.frombuffer(s.as_py(), np.int64)) for i, s in zip(few.column(0), few.column(1))]
                held = [(i, len(own), of(own)) for i, own in held if len(own)]
                if held:
                    ids, sizes, parts = zip(*held)
                    lengths = list(map(len, parts))
                    arrays = [np.concatenate(parts), np.repeat(np.array(ids, np.int64), lengths), np.repeat(np.array(sizes, np.int32), lengths), np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), names=["h", "id", "n", "at"])

    return run


def marks(shingles: bytes | np.ndarray) -> bytes:
    """Parities of how many of the shingles fall into each of 64 to 4,096 cells, one bit each."""
    own = np.frombuffer(shingles, np.int64) if isinstance(shingles, bytes) else shingles
    cells = min(4096, 1 << max(6, int(len(own) - 1).bit_length()))
    return np.packbits((np.bincount(own & (cells - 1), minlength=cells) & 1).astype(np.uint8), bitorder="little").tobytes()


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([marks(s.as_py()) for s in batch.column(1)], pa.binary())], names=["id", "marks"])


class Marks:
    """The marks of rows; those of many cells can be folded to fewer."""

    def __init__(self, held: list[bytes]) -> None:
        self.words = np.fromiter((len(m) // 8 for m in held), np.int64, len(held))
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in np.unique(self.words).tolist():
            wide = np.flatnonzero(self.words >= width)
            place = np.full(len(held), -1)
            place[wide] = np.arange(len(wide))
            table = np.zeros((len(wide), width), np.uint64)
            for own in np.unique(self.words[wide]).tolist():
                rows = np.flatnonzero(self.words[wide] == own)
                whole = np.frombuffer(b"".join(held[i] for i in wide[rows].tolist()), np.uint64).reshape(len(rows), -1, width)
                table[rows] = np.bitwise_xor.reduce(whole, axis=1)
            self.folded[width] = place, table

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many cells the marks of rows ``a`` and ``b`` differ."""
        out, width = np.zeros(len(a), np.int64), np.minimum(self.words[a], self.words[b])
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            place, table = self.folded[w]
            out[at] = np.bitwise_count(table[place[a[at]]] ^ table[place[b[at]]]).sum(axis=1, dtype=np.int64)
        return out


def possible_pairs(group: np.ndarray, n: np.ndarray, at: np.ndarray, held: Marks, least: float, step: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, most): pairs of rows of one group that may be ``least`` alike, and the most that they can be.

    Rows ascend by group and n, the size of the set; ``at`` is the shared shingle's position in it.
    """
    rows = len(n)
    # a partner comes later, so that it isn't smaller, and is at most n / least large
    key = group.astype(np.int64) << 32 | n
    ends = np.searchsorted(key, (group.astype(np.int64) << 32) + np.floor(n / least + 1e-6).astype(np.int64), "right")
    counts = np.maximum(ends - np.arange(rows) - 1, 0)
    edges = np.concatenate([[0], np.cumsum(counts)])
    begin = 0
    while begin < rows:  # about ``step`` pairs at once
        end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + step, "right")) - 1)
        k = counts[begin:end]
        a = np.repeat(np.arange(begin, end), k)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
        both = n[a] + n[b]
        # if this is the first shingle that they share, only those behind it can follow
        most = 1 + np.minimum(n[a] - at[a] - 1, n[b] - at[b] - 1)
        fits = most >= least / (1 + least) * both - 1e-6
        a, b, both = a[fits], b[fits], both[fits]
        most = (both - held.apart(a, b)) / 2
        fits = most >= least / (1 + least) * both - 1e-6
        if fits.any():
            a, b, most, both = a[fits], b[fits], most[fits], both[fits]
            yield a, b, most / (both - most)
        begin = end


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, own, blocks, id, n, at) sorted by (h, own, id) without repetitions and without those that are alone.

    Rows of groups in blocks stay, as their partners may be in other blocks.
    """
    names = ["h", "own", "blocks", "id", "n", "at"]

    def cut(held: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, (held[1:, :2] != held[:-1, :2]).any(axis=1)]
        held = held[new | np.r_[True, held[1:, 3] != held[:-1, 3]]]
        start = np.flatnonzero(np.r_[True, (held[1:, :2] != held[:-1, :2]).any(axis=1)])
        many = np.repeat(np.diff(np.r_[start, len(held)]), np.diff(np.r_[start, len(held)])) > 1
        held = held[many | (held[:, 2] > 1)]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(held[:, i]).cast(k) for i, k in enumerate(kinds)], names=names)

    rest = np.zeros((0, 6), np.int64)
    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        rest = np.concatenate([rest, rows]) if len(rest) else rows
        if len(rest):
            end = int(np.argmax((rest[:, :2] == rest[-1, :2]).all(axis=1)))  # the last group may go on
            if end:
                yield cut(rest[:end])
                rest = rest[end:]
    if len(rest):
        yield cut(rest)


def _group_pairs(least: float, enough: int = 50_000):
    """Streams rows (h, low, high, n, at, id, own, marks) sorted by the first four; whole groups, about ``enough`` rows at once.

    Gives each group's spanning forest of pairs that may be ``least`` alike, the likeliest first.
    """

    def solve(rows: np.ndarray, held: list[bytes]) -> pa.RecordBatch:
        group = np.cumsum(np.r_[False, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
        across = rows[:, 1] != rows[:, 2]
        found = []
        for a, b, most in possible_pairs(group, rows[:, 3], rows[:, 4], Marks(held), least):
            # pairs inside a block are found by that block's own group
            fits = (rows[a, 5] != rows[b, 5]) & (~across[a] | (rows[a, 6] != rows[b, 6]))
            found.append((a[fits], b[fits], most[fits]))
        tiers = [least + (1 - least) * x for x in (0.9, 0.75, 0.5, 0.25)]
        tiers = list(zip([*tiers, 0.0], [2.0, *tiers]))
        a, b = forest(len(rows), ((a[part], b[part]) for low, high in tiers for a, b, most in found for part in [(most >= low) & (most < high)]))
        u, v = np.minimum(rows[a, 5], rows[b, 5]), np.maximum(rows[a, 5], rows[b, 5])
        return pa.RecordBatch.from_arrays([pa.array(rows[a, 0]), pa.array(u), pa.array(v)], names=["h", "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, size = [], [], 0
        for batch in batches:
            parts.append(np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(7)]))
            held += batch.column(7).to_pylist()
            size += batch.num_rows
            if size < enough:
                continue
            rows = np.concatenate(parts)
            cut = int(np.argmax((rows[:, :3] == rows[-1, :3]).all(axis=1)))  # the last group may go on
            if cut:
                yield solve(rows[:cut], held[:cut])
            parts, held, size = [rows[cut:]], held[cut:], len(rows) - cut
        if size:
            yield solve(np.concatenate(parts), held)

    return run


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(s.as_py(), np.int64), np.frombuffer(t.as_py(), np.int64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= least * (len(a) + len(b) - both) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _few(ids: DataFrame) -> DataFrame:
    """Distinct ``ids`` ready to be joined: broadcast if a count shows that they are few."""
    ids = materialize(ids, "few")
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the distinct ``pairs`` (u, v) that are ``least`` alike."""
    ids = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    held = materialize(sets.join(_few(ids), "id", "left_semi").dropDuplicates(["id"]), "candidate-sets")
    both = pairs.join(held.select(F.col("id").alias("u"), F.col("shingles").alias("s")), "u").join(held.select(F.col("id").alias("v"), F.col("shingles").alias("t")), "v")
    return materialize(both.select("u", "v", "s", "t").mapInArrow(tidy(_alike(least)), "u long, v long"), "near-links")


def print_pairs(prints: DataFrame, *, distance: int = 4, block: int = 20_000) -> DataFrame:
    """Pairs (u, v) of ids in ``prints`` (id, fp), u the smaller: their components are those of all pairs within ``distance`` bits.

    Pigeonring links join different fingerprints, each of which stands for its smallest id; the others of it are linked with that one.
    """
    first = materialize(prints.groupBy("fp").agg(F.min("id").alias("id")), "distinct-prints")
    near = simhash.links(first.select("fp"), distance=distance, block=block)
    near = near.join(first.select(F.col("fp").alias("u"), F.col("id").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("id").alias("b")), "v").select("a", "b")
    same = prints.distinct().join(first.withColumnRenamed("id", "a"), "fp").where("id <> a").select("a", F.col("id").alias("b"))
    return near.unionByName(same).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def links(sets: DataFrame, prints: DataFrame, *, least: float = 0.8, distance: int = 4, frequent: int = 500_000, block: int = 20_000, limit: int = 2_000_000) -> DataFrame:
    """Pairs (u, v) of ids in ``sets`` (id, shingles) whose Jaccard similarity is ``least`` or more:
    so many that their components are those of all such pairs. ``prints`` (id, fp) are their fingerprints."""
    ddl = "h long, id long, n int, at int"
    none = np.zeros(0, np.int64)
    # samples decide on the order of shingles and on the division of work only, never on pairs
    first = sets.sample(0.25, seed=SEED).mapInArrow(tidy(_prefixes(least, none, none)), ddl).groupBy("h").agg(F.count("*").alias("k")).where("k > 2")
    often = first.orderBy(F.desc("k"), "h").limit(frequent).toArrow()
    h, k = (often.column(c).to_numpy().astype(np.int64) for c in ("h", "k"))
    order = np.argsort(h)
    prefixes = tidy(_prefixes(least, h[order], k[order]))
    # groups that are too large for one task are dealt out in blocks, a task for each pair of them
    part = min(1.0, 100 / block)
    some = sets.sample(part, seed=SEED) if part < 1 else sets
    hot = some.mapInArrow(prefixes, ddl).groupBy("h").agg(F.ceil(F.count("*") / (part * block)).cast("int").alias("blocks")).where("blocks > 1")
    hot = _few(hot)
    rows = sets.mapInArrow(prefixes, ddl).join(hot, "h", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.select("h", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("own"), "blocks", "id", "n", "at")
    rows = rows.repartition("h", "own").sortWithinPartitions("h", "own", "id").mapInArrow(tidy(_shared), "h long, own int, blocks int, id long, n int, at int")
    rows = materialize(rows, "shared-shingles")
    marked = sets.mapInArrow(tidy(_marked), "id long, marks binary").dropDuplicates(["id"])

    spread = rows.join(marked, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["h", "low", "high"]
    spread = spread.select("h", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "n", "at", "id", "own", "marks")
    tried = spread.repartition(*key).sortWithinPartitions(*key, "n").mapInArrow(tidy(_group_pairs(least)), "h long, u long, v long")
    tried = materialize(tried, "spanning-pairs")
    near = materialize(print_pairs(prints, distance=distance, block=block), "print-pairs")
    found = _verified(near.unionByName(tried.select("u", "v")).distinct(), sets, least)
    failed = tried.join(found, ["u", "v"], "left_anti")
    again = rows.join(_few(failed.select("h").distinct()), "h", "left_semi").withColumn("n", F.col("n").cast("long"))
    search = StoredJoin(sets, least=round(100 * least), limit=limit)
    members = search.named(again.where("blocks = 1").select("h", "id", "n"), again.where("blocks > 1").select("h", "id", "n").distinct())
    roots = components(found).withColumnRenamed("node", "id")
    members = materialize(members.select("rep", "id", "n").distinct().join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "open-blocks")
    return found.unionByName(search.links(members))


def _grouped(docs: DataFrame, words: int, least: float, frequent: int, block: int) -> DataFrame:
    """(doc_id, row_key, first) for each row of ``docs``; first is the (without, doc_id, row_key) of the
    component's first row: the smallest doc_id, and rows without one last."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text").mapInArrow(tidy(_sets(words)), "doc_id long, row_key long, id long, shingles binary, fp long")
    rows = materialize(rows, "shingles")
    own = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row_key")
    distinct = materialize(rows.groupBy("id").agg(F.min(own).alias("low")), "distinct-texts")
    once = rows.where("shingles is not null")
    roots = components(links(once.select("id", "shingles"), once.select("id", "fp"), least=least, frequent=frequent, block=block))
    named = distinct.join(roots, distinct["id"] == roots["node"], "left").select("id", "low", F.coalesce("root", "id").alias("root"))
    named = materialize(named, "roots")
    lowest = named.groupBy("root").agg(F.min("low").alias("first"))
    return rows.select("doc_id", "row_key", "id").join(named.join(lowest, "root").select("id", "first"), "id").select("doc_id", "row_key", "first")


def near_copies(docs: DataFrame, *, words: int = 5, least: float = 0.8, frequent: int = 500_000, block: int = 20_000) -> DataFrame:
    """(doc_id, component_id) for each row of ``docs``."""
    return _grouped(docs, words, least, frequent, block).select("doc_id", F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, *, words: int = 5, least: float = 0.8, frequent: int = 500_000, block: int = 20_000) -> DataFrame:
    """One document of each component of ``docs``: that with the smallest doc_id.

    Rows without a doc_id come last; rows that share it are told apart by a hash of their text,
    of which the smallest stays. Rows equal in both are one document and stay together.
    """
    found = _grouped(docs, words, least, frequent, block)
    here = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row_key")
    return without(docs, found.where(here != F.col("first")).select("doc_id", "row_key"))
