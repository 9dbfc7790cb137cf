"""Documents whose sets of word shingles are alike, by T-occurrence search (DivideSkip).

Two sets of a and b shingles have a Jaccard similarity of ``least`` percent or more only if a shingle
list index finds the one at least T = ceil(least * a / 100) times among the a inverted lists of the
other. DivideSkip sets the L longest of these lists aside, merges the a - L short ones, probes the
long ones by binary search for what the merge found T - L times, and retains what reaches T. This runs in two places.

On the cluster L is T - l with l = a - T + 1: each document posts (shingle, id, size) for its a - T + l shingles that are rarest in one order
of all. Documents that are alike share the l first of what they share (or as many as the smaller one's l), so a document in fewer lists
with others has no partner and goes no further. The documents of a list are named by the smallest
id among them, so documents that share many lists are sent to one block once, not once for each list. Inside a block L is T - 1: a task builds the inverted index of all its shingles, and
each document searches those before it: short lists are merged (all at once, by sorting what a heap would
give one by one), long ones are probed, and documents that reach the overlap which both sizes ask for
are linked. Documents that are joined already aren't probed, so a block gives a spanning forest.

A block of more than ``limit`` shingles is cut: the exact distance (1 - similarity, a metric) of all its documents to
that which names it puts them into bands as wide as a link is long. Documents of the first band are linked to it; others
can have links in their own band and the ones beside it only, so bands meet in tasks of at most about
``limit`` shingles a side. Lists of more than ``hot`` documents aren't shuffled by shingle at all: where rows
lie, they get the smallest id by a map-side combined minimum.

Which shingles are rare is counted on a quarter of the texts, and the ``frequent`` most frequent of
them are told to tasks. The order and ``hot`` decide on work only, never on links.

Defined cases
- null, empty or blank text: no shingles, linked with nothing, not even its like.
- fewer words than a shingle: the whole sequence is the one shingle.
- equal words in equal order are one text before anything is compared, under a 64-bit hash, as shingles are.
- null doc_id: takes part in linking, and never names a component unless nothing else does (then component_id is null).
- repeated rows, and rows that share a doc_id: each is returned, by its own text.
- ties: a similarity of exactly ``least`` percent links (in integers); the smallest doc_id names a component.
- very long texts: whole. A task holds its blocks' sets, a text's own set at least.
- an empty table gives an empty result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import MOST_BROADCAST, MOST_BYTES, materialize, row_key, tidy
from tessera.llm.shingles import SEED, shingle_set
from tessera.llm.simhash import components

#: One task of a block: ``band`` -1 for a whole block, else the pairs of two parts of a band or of it and the one below.
TASK = ["rep", "band", "i", "low", "j"]
TASK_DDL = "rep long, band int, i int, low boolean, j int, side int, root long"


def needed(n: int, least: int) -> int:
    """The fewest of n shingles that a set shares with one that is ``least`` percent alike."""
    return -(-least * n // 100)


def lists_needed(n: int | np.ndarray, least: int) -> int | np.ndarray:
    """In how many short lists a set of n shingles meets one of at most its size that is ``least`` percent alike."""
    wanted = -(-least * n // 100)
    return np.minimum(n - wanted + 1, wanted)


def overlap_needed(a: np.ndarray | int, b: np.ndarray | int, least: int) -> np.ndarray | int:
    """The fewest shared shingles of sets of a and b that are ``least`` percent alike."""
    return -(-least * (a + b) // (100 + least))


def _short_lists(words: int, least: int, frequent: np.ndarray, counts: np.ndarray):
    """Rows (doc_id, row_key, id, n, short); short is null where the task has already given that of the id."""

    def of(own: np.ndarray) -> bytes:
        size = len(own) - needed(len(own), least) + int(lists_needed(len(own), least))
        if len(frequent):
            place = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
            own = own[np.lexsort((own, np.where(frequent[place] == own, counts[place], 0)))]
        return own[:size].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                few = batch.slice(at, 256)
                ids, sizes, short = [], [], []
                for text in few.column(2):
                    own, hashes = shingle_set(text.as_py(), words)
                    ids.append(own)
                    sizes.append(len(hashes))
                    short.append(None if own in seen or not len(hashes) else of(hashes))
                    seen.add(own)
                yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(short, pa.binary())], names=["doc_id", "row_key", "id", "n", "short"])

    return run


def _postings(hot: np.ndarray):
    """Rows (h, id, n, hot) from (id, n, short)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(s.as_py(), np.int64) for s in batch.column(2)]
            sizes = list(map(len, lists))
            h = np.concatenate([np.zeros(0, np.int64), *lists])
            ids, n = (np.repeat(batch.column(k).to_numpy(), sizes) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids), pa.array(n), pa.array(np.isin(h, hot))], names=["h", "id", "n", "hot"])

    return run


def _named(least: int):
    """Rows (rep, id, n, lists) from postings (h, id, n) sorted by h, n and id: those that share a list, with the smallest id
    among them and in how many lists they do.

    Where the next size of a list is too large to be alike, a new group begins.
    """

    def cut(rows: np.ndarray) -> pa.RecordBatch:
        rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]]  # tasks may post the same text
        new = np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (least * rows[1:, 2] > 100 * rows[:-1, 2])]
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, len(rows)])
        rep = np.repeat(np.minimum.reduceat(rows[:, 1], start), size)
        found = np.column_stack([rep, rows[:, 1], rows[:, 2]])[np.repeat(size, size) > 1]
        found, lists = np.unique(found, axis=0, return_counts=True) if len(found) else (found, np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(found[:, k])) for k in range(3)), pa.array(lists)], names=["rep", "id", "n", "lists"])

    def run(batches: Iterator[pa.RecordBatch], enough: int = 100_000) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            parts.append(np.column_stack([c.to_numpy() for c in batch.columns]))
            size += batch.num_rows
            if size < enough:
                continue
            rows = np.concatenate(parts)
            end = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last list may go on
            if end:
                yield cut(rows[:end])
            parts, size = [rows[end:]], len(rows) - end
        if size:
            yield cut(np.concatenate(parts))

    return run


class Joined:
    """Which members of a block are joined."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = int(self.up[x])
        return x

    def roots(self, xs: np.ndarray) -> np.ndarray:
        found = self.up[xs]
        while (self.up[found] != found).any():
            found = self.up[found]
        return found


def occurrence_links(sets: list[np.ndarray], side: np.ndarray | None, least: int, root: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among ``sets``, which ascend by size, as positions.

    With ``side`` only pairs of different sides count. Sets of one ``root`` are joined from the start. Lists that hold
    every set that may be alike need neither merging nor probing: they count one for each.
    """
    many = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, many)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    index = np.sort(codes * many + np.repeat(np.arange(many), sizes))  # all lists, one after the other
    ends = np.cumsum(sizes)
    joined, us, vs = Joined(many), [], []
    if root is not None:
        joined.up = np.unique(root, return_index=True)[1][np.unique(root, return_inverse=True)[1]]
    lows = np.searchsorted(sizes * 100, sizes * least)  # the first that is large enough
    for q in range(1, many):
        low, n = int(lows[q]), int(sizes[q])
        if low >= q:
            continue
        own = codes[ends[q] - n : ends[q]] * many
        left, right = np.searchsorted(index, own + low), np.searchsorted(index, own + q)
        length = right - left
        least_shared = needed(n, least)
        some = (length > 0) & (length < q - low)
        full = int(np.count_nonzero(length == q - low))
        rest = np.flatnonzero(some)
        if full + len(rest) < least_shared:
            continue
        # of those in between, so many may be set aside that one that reaches the overlap is in a short one
        short_many = len(rest) - max(0, least_shared - full) + 1
        if least_shared > full:
            order = rest[np.argpartition(length[rest], short_many - 1)] if short_many < len(rest) else rest
            short, long = order[:short_many], order[short_many:]
        else:  # the full lists alone may be enough: every one is a candidate
            short, long = rest, rest[:0]
        # merged short lists: documents and how often they occur
        reach = length[short]
        at = np.repeat(left[short] - np.cumsum(reach) + reach, reach) + np.arange(reach.sum())
        found, times = np.unique(index[at] % many, return_counts=True)
        if least_shared <= full:
            times = np.bincount(found - low, weights=times, minlength=q - low).astype(np.int64)
            found = np.arange(low, q)
        wanted = overlap_needed(n, sizes[found], least) - full
        fits = times + len(long) >= wanted
        if side is not None:
            fits &= side[found] != side[q]
        found, times, wanted = found[fits], times[fits], wanted[fits]
        order = np.argsort(-times, kind="stable")
        found, times, wanted = found[order], times[order], wanted[order]
        step = 1
        while len(found):
            apart = joined.roots(found) != joined.root(q)
            found, times, wanted = found[apart], times[apart], wanted[apart]
            some = found[:step]
            probes = own[long][None, :] + some[:, None]
            place = np.minimum(np.searchsorted(index, probes), len(index) - 1)
            for d in some[times[:step] + (index[place] == probes).sum(axis=1) >= wanted[:step]].tolist():
                a, b = joined.root(q), joined.root(d)
                if a != b:
                    joined.up[max(a, b)] = min(a, b)
                    us.append(q)
                    vs.append(d)
            found, times, wanted = found[step:], times[step:], wanted[step:]
            step = min(64, 4 * step)
    return us, vs


def _search(least: int):
    """Streams rows (*TASK, side, root, n, id, shingles) sorted by task and n; links (u, v) of each task."""

    def solve(key: tuple, side: list[int], root: list[int], ids: list[int], held: list[bytes]) -> pa.RecordBatch:
        sets = [np.frombuffer(s, np.int64) for s in held]
        sides = None if key[1] < 0 or (not key[3] and key[2] == key[4]) else np.array(side)
        u, v = occurrence_links(sets, sides, least, np.array(root))
        return pa.RecordBatch.from_arrays([pa.array([ids[x] for x in part], pa.int64()) for part in (u, v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, side, root, ids, held = None, [], [], [], []
        for batch in batches:
            for *own, s, r, _, i, shingles in zip(*(c.to_pylist() for c in batch.columns[:9]), batch.column(9)):
                if own != key:
                    if len(set(root)) > 1:
                        yield solve(key, side, root, ids, held)
                    key, side, root, ids, held = own, [], [], [], []
                side.append(s)
                root.append(r)
                ids.append(i)
                held.append(shingles.as_py())
        if len(set(root)) > 1:
            yield solve(key, side, root, ids, held)

    return run


def _sets_for_tasks(words: int):
    """Rows (*TASK, side, root, n, id, shingles): the set of each text for each of its tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, own, tasks in zip(batch.column(0), batch.column(1), batch.column(2)):
                held = shingle_set(text.as_py(), words)[1]
                tasks = pa.array(tasks.values)
                many = len(tasks)
                whole = [pa.array([len(held)] * many, pa.int64()), pa.array([own.as_py()] * many, pa.int64()), pa.array([held.tobytes()] * many, pa.binary())]
                yield pa.RecordBatch.from_arrays([*tasks.flatten(), *whole], names=[*TASK, "side", "root", "n", "id", "shingles"])

    return run


def _bands(least: int):
    """(rep, id, n, band, root) from (rep, id, shingles, other, root): how many links' lengths the set lies from that of rep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bands = [], []
            for s, t in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(s.as_py(), np.int64), np.frombuffer(t.as_py(), np.int64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                union = len(a) + len(b) - both
                sizes.append(len(a))
                # a similarity of exactly ``least`` is a link, so it belongs to the band before
                bands.append(0 if 100 * both >= least * union else 100 * (union - both) // ((100 - least) * union))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(bands, pa.int32()), batch.column(4)], names=["rep", "id", "n", "band", "root"])

    return run


def _few(frame: DataFrame, row_bytes: Column | int = 40) -> DataFrame:
    """A written ``frame`` ready to be joined: broadcast if its rows and bytes are counted to be few."""
    size = frame.agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)), F.lit(0)).alias("bytes")).first()
    return F.broadcast(frame) if size["n"] <= MOST_BROADCAST and size["bytes"] <= MOST_BYTES else frame


def whole() -> list[Column]:
    """The task of a block that is searched in one."""
    return [F.lit(-1).alias("band"), F.lit(0).alias("i"), F.lit(False).alias("low"), F.lit(0).alias("j"), F.lit(0).alias("side")]


class NgramJoin:
    """The join over ``docs`` (doc_id, text): ``rows`` (doc_id, row_key, id, n) and ``links()`` between ids."""

    def __init__(self, docs: DataFrame, *, words: int = 3, least: int = 90, frequent: int = 500_000, hot: int = 20_000, limit: int = 2_000_000) -> None:
        if not 0 < least < 100:
            raise ValueError("least is a percentage over 0 and under 100")
        self.words, self.least, self.limit = words, least, limit
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")
        none = np.zeros(0, np.int64)
        part = 0.25
        some = self._posted(self.docs.sample(part, seed=SEED), none, none).where("short is not null").select("id", "n", "short")
        often = some.mapInArrow(_postings(none), "h long, id long, n long, hot boolean").groupBy("h").agg(F.count("*").alias("k")).where("k > 2")
        often = often.orderBy(F.desc("k"), "h").limit(frequent).toArrow()
        h, k = (often.column(c).to_numpy().astype(np.int64) for c in ("h", "k"))
        order = np.argsort(h)
        self.hot = h[k >= part * hot]
        self.rows = materialize(self._posted(self.docs, h[order], k[order]), "short-lists")

    def _posted(self, docs: DataFrame, h: np.ndarray, k: np.ndarray) -> DataFrame:
        return docs.mapInArrow(_short_lists(self.words, self.least, h, k), "doc_id long, row_key long, id long, n long, short binary")

    def members(self) -> DataFrame:
        """(rep, id, n): the documents of each block, of those that share enough lists with others."""
        postings = self.rows.where("short is not null").select("id", "n", "short").mapInArrow(_postings(self.hot), "h long, id long, n long, hot boolean")
        hot = postings.where("hot").select("h", "id", "n").distinct() if len(self.hot) else None
        named = self.named(postings.where("not hot").select("h", "id", "n"), hot)
        named = materialize(named.groupBy("rep", "id", "n").agg(F.sum("lists").alias("lists")), "shared-lists")
        smaller = F.ceil(F.lit(self.least) * F.col("n") / 100)  # the smallest partner, and what its size asks for
        wanted = F.ceil(F.lit(self.least) * smaller / 100)
        enough = named.groupBy("id", "n").agg(F.sum("lists").alias("lists")).where(F.col("lists") >= F.least(smaller - wanted + 1, wanted)).select("id")
        enough = materialize(enough, "enough-lists")
        return materialize(named.join(_few(enough, 16), "id", "left_semi").select("rep", "id", "n"), "blocks")

    def named(self, lists: DataFrame, hot: DataFrame | None) -> DataFrame:
        """(rep, id, n, lists) from postings (h, id, n): those of a list with its smallest id. ``hot`` ones, distinct, don't meet in a task."""
        ddl = "rep long, id long, n long, lists long"
        found = lists.repartition("h").sortWithinPartitions("h", "n", "id").mapInArrow(_named(self.least), ddl)
        if hot is None:
            return found
        least = _few(materialize(hot.groupBy("h").agg(F.min("id").alias("rep")), "hot-lists"), 16)
        return found.unionByName(hot.join(least, "h").select("rep", "id", "n", F.lit(1).cast("long").alias("lists")))

    def _sets(self, tasks: DataFrame) -> DataFrame:
        """(*TASK, side, root, n, id, shingles) for ``tasks`` (id, *TASK, side, root): made from the texts again, of one row for each id."""
        wanted = tasks.groupBy("id").agg(F.collect_list(F.struct(*TASK, "side", "root")).alias("tasks"))
        rows = self.rows.select("doc_id", "row_key", "id")
        picked = rows.groupBy("id").agg(F.min(F.struct("doc_id", "row_key")).alias("own")).join(wanted, "id")
        picked = materialize(picked.select(F.col("own.doc_id").alias("of_doc"), F.col("own.row_key").alias("of_key"), F.col("id").alias("of_id"), "tasks"), "wanted-sets")
        own = rows.join(_few(picked.select("of_doc", "of_key")), F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("row_key") == F.col("of_key")))
        repeated = own.count() > picked.count()
        wanted = _few(picked, F.size("tasks") * 41 + 40)
        wanted = wanted if wanted is not picked else picked.hint("shuffle_hash")
        texts = self.docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("row_key") == F.col("of_key"))).select("text", "of_id", "tasks")
        made = texts.mapInArrow(_sets_for_tasks(self.words), f"{TASK_DDL}, n long, id long, shingles binary")
        return made.dropDuplicates([*TASK, "side", "id"]) if repeated else made

    def _linked(self, tasks: DataFrame) -> DataFrame:
        """(u, v) found in ``tasks`` (id, *TASK, side, root)."""
        return self._sets(tasks).repartition(*TASK).sortWithinPartitions(*TASK, "n", "id").mapInArrow(tidy(_search(self.least)), "u long, v long")

    def links(self, members: DataFrame | None = None) -> DataFrame:
        """Pairs (u, v) of ids whose components are those of all pairs that are ``least`` percent alike.

        ``members`` (rep, id, n, root): blocks, with what is joined already under one root.
        """
        members = self.members().withColumn("root", F.col("id")) if members is None else members
        large = materialize(members.groupBy("rep").agg(F.sum("n").alias("weight")).where(F.col("weight") > self.limit).select("rep"), "large-blocks")
        if large.isEmpty():
            return materialize(self._linked(members.select("id", "rep", *whole(), "root")), "links")
        near = _few(large)
        found = self._linked(members.join(near, "rep", "left_anti").select("id", "rep", *whole(), "root"))
        cut, close = self._cut(members.join(near, "rep", "left_semi").select("rep", "id", "root"))
        return materialize(found.unionByName(close).unionByName(self._linked(cut)), "links")

    def _cut(self, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The tasks of large blocks, and their links to the documents that name them."""
        reps = members.select(F.col("rep").alias("id")).distinct()
        named = materialize(self._sets(reps.select("id", F.col("id").alias("rep"), *whole(), F.col("id").alias("root"))).select("rep", F.col("shingles").alias("other")).dropDuplicates(["rep"]), "block-names")
        sets = self._sets(members.select("id", "rep", *whole(), "root")).select("rep", "id", "shingles", "root")
        banded = sets.join(_few(named, F.length("other") + 16), "rep").select("rep", "id", "shingles", "other", "root")
        banded = materialize(banded.mapInArrow(_bands(self.least), "rep long, id long, n long, band int, root long").distinct(), "bands")
        close = banded.where("band = 0 and rep <> id").select(F.col("rep").alias("u"), F.col("id").alias("v"))
        parts = banded.groupBy("rep", "band").agg(F.ceil(F.sum("n") / self.limit).cast("int").alias("parts"))
        parts = _few(materialize(parts, "band-parts"))  # at most a row for each ``limit`` shingles and band
        part = banded.join(parts, ["rep", "band"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        own = part.where("band > 0").withColumn("other", every)
        own = own.select("id", "rep", "band", F.least("part", "other").alias("i"), F.lit(False).alias("low"), F.greatest("part", "other").alias("j"), F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"), "root")
        # the parts of the band below and of that above, under the band's own number
        rest = part.drop("parts")
        upper = rest.join(parts.select("rep", (F.col("band") + 1).alias("band"), "parts"), ["rep", "band"]).withColumn("other", every)
        upper = upper.select("id", "rep", "band", F.col("part").alias("i"), F.lit(True).alias("low"), F.col("other").alias("j"), F.lit(0).alias("side"), "root")
        lower = rest.join(parts.select("rep", (F.col("band") - 1).alias("band"), "parts"), ["rep", "band"]).withColumn("other", every)
        lower = lower.select("id", "rep", (F.col("band") + 1).alias("band"), F.col("other").alias("i"), F.lit(True).alias("low"), F.col("part").alias("j"), F.lit(1).alias("side"), "root")
        return materialize(own.unionByName(upper).unionByName(lower), "band-tasks"), close


class StoredJoin(NgramJoin):
    """The search over ``sets`` (id, shingles) that are stored, of blocks that are given to links()."""

    def __init__(self, sets: DataFrame, *, least: int, limit: int = 2_000_000) -> None:
        self.sets, self.least, self.limit = sets, least, limit

    def _sets(self, tasks: DataFrame) -> DataFrame:
        ids = materialize(tasks.select("id").distinct(), "searched")
        held = self.sets.join(_few(ids, 16), "id", "left_semi").dropDuplicates(["id"])
        rows = held.join(_few(materialize(tasks, "search-tasks"), 60), "id")
        return rows.select(*TASK, "side", "root", (F.length("shingles") / 8).cast("long").alias("n"), "id", "shingles")


def ngram_report(docs: DataFrame, *, words: int = 3, least: int = 90, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``: component_id is the smallest doc_id that links reach."""
    join = NgramJoin(docs, words=words, least=least, **options)
    roots = components(join.links(), tag="ngram-components").withColumnRenamed("node", "id")
    rows = join.rows.select("doc_id", "row_key", "id", "n")
    lowest = rows.groupBy("id").agg(F.min("doc_id").alias("low"))
    named = materialize(lowest.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "ngram-roots")
    first = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = _few(materialize(named.join(first, "root").select("id", "component_id"), "ngram-names"))
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(named, "id").select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
