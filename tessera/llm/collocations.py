"""Phrase collocations by suffix sorting (the Suffix-sigma method).

Every word starts a suffix, cut off after ``max_n`` words or at the end of its piece. Suffixes are
counted where the texts lie and move as (key, n), the key being language, first word and the words after
it. They are dealt out by ranges of keys, whose bounds come from a sample, and sorted in descending
order. So a first word's suffixes lie together, but one that holds a third of all rows, or a pair that does, spreads over many partitions.
Each partition is streamed once with one stack of a language and at most ``max_n`` words: a word that leaves the
stack gives the count of the phrase down to it. Only the phrases of a partition's first and last
suffix may go on in its neighbours; their partial counts are added up, some ``2 * max_n`` rows a partition.

Phrases under ``min_count`` end there: the parts of a phrase are at least as frequent as itself. What
is left joins its parts (one row a phrase, so that hot words are on one side only, which AQE splits),
is scored with exact decimals, and meets the phrases that contain it. The first ``top`` of each
language come from the first of each of its salted parts.

Defined cases
- null or empty text, or one without words: no phrases. A null lang is ``und``, as is that name itself.
- doc_id isn't read: repeated rows, and rows that share an id, count each.
- very long texts: whole, about ``CHUNK`` bytes at a time with the last words carried over.
- ties: see ``collocations``.
- an empty table gives an empty result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import MOST_BROADCAST, MOST_BYTES, materialize

#: Piece ends become one sign, tabs become spaces; A-Z are lower-cased. No other byte is touched.
_FOLD = bytes(10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
END = b"\n"
SEP = b"\x00"
CHUNK = 1 << 20
#: Words that a task holds before it passes their suffixes on, and sorted rows that it takes at once.
HELD, ROWS = 500_000, 1 << 16
SALTS = 32


def word_names(max_n: int) -> list[str]:
    return [f"w{i}" for i in range(1, max_n + 1)]


def word_runs(text: str, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """The words of ``text`` with END between pieces, in lists of about ``chunk`` bytes of text."""
    raw = text.encode().translate(_FOLD)
    at = 0
    while at < len(raw):
        end = at + chunk
        if end < len(raw):
            end = min((p for p in (raw.find(b" ", end), raw.find(END, end)) if p >= 0), default=len(raw))
        yield [w for w in raw[at:end].replace(END, b" \n ").split(b" ") if w]
        at = end


def escaped(word: bytes) -> bytes:
    """Without the byte that parts words in a key, which sorts before all that stay."""
    return word.replace(b"\x01", b"\x01\x02").replace(SEP, b"\x01\x01")


def plain(word: str) -> str:
    return word.replace("\x01\x01", "\x00").replace("\x01\x02", "\x01")


def counted_suffixes(lang: str, words: list[bytes], max_n: int, starts: int) -> tuple[pa.Array, np.ndarray]:
    """The distinct suffixes of at most ``max_n`` words that begin in the first ``starts`` of ``words``,
    as ascending keys (the language and the words with SEP between), and their counts. A suffix ends before END.
    """
    coded = pa.array([END, *words, *[END] * max_n], pa.binary()).dictionary_encode()
    names = coded.dictionary.to_pylist()
    if any(SEP in w or b"\x01" in w for w in names):
        names = list(map(escaped, names))
    order = sorted(range(1, len(names)), key=names.__getitem__)  # END stays 0
    place = np.zeros(len(names), np.int64)
    place[order] = np.arange(1, len(names))
    names = pa.array(["", *(names[k].decode() for k in order)], pa.string())
    codes = place[coded.indices.to_numpy()[1:]]
    columns = [codes[:starts]]
    for k in range(1, max_n):
        columns.append(np.where(columns[-1] == 0, 0, codes[k : k + starts]))
    if len(names) ** max_n < 1 << 62:
        key = columns[0]
        for c in columns[1:]:
            key = key * len(names) + c
        key, counts = np.unique(key, return_counts=True)
        columns = [key // len(names) ** k % len(names) for k in range(max_n - 1, -1, -1)]
    else:
        rows, counts = np.unique(np.column_stack(columns), axis=0, return_counts=True)
        columns = list(rows.T)
    begun = columns[0] != 0
    parts = [names.take(pa.array(c[begun], mask=c[begun] == 0)) for c in columns]
    keys = pc.binary_join_element_wise(escaped(lang.encode()).decode(), *parts, SEP.decode(), null_handling="skip")
    return keys, counts[begun]


def _suffixes(max_n: int, held: int, bounds: list[str]):
    """Rows (part, key, n) from (lang, text), counted over about ``held`` words at a time.

    ``part`` is the number of ``bounds`` (which ascend) that aren't above the key.
    """
    bounds = [b.encode() for b in bounds]

    def take(lang: str, words: list[bytes], starts: int) -> Iterator[pa.RecordBatch]:
        keys, counts = counted_suffixes(lang, words, max_n, starts)
        raw = keys.cast(pa.binary()).to_pylist()
        cuts = [bisect_left(raw, b) for b in bounds]
        parts = np.repeat(np.arange(len(bounds) + 1, dtype=np.int32), np.diff([0, *cuts, len(keys)]))
        whole = pa.RecordBatch.from_arrays([pa.array(parts), keys, pa.array(counts, pa.int64())], names=["part", "key", "n"])
        for at in range(0, len(keys), ROWS):
            yield whole.slice(at, ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = words.setdefault(lang, [])
                for part in word_runs(text.as_py() or ""):
                    own += part
                    size += len(part)
                    if size >= held:
                        for name, found in words.items():  # the last words of this text may go on
                            starts = max(0, len(found) - max_n + 1) if found is own else len(found)
                            yield from take(name, found, starts)
                            del found[:starts]
                        size = len(own)
                own.append(END)
        for name, found in words.items():
            yield from take(name, found, len(found))

    return run


class Stack:
    """The language and words of the current suffix with the counts of the phrases down to each.

    Rows come in descending order, many at once: a phrase that begins and ends inside them is a
    run of equal prefixes, whose count is a difference of cumulative sums; phrases of the last
    row stay on the stack, and those of the next first row that continue them take their counts.
    """

    def __init__(self, max_n: int, min_count: int) -> None:
        self.depth, self.min_count = max_n + 1, min_count
        self.path: list[str] = []
        self.counts: list[int] = []
        self.edge: int | None = None  # how much of the stack is of the partition's first suffix

    def rows(self, keys: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Takes suffixes in descending order of their keys; gives (path, n, open) of what has ended."""
        many = len(keys)
        parted = pc.split_pattern(keys, SEP.decode())
        coded = parted.flatten().dictionary_encode()
        names, flat = coded.dictionary, coded.indices.to_numpy()
        if pc.any(pc.match_substring(names, "\x01")).as_py():
            names = pa.array([plain(w) for w in names.to_pylist()], pa.string())
        begin = parted.offsets.to_numpy() - parted.offsets[0].as_py()
        length = np.diff(begin)
        columns = [np.where(length > k, flat[np.minimum(begin[:-1] + k, len(flat) - 1)], -1) for k in range(self.depth)]
        sums = np.concatenate([[0], np.cumsum(n)])
        first, last = ([names[int(c[at])].as_py() if c[at] >= 0 else None for c in columns] for at in (0, -1))
        same = 0
        while same < len(self.path) and self.path[same] == first[same]:
            same += 1
        yield from self.pop(same)
        carried, edge = self.counts, self.depth if self.edge is None else self.edge
        path, counts = [], []
        changed = np.zeros(many, bool)
        changed[0] = True
        for level, codes in enumerate(columns):
            changed[1:] |= codes[1:] != codes[:-1]
            at = np.flatnonzero(changed)
            total = sums[np.r_[at[1:], many]] - sums[at]
            if level < same:
                total[0] += carried[level]
            ended = codes[at] >= 0
            if last[level] is not None:
                path.append(last[level])
                counts.append(int(total[-1]))
                ended[-1] = False
            opened = np.zeros(len(at), bool)
            opened[0] = level < edge  # may have begun in the partition before
            kept = ended & (opened | (total >= self.min_count) | (level == 0))
            if kept.any():
                yield self.batch(names, [c[at[kept]] for c in columns[: level + 1]], total[kept], opened[kept])
        # rows are sorted: where the ends have equal words, so have all rows between
        held = 0
        while held < min(edge, len(path)) and first[held] == last[held]:
            held += 1
        self.edge, self.path, self.counts = held, path, counts

    def pop(self, depth: int, last: bool = False) -> Iterator[pa.RecordBatch]:
        """Takes from the stack what lies over ``depth``; at a partition's end all of it may go on in the next."""
        out = []
        while len(self.path) > depth:
            size, n = len(self.path), self.counts.pop()
            if last or size <= (self.edge or 0):
                out.append((self.path[:], n, True))
            elif n >= self.min_count or size == 1:
                out.append((self.path[:], n, False))
            self.path.pop()
        if self.edge is not None:
            self.edge = min(self.edge, depth)
        if out:
            kinds = (pa.list_(pa.string()), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["path", "n", "open"])

    @staticmethod
    def batch(names: pa.Array, codes: list[np.ndarray], n: np.ndarray, opened: np.ndarray) -> pa.RecordBatch:
        flat = names.take(pa.array(np.column_stack(codes).ravel()))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(codes), dtype=np.int32)), flat)
        return pa.RecordBatch.from_arrays([lists, pa.array(n, pa.int64()), pa.array(opened)], names=["path", "n", "open"])


def _stack(max_n: int, min_count: int, rows: int = ROWS):
    """Streams suffixes in descending order; rows (path, n, open) of languages, and of phrases that are ``min_count`` frequent or open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, held, size = Stack(max_n, min_count), [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= rows:
                yield from stack.rows(*joined(held))
                held, size = [], 0
        if size:
            yield from stack.rows(*joined(held))
        yield from stack.pop(0, last=True)

    def joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray]:
        return tuple(c.combine_chunks() for c in pa.Table.from_batches(held).columns)

    return run


def phrase_counts(docs: DataFrame, *, max_n: int = 3, min_count: int = 10, held: int = HELD, sample: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(lang, words, f) of the phrases of at most ``max_n`` words that occur ``min_count`` times, and (lang, n) of all words.

    Keys of about ``sample`` documents, at most 50 for each partition, say where partitions begin; they
    decide on work only.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    schema = "part int, key string, n long"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, sample / max(1, rows.count()))
    some = rows.sample(share, seed=42).mapInArrow(_suffixes(max_n, held, []), schema)
    some = sorted((r["key"] for r in some.select("key").orderBy(F.rand(42)).limit(50 * parts).collect()), key=str.encode)
    bounds = sorted({some[len(some) * k // parts] for k in range(1, parts)}, key=str.encode) if some else []
    found = rows.mapInArrow(_suffixes(max_n, held, bounds), schema).repartitionById(parts, "part").select("key", "n").sortWithinPartitions(F.desc("key"))
    counted = materialize(found.mapInArrow(_stack(max_n, min_count), "path array<string>, n long, open boolean"), "phrase-counts")
    edges = counted.where("open").groupBy("path").agg(F.sum("n").alias("n"))
    whole = counted.where("not open").select("path", "n").unionByName(edges)
    phrase = whole.where((F.size("path") > 1) & (F.col("n") >= min_count))
    phrase = phrase.select(F.get("path", F.lit(0)).alias("lang"), F.slice("path", F.lit(2), F.size("path") - 1).alias("words"), F.col("n").alias("f"))
    return phrase, whole.where(F.size("path") == 1).groupBy(F.get("path", F.lit(0)).alias("lang")).agg(F.sum("n").alias("n"))


def _small(frame: DataFrame, tag: str) -> DataFrame:
    """``frame`` written, and broadcast if a count shows that it is small."""
    frame = materialize(frame, tag)
    size = frame.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.concat_ws(" ", "words")) + 40), F.lit(0)).alias("bytes")).first()
    return F.broadcast(frame) if size["n"] <= MOST_BROADCAST and size["bytes"] <= MOST_BYTES else frame


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def score_cuts(counts: DataFrame) -> DataFrame:
    """(lang, words, a, score, l, r) of the phrases in ``counts`` (lang, words, f), each at its lowest-scoring cut."""
    phrases = counts.where(F.size("words") > 1).select("lang", "words", F.col("f").alias("a"))
    # a row for each cut, which fetches the counts of both parts
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("first"), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("words").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("words").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("above", F.lit(1_000_000).cast("decimal(7,0)") * (_exact("a") * _exact("a")).cast("decimal(31,0)")).withColumn("below", (_exact("l") * _exact("r")).cast("decimal(38,0)"))
    cuts = cuts.select("lang", "words", "a", F.struct(F.expr("above div below").alias("score"), "k", "l", "r").alias("cut"))
    return cuts.groupBy("lang", "words", "a").agg(F.min("cut").alias("cut")).select("lang", "words", "a", "cut.score", "cut.l", "cut.r")


def collocations(docs: DataFrame, *, max_n: int = 3, min_count: int = 10, cover: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the phrases of 2 to ``max_n`` words.

    a is the phrase's count, l and r those of the parts at its lowest-scoring cut (ties to the shortest
    first part), n the words of the language, score floor(1000000 * a * a / (l * r)), which is at most a
    million as no part is rarer than the phrase. Phrases go whose words lie inside a longer one that
    occurs at least ``cover`` percent as often. Ranks are by score, then a, both descending, then phrase.
    a * a * 1000000 has to fit 38 digits: a up to 10^16.
    """
    counts, totals = phrase_counts(docs, max_n=max_n, min_count=min_count)
    counts = _small(counts, "frequent-phrases")
    phrases = counts.where(F.size("words") > 1).select("lang", "words", F.col("f").alias("a"))
    scored = score_cuts(counts)

    # the parts of two words or more inside each phrase, with the phrase's count
    inside = phrases.where(F.size("words") > 2).withColumn("size", F.explode(F.sequence(F.lit(2), F.size("words") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)))
    inside = inside.select("lang", F.slice("words", F.col("at"), F.col("size")).alias("words"), "a").groupBy("lang", "words").agg(F.max("a").alias("longer"))
    covered = F.coalesce(F.lit(100) * _exact("longer") >= F.lit(cover) * _exact("a"), F.lit(False))
    kept = scored.join(inside, ["lang", "words"], "left").where(~covered)
    kept = kept.select("lang", F.concat_ws(" ", "words").alias("phrase"), "a", "l", "r", "score")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    # a language may hold most phrases: the first of each of its parts meet
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.join(F.broadcast(totals), "lang")  # a row a language
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
