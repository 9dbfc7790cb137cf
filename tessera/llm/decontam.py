"""Benchmark decontamination by BM25 retrieval with block-max WAND.

The inverted index is of the test items: per term the items that hold it in order of
threshold, cut into blocks with the largest score contribution of each. Every passage of every
training document is a query against it. Items are searched in classes of like length, each
with passages that overlap by half and are long enough for its longest item to lie whole inside
one of them, so that a long item doesn't widen the passages of short ones.

Items are ordered by threshold. For each block of items, the sum of its maxima over a
passage's terms bounds the score of any of its items; where it stays under the block's
lowest threshold, the block is skipped. These sums are made for all passages at once. The
blocks left run WAND: cursors over the terms' postings, a pivot where the summed maxima
reach the threshold, and only there a score. An item is retrieved if it scores ``share``
of the score that it has against itself. What is retrieved is verified: the question's and the
answer's word shingles must be found in the document, or those of the whole item. Of an
item of two parts, one under ten words may instead stand there with few words changed: one minus
its edit distance to the nearest run of the document's words, by its length, counts.

The index goes to every task, so its size is checked: benchmarks above ``most_words`` words
are cut into shards, each searched by a pass of its own whose leaks are written before the next.
Items and documents are cut into words by one function, so that frequencies hold for both.

Defined cases
- words are runs of word characters, lower-cased; punctuation and white space don't count.
- null or empty text, of either side: never a leak. Items without words are left out.
- an item's last sentence is its answer and the rest its question; an item of one sentence
  is all question.
- items shorter than a shingle: the whole sequence is the one shingle.
- repeated items or documents: each pair is reported once per row of documents and item_id.
- null doc_id or item_id: reported with the null. drop_contaminated() decides row by row, also
  where rows share an id or have none.
- very long texts are searched in whole; extra columns are not read.
- ties: every item above its bound is reported, so equal scores need no order.
- an empty table, of either side, gives an empty result; drop_contaminated() then keeps all.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, row_key, slices, tidy, without

WORD = re.compile(r"\w+")
LEAST_BLOCK, MOST_BLOCKS = 8, 64
K1, B = 1.2, 0.75
#: A part of fewer words may be found by alignment, as one edit takes most or all of its shingles.
SHORT = 10


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(tokens: list[str], size: int) -> list[tuple[str, ...]]:
    return [tuple(tokens[i : i + size]) for i in range(max(1, len(tokens) - size + 1))] if tokens else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last, and of the last one."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if WORD.search(p)]
    if len(parts) < 2:
        return words(text), []
    return words(" ".join(parts[:-1])), words(parts[-1])


def aligned(part: list[str], tokens: list[str]) -> float:
    """One minus the edit distance of ``part`` to the nearest run of ``tokens``, by the length of ``part``.

    Bit-parallel over the words of ``part``, one step for each token.
    """
    m = len(part)
    masks: dict[str, int] = {}
    for i, w in enumerate(part):
        masks[w] = masks.get(w, 0) | 1 << i
    every, last = (1 << m) - 1, 1 << (m - 1)
    up, down, distance, best = every, 0, m, m
    for w in tokens:
        same = masks.get(w, 0)
        across = (((same & up) + up) ^ up) | same | down
        more, less = down | (~(across | up) & every), up & across
        distance += bool(more & last) - bool(less & last)
        best = min(best, distance)
        more, less = more << 1 & every, less << 1 & every  # a run may begin anywhere
        up, down = less | (~(same | down | more) & every), more & (same | down)
    return 1 - best / m


@dataclass
class Index:
    """Postings of one shard of items, ordered by threshold; item numbers are positions in ``items``."""

    items: list[tuple[int | None, set, set, set, list[str], list[str]]]  # item_id, shingles of question, answer and whole, words of question and answer
    thresholds: list[float]
    vocabulary: dict[str, int]
    postings: list[list[int]]  # item numbers, ascending
    scores: list[list[float]]
    block: int  # items in a block
    block_max: np.ndarray  # terms (and one more for other words) x blocks
    block_floor: np.ndarray  # the lowest threshold of each block
    longest: int

    def search(self, terms: list[int], blocks: list[int]) -> list[tuple[int, float]]:
        """Items of ``blocks`` whose score reaches their threshold, by WAND inside each block.

        ``blocks`` are those whose maxima let them pass. Cursors stand in the terms' postings;
        the pivot is the first item at which the summed block maxima reach the block's floor.
        """
        found = []
        for block in blocks:
            first, end, least = block * self.block, (block + 1) * self.block, float(self.block_floor[block])
            maxima = self.block_max[terms, block].tolist()
            cursors = []
            for term, most in zip(terms, maxima):
                if most:
                    posting = self.postings[term]
                    at = bisect_left(posting, first)
                    cursors.append([posting[at], at, term, most])
            while cursors:
                cursors.sort()
                bound = 0.0
                for pivot, _, _, most in cursors:
                    bound += most
                    if bound >= least:
                        break
                else:
                    break
                if cursors[0][0] == pivot:
                    score = sum(self.scores[t][at] for item, at, t, _ in cursors if item == pivot)
                    if score >= self.thresholds[pivot]:
                        found.append((pivot, score))
                    target = pivot + 1
                else:
                    target = pivot
                moved = []
                for cursor in cursors:
                    if cursor[0] < target:
                        posting = self.postings[cursor[2]]
                        cursor[1] = bisect_left(posting, target, cursor[1])
                        if cursor[1] == len(posting) or posting[cursor[1]] >= end:
                            continue
                        cursor[0] = posting[cursor[1]]
                    moved.append(cursor)
                cursors = moved
        return found


def build_index(items: list[tuple[int | None, str]], stats: tuple[int, float], frequency: dict[str, int], share: float, shingle: int) -> Index:
    """An index of ``items``. ``stats``: number of items and mean length; both and the
    document frequencies are of the whole benchmark, whatever the shard."""
    n, mean = stats
    weighed = []
    for item, text in items:
        tokens = words(text)
        weights = {}
        for w, tf in Counter(tokens).items():
            idf = math.log(1 + (n - frequency[w] + 0.5) / (frequency[w] + 0.5))
            weights[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(tokens) / mean))
        weighed.append((share * sum(weights.values()) * (1 - 1e-9), item, text, len(tokens), weights))
    weighed.sort(key=lambda x: x[0])  # blocks of like thresholds
    rows, vocabulary, postings, scores = [], {}, [], []
    for number, (_, item, text, _, weights) in enumerate(weighed):
        question, answer = question_and_answer(text)
        rows.append((item, set(shingles(question, shingle)), set(shingles(answer, shingle)), set(shingles(words(text), shingle)), question, answer))
        for w, weight in sorted(weights.items()):
            term = vocabulary.setdefault(w, len(vocabulary))
            if term == len(postings):
                postings.append([])
                scores.append([])
            postings[term].append(number)
            scores[term].append(weight)
    block = max(LEAST_BLOCK, -(-len(items) // MOST_BLOCKS))
    thresholds = [x[0] for x in weighed]
    floors = np.array(thresholds[::block])
    block_max = np.zeros((len(postings) + 1, len(floors)), np.float32)
    for term, (ids, weights) in enumerate(zip(postings, scores)):
        np.maximum.at(block_max[term], np.array(ids) // block, np.array(weights, np.float32) * np.float32(1 + 1e-6))
    return Index(rows, thresholds, vocabulary, postings, scores, block, block_max, floors, max(x[3] for x in weighed))


def classes(items: list[tuple[int | None, str]]) -> list[list[tuple[int | None, str]]]:
    """Items in classes whose longest has less than four times the words of the shortest."""
    found: dict[int, list] = {}
    for item in items:
        found.setdefault((len(words(item[1])).bit_length() - 1) // 2, []).append(item)
    return [found[k] for k in sorted(found)]


FOUND = "doc_id long, row_key long, item_id long, score double, question_overlap double, answer_overlap double, start_word long"


def _leaks(indexes: list[Index], least: float, shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("start_word", pa.int64())])
    everything: dict[str, int] = {}
    for index in indexes:
        for w in index.vocabulary:
            everything.setdefault(w, len(everything))
    own_terms = []  # of each index, by number in everything; the last one stands for other words
    for index in indexes:
        terms = np.full(len(everything) + 1, len(index.block_max) - 1)
        terms[[everything[w] for w in index.vocabulary]] = list(index.vocabulary.values())
        own_terms.append(terms)

    def overlap(own: set, there: set) -> float:
        return len(own & there) / len(own) if own else 1.0

    def search(index: Index, ids: np.ndarray, part: np.ndarray, parts: int) -> Iterator[tuple[int, int, float]]:
        """(first part of the passage, item, score) over words whose parts are numbered."""
        other = len(index.block_max) - 1
        pairs = np.unique(part[ids != other] * (other + 1) + ids[ids != other])  # distinct words of each part
        own, terms = pairs // (other + 1), pairs % (other + 1)
        edges = np.searchsorted(own, np.arange(parts + 1))
        bound = np.zeros((parts, index.block_max.shape[1]), np.float32)
        held = np.flatnonzero(np.diff(edges))
        if len(held):
            bound[held] = np.add.reduceat(index.block_max[terms], edges[held], axis=0)
        bound[:-1] += bound[1:]
        passed = bound >= index.block_floor
        for at in np.flatnonzero(passed.any(axis=1)).tolist():
            distinct = np.unique(terms[edges[at] : edges[min(at + 2, parts)]])
            blocks = np.flatnonzero(passed[at])
            # the exact maxima over distinct words
            blocks = blocks[index.block_max[distinct][:, blocks].sum(axis=0) >= index.block_floor[blocks]]
            if len(blocks):
                for item, score in index.search(distinct.tolist(), blocks.tolist()):
                    yield at, item, score

    def of_texts(docs: list, keys: list, texts: list[str]) -> list[tuple]:
        get, other = everything.get, len(everything)
        ids, lengths = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            tokens = words(text)
            ids.append(np.fromiter((get(w, other) for w in tokens), np.int64, len(tokens)))
            lengths[i] = len(tokens)
        ids = np.concatenate(ids)
        start = np.cumsum(lengths) - lengths
        best: dict[tuple[int, int, int], tuple[float, int]] = {}
        for which, (index, terms) in enumerate(zip(indexes, own_terms)):
            size = index.longest  # a passage is two neighbouring parts of so many words
            first = np.concatenate([[0], np.cumsum(-(-lengths // size) + 1)])  # an empty part keeps documents apart
            part = np.repeat(first[:-1], lengths) + (np.arange(len(ids)) - np.repeat(start, lengths)) // size
            for at, item, score in search(index, terms[ids], part, int(first[-1])):
                doc = int(np.searchsorted(first, at, "right")) - 1
                if score > best.get((doc, which, item), (-1.0,))[0]:
                    best[doc, which, item] = (score, max(0, at - int(first[doc])) * size)
        rows, whole_of, whole, tokens = [], None, set(), []
        for (doc, which, item), (score, begin) in sorted(best.items()):
            if doc != whole_of:
                tokens = words(texts[doc])
                whole_of, whole = doc, set(shingles(tokens, shingle))
            name, question, answer, both, *parts = indexes[which].items[item]
            q, r = _contained(question, whole, tokens, shingle), _contained(answer, whole, tokens, shingle)
            found = q >= least and r >= least or _contained(both, whole, tokens, shingle) >= least
            if not found and all(parts):
                q, r = (max(o, aligned(p, tokens)) if o < least and len(p) < SHORT else o for o, p in zip((q, r), parts))
                found = q >= least and r >= least
            if found:
                rows.append((docs[doc], keys[doc], name, score, q, r, begin))
        return rows

    def _contained(own: set, whole: set, tokens: list[str], size: int) -> float:
        short = next((s for s in own if len(s) < size), None)
        if short is None:
            return overlap(own, whole)
        return float(short in set(shingles(tokens, len(short))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch, 2, 1 << 20):
                held = [r for r in zip(*(c.to_pylist() for c in few.columns)) if r[2]]
                rows = of_texts(*map(list, zip(*held))) if held else []
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 7, schema)], schema=schema)

    return run


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [words(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=["item_id", "text", "w"])


def _found(docs: DataFrame, benchmark: DataFrame, share: float, least: float, shingle: int, most_words: int) -> DataFrame:
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_with_words, "item_id long, text string, w array<string>").where(F.size("w") > 0)
    items = materialize(items, "benchmark-words")
    total = items.agg(F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("words"), F.count("*").alias("n")).first()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")
    if not total["n"]:
        return spark.createDataFrame([], FOUND)
    shards = max(1, math.ceil(total["words"] / most_words))
    numbered = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    frequency = items.select(F.explode(F.array_distinct("w")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    if shards > 1:
        frequency = materialize(frequency, "benchmark-frequencies")
    found = None
    for shard in range(shards):
        part = numbered.where(F.col("shard") == shard)
        held = sorted(((r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if not held:
            continue
        known = {r["w"]: r["df"] for r in part.select(F.explode("w").alias("w")).distinct().join(frequency, "w").collect()}
        indexes = [build_index(few, (total["n"], total["words"] / total["n"]), known, share, shingle) for few in classes(held)]
        leaks = rows.mapInArrow(tidy(_leaks(indexes, least, shingle)), FOUND)
        if shards > 1:
            leaks = materialize(leaks, "leaks")
        found = leaks if found is None else found.unionByName(leaks)
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, share: float = 0.6, least: float = 0.8, shingle: int = 5, most_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, start_word), a row per leak.

    ``share``: of an item's score against itself, for retrieval. ``least``: of its question's
    and its answer's shingles, or of the whole item's, for verification. ``most_words``: of a shard of the index,
    which a task holds in memory.
    """
    return _found(docs, benchmark, share, least, shingle, most_words).drop("row_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, share: float = 0.6, least: float = 0.8, shingle: int = 5, most_words: int = 2_000_000) -> DataFrame:
    """``docs`` without those that hold a benchmark item."""
    return without(docs, _found(docs, benchmark, share, least, shingle, most_words).select("doc_id", "row_key"))
