"""Line deduplication over a corpus.

Lines are hashed where they lie; only (hash, document, position) rows move. They are
range-partitioned on (hash, document), so that a line found in a third of all documents
spreads over many partitions, and sorted within partitions by hash, document (largest
first) and position. Each partition is streamed once: the first document of a run of
equal hashes keeps its lines, later ones lose theirs. Runs that touch a partition's edge
go on in its neighbour; each partition has two such runs at most, so the table that
settles them has at most two rows per partition and can be broadcast. The result is a
zlib-compressed keep bitmap for each document that loses a line, instead of text.

To cut the texts, bitmaps are written and counted. While they are few they go to the texts
(``MOST_BROADCAST`` rows and ``MOST_BYTES`` bytes at most); more than that meet the
documents in a shuffle, in which the texts move once.

Defined cases
- null or empty text: one empty line, which is too short to count; dedup_lines() leaves a null text null.
- null doc_id: the row keeps all its lines and isn't counted among documents.
- several rows with one doc_id: they count as one document, each row has its own bitmap.
- the winner is the largest doc_id; repeated lines inside it all stay.
- extra columns pass through untouched, whatever their names.
- very long texts: whole; a task holds one text's lines at a time, and of a line's run the documents before ``min_docs``.
- an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import MOST_BROADCAST, MOST_BYTES, ddl_of, free_name, materialize, row_key, slices

SPACE = " \t\n\x0b\x0c\r"
LINES = "hi long, lo long, doc_id long, row_key long, pos int"
#: kind: 0 a line to drop, 1 a line whose run is open, 2 what a partition knows of an open run.
RUNS = "kind byte, hi long, lo long, doc_id long, row_key long, pos int, docs long"


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("pos", pa.int32())])
        for batch in (part for whole in batches for part in slices(whole, 2)):
            digests, docs, keys, places = [], [], [], []
            for doc, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if doc is None or not text:
                    continue
                for at, line in enumerate(text.split("\n")):
                    if len(line) >= min_chars and len(line := line.strip(SPACE)) >= min_chars:
                        digests.append(xxhash.xxh3_128_digest(line.encode().lower()))
                        docs.append(doc)
                        keys.append(key)
                        places.append(at)
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.int32())], schema=schema)

    return run


class _Out:
    """Rows of RUNS gathered until a batch is full."""

    schema = pa.schema([("kind", pa.int8()), ("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("pos", pa.int32()), ("docs", pa.int64())])

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def _stream_runs(min_docs: int):
    """Streams lines sorted by (hi, lo, doc_id descending, pos).

    Memory: the lines of fewer than ``min_docs`` documents of the current run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out()
        current = last_doc = top = None
        docs, first, waiting = 0, True, []

        def close(open_end: bool) -> None:
            if current is None:
                return
            if first or open_end:
                out.rows.append((2, *current, top, None, None, docs))
                if not first:  # with min_docs documents the lines were dropped already
                    out.rows.extend((1, *current, *x, None) for x in waiting)

        for batch in batches:
            for hi, lo, doc, key, pos in zip(*(c.to_pylist() for c in batch.columns)):
                if (hi, lo) != current:
                    close(False)
                    first = current is None
                    current, last_doc, top, docs, waiting = (hi, lo), None, doc, 0, []
                if doc != last_doc:
                    docs, last_doc = docs + 1, doc
                    if docs == min_docs and not first:
                        out.rows.extend((0, hi, lo, *x, None) for x in waiting if x[0] != top)
                        waiting = []
                if first:
                    out.rows.append((1, hi, lo, doc, key, pos, None))
                elif docs >= min_docs:
                    if doc != top:
                        out.rows.append((0, hi, lo, doc, key, pos, None))
                else:
                    waiting.append((doc, key, pos))
                if len(out.rows) >= 50_000:
                    yield out.take()
        close(True)
        yield out.take()

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dropped positions, sorted by row, to one compressed keep bitmap for each row.

    Bit i is 1 if line i stays; lines past the bitmap's end stay too.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("keep", pa.binary())])
    current, places = None, []
    rows: list[tuple] = []

    def close() -> None:
        if current is not None:
            keep = np.ones(places[-1] + 1, np.uint8)
            keep[places] = 0
            rows.append((*current, zlib.compress(np.packbits(keep).tobytes() + (len(keep) % 8).to_bytes(1, "big"), 1)))

    def take() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 3
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        for doc, key, pos in zip(*(c.to_pylist() for c in batch.columns)):
            if (doc, key) != current:
                close()
                current, places = (doc, key), []
            if not places or places[-1] != pos:
                places.append(pos)
        if len(rows) >= 10_000:
            yield take()
    close()
    yield take()


def unpack_keep(keep: bytes) -> np.ndarray:
    raw = zlib.decompress(keep)
    bits = np.unpackbits(np.frombuffer(raw[:-1], np.uint8))
    return bits[: len(bits) - (8 - raw[-1]) % 8]


def keep_bitmaps(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Rows (doc_id, row_key, keep) for the rows of ``docs`` that lose a line.

    ``docs`` needs doc_id and text; row_key is xxhash64(text) and tells apart rows
    that share a doc_id.
    """
    spark = docs.sparkSession
    lines = docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(_hash_lines(min_chars), LINES)
    lines = materialize(lines, "lines")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["hi", "lo", F.desc("doc_id")]
    runs = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order, "pos").mapInArrow(_stream_runs(min_docs), RUNS)
    runs = materialize(runs, "line-runs")
    # Two rows per partition at most, whatever the data: small enough to broadcast.
    settled = runs.where("kind = 2").groupBy("hi", "lo").agg(F.sum("docs").alias("n"), F.max("doc_id").alias("top")).where(F.col("n") >= min_docs)
    drops = runs.where("kind = 0").select("doc_id", "row_key", "pos").unionByName(runs.where("kind = 1").drop("docs").join(F.broadcast(settled), ["hi", "lo"]).where("doc_id <> top").select("doc_id", "row_key", "pos"))
    return drops.repartition("doc_id", "row_key").sortWithinPartitions("doc_id", "row_key", "pos").mapInArrow(_pack, "doc_id long, row_key long, keep binary")


def _kept(text: str | None, keep: bytes | None) -> tuple[int, int, str]:
    text = text or ""
    if keep is None:
        return text.count("\n") + 1, 0, text
    lines = text.split("\n")
    stays = unpack_keep(keep)
    return len(lines), int(len(stays) - stays.sum()), "\n".join(x for i, x in enumerate(lines) if i >= len(stays) or stays[i])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts ``text`` by the bitmap, which is the last column."""
    for batch in batches:
        for part in slices(batch, batch.schema.get_field_index("text")):
            texts = part.column("text").to_pylist()
            kept = [t if k is None else _kept(t, k)[2] for t, k in zip(texts, part.column(part.num_columns - 1).to_pylist())]
            columns = dict(zip(part.schema.names[:-1], part.columns[:-1]))
            yield pa.RecordBatch.from_pydict(columns | {"text": pa.array(kept, pa.string())})


def _with_keep(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Adds each row's bitmap as the last column, under a name that isn't taken. Many bitmaps are hashed, so that the texts needn't be sorted."""
    doc_id, key, keep = (free_name(docs, n) for n in ("__ld_doc_id", "__ld_row_key", "__ld_keep"))
    right = materialize(bitmaps.select(F.col("doc_id").alias(doc_id), F.col("row_key").alias(key), F.col("keep").alias(keep)), "line-bitmaps")
    size = right.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(keep) + 16), F.lit(0)).alias("bytes")).first()
    right = F.broadcast(right) if size["n"] <= MOST_BROADCAST and size["bytes"] <= MOST_BYTES else right.hint("shuffle_hash")
    return docs.join(right, (docs["doc_id"] == right[doc_id]) & (row_key(docs["text"]) == right[key]), "left").drop(doc_id, key)


def dedup_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``text`` cut to the lines that stay; other columns as they were.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of
    ``min_chars`` code points or more that are found in ``min_docs`` documents or more
    stay only in the largest doc_id that holds them.
    """
    marked = _with_keep(docs, keep_bitmaps(docs, min_chars=min_chars, min_docs=min_docs))
    return marked.mapInArrow(_apply, ddl_of(docs))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])
    for batch in (part for whole in batches for part in slices(whole, 1)):
        rows = []
        for doc, text, keep in zip(*(c.to_pylist() for c in batch.columns)):
            n, dropped, kept = _kept(text, keep)
            rows.append((doc, n, dropped, hashlib.sha256(kept.encode()).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 4, schema)], schema=schema)


def dedup_report(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = _with_keep(docs, keep_bitmaps(docs, min_chars=min_chars, min_docs=min_docs))
    return marked.mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
