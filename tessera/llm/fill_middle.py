"""Fill-in-the-middle transformation of whole texts by big-integer bit-parallelism.

``bytes.translate`` turns a text's UTF-8 bytes into a string of class digits, which is read as one
integer with a bit for each byte: 1 for a byte that isn't ASCII white space. A token is white space
with the word after it, or the white space at the end, so its last byte is found by a shift and two
boolean operations over all bytes at once, ``bit_count`` gives the number of tokens, and the byte at
which the k-th token ends is selected by halving the integer. The bytes that mark boundaries are
ASCII or the last of a character, so no character is cut.

Cuts are drawn from a digest of seed and doc_id: they don't depend on partitions, retries or other
rows. Texts are changed where they lie; nothing is shuffled. The text comes back from output and
form with built-in functions alone (``restored``).

Defined cases
- null or empty text: form plain, output empty, no tokens. A null stays the empty string.
- null doc_id: the digest is that of the seed and an empty id.
- a text that holds one of the markers: form plain, as it couldn't be taken apart.
- repeated rows, and rows that share a doc_id: each is transformed, with the same cuts in as many tokens.
- very long texts: whole; integers take an eighth of the text's bytes, digits as many as the text.
- ties: equal draws give an empty middle.
- an empty table gives an empty result.
- extra columns pass through ``transform`` untouched; it adds ``fim_n``, ``fim_form``, ``fim_prefix``,
  ``fim_middle`` and ``fim_output``, with underscores after a name that is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ddl_of, free_name, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SPACE = b" \t\n\x0b\x0c\r"
#: The digit of each byte: 0 for ASCII white space.
_CLASS = bytes(ord("0") if b in SPACE else ord("1") for b in range(256))


def token_ends(raw: bytes) -> int:
    """Bit i is 1 if a token ends with byte i."""
    if not raw:
        return 0
    word = int(raw.translate(_CLASS)[::-1], 2)  # the first byte is the lowest bit
    ends = word & ~(word >> 1)
    return ends if raw[-1] not in SPACE else ends | 1 << len(raw) - 1


def select_bit(bits: int, rank: int, width: int) -> int:
    """The position of the ``rank``-th one (from 1) of ``bits``, which has at most ``width`` bits.

    Each step counts the lower half and goes on in one half, so all steps together are linear.
    """
    at = 0
    while width > 1:
        half = width // 2
        low = bits & ((1 << half) - 1)
        here = low.bit_count()
        if rank <= here:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - here, at + half, width - half
    return at


class Cut(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits from the digest of seed and doc_id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(doc_id: int | None, text: str | None, *, seed: int = 42, rate: int = 50, spm: int = 80) -> Cut:
    """``text`` in its form: ``rate`` percent are cut, ``spm`` percent of them with the suffix first."""
    text = text or ""
    raw = text.encode()
    ends = token_ends(raw)
    n = ends.bit_count()
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return Cut(n, PLAIN, None, None, text)
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (select_bit(ends, k, len(raw)) + 1 if k else 0 for k in (first, last))
    prefix, middle, suffix = raw[:a].decode(), raw[a:b].decode(), raw[b:].decode()
    if h4 % 100 < spm:
        return Cut(n, SPM, len(prefix), len(middle), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    return Cut(n, PSM, len(prefix), len(middle), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")


ADDED = {"fim_n": "long", "fim_form": "string", "fim_prefix": "long", "fim_middle": "long", "fim_output": "string"}


def transform(docs: DataFrame, *, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``docs`` (doc_id, text and any others) with the columns of ``ADDED``."""
    names = {n: free_name(docs, n) for n in ADDED}
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, key = (batch.schema.get_field_index(c) for c in ("text", "doc_id"))
            for part in slices(batch, text):
                found = [cut(i.as_py(), t.as_py(), seed=seed, rate=rate, spm=spm) for i, t in zip(part.column(key), part.column(text))]
                added = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, *names.values()])

    return docs.mapInArrow(run, ", ".join([ddl_of(docs), *(f"{names[n]} {kind}" for n, kind in ADDED.items())]))


def restored(output: Column | str = "fim_output", form: Column | str = "fim_form") -> Column:
    """The text from its output and form. A text with a marker is plain, so each marker stands once."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def between(first: str, then: str) -> Column:
        return F.substring_index(F.substring_index(output, then, 1), first, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def middle_report(docs: DataFrame, *, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) for each row."""
    made = transform(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), seed=seed, rate=rate, spm=spm).drop("text")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id",
        F.col("fim_n").alias("n"),
        F.col("fim_form").alias("form"),
        F.col("fim_prefix").alias("prefix_chars"),
        F.col("fim_middle").alias("middle_chars"),
        digest(F.col("fim_output")).alias("output_sha256"),
        digest(restored()).alias("restored_sha256"),
    )
