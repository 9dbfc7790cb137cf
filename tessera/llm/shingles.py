"""Word shingles and their sets as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42


def shingles(text: str | None, words: int = 5) -> tuple[int, np.ndarray]:
    """A hash of the text's words, as a signed long, and the unsigned hashes of its shingles in their order, repeats included."""
    found = (text or "").encode().lower().split()
    joined = b" ".join(found)
    hashed = xxhash.xxh64_intdigest
    if len(found) <= words:
        hashes = np.array([hashed(joined, SEED)] if found else [], np.uint64)
    else:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: 1 - words].tolist()
        hashes = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64)
    return int(np.array([xxhash.xxh3_64_intdigest(joined, SEED)], np.uint64).view(np.int64)[0]), hashes


def shingle_set(text: str | None, words: int = 5) -> tuple[int, np.ndarray]:
    """A hash of the text's words and the ascending distinct hashes of its shingles, as signed longs."""
    own, hashes = shingles(text, words)
    return own, np.unique(hashes.view(np.int64))
