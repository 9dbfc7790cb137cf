"""Secret scans behind a trigram inverted index.

Each rule's regular expression is parsed with Python's own ``re`` parser and turned into a
Boolean query over trigrams that any match must contain (AND over a sequence, OR over
alternatives). Within a task, each few megabytes of documents get an inverted index
from the needed trigrams to documents; a rule's postings are intersected and united, and
the regular expression runs over those candidates only. Rules without mandatory
trigrams scan every document. Nothing is shuffled.

Trigrams are those of the lower-cased UTF-8 bytes, so that they hold for rules in either
case. Only ASCII letters fold.

Defined cases
- null or empty text: no spans.
- spans count code points, end exclusive; ties in start go by the order of rules.
- very long texts are indexed by themselves; memory is about ten times the longest text.
- extra columns are not read, whatever their names. An empty table gives an empty result.
- repeated rows and null ids are returned as they come.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, text_bytes

try:
    from re import _parser as sre  # Python 3.11 and later
except ImportError:
    import sre_parse as sre


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: The base kinds, whose spans always stay.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 20),
    Rule("hex", r"[0-9a-f]+", False, 0, 24),
)
#: Spans that the method adds.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9+/_.=-]{16,}", True),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"://[A-Za-z0-9._~-]+:[A-Za-z0-9._~!$&*+=%-]+@"),
)

# A query is None (anything matches), a trigram, ("and", queries) or ("or", queries).


def _join(kind: str, queries: list):
    queries = list(dict.fromkeys(queries))
    return queries[0] if len(queries) == 1 else (kind, tuple(queries))


def _both(a, b):
    if a is None or b is None:
        return b if a is None else a
    return _join("and", [a, b])


def _of_strings(strings: set[str]):
    """The query for one of ``strings``."""
    each = []
    for s in sorted(strings):
        grams = list(dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2)))
        if not grams:
            return None
        each.append(_join("and", grams))
    return _join("or", each) if each else None


_MOST = 64  # strings that a run of literals may stand for


def _analyse(items) -> tuple[set[str] | None, object]:
    """(the exact strings that ``items`` stands for or None, the query that holds anyway)."""
    run: set[str] | None = {""}
    exact, query = True, None

    def cut() -> None:
        nonlocal run, exact, query
        if run is not None:
            query = _both(query, _of_strings(run))
        run, exact = None, False

    def add(strings: set[str]) -> None:
        nonlocal run
        if run is None:
            run = {""}
        wider = {a + b for a in run for b in strings}
        if len(wider) > _MOST:
            cut()
            wider = set(strings)
        run = wider

    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            add({chr(value).lower()})
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value):
            add({chr(v).lower() for _, v in value})
        elif name in ("SUBPATTERN", "BRANCH"):
            branches = [value[3]] if name == "SUBPATTERN" else value[1]
            parts = [_analyse(b) for b in branches]
            if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= _MOST:
                add(set().union(*(s for s, _ in parts)))
            else:
                cut()
                each = [_both(q, _of_strings(s) if s is not None else None) for s, q in parts]
                if all(q is not None for q in each):
                    query = _both(query, _join("or", each))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = value
            strings, inner_query = _analyse(inner)
            if (low, high) == (0, 1) and strings is not None:
                add(strings | {""})
            elif low >= 1 and strings is not None and low * max(map(len, strings), default=0) <= 8:
                for _ in range(low):
                    add(strings)
                if high != low:
                    cut()
            else:
                cut()
                if low >= 1:
                    query = _both(query, _both(inner_query, _of_strings(strings) if strings is not None else None))
        elif name == "AT":
            continue
        else:
            cut()
    if exact:
        return run, query
    if run is not None:
        query = _both(query, _of_strings(run))
    return None, query


def trigram_query(pattern: str):
    """The Boolean trigram query of a regular expression; None if it has no mandatory trigram."""
    strings, query = _analyse(sre.parse(pattern))
    return _both(query, _of_strings(strings) if strings is not None else None)


def grams(query) -> set[str]:
    if query is None:
        return set()
    if isinstance(query, str):
        return {query}
    return set().union(*(grams(q) for q in query[1]))


def _code(gram: str) -> list[int]:
    raw = gram.lower().encode()
    return [raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2)]


class Scanner:
    """Rules with their queries. Made once per Python worker."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        # a non-ASCII trigram has more bytes; its first three stand for it
        self.codes = {g: _code(g)[0] for g in sorted(set().union(*(grams(q) for _, _, q in self.rules)))}
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[list(self.codes.values())] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def postings(self, column: pa.Array) -> dict[str, np.ndarray]:
        """From each wanted trigram to a mask over the documents of ``column``."""
        values, offsets = text_bytes(column)
        empty = np.zeros(len(column), bool)
        index = {g: empty for g in self.codes}
        if len(values) < 3:
            return index
        raw = self.lower[values]
        code = raw[:-2].astype(np.uint32) << 16
        code |= raw[1:-1].astype(np.uint32) << 8
        code |= raw[2:]
        hits = np.flatnonzero(self.wanted[code])
        docs = np.searchsorted(offsets, hits, "right") - 1
        inside = hits + 3 <= offsets[docs + 1]
        hits, docs = code[hits[inside]], docs[inside]
        for g, c in self.codes.items():
            index[g] = np.zeros(len(column), bool)
            index[g][docs[hits == c]] = True
        return index

    def candidates(self, query, index: dict[str, np.ndarray], n: int) -> np.ndarray:
        if query is None:
            return np.ones(n, bool)
        if isinstance(query, str):
            return index[query]
        each = [self.candidates(q, index, n) for q in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(each)

    def scan(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Per document the spans (start, number of the rule, end), sorted."""
        index, found = self.postings(column), [[] for _ in range(len(column))]
        for number, (rule, pattern, query) in enumerate(self.rules):
            # a long run of one class is found sooner with its least length in the pattern
            for at in np.flatnonzero(self.candidates(query, index, len(column))).tolist():
                text = column[at].as_py()
                if text:
                    found[at].extend((m.start(), number, m.end()) for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least)
        for spans in found:
            spans.sort()
        return found


def tightened(rule: Rule) -> Rule:
    """The same matches: a pattern that is one greedy class repeated takes its least length along."""
    if rule.group == 0 and rule.least and re.fullmatch(r"\[[^\]\\]+\]\+", rule.pattern):
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}", rule.ignore_case)
    return rule


def _render(spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    return ",".join(f"{kinds[n]}:{a}:{b}" for a, n, b in spans)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, *, base: int = len(BASE)) -> DataFrame:
    """(doc_id, counts array<long> per rule, base string, spans string).

    ``base`` holds the spans of the first ``base`` rules, ``spans`` those of all, each as
    kind:start:end joined by commas.
    """
    kinds = [r.kind for r in rules]
    rules = tuple(tightened(r) for r in rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for part in slices(batch, 1):
                found = scanner.scan(part.column(1))
                counts = [np.bincount([n for _, n, _ in s], minlength=len(kinds)).tolist() for s in found]
                first = [_render([x for x in s if x[1] < base], kinds) for s in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.list_(pa.int64())), pa.array(first, pa.string()), pa.array([_render(s, kinds) for s in found], pa.string())], names=["doc_id", "counts", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, counts array<long>, base string, spans string")


def secret_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    found = scan_secrets(docs)
    counts = [F.col("counts")[i].alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")


def spans_sha256(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
