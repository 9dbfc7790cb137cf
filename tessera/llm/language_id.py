"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior per row: the text's likelihood under
byte-trigram models, the language that the markup or a metadata field declares, the
suffix of the address, and a prior of the host (or source) smoothed towards its domain,
its suffix and the whole corpus. A further hypothesis, "und" (undetermined), spreads its
likelihood evenly over all trigrams; it wins for symbol strings and noise.

Trigram models are naive Bayes models of every declared language, however rare, each fitted
on ``sample`` of its rows, those with the smallest hashes: the only bounded sample here, and a
parameter. The confusion of declared and text languages and the counts per host, domain and
suffix are grouped aggregates over all rows; a row's own vote is taken out of its host's prior.
Web data declares hundreds of languages, so no table has a number for each of them in each row, host or declaration:
counts are kept for what occurs, and texts are scored again for the posterior instead of keeping their scores.

Defined cases
- null, empty or letterless text: "und". Text too short for a trigram: the other evidence decides.
- no declared language: the evidence class "other".
- null host: the empty host. Null ids and repeated rows are returned each, and never in a
  language's sample without an id.
- very long texts are read in whole, some megabytes of them at a time.
- ties go to the alphabetically first language.
- an empty table gives an empty result.
- extra columns pass through filter_language() untouched, whatever their names; it decides
  row by row, also where rows share an id or have none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import MOST_BROADCAST, MOST_BYTES, materialize, row_key, slices, text_bytes, without

UND = "und"
#: Log-likelihood of any language for a text without letters.
NOTHING = -50.0
BUCKETS = 1 << 14
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(9, 14), *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32  # signs are gaps


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_WORD = _LETTER.copy()
_WORD[32] = True


def letter_trigrams(values: np.ndarray) -> np.ndarray:
    """Which trigrams count: letters and spaces only, one letter at least. Digits and signs say nothing."""
    raw = _FOLD[values]
    word, letter = _WORD[raw], _LETTER[raw]
    return word[:-2] & word[1:-1] & word[2:] & (letter[:-2] | letter[1:-1] | letter[2:])


def trigram_buckets(values: np.ndarray) -> np.ndarray:
    """The bucket of each byte trigram of folded UTF-8 bytes."""
    raw = _FOLD[values].astype(np.uint32)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int32)


@dataclass
class TextModel:
    """Log-probabilities of buckets per language, as what a bucket has in all of them, what a language has in all buckets,
    and additions where a language's sample has the bucket at all: no number for what doesn't occur.

    Bucket b has the languages ``language[start[b]:start[b + 1]]`` with additions ``more``.
    """

    languages: list[str]
    temper: float
    base: np.ndarray
    own: np.ndarray
    start: np.ndarray
    language: np.ndarray
    more: np.ndarray

    @staticmethod
    def fit(languages: list[str], language: np.ndarray, bucket: np.ndarray, n: np.ndarray, temper: float) -> TextModel:
        """From counts ``n`` of (language, bucket), smoothed towards the mean of all languages, so that a rare trigram says little."""
        total = n.sum()
        share = (np.bincount(bucket, weights=n, minlength=BUCKETS) + 0.5) / (total + 0.5 * BUCKETS)
        order = np.lexsort((language, bucket))
        language, bucket, n = language[order].astype(np.int32), bucket[order], n[order].astype(np.float64)
        own = -np.log(np.bincount(language, weights=n, minlength=len(languages)) + SMOOTH)
        start = np.searchsorted(bucket, np.arange(BUCKETS + 1))
        return TextModel(languages, temper, np.log(SMOOTH * share), own, start, language, np.log1p(n / (SMOOTH * share[bucket])))

    def additions(self, buckets: np.ndarray, first: int, last: int) -> np.ndarray:
        """A row for each of ``buckets``, a column for each language from ``first`` to ``last``."""
        size = self.start[buckets + 1] - self.start[buckets]
        row = np.repeat(np.arange(len(buckets)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[buckets], size)
        language = self.language[at]
        inside = (language >= first) & (language < last)
        out = np.zeros((len(buckets), last - first))
        out[row[inside], language[inside] - first] = self.more[at[inside]]
        return out


#: Pseudo-counts that a language's model has from the mean of all.
SMOOTH = 500.0
#: Bytes of text, rows and languages that are dealt with at once.
STEP, ROWS, WIDE = 1 << 17, 64, 512


def likelihoods(model: TextModel, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The tempered log-likelihood of each row under each language, "und" last.

    Trigrams become counts per (row, bucket) first, so that languages cost a product of small
    matrices and not a pass over the text each. Memory is bounded by the constants above.
    """
    rows, n = len(offsets) - 1, len(model.languages)
    out = np.zeros((rows, n + 1))
    for at in range(0, len(values) - 2, STEP):
        part = values[at : at + STEP + 2]
        place = np.flatnonzero(letter_trigrams(part))
        bucket = trigram_buckets(part)[place]
        row = np.searchsorted(offsets, place + at, "right") - 1
        inside = place + at + 2 < offsets[row + 1]  # no trigram across rows
        row, bucket = row[inside], bucket[inside]
        many = np.bincount(row, minlength=rows)
        out[:, n] -= many * np.log(BUCKETS)
        if not n or not len(row):
            continue
        out[:, :n] += np.bincount(row, weights=model.base[bucket], minlength=rows)[:, None] + many[:, None] * model.own[None, :]
        seen = np.flatnonzero(np.bincount(bucket, minlength=BUCKETS))
        column = np.zeros(BUCKETS, np.int64)
        column[seen] = np.arange(len(seen))
        for first in range(0, n, WIDE):
            last = min(n, first + WIDE)
            more = model.additions(seen, first, last)
            for low in range(int(row[0]), int(row[-1]) + 1, ROWS):
                a, b = np.searchsorted(row, (low, low + ROWS))
                if a < b:
                    here = min(ROWS, rows - low)
                    counts = np.bincount((row[a:b] - low) * len(seen) + column[bucket[a:b]], minlength=here * len(seen))
                    out[low : low + here, first:last] += counts.reshape(here, len(seen)) @ more
    out *= model.temper
    letters = np.concatenate([[0], np.cumsum(_LETTER[_FOLD[values]])])[offsets]
    out[letters[1:] == letters[:-1], :n] = NOTHING
    return out


def declared_of(column: Column) -> Column:
    """The primary subtag of a declared language, lower-cased; null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(column)), r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (declared, bucket, n) of some megabytes of text at a time."""
    for batch in batches:
        for part in slices(batch, 1):
            values, offsets = text_bytes(part.column(1))
            total: dict[str, np.ndarray] = {}
            for at, lang in enumerate(part.column(0).to_pylist()):
                own = values[offsets[at] : offsets[at + 1]]
                if len(own) > 2:
                    found = np.bincount(trigram_buckets(own)[letter_trigrams(own)], minlength=BUCKETS)
                    total[lang] = total[lang] + found if lang in total else found
            for lang, counts in total.items():
                bucket = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bucket), pa.string()), pa.array(bucket.astype(np.int32)), pa.array(counts[bucket])], names=["declared", "bucket", "n"])


def sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """(declared, text): per declared language ``sample`` rows of ``labelled`` (key, declared, text).

    Keys are picked before texts are read, so that texts of the sample alone move. Counts per range
    of hashes tell below which hash a language's sample lies, so that few keys meet; rows that
    repeat a key are cut to the sample where they lie.
    """
    first = F.shiftrightunsigned(F.xxhash64("key"), 48)
    order = Window.partitionBy("declared").orderBy(first, F.xxhash64("key"), "key")
    known = labelled.where("key is not null").select("declared", "key")
    counts = known.groupBy("declared", first.alias("first")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("declared").orderBy("first")) - F.col("n")
    cuts = counts.withColumn("before", before).where(F.col("before") < sample).groupBy("declared").agg(F.max("first").alias("cut"))
    near = known.join(F.broadcast(cuts), "declared").where(first <= F.col("cut"))  # a row per language is small
    picked = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)
    picked = materialize(picked.select("declared", "key").distinct(), "language-sample")
    if picked.count() <= MOST_BROADCAST:
        picked = F.broadcast(picked)
    rows = labelled.join(picked, ["declared", "key"], "left_semi").withColumn("place", F.row_number().over(order))
    return rows.where(F.col("place") <= sample).select("declared", "text")


def fit_text_model(rows: DataFrame, *, sample: int = 500, temper: float = 0.2) -> TextModel:
    """Fits on ``rows`` (key, declared, text): ``sample`` rows for each declared language.

    What reaches the driver is the model: a number for each bucket that a language's sample has.
    """
    labelled = rows.where("declared is not null")
    counted = materialize(sampled(labelled, sample).mapInArrow(_count, "declared string, bucket int, n long").groupBy("declared", "bucket").agg(F.sum("n").alias("n")), "language-trigrams")
    languages = sorted(r["declared"] for r in labelled.select("declared").distinct().collect())
    found = counted.toArrow()
    place = {x: i for i, x in enumerate(languages)}
    language = np.array([place[x] for x in found.column("declared").to_pylist()], np.int64)
    return TextModel.fit(languages, language, found.column("bucket").to_numpy().astype(np.int64), found.column("n").to_numpy(), temper)


EVIDENCE = ["key", "row_key", "declared", "suffix", "domain", "host"]
EVIDENCE_DDL = "key long, row_key long, declared string, suffix string, domain string, host string"


def _votes(shared):
    """Adds the row's likeliest language by its text alone. ``shared`` has the model as ``value``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(EVIDENCE), 1 << 19):
                votes = likelihoods(shared.value, *text_bytes(part.column(len(EVIDENCE)))).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(EVIDENCE)], pa.array(votes, pa.int32())], names=[*EVIDENCE, "vote"])

    return run


class Priors:
    """Priors of hosts and likelihoods of declarations from counts that there are; the rest follows from formulas."""

    def __init__(self, totals: list[int], strength: float, und_prior: float) -> None:
        self.totals = np.array(totals, float)
        self.n, self.strength, self.und_prior = len(totals), strength, und_prior
        self.overall = (self.totals + 1) / (self.totals.sum() + self.n)
        self.held: dict[tuple, np.ndarray] = {}

    def counts(self, pairs: list[tuple[int, int]]) -> np.ndarray:
        out = np.zeros(self.n)
        for vote, n in pairs:
            out[vote] = n
        return out

    def remember(self, key: tuple, make) -> np.ndarray:
        if key not in self.held:
            if len(self.held) >= 4096:
                self.held.clear()
            self.held[key] = make()
        return self.held[key]

    def shrunk(self, pairs: list[tuple[int, int]], parent: np.ndarray) -> np.ndarray:
        found = self.counts(pairs)
        return (found + self.strength * parent) / (found.sum() + self.strength)

    def host(self, votes: list[tuple[int, int]], mean: np.ndarray) -> tuple[np.ndarray, float]:
        found = self.counts(votes)
        return found + self.strength * mean, found.sum() - 1 + self.strength

    def said(self, pairs: list[tuple[int, int]]) -> np.ndarray:
        """log P(declared | language), Laplace-smoothed; "und" declares everything alike. As many kinds as languages and "other"."""
        out = np.log((self.counts(pairs) + 1) / (self.totals + self.n))
        out[-1] = -np.log(self.n)
        return out


def _decide(shared, priors: Priors, names: list[str]):
    """The language and its probability from EVIDENCE, text and the maps of votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(EVIDENCE), 1 << 19):
                ll = likelihoods(shared.value, *text_bytes(part.column(len(EVIDENCE))))
                votes = ll.argmax(axis=1)
                declared, suffix, domain, host = (part.column(k).to_pylist() for k in range(2, 6))
                said, of_host, of_domain, of_suffix = (part.column(c) for c in ("said", "host_votes", "domain_votes", "suffix_votes"))
                for i in range(part.num_rows):
                    s, d, h = suffix[i], domain[i], host[i]

                    def mean(i=i, s=s) -> np.ndarray:
                        up = priors.remember(("suffix", s), lambda: priors.shrunk(of_suffix[i].as_py(), priors.overall))
                        return priors.shrunk(of_domain[i].as_py(), up)

                    prior, size = priors.remember(("host", s, d, h), lambda i=i, s=s, d=d: priors.host(of_host[i].as_py(), priors.remember(("domain", s, d), mean)))
                    prior = prior.copy()
                    prior[votes[i]] -= 1  # a row's own vote doesn't count
                    prior /= size
                    prior[-1] = priors.und_prior  # hosts full of noise don't condemn their texts
                    ll[i] += np.log(prior) + priors.remember(("said", declared[i]), lambda i=i: priors.said(said[i].as_py()))
                top = ll.argmax(axis=1)
                weight = np.exp(ll - ll[np.arange(len(ll)), top][:, None]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([names[k] for k in top], pa.string()), pa.array(1 / weight, pa.float64()), part.column(2)], names=["key", "row_key", "lang", "probability", "declared"])

    return run


def identify(rows: DataFrame, *, sample: int = 500, temper: float = 0.2, strength: float = 10.0, und_prior: float = 0.001) -> DataFrame:
    """(key, row_key, lang, probability, declared) for each of ``rows`` (key, row_key, text, declared, suffix, domain, host).

    ``declared`` is a primary subtag or null; suffix, domain and host may be null. Texts are scored twice: for
    votes, of which counts are made, and for the posterior. So nothing is written that grows with the number of languages.
    """
    model = fit_text_model(rows.select("key", "declared", "text"), sample=sample, temper=temper)
    names = [*model.languages, UND]
    rows = rows.select("key", "row_key", F.coalesce("declared", F.lit("other")).alias("declared"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("suffix", "domain", "host")), "text")
    shared = rows.sparkSession.sparkContext.broadcast(model)
    voted = materialize(rows.mapInArrow(_votes(shared), f"{EVIDENCE_DDL}, vote int").groupBy("declared", "suffix", "domain", "host", "vote").agg(F.count("*").alias("n")), "language-votes")

    def gathered(*keys: str, into: str) -> DataFrame:
        """Counts per vote by ``keys``, as entries of those that there are."""
        counted = voted.groupBy(*keys, "vote").agg(F.sum("n").alias("n"))
        return counted.groupBy(*keys).agg(F.collect_list(F.struct("vote", "n")).alias(into))

    totals = [0] * len(names)
    for r in voted.groupBy("vote").agg(F.sum("n").alias("n")).collect():  # a row per language
        totals[r["vote"]] = r["n"]
    levels = gathered("suffix", "domain", "host", into="host_votes").join(gathered("suffix", "domain", into="domain_votes"), ["suffix", "domain"]).join(gathered("suffix", into="suffix_votes"), ["suffix"])
    levels = _few(materialize(levels, "language-hosts"), F.size("host_votes") + F.size("domain_votes") + F.size("suffix_votes"))
    # a declaration of a third of all rows is a hot key; the table of declarations has a row for each that occurs
    said = _few(materialize(gathered("declared", into="said"), "language-declared"), F.size("said"))
    joined = rows.join(said, "declared").join(levels, ["suffix", "domain", "host"])
    pairs = [F.transform(c, lambda x: F.array(x["vote"].cast("long"), x["n"])).alias(c) for c in ("said", "host_votes", "domain_votes", "suffix_votes")]
    decided = joined.select(*EVIDENCE, "text", *pairs).mapInArrow(_decide(shared, Priors(totals, strength, und_prior), names), "key long, row_key long, lang string, probability double, declared string")
    return decided


def _few(frame: DataFrame, entries: Column) -> DataFrame:
    """A written table, broadcast if a count of its rows and entries shows that it is small."""
    size = frame.agg(F.count("*").alias("n"), F.coalesce(F.sum(entries), F.lit(0)).alias("entries")).first()
    small = size["n"] <= MOST_BROADCAST and 64 * size["n"] + 24 * size["entries"] <= MOST_BYTES
    return F.broadcast(frame) if small else frame.hint("shuffle_hash")


def identify_documents(docs: DataFrame, **options) -> DataFrame:
    """Languages of ``docs`` (doc_id, text, lang as declared, source as host)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), row_key().alias("row_key"), "text", declared_of(F.col("lang")).alias("declared"), F.lit("").alias("suffix"), F.lit("").alias("domain"), F.col("source").cast("string").alias("host"))
    return identify(rows, **options)


def identify_pages(pages: DataFrame, **options) -> DataFrame:
    """Languages of ``pages`` (page_id, url, html): markup, suffix, domain and host are evidence."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1)), r":[0-9]*$", "")
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    declared = declared_of(F.regexp_extract("html", r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z_-]+)""", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("key"), row_key("html").alias("row_key"), text.alias("text"), declared.alias("declared"), F.substring_index(host, ".", -1).alias("suffix"), F.substring_index(host, ".", -2).alias("domain"), host.alias("host"))
    return identify(rows, **options).drop("row_key")


def accepted(languages: tuple[str, ...] | None, least: float) -> Column:
    """A row is kept if a language is found with probability ``least``, one of ``languages`` if given."""
    keep = (F.col("lang") != UND) & (F.col("probability") >= least)
    return keep & F.col("lang").isin(*languages) if languages else keep


def document_report(docs: DataFrame, *, languages: tuple[str, ...] | None = None, least: float = 0.5) -> DataFrame:
    """(doc_id, lang, probability, declared, accepted)."""
    found = identify_documents(docs)
    return found.select(F.col("key").alias("doc_id"), "lang", "probability", "declared", accepted(languages, least).alias("accepted"))


def filter_language(docs: DataFrame, *, languages: tuple[str, ...] | None = None, least: float = 0.5) -> DataFrame:
    """``docs`` without those whose language is not accepted."""
    found = identify_documents(docs)
    return without(docs, found.where(~accepted(languages, least)).select(F.col("key").alias("doc_id"), "row_key"))
