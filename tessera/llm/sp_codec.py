"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton over the model's pieces runs over a text once. At each position its output
links give all pieces that end there, and each relaxes the best segmentation of the
prefix that it extends.

- Unigram models: scores are log-probabilities; the best segmentation has the largest sum
  (Viterbi).
- BPE models: scores are merge priorities and adding them up means nothing. There the best
  segmentation of a prefix is the one that the merges give; it is unique, and a piece
  extends it exactly if no merge of higher priority would join or cut the two pieces at
  their border. So a relaxation is accepted if that holds for the last piece of the prefix.
  Every prefix has one such last piece, and the single pass stays the same, also for runs
  of marks, whose pieces have equal priorities: there the leftmost merges first.

Characters without a piece become their UTF-8 byte pieces. White space is the piece mark
U+2581; a text's own U+2581 is written as byte pieces, so that decoding gives back every
text exactly. Pieces hold the mark at their start only, so words are encoded by themselves and
kept in a bounded cache; a model with marks elsewhere is run over whole texts. The words of some
texts that the cache doesn't have take the pass together, position after position, through the
automaton's states and links in arrays. Texts are cut into words where their bytes lie, and Arrow's
dictionary encoding numbers these, so that only different words become Python strings.

Defined cases
- null text: null ids and null text; empty text: no ids.
- lone surrogates can't occur in Spark strings. Control characters are ordinary text.
- very long texts and words: memory is proportional to the text; batches are handled some
  megabytes of text at a time.
- repeated rows and null doc_ids are returned as they come; extra columns pass through. Where a
  table has a column that is called like a new one, the new one gets an underscore more.
- ties of equal sums: the longer last piece.
- an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain, count
from operator import eq

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ddl_of, free_name, slices, text_bytes, tidy

MARK = "▁"
MARK_BYTES = MARK.encode()
FOLDER = "/opt/tokenizers"
#: Words from this length on are neither cached nor passed with others; fewer words than FEW aren't worth arrays; WORDS go at once, ids of PLACES words, and bytes of BYTES ids.
LONG, FEW, WORDS, PLACES, BYTES = 64, 50, 8192, 1 << 18, 1 << 16
#: Ids as they are joined, hashed and stored.
IDS = np.dtype("<i4")
#: Next states that an automaton's table may hold; code points.
TABLE, POINTS = 1 << 23, 0x110000


class Links:
    """The automaton over ``pieces`` (text to id) in arrays, for many words at once.

    States are the prefixes of pieces, by length; 0 is the empty one. The table gives the next state for the letters that most
    states go on with, and failure links do for others. ``piece`` is the piece that a state is, or -1, ``ending`` the state of the longest
    piece that ends at a state, ``link`` that of the longest one behind it; 0 where there is none.
    """

    def __init__(self, pieces: dict[str, int]) -> None:
        self.pieces = pieces
        names = ["", *sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)}, key=len)]
        number = {name: i for i, name in enumerate(names)}
        parent = np.array([number[name[:-1]] for name in names], np.int64)
        letter = np.array([0, *(ord(name[-1]) for name in names[1:])], np.int64)
        self.piece = np.array([pieces.get(name, -1) for name in names], np.int64)
        self.fail, self.ending, self.link = (np.zeros(len(names), np.int64) for _ in range(3))
        edge = parent[1:] * POINTS + letter[1:]
        order = np.argsort(edge)
        self.edges, self.to = np.append(edge[order], np.iinfo(np.int64).max), order + 1
        some, times = np.unique(letter[1:], return_counts=True)
        usual = some[np.argsort(-times, kind="stable")][: max(0, TABLE // len(names) - 1)]
        self.column = np.zeros(POINTS, np.int32)
        self.column[usual] = np.arange(1, len(usual) + 1)
        self.table = np.zeros((len(names), len(usual) + 1), np.uint16 if len(names) <= 1 << 16 else np.int32)
        depth = np.fromiter(map(len, names), np.int64, len(names))
        ends = [0, *np.cumsum(np.bincount(depth)).tolist()]
        for d, (a, b) in enumerate(zip(ends, ends[1:])):
            if d > 1:
                self.fail[a:b] = self.step(self.fail[parent[a:b]], letter[a:b])
            self.table[a:b] = self.table[self.fail[a:b]]
            on = np.arange(b, ends[d + 2] if d + 2 < len(ends) else b)
            on = on[self.column[letter[on]] > 0]
            self.table[parent[on], self.column[letter[on]]] = on
            self.link[a:b] = self.ending[self.fail[a:b]]
            self.ending[a:b] = np.where(self.piece[a:b] >= 0, np.arange(a, b), self.link[a:b])

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The states that come after ``state`` with ``letter``."""
        column = self.column[letter]
        out = self.table[state, column].astype(np.int64)
        at = np.flatnonzero(column == 0)
        state, letter = state[at], letter[at]
        while len(at):
            key = state * POINTS + letter
            place = np.searchsorted(self.edges, key)
            hit = self.edges[place] == key
            out[at[hit]] = self.to[place[hit]]
            more = ~hit & (state > 0)
            at, state, letter = at[more], self.fail[state[more]], letter[more]
        return out


class Codec:
    """Pieces of a model, given as (piece, score) in order of id."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_at: dict[int, int], *, bpe: bool, prefix: bool = True, unknown: int = 0, skip: frozenset[int] = frozenset(), cache: int = 120_000, links: Links | None = None) -> None:
        self.pieces, self.bytes_at, self.bpe, self.prefix, self.unknown, self.skip = pieces, bytes_at, bpe, prefix, unknown, skip
        self.byte_of = {i: b for b, i in bytes_at.items()}
        self.id_of = {p: i for i, (p, _) in enumerate(pieces) if i not in skip and i not in self.byte_of and p}
        self.score = [s for _, s in pieces]
        self.split: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        whole = {p: i for p, i in self.id_of.items() if not bpe or len(p) == 1 or self._halves(i) is not None}  # the merges never make others
        for piece, i in whole.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.links = links if links is not None and links.pieces == whole else Links(whole)
        self.size = [len(p) for p, _ in pieces]
        self.sizes, self.scores = np.array(self.size, np.int64), np.array(self.score, float)
        self.inner = any(MARK in p.lstrip(MARK) for p in self.id_of)
        self.chunk = re.compile(r".+", re.S) if self.inner else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.worst = min((self.score[i] for i in self.id_of.values()), default=0.0) - 10.0
        #: Ids of words; the empty one stands for a text's own mark.
        self.cache: dict[str, bytes] = {"": self._packed(self._bytes(MARK))}
        self.room = cache
        #: What is known of pairs, twice the pair and 1 if it fits, by a hash of the pair: one that had the place.
        self.known = np.full(1 << 19, -1, np.int64)
        if bpe:
            self._chains()
        self.text_of = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in skip else p.replace(MARK, " ").encode() for i, (p, _) in enumerate(pieces)]
        self.letters = np.frombuffer(b"".join(self.text_of), np.uint8)
        self.lengths = np.fromiter(map(len, self.text_of), np.int32, len(pieces))
        self.firsts = np.cumsum(self.lengths, dtype=np.int32) - self.lengths

    # -- encoding ---------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.joined([self.words(text)])[0], IDS).tolist()

    def encode_with(self, other: Codec, text: str) -> tuple[list[int], list[int]]:
        """The ids of this codec and of ``other``, which has the same pieces with other scores; the text is cut into words once."""
        ids, others = (np.frombuffer(found[0], IDS).tolist() for found in self.joined_with(other, [self.words(text)]))
        return ids, others

    def words(self, text: str) -> list[str]:
        """The words of ``text`` with marks for spaces; "" for each of its own marks."""
        if not text:
            return []
        parts = [self.chunk.findall(part.replace(" ", MARK)) for part in ((" " if self.prefix else "") + text).split(MARK)]
        if len(parts) == 1:
            return parts[0]
        return [word for k, part in enumerate(parts) for word in ([""] if k else []) + part]

    def joined(self, texts: Sequence[list[str]]) -> list[bytes]:
        """The ids of each of some texts, given as words()."""
        return self._joined([self], texts)[0]

    def joined_with(self, other: Codec, texts: Sequence[list[str]]) -> tuple[list[bytes], list[bytes]]:
        """The same of this codec and of ``other``, which has the same pieces with other scores: the automaton runs once for both."""
        ids, others = self._joined([self, other], texts)
        return ids, others

    @staticmethod
    def _joined(codecs: list[Codec], texts: Sequence[list[str]]) -> list[list[bytes]]:
        number: dict[str, int] = defaultdict(count().__next__)
        places = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int32)
        return Codec._ids(codecs, list(number), places, np.cumsum([0, *map(len, texts)]))

    def led(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of some texts with the space that the model puts before them, and their borders; a text that is null or empty has none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if self.prefix:
            lead, none = (pa.scalar(c, pa.large_string()) for c in (" ", ""))
            texts = pa.compute.if_else(pa.compute.equal(texts, none), none, pa.compute.binary_join_element_wise(lead, texts, none))
        return text_bytes(texts)

    def numbered(self, raw: np.ndarray, borders: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """words() of texts given as led() gives them: the words, once each, the number of each word of the texts, and the texts' borders among these.

        A word begins with a run of spaces, with a text, and on both sides of a text's own mark.
        """
        first = np.zeros(len(raw) + 1, bool)
        if not self.inner:
            first[:-1] = raw == 32
            first[1:-1] &= raw[:-1] != 32
        own = np.flatnonzero(raw == MARK_BYTES[0])
        own = own[(raw[own + 1] == MARK_BYTES[1]) & (raw[own + 2] == MARK_BYTES[2])]
        first[own] = first[own + 3] = first[borders] = True
        starts = np.flatnonzero(first)
        words = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(raw)]).dictionary_encode()
        used = pa.compute.replace_substring(words.dictionary, " ", MARK).to_numpy(zero_copy_only=False).tolist()
        alone = words.dictionary.index(MARK).as_py() if len(own) else -1
        if alone >= 0:
            used[alone] = ""
        return used, words.indices.to_numpy(), np.searchsorted(starts, borders)

    @staticmethod
    def _ids(codecs: list[Codec], used: list[str], places: np.ndarray, ends: np.ndarray) -> list[list[bytes]]:
        """The ids by each codec of texts that end at ``ends`` of ``places``, which number their words in ``used``. What a cache doesn't have is segmented together, each word once."""
        kept = [list(map(codec.cache.get, used)) for codec in codecs]
        known = np.fromiter(chain(*(map(bool, ids) for ids in kept)), bool).reshape(len(codecs), -1).all(0)
        new = np.flatnonzero(~known)
        sizes = np.fromiter(map(len, map(used.__getitem__, new.tolist())), np.int64, len(new))
        order = np.argsort(sizes, kind="stable")
        new, short = new[order].tolist(), int(np.searchsorted(sizes[order], LONG))
        missing = list(map(used.__getitem__, new))
        many = short if short >= FEW else 0
        made: list[list[bytes]] = [[] for _ in codecs]
        shared = all(codec.links is codecs[0].links for codec in codecs)
        for k in range(0, many, WORDS):
            words = missing[k : min(many, k + WORDS)]
            found = Codec._together(codecs, words) if shared else [ids for codec in codecs for ids in Codec._together([codec], words)]
            for ids, more in zip(made, found):
                ids += more
        out = []
        for codec, ids, more in zip(codecs, kept, made):
            more += [codec._packed(codec._segment(w)) for w in missing[many:]]
            for k, i in zip(new, more):
                ids[k] = i
            codec.cache.update(zip(missing[: min(short, max(0, codec.room - len(codec.cache)))], more))
            out.append(Codec._dealt(ids, places, ends))
        return out

    @staticmethod
    def _dealt(ids: list[bytes], places: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The ids of texts that end at ``ends`` of ``places``, which number their words; some words at once."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // IDS.itemsize
        first, whole = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), IDS)
        parts, upto = [], np.append(0, np.cumsum(sizes[places]))
        for k in range(0, len(places), PLACES):
            some = places[k : k + PLACES]
            size = sizes[some]
            turn = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            parts.append(whole[np.repeat(first[some], size) + turn].tobytes())
        raw, cuts = b"".join(parts), (upto[ends] * IDS.itemsize).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.array(ids, IDS).tobytes()

    def _bytes(self, char: str) -> list[int]:
        if not self.bytes_at:
            return [self.unknown]
        return [self.bytes_at[b] for b in char.encode()]

    def _segment(self, text: str) -> list[int]:
        return self._merge_pass(text) if self.bpe else self._sum_pass(text)

    def _sum_pass(self, text: str) -> list[int]:
        """Viterbi over sums of scores."""
        n = len(text)
        best, pieces, starts = [0.0] + [-np.inf] * n, [-1] * (n + 1), [0] * (n + 1)
        matches = self.automaton.iter(text)
        pending = next(matches, None)
        for position in range(n):
            end = position + 1
            best[end] = best[position] + self.worst  # one character on its own, without a piece
            while pending is not None and pending[0] == position:
                piece = pending[1]
                size = self.size[piece]
                value = best[end - size] + self.score[piece]
                if value > best[end]:
                    best[end], pieces[end], starts[end] = value, piece, end - size
                pending = next(matches, None)
        return self._walk(text, pieces, starts)

    def _merge_pass(self, text: str) -> list[int]:
        """The same pass, where a piece extends a prefix if the merges put a border between them."""
        n = len(text)
        pieces, starts = [-1] * (n + 1), [0] * (n + 1)
        for position, piece in self.automaton.iter(text):
            if pieces[position + 1] >= 0:
                continue  # a prefix has one last piece
            start = position + 1 - self.size[piece]
            before = pieces[start] if start else -1
            if before >= 0 and not self._pair(before, piece):  # characters without a piece never merge
                continue
            pieces[position + 1], starts[position + 1] = piece, start
        return self._walk(text, pieces, starts)

    def _pair(self, before: int, piece: int) -> bool:
        """_border(), remembered."""
        key = before * len(self.pieces) + piece
        fits = self.pairs.get(key)
        if fits is None:
            fits = self._border(before, piece)
            if len(self.pairs) < self.room:
                self.pairs[key] = fits
        return fits

    def _pairs(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """_pair() of arrays."""
        key = before * len(self.pieces) + piece
        at = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(45)).astype(np.int64)
        known = self.known[at]
        fits, new = (known & 1) > 0, np.flatnonzero(known >> 1 != key)
        if len(new):
            some, each = np.unique(key[new], return_inverse=True)
            fits[new] = self._borders(*np.divmod(some, len(self.pieces)))[each]
            self.known[at[new]] = key[new] * 2 + fits[new]
        return fits

    @staticmethod
    def _together(codecs: list[Codec], words: list[str]) -> list[list[bytes]]:
        """The ids of each of ``words``, which ascend by length, by each of the codecs, which share their links: the pass over all at once.

        Prefixes are nodes, numbered by length and word. Those of one length take a step of the automaton, and the pieces that
        end at them relax them in its order, the longest first.
        """
        links, wide = codecs[0].links, len(words)
        sizes = np.fromiter(map(len, words), np.int64, wide)
        top = int(sizes[-1])
        letters = np.zeros((top, wide), np.int64)
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        letters[np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.arange(wide), sizes)] = text
        state = np.zeros(wide, np.int64)
        lasts = [np.full((top + 1) * wide, -1) for _ in codecs]
        sums = [None if codec.bpe else np.zeros((top + 1) * wide) for codec in codecs]
        backs = [codec.sizes[links.piece] * wide for codec in codecs]
        gains = [codec.scores[links.piece] for codec in codecs]
        for depth in range(1, top + 1):
            a = int(np.searchsorted(sizes, depth))
            state[a:] = links.step(state[a:], letters[depth - 1, a:])
            ending = links.ending[state[a:]]
            some = np.flatnonzero(ending)
            ending, nodes = ending[some], some + (depth * wide + a)
            for codec, last, best, back, gain in zip(codecs, lasts, sums, backs, gains):
                if best is None:
                    codec._merge_step(ending, nodes, last, back)
                else:
                    row = slice(depth * wide + a, (depth + 1) * wide)
                    best[row] = best[row.start - wide : row.stop - wide] + codec.worst
                    codec._sum_step(ending, nodes, last, back, best, gain)
        return [codec._walks(letters, sizes, last) for codec, last in zip(codecs, lasts)]

    def _sum_step(self, ending: np.ndarray, nodes: np.ndarray, last: np.ndarray, back: np.ndarray, best: np.ndarray, gain: np.ndarray) -> None:
        """Relaxes ``nodes``, where pieces of the states ``ending`` and of their links end, by sums; ``back`` and ``gain`` are by state."""
        while len(ending):
            value = best[nodes - back[ending]] + gain[ending]
            fits = np.flatnonzero(value > best[nodes])
            to = nodes[fits]
            best[to], last[to] = value[fits], self.links.piece[ending[fits]]
            ending = self.links.link[ending]
            more = np.flatnonzero(ending)
            ending, nodes = ending[more], nodes[more]

    def _merge_step(self, ending: np.ndarray, nodes: np.ndarray, last: np.ndarray, back: np.ndarray) -> None:
        """The same by borders: the first piece that fits is a node's last."""
        while len(ending):
            before, piece = last[nodes - back[ending]], self.links.piece[ending]
            fits = before < 0
            inner = np.flatnonzero(~fits)
            fits[inner] = self._pairs(before[inner], piece[inner])
            last[nodes[fits]] = piece[fits]
            ending = np.where(fits, 0, self.links.link[ending])
            more = np.flatnonzero(ending)
            ending, nodes = ending[more], nodes[more]

    def _walks(self, letters: np.ndarray, sizes: np.ndarray, last: np.ndarray) -> list[bytes]:
        """_walk() of many words at once, from their ends."""
        wide = len(sizes)
        letters = letters.ravel()
        owner, owners, ids = np.arange(wide), [], []
        at = sizes * wide + owner
        while len(owner):
            piece = last[at]
            owners.append(owner)
            ids.append(np.where(piece >= 0, piece, -1 - letters[at - wide]))  # below 0: a character without a piece
            at = at - np.where(piece >= 0, self.sizes[piece], 1) * wide
            more = np.flatnonzero(at >= wide)
            owner, at = owner[more], at[more]
        owner, ids = np.concatenate(owners)[::-1], np.concatenate(ids)[::-1]
        order = np.argsort(owner, kind="stable")
        owner, ids = owner[order], ids[order]
        bare = ids < 0
        if bare.any():
            some, each = np.unique(ids[bare], return_inverse=True)
            made = [self._bytes(chr(-1 - c)) for c in some.tolist()]
            times = np.ones(len(ids), np.int64)
            times[bare] = np.array(list(map(len, made)))[each]
            owner, ids, bare = np.repeat(owner, times), np.repeat(ids, times), np.repeat(bare, times)
            ids[bare] = list(chain.from_iterable(made[k] for k in each.tolist()))
        ends = (np.cumsum(np.bincount(owner, minlength=wide)) * IDS.itemsize).tolist()
        whole = ids.astype(IDS).tobytes()
        return [whole[a:b] for a, b in zip([0, *ends], ends)]

    def _walk(self, text: str, pieces: list[int], starts: list[int]) -> list[int]:
        out, end = [], len(text)
        while end > 0:
            piece = pieces[end]
            if piece >= 0:
                out.append(piece)
                end = starts[end]
            else:
                out.extend(reversed(self._bytes(text[end - 1 : end])))
                end -= 1
        out.reverse()
        return out

    # -- merges -----------------------------------------------------------------

    def _halves(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes ``piece``; None for single characters."""
        found = self.split.get(piece)
        if found is None and piece not in self.split:
            text = self.pieces[piece][0]
            found = self._replay(text)
            self.split[piece] = found
        return found

    def _replay(self, text: str) -> tuple[int, int] | None:
        """Merges ``text`` from its characters; the halves of the last merge if it becomes one piece."""
        parts = list(text)
        halves = None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                made = self.id_of.get(parts[i] + parts[i + 1])
                if made is not None and (best is None or self.score[made] > best):
                    best, at = self.score[made], i
            if at < 0:
                return None
            halves = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if halves is None or any(h not in self.id_of for h in halves):
            return None
        return self.id_of[halves[0]], self.id_of[halves[1]]

    def _border(self, left: int, right: int) -> bool:
        """Do the merges leave a border between neighbours ``left`` and ``right``?

        Time runs from high scores to low ones. On each side a chain of ever longer pieces
        stands at the border, each from its own merge until the next. Two that stand there
        together and have a merge of their own would merge before the next one on the left,
        and no later than the next one on the right, as the leftmost of equals comes first.
        """
        rights = [right]
        while (halves := self._halves(rights[-1])) is not None:
            rights.append(halves[0])
        lefts = [left]
        while (halves := self._halves(lefts[-1])) is not None:
            lefts.append(halves[1])
        made = lambda p: self.score[p] if len(self.pieces[p][0]) > 1 else np.inf
        for i, a in enumerate(lefts):
            for j, b in enumerate(rights):
                joined = self.id_of.get(self.pieces[a][0] + self.pieces[b][0])
                if joined is not None:
                    when = min(self.score[joined], made(a), made(b))
                    if when > (made(lefts[i - 1]) if i else -np.inf) and when >= (made(rights[j - 1]) if j else -np.inf):
                        return False
        return True

    def _chains(self) -> None:
        """What _borders() takes: chains of all pieces one behind the other, and all merges of two pieces, by pair."""
        self.made = np.where(self.sizes > 1, self.scores, np.inf)
        self.sides = []
        for side in (1, 0):
            ids, floors, ends = [], [], [0]
            for i in range(len(self.pieces)):
                piece, floor = i, -np.inf
                ids.append(piece)
                floors.append(floor)
                while (halves := self._halves(piece)) is not None:
                    floor, piece = self.made[piece], halves[side]
                    ids.append(piece)
                    floors.append(floor)
                ends.append(len(ids))
            self.sides.append((np.array(ids), np.array(floors), np.array(ends[:-1]), np.diff(ends)))
        pairs = {a * len(self.pieces) + b: self.score[i] for p, i in self.id_of.items() for k in range(1, len(p)) if (a := self.id_of.get(p[:k])) is not None and (b := self.id_of.get(p[k:])) is not None}
        order = sorted(pairs)
        self.merges, self.merged = np.array([*order, np.iinfo(np.int64).max]), np.array([pairs[k] for k in order] + [0.0])

    def _borders(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_border() of arrays: each link of the chain on the left against each on the right."""
        (lefts, above, at, many), (rights, beyond, to, much) = self.sides
        times = many[left] * much[right]
        owner = np.repeat(np.arange(len(left)), times)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
        i, j = np.divmod(turn, much[right][owner])
        i, j = i + at[left][owner], j + to[right][owner]
        key = lefts[i] * len(self.pieces) + rights[j]
        place = np.searchsorted(self.merges, key)
        hit = np.flatnonzero(self.merges[place] == key)
        i, j, place, owner = i[hit], j[hit], place[hit], owner[hit]
        when = np.minimum(self.merged[place], np.minimum(self.made[lefts[i]], self.made[rights[j]]))
        fits = np.ones(len(left), bool)
        fits[owner[(when > above[i]) & (when >= beyond[j])]] = False
        return fits

    # -- decoding ---------------------------------------------------------------

    def decode(self, ids: Sequence[int] | bytes) -> str:
        """The text of ids, which may be given as joined() gives them."""
        if isinstance(ids, bytes):
            ids = np.frombuffer(ids, IDS).tolist()
        return self._text(b"".join(map(self.text_of.__getitem__, ids)))

    def _text(self, raw: bytes) -> str:
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def decoded(self, texts: Sequence[bytes]) -> list[str]:
        """decode() of each of some texts, given as joined() gives them."""
        return list(map(self._text, self.spelt(texts)))

    def spelt(self, texts: Sequence[bytes]) -> list[bytes]:
        """The bytes of each of some texts, given as joined() gives them, taken from the pieces' in arrays; a prefix stays."""
        ids, parts = np.frombuffer(b"".join(texts), IDS), []
        upto = np.append(0, np.cumsum(self.lengths[ids], dtype=np.int64))
        for k in range(0, len(ids), BYTES):
            some = ids[k : k + BYTES]
            size = self.lengths[some]
            shift = self.firsts[some] - np.cumsum(size, dtype=np.int32) + size
            parts.append(self.letters[np.repeat(shift, size) + np.arange(size.sum(), dtype=np.int32)].tobytes())
        raw, cuts = b"".join(parts), upto[np.cumsum([0, *(len(i) // IDS.itemsize for i in texts)])].tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def load(model: str) -> Codec:
    """A codec of a SentencePiece model file."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(n)]
    bytes_at = {int(pieces[i][0][3:5], 16): i for i in range(n) if sp.is_byte(i)}
    skip = frozenset(i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
    # a BPE model merges "a b" by priority: its own encoding tells, as the file's type isn't exposed
    plain = set(range(n)) - skip - set(bytes_at.values())
    scores = [pieces[i][1] for i in sorted(plain)]
    bpe = all(float(s).is_integer() for s in scores)
    return Codec(pieces, bytes_at, bpe=bpe, prefix=sp.encode("a") != sp.encode(" a") or sp.id_to_piece(sp.encode("a")[0]).startswith(MARK), unknown=max(0, sp.unk_id()), skip=skip)


def by_rank(codec: Codec) -> Codec:
    """The same pieces as a unigram model. Nothing is trained: a vocabulary lists its pieces by falling
    frequency, so by Zipf's law the log-probability of the piece with rank r is -log(r) less a constant."""
    ranked = sorted(codec.id_of.values(), key=lambda i: (-codec.score[i], i))
    whole = float(np.log(sum(1 / r for r in range(1, len(ranked) + 1))))
    score = {i: -float(np.log(r)) - whole for r, i in enumerate(ranked, 1)}
    pieces = [(p, score.get(i, 0.0)) for i, (p, _) in enumerate(codec.pieces)]
    return Codec(pieces, codec.bytes_at, bpe=False, prefix=codec.prefix, unknown=codec.unknown, skip=codec.skip, links=codec.links)


@lru_cache(maxsize=2)
def worker_codec(model: str, unigram: bool = False) -> Codec:
    return by_rank(worker_codec(model)) if unigram else load(model)


class Model:
    """The codecs of a model file, made where they are first used.

    Tasks get it as a broadcast: a worker keeps the value from task to task, and lets go of it when it is
    given a task without it. A worker's own cache would stay beside all that the worker does later.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        self.made: dict[bool, Codec] = {}

    def codec(self, unigram: bool = False) -> Codec:
        if unigram not in self.made:
            self.made[unigram] = by_rank(self.codec()) if unigram else load(self.path)
        return self.made[unigram]


def held(frame: DataFrame, model: str | None) -> Broadcast[Model]:
    return frame.sparkSession.sparkContext.broadcast(Model(model or default_model()))


def default_model() -> str:
    return os.path.join(FOLDER, "piece_bpe_32k.model")


def encoded(codecs: list[Codec], texts: pa.Array) -> tuple[list[list[bytes]], list[bytes], list[bytes]]:
    """The ids of each text of a column by each of the codecs, its UTF-8 bytes, and those of what the first codec's ids decode to."""
    codec = codecs[0]
    raw, borders = codec.led(texts)
    ids = codec._ids(codecs, *codec.numbered(raw, borders))
    whole, lead, cuts = raw.tobytes(), int(codec.prefix), borders.tolist()
    own = [whole[a + lead : b] for a, b in zip(cuts, cuts[1:])]
    back = [text if spelt == whole[a:b] else codec._text(spelt).encode() for text, spelt, a, b in zip(own, codec.spelt(ids[0]), cuts, cuts[1:])]
    return ids, own, back


def id_lists(texts: pa.Array, ids: list[bytes]) -> pa.ListArray:
    """Lists of the ids of each text; null for null."""
    ends = np.cumsum([0, *(len(i) // IDS.itemsize for i in ids)])
    none = np.append(texts.is_null().to_numpy(zero_copy_only=False), False)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=none), pa.array(np.frombuffer(b"".join(ids), IDS), pa.int32()))


def encode(docs: DataFrame, model: str | None = None, *, column: str = "text", into: str = "ids", unigram: bool = False) -> DataFrame:
    """``docs`` with the piece ids of ``column``. ``model`` is a path that executors have."""
    shared, into = held(docs, model), free_name(docs, into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.codec(unigram)
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index(column)):
                texts = part.column(column)
                ids = id_lists(texts, codec._ids([codec], *codec.numbered(*codec.led(texts)))[0])
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, into])

    return docs.mapInArrow(tidy(run), f"{ddl_of(docs)}, `{into}` array<int>")


def decode(rows: DataFrame, model: str | None = None, *, column: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of the piece ids in ``column``."""
    shared, into = held(rows, model), free_name(rows, into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.codec()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [None if i is None else codec.decode(i) for i in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, into])

    return rows.mapInArrow(tidy(run), f"{ddl_of(rows)}, `{into}` string")


def encode_checked(docs: DataFrame, model: str | None = None, *, column: str = "text", unigram: bool = False) -> DataFrame:
    """``docs`` with ``ids``, ``n_pieces`` and ``exact``: whether decoding the ids gives back the text."""
    shared = held(docs, model)
    new = [free_name(docs, n) for n in ("ids", "n_pieces", "exact")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.codec(unigram)
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index(column)):
                texts = part.column(column)
                (ids,), own, back = encoded([codec], texts)
                lists, none = id_lists(texts, ids), texts.is_null().to_numpy(zero_copy_only=False)
                exact = np.fromiter(map(eq, own, back), bool, len(own))
                made = [lists, pa.compute.list_value_length(lists).cast(pa.int64()), pa.array(exact, mask=none)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *new])

    return docs.mapInArrow(tidy(run), f"{ddl_of(docs)}, `{new[0]}` array<int>, `{new[1]}` long, `{new[2]}` boolean")


def _digest(ids: list[int] | bytes) -> str:
    return hashlib.sha256(ids if isinstance(ids, bytes) else np.array(ids, IDS).tobytes()).hexdigest()


def codec_report(docs: DataFrame, model: str | None = None, *, unigram: bool = False) -> DataFrame:
    """(doc_id, n_chars, n_pieces, ids_sha256, decoded_sha256, exact, viterbi_pieces, viterbi_sha256), in one pass.

    ``ids_sha256`` is of the ids as little-endian 32-bit integers; ``exact`` tells whether
    decoding gave back the text. The Viterbi's columns are of the segmentation with the largest sum of
    scores of by_rank(), of the same pieces. ``unigram``: all columns are of that.
    """
    shared = held(docs, model)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("exact", pa.bool_()), ("viterbi_pieces", pa.int64()), ("viterbi_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, viterbi = shared.value.codec(unigram), shared.value.codec(True)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows = []
            docs, texts = batch.columns
            found, *texts_of = encoded([codec] if codec is viterbi else [codec, viterbi], texts)
            chars = pa.compute.utf8_length(texts).to_pylist()
            for doc, many, ids, sums, own, back in zip(docs.to_pylist(), chars, found[0], found[-1], *texts_of):
                if many is None:
                    rows.append((doc, *[None] * 7))
                    continue
                digest = _digest(ids)
                rows.append((doc, many, len(ids) // IDS.itemsize, digest, hashlib.sha256(back).hexdigest(), back == own, len(sums) // IDS.itemsize, digest if sums is ids else _digest(sums)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 8, schema)], schema=schema)

    ddl = "doc_id long, n_chars long, n_pieces long, ids_sha256 string, decoded_sha256 string, exact boolean, viterbi_pieces long, viterbi_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), ddl)
