"""SentencePiece encoding, decoding and sampled segmentations.

A text falls into units that no piece of the vocabulary crosses: blanks and the word after them, or a
newline and what follows it. Distinct units are encoded by the SentencePiece library, and as a lattice whose
edges are the pieces (or byte fallback) at each position. Backward sums over the lattice give the exact
probability of each next piece. A task keeps a bounded store of units, so those that come back are done once.

Sampling without replacement is the Gumbel top-k search from the top: a region of segmentations has a
Gumbel value with its mass as location, the best path of a region inherits the value, and the regions
that leave the path at one edge get values truncated to it. A queue per text pops the best region next
(A-star: the value bounds all that lies below), so the first ``k`` paths are the top k of all segmentations
under independent Gumbel noise: distinct samples, in order. The value of the next region is the threshold
of the inclusion scores. All noise is a hash of the row's key, so results do not depend on batches.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.llm.common import fresh, give_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Units of one batch; units and characters that a task's store keeps; units whose lattices are built at once; log
#: mass below the best region's at which a region can no longer be the next.
BATCH, KEPT, KEPT_CHARS, BUILT, FAINT = 25_000, 170_000, 1_600_000, 10_000, 45.0
#: Rows whose texts become Python strings at once.
ROWS = 256
BLANK = "▁"
NONE, BYTES = 0xFFFF, 0xFFFE
#: Most states have no longer piece than this; the others are summed apart.
NARROW = 5
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class Vocab:
    """Pieces of a model, their bytes, log weights, and a hash table over all their prefixes."""

    def __init__(self, path: str):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        # whether the model keeps characters as they are; if not, every unit beyond ASCII is checked
        probe = "é é Ａ ﬁ ① 漢 \u00a0 ß İ"
        self.lossless = sp.decode(sp.encode(probe)) == probe
        n = sp.get_piece_size()
        self.raw, self.weight = [b""] * n, np.full(0x10000, -np.inf)
        self.byte = np.zeros(256, np.int64)
        normal = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.raw[i] = bytes([int(piece[3:5], 16)])
                self.byte[self.raw[i][0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.raw[i] = piece.replace(BLANK, " ").encode()
                normal[piece] = i
                self.weight[i] = -np.log(2.0 - sp.get_score(i))
        self.byte_weight = -np.log(2.0 * n)
        self.longest = max(map(len, normal))
        self.blank = normal[BLANK]
        hashes = {"": 0}  # of every prefix of a piece, by the same step as ``extend``
        for p in normal:
            for k in range(1, len(p) + 1):
                if p[:k] not in hashes:
                    h = hashes[p[:k - 1]]
                    hashes[p[:k]] = (((h ^ (ord(p[k - 1]) + 1)) * _MIX[0]) + (h >> 29) + 1) % 2**64
        del hashes[""]
        self.bits = (4 * len(hashes)).bit_length()
        self.keys, self.ids = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, NONE, np.uint16)
        slots = self.slot(np.fromiter(hashes.values(), np.uint64, len(hashes))).tolist()
        taken = {}
        for at, (p, h) in zip(slots, hashes.items()):
            while at in taken:
                at = (at + 1) & ((1 << self.bits) - 1)
            taken[at] = h
            self.ids[at] = normal.get(p, NONE)
        self.keys[list(taken)] = np.fromiter(taken.values(), np.uint64, len(taken))
        self.n_raw = np.fromiter(map(len, self.raw), np.int64, n)
        self.raw_at = np.cumsum(self.n_raw) - self.n_raw
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.store = Store(self)

    @staticmethod
    def extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (h ^ (c + np.uint64(1))) * np.uint64(_MIX[0]) + (h >> np.uint64(29)) + np.uint64(1)

    def slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(_MIX[2])) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are prefixes of pieces, and the piece id of those that are pieces."""
        at = self.slot(h)
        got = self.keys[at]
        hit = got == h
        ids = np.where(hit, self.ids[at], np.uint16(NONE))
        rest = np.flatnonzero(~hit & (got != 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[rest]]
            ok = got == h[rest]
            hit[rest[ok]], ids[rest[ok]] = True, self.ids[at[rest[ok]]]
            rest = rest[~ok & (got != 0)]
        return hit, ids

    def _encode(self, keys: list[str]) -> list[list[int]]:
        """Ids of units; units that the library cannot give back are spelled in bytes."""
        out = self.sp.encode(keys, num_threads=1)
        for i, (key, ids) in enumerate(zip(keys, out)):
            if not key:
                out[i] = [self.blank]
            elif key[0] == "\n":
                out[i] = ids = ids[1:]  # the blank that the library puts in front
            if BLANK in key or not (self.lossless or key.isascii()):
                raw = unit(key).encode()
                if b"".join(map(self.raw.__getitem__, ids)) != raw:
                    word = raw.lstrip(b" ")
                    out[i] = [self.blank] * (len(raw) - len(word)) + self.byte[list(word)].tolist()
        return out

    def spell(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids in turn."""
        n = self.n_raw[ids]
        end = np.cumsum(n)
        at = np.repeat(self.raw_at[ids] - end + n, n)
        at += np.arange(len(at))
        return self.raw_bytes[at].tobytes()

    def decode(self, ids) -> bytes:
        """The text of ids, without the blank that encoding puts in front."""
        return b"".join(map(self.raw.__getitem__, ids))[1:]


@lru_cache(maxsize=2)
def vocab(path: str) -> Vocab:
    return Vocab(path)


def unit(key: str) -> str:
    return key if key[:1] == "\n" else " " + key


def units(text: str) -> list[str]:
    """Keys of a text's units: the unit itself if it starts with a newline, else without its first blank.

    Concatenated the units are a blank and the text; an empty text has none.
    """
    if not text:
        return []
    words = text.replace("\n", " \n").split(" ")
    if "" not in words:
        return words
    out, blanks = [], 0
    for w in words:
        if not w:
            blanks += 1
        elif w[0] == "\n":
            if blanks:
                out.append(" " * (blanks - 1))
            out.append(w)
            blanks = 0
        else:
            out.append(" " * blanks + w)
            blanks = 0
    if blanks:
        out.append(" " * (blanks - 1))
    return out


def numbered(keys: Iterable[str] = ()) -> defaultdict:
    """key -> its number: the given keys in turn, then others by first appearance."""
    out = defaultdict(None, zip(keys, count()))
    out.default_factory = count(len(out)).__next__
    return out


def uniform(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from 64-bit counters."""
    z = x + np.uint64(_MIX[0])
    z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX[1])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX[2])
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54


class Lattice:
    """Lattices of distinct units, one state per character; ``start`` has each unit's first state.

    A state has an entry for each length up to that of its longest piece, from ``first`` on: ``chance`` is the
    probability that the next piece has at most that many characters, ``pid`` the piece of so many.
    """

    def __init__(self, distinct: list[str], v: Vocab):
        size = np.fromiter(map(len, distinct), np.int64, len(distinct))
        self.start = np.concatenate([[0], np.cumsum(size)])
        cps = np.frombuffer("".join(distinct).encode("utf-32-le"), np.uint32)
        self.chars, n, wide = cps, len(cps), v.longest
        own = cps == ord(BLANK)
        cps = np.where(cps == 32, np.uint64(ord(BLANK)), np.where(own, np.uint64(0x110000), cps))
        left = np.repeat(self.start[1:], size) - np.arange(n)
        live, h = np.arange(n), np.zeros(n, np.uint64)
        self.longest = longest = np.ones(n, np.int64)
        found = []  # length less one, states and ids of all pieces
        for k in range(wide):
            ok = np.flatnonzero(left.take(live) > k)
            if not len(ok):
                break
            live, h = live.take(ok), h.take(ok)
            h = v.extend(h, cps.take(live + k))
            hit, ids = v.find(h)
            piece = np.flatnonzero(ids != NONE)
            at, ids = live.take(piece), ids.take(piece)
            if not k:
                one = np.full(n, NONE, np.uint16)
                one[at] = ids
                lone = np.flatnonzero(one == NONE)
                chars = self.chars.take(lone)
                one[lone] = np.where(chars < 0x80, v.byte.take(np.minimum(chars, 0x7f).astype(np.int64)), BYTES)
            elif len(at):
                longest[at] = k + 1
                found.append((k, at, ids))
            hit = np.flatnonzero(hit)
            live, h = live.take(hit), h.take(hit)
        end = np.cumsum(longest)
        self.first = first = end - longest
        total = int(end[-1]) if n else 0
        self.pid, self.chance = np.full(total, NONE, np.uint16), np.ones(total)
        if not n:
            return
        self.pid[first] = one
        # Longest units first: the states with d characters left are then those of the first units, in turn, and what
        # follows them after j characters are the first of the states with d - j left.
        most = int(size.max())
        by_size = np.argsort(-size, kind="stable")
        many = np.searchsorted(-size[by_size], -np.arange(1, most + 1), side="right")
        edge = np.concatenate([[0], np.cumsum(many)])
        last = self.start[1:].take(by_size)
        place = np.empty(n, np.int64)  # of each state among the ordered ones
        place[np.concatenate([last[:m] - d for d, m in enumerate(many.tolist(), 1)])] = np.arange(n)
        val = np.full((NARROW, n), -np.inf)
        val[0, place] = v.weight.take(one)
        val[0, place.take(lone)] = v.byte_weight * (1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000))
        # the few states with long pieces are worked out apart, in rows by place
        long = np.flatnonzero(longest > NARROW)
        long = long[np.argsort(place.take(long))]
        at_long = place.take(long)
        long_edge = np.searchsorted(at_long, edge)
        row = np.full(n, -1)
        row[long] = np.arange(len(long))
        apart = np.full((len(long), wide), -np.inf)
        for k, at, ids in found:
            self.pid[first.take(at) + k] = ids
            if k < NARROW:
                val[k, place.take(at)] = v.weight.take(ids)
            else:
                apart[row.take(at), k] = v.weight.take(ids)
        apart[:, :NARROW] = val[:, at_long].T
        beta, edge = np.zeros(n), edge.tolist()
        for d in range(1, most + 1):
            a, b = edge[d - 1:d + 1]
            w = min(NARROW, d)
            p = val[:w, a:b]
            for j in range(w - (d == w)):
                p[j] += beta[edge[d - j - 2]:edge[d - j - 2] + b - a]
            beta[a:b] = self._chances(p)
            c, e = long_edge[d - 1:d + 1]
            if c == e:
                continue
            follow, w = at_long[c:e] - a, min(wide, d)
            p = apart[c:e, :w]
            for j in range(w - (d == w)):
                p[:, j] += beta.take(follow + edge[d - j - 2])
            if w < 8:  # columns apart: sums of so few take their terms in turn either way
                p = np.ascontiguousarray(p.T)
                beta[at_long[c:e]] = self._chances(p)
                apart[c:e, :w] = p.T
                continue
            p = np.ascontiguousarray(p)
            top = p.max(axis=1)
            p = np.exp(p - top[:, None])
            total = p.sum(axis=1)
            p /= total[:, None]
            apart[c:e, :w] = np.cumsum(p, axis=1)
            beta[at_long[c:e]] = top + np.log(total)
        for j in range(NARROW - 1):  # the last entry of a state is 1
            more = np.flatnonzero(longest > j + 1)
            self.chance[first.take(more) + j] = val[j].take(place.take(more))
        self.chance[spans(first.take(long), longest.take(long) - 1)] = apart[np.arange(wide) < longest.take(long)[:, None] - 1]

    @staticmethod
    def _chances(p: np.ndarray) -> np.ndarray:
        """Turn log masses, one column per state, into chances summed from the first row on; returns the log totals."""
        top = p.max(axis=0)
        p -= top
        np.exp(p, out=p)
        total = p.sum(axis=0)
        p /= total
        for j in range(1, len(p)):
            p[j] += p[j - 1]
        return top + np.log(total)

    @property
    def cum(self) -> np.ndarray:
        """``chance`` as a table, one row per state; beyond its entries a row is 1."""
        out = np.ones((len(self.first), max(1, int(self.longest.max(initial=1)))))
        out[np.arange(out.shape[1]) < self.longest[:, None]] = self.chance
        return out


class Rows:
    """An array of rows that grows at its end."""

    def __init__(self, kind, *shape: int):
        self.all, self.n = np.empty((0, *shape), kind), 0

    def add(self, rows: np.ndarray) -> None:
        n = self.n + len(rows)
        if n > len(self.all):
            grown = np.empty((max(n, len(self.all) * 5 // 4), *self.all.shape[1:]), self.all.dtype)
            grown[:self.n] = self.all[:self.n]
            self.all = grown
        self.all[self.n:n] = rows
        self.n = n

    def keep(self, at: np.ndarray) -> None:
        self.all, self.n = self.all[at], len(at)


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[i] to first[i] + size[i] - 1, for all i in turn."""
    at = np.repeat(first - np.cumsum(size) + size, size)
    at += np.arange(len(at))
    return at


class Store:
    """Ids and lattices of units, which are numbered; a unit's states follow each other from ``start``.

    ``near`` is the place of a state's first entry in ``chance`` and ``pid``, which are those of ``Lattice``. Full, it keeps the
    units met in most batches for their size, older batches counting less, half of its bound at most, and those of the
    batch at hand.
    """

    def __init__(self, v: Vocab):
        self.v = v
        self.index, self.met = numbered(), Rows(np.float32)
        self.start, self.size = Rows(np.int32), Rows(np.int32)
        self.first, self.n_ids, self.ids = Rows(np.int32), Rows(np.int32), Rows(np.int32)
        self.near, self.chars = Rows(np.int32), Rows(np.uint32)
        self.chance, self.pid = Rows(np.float64), Rows(np.uint16)

    def number(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The units of the texts in turn by number, and the first of each text and the end."""
        index, of, docs = self.index, [], [0]
        for t in texts:
            of.extend(map(index.__getitem__, units(t)))
            docs.append(len(of))
        of, docs = np.array(of, np.int64), np.array(docs)
        new = list(islice(index, self.start.n, None))
        if self.start.n and (len(index) > KEPT or self.chars.n + sum(map(len, new)) > KEPT_CHARS):
            of = self._compact(of, new)
        for i in range(0, len(new), BUILT):
            self._add(new[i:i + BUILT])
        self.met.all[:self.met.n] += np.bincount(of, minlength=self.met.n) > 0
        return of, docs

    def _add(self, keys: list[str]) -> None:
        enc = self.v._encode(keys)
        n = np.fromiter(map(len, enc), np.int64, len(enc))
        self.first.add(self.ids.n + np.cumsum(n) - n)
        self.n_ids.add(n)
        self.ids.add(np.fromiter(chain.from_iterable(enc), np.int32, int(n.sum())))
        lat = Lattice(list(map(unit, keys)), self.v)
        self.start.add(self.chars.n + lat.start[:-1])
        self.size.add(np.diff(lat.start))
        self.met.add(np.zeros(len(keys)))
        self.near.add(self.pid.n + lat.first)
        self.chars.add(lat.chars)
        self.chance.add(lat.chance)
        self.pid.add(lat.pid)

    def _compact(self, of: np.ndarray, new: list[str]) -> np.ndarray:
        """Keep what is often met and in ``of``, whose new numbers are returned; ``new`` has no rows yet."""
        n = self.start.n
        size = self.size.all[:n]
        often = np.argsort(-self.met.all[:n] / (size + 4), kind="stable")[:KEPT // 2]
        often = often[np.cumsum(size[often]) <= KEPT_CHARS // 2]
        stay = np.zeros(n, bool)
        stay[often] = True
        stay[of[of < n]] = True
        old = np.flatnonzero(stay)
        numbers = np.concatenate([np.cumsum(stay) - 1, len(old) + np.arange(len(new))])
        words, self.index = list(self.index), None
        self.index = numbered(chain(map(words.__getitem__, old.tolist()), new))
        self.ids.keep(spans(self.first.all[old], self.n_ids.all[old]))
        states = spans(self.start.all[old], self.size.all[old])
        entries = np.diff(self.near.all[:self.near.n], append=self.pid.n)[states]
        at = spans(self.near.all[states], entries)
        self.chance.keep(at)
        self.pid.keep(at)
        self.chars.keep(states)
        for x in (self.size, self.n_ids, self.met):
            x.keep(old)
        self.met.all *= 0.9
        for x, size in ((self.start, self.size.all), (self.first, self.n_ids.all), (self.near, entries)):
            x.all, x.n = (np.cumsum(size) - size).astype(np.int32), len(size)
        return numbers[of]

    def best(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of the units in turn, and where each unit's begin, with the end."""
        n = self.n_ids.all[of].astype(np.int64)
        return self.ids.all[spans(self.first.all[of], n)], np.concatenate([[0], np.cumsum(n)])

    def draw(self, st: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each state the next piece at ``r`` of its distribution: characters, probability and id."""
        chance, at = self.chance.all, self.near.all.take(st)
        p = chance.take(at)
        l = np.ones(len(st), np.int8)
        go = np.flatnonzero(r >= p)
        below, here, r = p.take(go), at.take(go), r.take(go)
        while len(go):  # a state's last entry is 1
            here += 1
            upto = chance.take(here)
            l[go] += 1
            p[go] = upto - below
            more = np.flatnonzero(r >= upto)
            go, below, here, r = go.take(more), upto.take(more), here.take(more), r.take(more)
        at += l
        at -= 1
        return l, p, self.pid.all.take(at)

    def probability(self, state: int) -> np.ndarray:
        a = int(self.near.all[state])
        b = int(self.near.all[state + 1]) if state + 1 < self.near.n else self.pid.n
        cum = np.ones((NARROW if b - a <= NARROW else self.v.longest) + 1)
        cum[0], cum[1:b - a + 1] = 0, self.chance.all[a:b]
        return np.diff(cum)

    def piece(self, state: int, length: int) -> int:
        return int(self.pid.all[self.near.all[state] + length - 1])


class Paths:
    """Segmentations of a batch of texts, one per text: piece length, id and probability by character; ``at``: where pieces begin."""

    def __init__(self, n: int):
        self.length, self.ids, self.p = np.zeros(n, np.uint8), np.empty(n, np.uint16), np.ones(n)
        self.at = np.zeros(0, np.int64)


def sample(units: Store, of: np.ndarray, docs: np.ndarray, keys: np.ndarray, k: int):
    """Gumbel top-k of every text. ``of``: unit of each token; ``docs``: first token of each text, and the end.

    Returns per text up to ``k`` tuples (path number, log probability, log inclusion score), the paths, and the
    first character and the first state of each token.
    """
    n_docs = len(docs) - 1
    begin, size = units.start.all[of].astype(np.int64), units.size.all[of].astype(np.int64)
    final = begin + size
    off = np.concatenate([[0], np.cumsum(size)])  # first character of each token
    shift = off[:-1] - begin
    doc = np.repeat(np.arange(n_docs), np.diff(docs))
    seed = keys[doc] + (np.arange(len(of)) - docs[doc]).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    ends = off[docs]  # first character of each text, and the end
    paths: list[Paths] = []

    def walk(path: Paths, first: np.ndarray, state: np.ndarray, turn: int) -> None:
        """Fill ``path`` for the tokens ``first`` from ``state`` to each token's end."""
        act, st, end, step = first, state, final[first], 0
        ok = np.flatnonzero(st < end)
        if len(ok) < len(act):
            act, st, end = act[ok], st[ok], end[ok]
        base, far = seed[act] + np.uint64(turn * 0xA0761D6478BD642F % 2**64), shift[act]
        while len(st):
            l, p, pid = units.draw(st, uniform(base + np.uint64(step * 0xE7037ED1A0B428DB % 2**64)))
            g = st + far
            path.length[g], path.ids[g], path.p[g] = l, pid, p
            st = st + l
            ok = np.flatnonzero(st < end)
            st, end, base, far, step = st.take(ok), end.take(ok), base.take(ok), far.take(ok), step + 1

    queues: list[list] = [[] for _ in range(n_docs)]
    found: list[list] = [[] for _ in range(n_docs)]
    tie = 0

    def settle(turn: int, live: list[int], start: dict[int, tuple]) -> None:
        """Log probabilities of the new paths, and in the queues the regions that leave them at one edge."""
        nonlocal tie
        path = paths[turn]
        at_all = path.at = np.flatnonzero(path.length != 0)
        logs_all = np.log(np.maximum(path.p.take(at_all), 1e-300))
        edge = np.searchsorted(at_all, ends).tolist()
        owner, cuts, prefixes, values = [], [], [], []
        for d in live:
            first, last = edge[d:d + 2]
            logs = logs_all[first:last]
            value, left = start[d]
            found[d].append([turn, float(logs.sum()), value])
            if first == last:
                continue
            s = int(at_all[first:last].searchsorted(left, side="right")) if left >= 0 else 0
            if s == len(logs):
                continue
            many = s + 128
            while True:  # until a region is too faint; mostly at once
                prefix = np.zeros(min(many, len(logs)))
                np.add.accumulate(logs[:len(prefix) - 1], out=prefix[1:])
                e = s + np.count_nonzero(prefix[s:] > prefix[s] - FAINT) + 1
                if e <= len(prefix) or len(prefix) == len(logs):
                    break
                many *= 2
            owner.append(d)
            cuts.append((first + s, min(first + e, last)))
            prefixes.append(prefix[s:e])
            values.append(value)
        if not owner:
            return
        # the edges of all texts at once: ``of_text`` is the text's number among ``owner``
        lo, hi = np.array(cuts).T
        edges, of_text, prefix = spans(lo, hi - lo), np.repeat(np.arange(len(lo)), hi - lo), np.concatenate(prefixes)
        rest = -np.expm1(logs_all.take(edges))
        mass = prefix + np.log(np.maximum(rest, 1e-300))
        most = np.maximum.reduceat(mass, np.cumsum(hi - lo) - (hi - lo))
        use = np.flatnonzero((rest > 1e-14) & (mass > most.take(of_text) - FAINT))
        of_text, prefix, at, text = of_text.take(use), prefix.take(use), at_all.take(edges.take(use)), np.array(owner)
        text = text.take(of_text)
        u = uniform(keys[text] + np.uint64((turn + 1) * 0x8EBC6AF09C88C6E3 % 2**64) + (at - ends[text]).astype(np.uint64) * np.uint64(0x589965CC75374CC3))
        cut = -np.logaddexp(-np.array(values).take(of_text), np.log(-np.log(u)) - mass.take(use))
        order = np.lexsort((-cut, of_text))
        rank = np.arange(len(order)) - np.searchsorted(of_text, of_text)  # sorted by text before and after
        order = order[rank <= k]
        for d, c, a, x in zip(text.take(order).tolist(), cut.take(order).tolist(), at.take(order).tolist(), prefix.take(order).tolist()):
            tie += 1
            heapq.heappush(queues[d], (-c, tie, turn, a, (), x))

    def noise(d: np.ndarray, at: np.ndarray, salt: int) -> list[float]:
        """One uniform number for each character ``at`` of the texts ``d``."""
        return uniform(keys[d] + np.uint64(salt) + (at - ends[d]).astype(np.uint64)).tolist()

    g0 = -np.log(-np.log(uniform(keys)))
    path = Paths(int(off[-1]))
    paths.append(path)
    every = np.arange(len(of))
    walk(path, every, begin, 0)
    settle(0, list(range(n_docs)), {d: (float(g0[d]), -1) for d in range(n_docs)})
    for turn in range(1, k):
        live, start, first, state = [], {}, [], []
        path = Paths(int(off[-1]))
        paths.append(path)
        ds = np.array([d for d in range(n_docs) if queues[d]], np.int64)
        best = [heapq.heappop(queues[d]) for d in ds]
        ats = np.array([x[3] for x in best], np.int64)
        ts = np.searchsorted(off, ats, side="right") - 1
        draws, others = noise(ds, ats, turn * 0x9FB21C651E98DF25 % 2**64), noise(ds, ats, turn * 0xC6BC279692B5C323 % 2**64)
        for d, (value, _, old, at, gone, before), t, st, u, other in zip(
                ds.tolist(), best, ts.tolist(), (ats - shift[ts]).tolist(), draws, others):
            p = units.probability(st)
            gone = (*gone, int(paths[old].length[at]) - 1)
            q = p.copy()
            q[list(gone)] = 0
            total = q.sum()
            if total <= 0:
                continue
            l = int(np.searchsorted(np.cumsum(q), u * total, side="right"))
            l = min(l, int(np.flatnonzero(q)[-1]))
            a, b = int(ends[d]), at
            for x in ("length", "ids", "p"):
                getattr(path, x)[a:b] = getattr(paths[old], x)[a:b]
            path.length[at], path.ids[at], path.p[at] = l + 1, units.piece(st, l + 1), p[l]
            live.append(d)
            start[d] = (-value, at)
            first.append(np.arange(t, int(docs[d + 1])))
            state.append(np.concatenate([[st + l + 1], begin[t + 1:int(docs[d + 1])]]))
            # what leaves the old path at this edge by yet another piece
            rest = 1.0 - p[list(gone)].sum() - p[l]
            if rest > 1e-14:
                cut = -np.logaddexp(value, -(before + np.log(rest) - np.log(-np.log(other))))
                tie += 1
                heapq.heappush(queues[d], (-cut, tie, turn, at, gone, before))
        if live:
            walk(path, np.concatenate(first), np.concatenate(state), turn)
            settle(turn, live, start)
    out = []
    for d in range(n_docs):
        threshold = -queues[d][0][0] if queues[d] else -np.inf
        got = []
        for turn, logp, _ in found[d]:
            x = logp - threshold  # log of 1 - exp(-exp(x))
            got.append((turn, logp, 0.0 if x > 4 else float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else float(x)))
        out.append(got)
    return out, paths, off, begin


def path_ids(units: Store, path: Paths, off: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts' paths and where each text's begin; unknown characters are spelled in bytes."""
    at = path.at
    ids = path.ids.take(at).astype(np.int32)
    edge = np.searchsorted(at, ends)
    odd = np.flatnonzero(ids == BYTES)
    if len(odd):
        token = np.searchsorted(off, at[odd], side="right") - 1
        raws = [chr(c).encode() for c in units.chars.all[at[odd] - off[token] + begin[token]].tolist()]
        n = np.ones(len(ids), np.int64)
        n[odd] = list(map(len, raws))
        new = np.concatenate([[0], np.cumsum(n)])
        out = np.repeat(ids, n)
        for i, raw in zip(odd, raws):
            out[new[i]:new[i] + len(raw)] = units.v.byte[list(raw)]
        return out, new[edge]
    return ids, edge


def encode_batch(texts: list[str], keys: np.ndarray, k: int, v: Vocab):
    """Ids of every text and its sampled segmentations: (ids, starts), per text [(ids, log p, log inclusion)]."""
    of, docs = v.store.number(texts)
    best, begin = v.store.best(of)
    got, paths, off, first = sample(v.store, of, docs, keys, k)
    ids = [path_ids(v.store, p, off, first, off[docs]) for p in paths]
    samples = [[(ids[r][0][ids[r][1][d]:ids[r][1][d + 1]], lp, li) for r, lp, li in g] for d, g in enumerate(got)]
    return best, begin[docs], samples


def round_trips(texts: list[str], ids: np.ndarray, begin: np.ndarray, v: Vocab) -> list[bool]:
    """Whether each text's ids decode to it; all texts at once if they do."""
    if v.spell(ids) == "".join(" " + t for t in texts if t).encode():
        return [True] * len(texts)
    every = ids.tolist()
    return [v.decode(every[a:b]) == t.encode() for t, a, b in zip(texts, begin, begin[1:])]


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(parts) if parts else np.zeros(0), kind))


#: Columns that encoding adds.
ADDED = (("ids", "array<int>"), ("sampled", "array<array<int>>"), ("log_prob", "array<double>"), ("log_inclusion", "array<double>"),
         ("round_trip", "boolean"))


def with_pieces(df: DataFrame, id_col: str, text_col: str, k: int = 2, model: str = MODEL,
                keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``df`` with ids, sampled, log_prob, log_inclusion and round_trip (an underscore follows a name that
    ``df`` has).

    ``ids`` is the library's encoding; ``sampled`` has up to ``k`` distinct segmentations drawn without
    replacement, best perturbed value first (fewer where fewer exist), with their log probabilities and log
    inclusion scores. ``round_trip`` tells whether ``ids`` decode to the text, which they always should; the
    samples do by construction, as each edge of the lattice spells its characters. A null or empty text has no ids and one empty sample. Null ids
    and repeated rows stay rows; rows of equal id and text get equal samples; an empty table gives no rows.
    Texts are encoded whole.
    """
    key, text, *names = fresh(df, "key", "plain", *[n for n, _ in ADDED])
    kept = df.select(*(df.columns if keep is None else keep))
    width = len(kept.columns)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab(model)
        try:
            yield from encoded(it, v)
        finally:  # an idle worker keeps the vocabulary alone
            v.store = Store(v)
            give_back()

    def encoded(it: Iterator[pa.RecordBatch], v: Vocab) -> Iterator[pa.RecordBatch]:
        def flush(rows: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            keys = np.asarray(rows.column(width)).astype(np.int64).view(np.uint64)
            best, begin, got = encode_batch(texts, keys, k, v)
            each = [ids for g in got for ids, _, _ in g]
            outer = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
            return pa.RecordBatch.from_arrays([
                *rows.columns[:width], pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(best, pa.int32())),
                pa.ListArray.from_arrays(pa.array(outer), _lists(each, pa.int32())),
                *(pa.ListArray.from_arrays(pa.array(outer), pa.array([x[i] for g in got for x in g], pa.float64())) for i in (1, 2)),
                pa.array(round_trips(texts, best, begin, v))],
                [*rows.schema.names[:width], *names])

        for b in it:
            texts, begin, held = [], 0, 0
            for at in range(0, b.num_rows, ROWS):
                for i, t in enumerate(b.column(width + 1).slice(at, ROWS).to_pylist(), at + 1):
                    texts.append(t)
                    held += t.count(" ") + t.count("\n") + 1
                    if held > BATCH or i == b.num_rows:
                        yield flush(b.slice(begin, i - begin), texts)
                        texts, begin, held = [], i, 0

    rows = df.select(*kept.columns, F.xxhash64(id_col, text_col).alias(key), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text))
    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, (_, t) in zip(names, ADDED))).fields])
    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]))


def encode(df: DataFrame, id_col: str, text_col: str, k: int = 2, model: str = MODEL) -> DataFrame:
    """``with_pieces`` of one row (id) per row of ``df``; a null text counts as empty, other columns are ignored."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return with_pieces(rows, "id", "text", k, model, keep=["id"])


def decode(ids: Column, model: str = MODEL) -> Column:
    """The text of piece ids; null stays null, no ids give the empty text."""
    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        v = vocab(model)
        return col.map(lambda x: None if x is None else v.decode(x.tolist()).decode("utf-8", "replace"))

    return run(ids)
