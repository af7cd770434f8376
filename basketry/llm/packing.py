"""Pack documents into sequences by hierarchical multi-length packing.

A document is cut into full windows of the longest tier; its rest is routed to the shortest tier that holds
it. Tiers are packed from the longest down: a window is opened by the longest rest of its own tier, its gap is
filled with the longest rests that fit from shorter tiers, and what still gapes takes the head of the shortest
longer rest, whose tail is routed again. So every window is full; only the last one of a group of documents is
split into windows that are smaller powers of two. Finished windows, long and short, are dealt to step groups of
equal tokens.

A task tokenises and packs its own documents in groups bounded by GROUP_TOKENS, so nothing is shuffled, no
token is kept beyond its group, and a task that runs again on the same rows gives the same pieces.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Window sizes, longest first; each is a power of two and half the one before.
TIERS = (2048, 1024, 512, 256)
#: Tokens of documents packed together, and of one step group.
GROUP_TOKENS, STEP_TOKENS = 1 << 22, 64 * 2048
#: The published splitting pattern of byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: A text without these has settled characters only.
_RARE = re.compile("[\x1c-\x1f\x85\u0220-\U0010ffff]")


@lru_cache(maxsize=1)
def unsettled() -> re.Pattern:
    """Characters that two engines may class differently: those not yet assigned in Unicode 3.2, and odd white space."""
    new, ranges = unicodedata.ucd_3_2_0.category, []
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (new(chr(c)) == "Cn" or c in (0x85, 0x180E, 0x200B, 0xFEFF) or 0x1C <= c < 0x20):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]")


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary of a tokenizer file as ranks of byte strings, if it is a plain byte-level one whose ids follow
    the order of its merges; else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    special = {t["content"] for t in spec["added_tokens"]}
    if (spec.get("normalizer") or spec.get("post_processor") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
            or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges")):
        return None
    # the byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    joined = [vocab.get(m.replace(" ", "")) for m in merges]
    if joined != list(range(256, 256 + len(merges))) or len(vocab) != 256 + len(merges):
        return None
    return {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items()}


class Encoder:
    """Ids of texts as the tokenizers library gives them. Where it can be shown to give the same, the faster engine for
    byte ranks does the work: in texts without special tokens whose characters all engines class alike."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        ranks = byte_ranks(path)
        self.fast = ranks and tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str, end: int) -> np.ndarray:
        """The ids of ``text`` and the id ``end``."""
        got = None
        if self.fast and not any(s in text for s in self.special) and not (_RARE.search(text) and unsettled().search(text)):
            try:
                got = self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its splitting gives up on very long runs of white space
                pass
        if got is None:
            got = self.library.encode(text, add_special_tokens=False).ids
        return np.append(np.asarray(got, "<u4"), np.array([end], "<u4"))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Rests:
    """Pieces by length, with the longest one up to a length, or the shortest above it, at hand."""

    def __init__(self, pieces: list[tuple[int, int, int]]):
        self.of, self.mask = defaultdict(list), 0
        for p in reversed(pieces):
            self.add(p)

    def add(self, piece: tuple[int, int, int]) -> None:
        self.of[piece[2]].append(piece)
        self.mask |= 1 << piece[2]

    def up_to(self, n: int) -> int:
        return max(0, (self.mask & ((1 << (n + 1)) - 1)).bit_length() - 1)

    def above(self, n: int) -> int:
        rest = self.mask >> (n + 1)
        return (rest & -rest).bit_length() + n if rest else 0

    def take(self, n: int) -> tuple[int, int, int]:
        held = self.of[n]
        if len(held) == 1:
            self.mask &= ~(1 << n)
        return held.pop()


def pack(pieces: list[tuple[int, int, int]], tiers: tuple[int, ...] = TIERS) -> Iterator[tuple[int, list]]:
    """Windows (size, pieces) from pieces (document, start, length), none longer than the first tier.

    Every window is full and its size a tier, but for those of the last, unfinished window, which are the powers of
    two that make up its length. Equal lengths are taken in the order given.
    """
    rests = Rests(pieces)
    for size, shorter in zip(tiers, [*tiers[1:], 0]):
        while (n := rests.up_to(size)) > shorter:
            window, gap = [rests.take(n)], size - n
            while gap and rests.mask:
                if n := rests.up_to(gap):
                    window.append(rests.take(n))
                    gap -= n
                else:
                    doc, start, n = rests.take(rests.above(gap))
                    window.append((doc, start, gap))
                    rests.add((doc, start + gap, n - gap))
                    gap = 0
            if gap:
                yield from _powers(window, size - gap)
            else:
                yield size, window


def _powers(window: list, length: int) -> Iterator[tuple[int, list]]:
    """An unfinished window as full windows whose sizes are the powers of two of its length."""
    rest = window[::-1]
    for bit in range(length.bit_length() - 1, -1, -1):
        if length >> bit & 1:
            part, room = [], 1 << bit
            while room:
                doc, start, n = rest.pop()
                part.append((doc, start, min(n, room)))
                if n > room:
                    rest.append((doc, start + room, n - room))
                room -= min(n, room)
            yield 1 << bit, part


def steps(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step for each window: windows go, longest first, to the step that has the fewest tokens so far."""
    out = [0] * len(sizes)
    least = [(0, s) for s in range(max(1, round(sum(sizes) / step_tokens)))]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        tokens, step = least[0]
        out[i] = step
        heapq.heapreplace(least, (tokens + sizes[i], step))
    return out


class _Group:
    """Documents of a task that are packed together."""

    def __init__(self):
        self.ids, self.sizes, self.rests, self.full, self.tokens = [], [], {}, [], 0

    def add(self, doc_id, ids: np.ndarray, window: int) -> None:
        doc, n = len(self.ids), len(ids)
        self.ids.append(doc_id)
        self.sizes.append(n)
        self.tokens += n
        whole = n - n % window
        self.full += [(doc, at, zlib.crc32(ids[at:at + window])) for at in range(0, whole, window)]
        if whole < n:
            self.rests[doc] = whole, ids[whole:].copy()

    def rows(self, tiers: tuple[int, ...], step_tokens: int, first: int, first_step: int):
        """Lists of (document, start, length, crc, sequence, offset, window, step), and how many windows and steps."""
        windows = [(tiers[0], [(doc, at, tiers[0], crc)]) for doc, at, crc in self.full]
        rests = [(doc, whole, len(ids)) for doc, (whole, ids) in self.rests.items()]
        for size, window in pack(rests, tiers):
            part = []
            for doc, start, n in window:
                whole, ids = self.rests[doc]
                part.append((doc, start, n, zlib.crc32(ids[start - whole:start - whole + n])))
            windows.append((size, part))
        step = steps([size for size, _ in windows], step_tokens)
        out = []
        for i, (size, part) in enumerate(windows):
            at = 0
            for doc, start, n, crc in part:
                out.append((doc, start, n, crc, first + i, at, size, first_step + step[i]))
                at += n
        return out, len(windows), max(step, default=-1) + 1


def pack_documents(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER, end: int = 1,
                   tiers: tuple[int, ...] = TIERS, group_tokens: int = GROUP_TOKENS,
                   step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_id.

    Each token of each row of ``df`` lies in exactly one piece, each window is full, and a sequence's length is
    always a power of two. A null or empty text has the end id alone; null ids and repeated rows are documents like
    any other; an empty table gives no rows; other columns are ignored. Which rows share a window follows the
    table's partitions, so ids of sequences and steps are unique within one result only.
    """
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type)] + [T.StructField(c, T.LongType()) for c in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_id")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(tokenizer).ids, TaskContext.get().partitionId() << 33
        sequence = step = base
        group, kind = _Group(), None

        def close() -> pa.RecordBatch:
            nonlocal sequence, step, group
            rows, n_windows, n_steps = group.rows(tiers, step_tokens, sequence, step)
            cols = np.array(rows, np.int64).reshape(-1, 8).T
            ids = pa.array(group.ids, kind).take(pa.array(cols[0]))
            tokens = np.array(group.sizes, np.int64)[cols[0]]
            sequence, step, group = sequence + n_windows, step + n_steps, _Group()
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in (*cols[1:4], tokens, *cols[4:]))],
                                              names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                group.add(doc_id, encode(text.as_py(), end), tiers[0])
                if group.tokens >= group_tokens:
                    yield close()
        if group.ids:
            yield close()

    return df.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(run, schema)
