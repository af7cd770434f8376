import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from basketry.llm import packing
from basketry.llm.queries import QUERIES

LIBRARY = Tokenizer.from_file(packing.TOKENIZER)


def plain_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, docs, most=2048):
    """Every token once, checksums by the library's ids, offsets gapless, lengths powers of two."""
    want = Counter()
    for doc_id, text in docs:
        ids = np.array(plain_ids(text), "<u4")
        want[doc_id, len(ids), zlib.crc32(ids)] += 1
    ids_of = {(d, len(i)): i for d, i in ((d, np.array(plain_ids(t), "<u4")) for d, t in docs)}
    sequences, covered = defaultdict(list), Counter()
    for r in rows:
        ids = ids_of[r["id"], r["doc_tokens"]]
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]]) and r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["window"], r["step_id"]))
        covered.update(((r["id"], r["doc_tokens"], p) for p in range(r["start"], r["start"] + r["length"])))
    copies = Counter((d, len(plain_ids(t))) for d, t in docs)
    assert covered == Counter({(d, n, p): c for (d, n), c in copies.items() for p in range(n)})
    for parts in sequences.values():
        at = 0
        for offset, n, *_ in sorted(parts):
            assert offset == at
            at += n
        assert at == parts[0][2] <= most and at & (at - 1) == 0 and len(set(p[2:] for p in parts)) == 1
    return sequences


def test_ids_are_the_librarys():
    e = packing.Encoder(packing.TOKENIZER)
    rnd = random.Random(3)
    alphabet = ["a", "b", "The", "'s", "'", "1", "23", ".", ",", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2003", "\u3000",
                "\u200b", "\u1680", "\u2028", "\u00e9", "\u00df", "\u4e2d", "\u6587", "\U0001f600", "\u0301", "<|endoftext|>", "<|endo", "\u00bd", "\u0663", "\x00", "don't", "_"]
    rare = [chr(c) for c in (0x378, 0x1E9E, 0x2C2F, 0xA7AF, 0x10D00, 0x1F9D0, 0x31350, 0x1E900, 0x16E40, 0x2E80, 0x660, 0x9FFF, 0x3400)]
    alphabet += rare
    texts = [" " * 2_000_000 + "a", "x" * 50_000, "ab " * 20_000, "", " ", "\n\n", "a  b", "x <|endoftext|>  y"] + ["".join(rnd.choices(alphabet, k=rnd.randrange(1, 40))) for _ in range(4000)]
    for t in texts:
        assert e.ids(t, 1).tolist() == plain_ids(t), repr(t[:60])
    # the fast engine alone agrees wherever it may be asked
    assert e.fast and sum(not packing.unsettled().search(t) for t in texts) > 250
    assert packing.byte_ranks(packing.TOKENIZER)[b" the"] == LIBRARY.token_to_id("\u0120the")


@pytest.mark.parametrize("seed", range(6))
def test_pack_fills_every_window(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([1, 255, 256, 257, 600, 1024, 1025, 1500, 2047]) if seed % 2 else rnd.randrange(1, 2048) for _ in range(rnd.randrange(0, 400))]
    windows = list(packing.pack([(i, 0, n) for i, n in enumerate(sizes)]))
    seen = Counter()
    for size, parts in windows:
        assert sum(p[2] for p in parts) == size and size & (size - 1) == 0
        seen.update((d, x) for d, s, n in parts for x in range(s, s + n))
    assert seen == Counter((i, x) for i, n in enumerate(sizes) for x in range(n))
    assert sum(size not in packing.TIERS for size, _ in windows) <= 8
    # a window of a tier is opened by a piece that is too long for the next tier
    for size, parts in windows:
        if size in packing.TIERS[:-1]:
            assert max(p[2] for p in parts) > size // 2


def test_step_groups_are_balanced():
    rnd = random.Random(1)
    sizes = [rnd.choice(packing.TIERS) for _ in range(3000)]
    total = Counter()
    for size, step in zip(sizes, packing.steps(sizes, 65_536)):
        total[step] += size
    assert len(total) == round(sum(sizes) / 65_536) and max(total.values()) - min(total.values()) <= 2048


def test_every_token_in_one_piece(spark, docs):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefg", k=rnd.randrange(1, 9)))
    rows = [(i, " ".join(word() for _ in range(rnd.randrange(0, 400)))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (None, None), (None, "no id"), (7, rows[7][1]), (7, "another text"), (1002, "long text " * 30_000)]
    got = packing.pack_documents(docs(rows, extra="window"), "doc_id", "text", group_tokens=20_000, step_tokens=8192).collect()
    sequences = check(got, rows)
    tokens = sum(len(plain_ids(t)) for _, t in rows)
    assert sum(p[0][2] for p in sequences.values()) == tokens
    assert sum(p[0][2] >= 256 for p in sequences.values()) > len(sequences) / 2


def test_empty_table(spark, docs):
    assert packing.pack_documents(docs([]), "doc_id", "text").count() == 0


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = [r.asDict() | {"id": r["doc_id"]} for r in QUERIES["op12_pack_sequences"](spark, sf).collect()]
    check(got, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
