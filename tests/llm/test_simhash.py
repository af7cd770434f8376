import random

import numpy as np
import pytest
import xxhash

from basketry.llm import simhash
from basketry.llm.simhash import fingerprint, keep_one, near_links, simhash_groups

from basketry.llm.components import connected_components


def plain_fp(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    sh = [b" ".join(ws[i:i + 4]) for i in range(len(ws) - 3)] or [b" ".join(ws)]
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_groups(fps, bits=4):
    """Smallest member linked to each, by all pairs."""
    par = {f: f for f in fps}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    fs = sorted(fps)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                par[max(x, y)] = min(x, y)
    return {f: find(f) for f in fs}


def test_fingerprint_matches_plain():
    rnd = random.Random(1)
    for n in (0, 1, 3, 4, 5, 50, 700):
        t = " ".join(rnd.choice(["Ab", "cé", "x", "Ét", "of"]) for _ in range(n))
        assert fingerprint(t.encode()) % 2**64 == plain_fp(t)


@pytest.mark.parametrize("shard,chunk", [(16_384, 200_000), (64, 200_000), (64, 150)])
def test_links_connect_exactly_the_near_groups(spark, shard, chunk):
    rnd = random.Random(shard + chunk)
    fps = {rnd.getrandbits(64) for _ in range(400)}
    for f in list(fps)[:60]:  # chains: each step flips up to 6 bits
        for _ in range(4):
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                f ^= 1 << b
            fps.add(f)
    hub = rnd.getrandbits(64)  # a dense group
    fps |= {hub ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(300)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node % 2**64: r.comp % 2**64 for r in connected_components(near_links(df, 4, 4, shard, chunk)).collect()}
    want = plain_groups(fps)
    groups = lambda m: sorted(sorted(x for x in m if m[x] == c) for c in set(m.values()))
    assert groups({f: got.get(f, f) for f in fps}) == groups(want)


def test_dense_group_without_splits():
    rng = np.random.default_rng(3)
    base = np.uint64(0x123456789ABCDEF0)
    fps = np.unique(base ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64))
                    ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)))
    lab = simhash.linked_groups(fps, np.ones(len(fps), bool), 0xFFFF, 1, 4)
    assert set(lab) == {0}


ROWS = [(5, "a b c d e f g h"), (2, "A B c d e f g h"), (9, None), (7, ""), (None, " \t\n"), (3, "x y"), (3, "x y"),
        (11, "w" * 100_000 + " z " * 5000), (None, "only null id here and some words more")]


def test_groups_edge_cases(docs):
    got = simhash_groups(docs(ROWS), "doc_id", "text").collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert by[5][0].component == by[2][0].component == 2
    assert by[9][0].component == by[7][0].component == 7 and by[9][0].fp == 0
    assert [r.component for r in by[3]] == [3, 3] and by[11][0].component == 11
    assert sorted(r.component for r in by[None] if r.fp == 0) == [7]
    assert [r.component for r in by[None] if r.fp != 0] == [None]
    assert simhash_groups(docs([]), "doc_id", "text").count() == 0


def test_keep_one(docs):
    got = keep_one(docs(ROWS, extra="fp"), "doc_id", "text")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [
        (False, 2), (False, 3), (False, 7), (False, 11), (True, 0)]


def test_query_against_all_pairs(spark):
    from basketry.llm.queries import op9_simhash_dedup
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: plain_fp(r.text) for r in rows}
    comp = plain_groups(set(fps.values()))
    least = {}
    for i, f in fps.items():
        least[comp[f]] = min(i, least.get(comp[f], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op9_simhash_dedup(spark, sf).collect()}
    assert got == {i: (f"{f:016x}", least[comp[f]]) for i, f in fps.items()}
