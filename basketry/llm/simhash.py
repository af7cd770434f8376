"""SimHash near-duplicates: exact pairs by a forest of vantage-point trees.

A single VP tree over 64-bit fingerprints cannot prune at radius 4: distances to any vantage point
crowd round 32 +- 4, so a ball of radius 4 straddles about three of four median splits. The forest
therefore splits the bits into ``blocks`` groups. Two fingerprints within ``max_bits`` agree within
``max_bits // blocks`` on at least one group, and each group has its own VP tree under the Hamming
distance restricted to its bits, where the radius is small. Vantage points and cuts of the top levels
come from a bounded sample of fingerprints and only shape the shards; the result is exact for any tree.

Every fingerprint goes to its home shard of each tree and, by the triangle bound, to each earlier
shard that its ball overlaps. Inside a shard the tree goes on until leaves are small, and full
64-bit distances decide. A shard emits a spanning star per linked group, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import fresh, join_spread, stored, utf8, with_row
from basketry.llm.components import connected_components

#: Fingerprints a shard aims at; rows of a shard beyond CHUNK are dealt to a grid of tasks.
SHARD, CHUNK = 16_384, 200_000
#: Fingerprints sampled to shape the trees, and the most levels of a top tree (2^12 shards a block).
SAMPLE, MAX_LEVELS = 20_000, 12
LEAF = 64
_H = xxhash.xxh64_intdigest


def fingerprint(text: bytes, k: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of ASCII-lower-cased ``k``-word shingles, as a signed long.

    Repeated shingles count each time; fewer than ``k`` words make one shingle; no word gives 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= k:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(k)))), len(words) - k + 1
    h = np.fromiter(map(_H, shingles, repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65_536):
        bits = np.unpackbits(h[i:i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def with_fingerprint(df: DataFrame, text_col: str, out: str, k: int = 4, seed: int = 42) -> DataFrame:
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, k, seed) for t in texts], dtype="int64")

    return df.withColumn(out, fp(utf8(text_col)))


def _masks(blocks: int) -> list[int]:
    edge = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edge, edge[1:])]


def _dist(x: np.ndarray, v, mask) -> np.ndarray:
    return np.bitwise_count((x ^ v) & np.uint64(mask)).astype(np.int16)


def _vantage(x: np.ndarray, mask: int, radius: int, rng) -> tuple[np.uint64, int]:
    """Of a few members, the vantage point whose median cut is straddled least and splits best."""
    best = None
    for v in rng.choice(x, min(4, len(x)), replace=False):
        d = _dist(x, v, mask)
        for cut in {int(np.median(d)), int(np.median(d)) - 1}:
            left = int((d <= cut).sum())
            cost = max(left, len(x) - left) + int((np.abs(d * 2 - 2 * cut - 1) <= 2 * radius).sum()) / 2
            if best is None or cost < best[0]:
                best = cost, v, cut
    return best[1], best[2]


def top_trees(sample: np.ndarray, blocks: int, levels: int, radius: int) -> list[list[tuple[int, int]]]:
    """Per block, ``2^levels`` nodes in heap order (the root is 1): vantage point and cut."""
    rng, trees = np.random.default_rng(7), []
    for mask in _masks(blocks):
        nodes = [(0, 0)] * (1 << levels)
        todo = [(1, sample)]
        while todo:
            i, x = todo.pop()
            if i >= len(nodes):
                continue
            v, cut = _vantage(x, mask, radius, rng) if len(x) >= 8 else (rng.integers(0, 1 << 63, dtype=np.uint64), mask.bit_count() // 2 - 1)
            nodes[i] = int(v), int(cut)
            left = _dist(x, v, mask) <= cut
            todo += [(2 * i, x[left]), (2 * i + 1, x[~left])]
        trees.append(nodes)
    return trees


def _route(fps: np.ndarray, trees, levels: int, radius: int, blocks: int):
    """(row, block, leaf, home) of the shards that each fingerprint visits.

    A ball that reaches over a cut also goes to the other side, but only leftwards of its home: of two
    fingerprints in different home shards, the one whose home comes later visits the other's home.
    """
    for b, (mask, nodes) in enumerate(zip(_masks(blocks), trees)):
        vant = np.array([n[0] for n in nodes], np.uint64)
        cuts = np.array([n[1] for n in nodes], np.int16)
        row, node, home = np.arange(len(fps)), np.ones(len(fps), np.int64), np.ones(len(fps), bool)
        for _ in range(levels):
            d, cut = _dist(fps[row], vant[node], mask), cuts[node]
            own_left = d <= cut
            left = np.where(home, own_left | (d - radius <= cut), d - radius <= cut)
            right = np.where(home, ~own_left, d + radius > cut)
            row, node, home = (np.concatenate([row[left], row[right]]),
                               np.concatenate([2 * node[left], 2 * node[right] + 1]),
                               np.concatenate([home[left] & own_left[left], home[right]]))
        yield row, np.full(len(row), b, np.int32), (node - (1 << levels)).astype(np.int32), home


def spanning_star(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index linked to each of ``n`` items by the links (a, b)."""
    lab = np.arange(n)
    while len(a):
        lo, hi = np.minimum(lab[a], lab[b]), np.maximum(lab[a], lab[b])
        live = lo != hi
        if not live.any():
            break
        a, b = a[live], b[live]
        np.minimum.at(lab, hi[live], lo[live])
        while (nxt := lab[lab]).tolist() != lab.tolist() if n < 64 else not np.array_equal(nxt := lab[lab], lab):
            lab = nxt
    return lab


def linked_groups(fps: np.ndarray, home: np.ndarray, mask: int, radius: int, max_bits: int) -> np.ndarray:
    """Labels (smallest index) of groups linked by pairs within ``max_bits`` of which one is at home."""
    n, rng = len(fps), np.random.default_rng(11)
    links_a, links_b, held = [], [], 0

    def link(a, b):
        nonlocal links_a, links_b, held
        if len(a):
            links_a.append(a)
            links_b.append(b)
            held += len(a)
            if held > 2_000_000:  # keep a spanning star only
                lab = spanning_star(n, np.concatenate(links_a), np.concatenate(links_b))
                off = np.flatnonzero(lab != np.arange(n))
                links_a, links_b, held = [off], [lab[off]], len(off)

    todo = [(np.arange(n), home)]
    while todo:
        rows, own = todo.pop()
        n_own = int(own.sum())
        if n_own == 0 or len(rows) < 2:
            continue
        x = fps[rows]
        if n_own <= LEAF:
            mine = rows[own]
            for i in range(0, len(rows), 65_536):
                part = rows[i:i + 65_536]
                hit = np.bitwise_count(fps[mine][:, None] ^ fps[part][None, :]) <= max_bits
                p, q = np.nonzero(hit)
                keep = mine[p] != part[q]
                link(mine[p[keep]], part[q[keep]])
            continue
        v, cut = _vantage(x[own][:4096], mask, radius, rng)
        d = _dist(x, v, mask)
        left = d <= cut
        to_left = np.where(own, left | (d - radius <= cut), d - radius <= cut)
        to_right = np.where(own, ~left, d + radius > cut)
        n_left, n_right = int((own & left).sum()), int((own & ~left).sum())
        if min(n_left, n_right) * 16 < n_own or int(to_left.sum()) + int(to_right.sum()) > 1.8 * len(rows):
            # too dense to split: grow each group from a member; what is reached leaves the rest,
            # so a dense group costs little more than one look at each member
            rest, queue = rows, []
            while len(rest) or queue:
                if not queue:
                    queue, rest = [rest[0]], rest[1:]
                    continue
                at = queue.pop()
                near = np.bitwise_count(fps[rest] ^ fps[at]) <= max_bits
                if near.any():
                    got, rest = rest[near], rest[~near]
                    link(np.full(len(got), at), got)
                    queue.extend(got.tolist())
            continue
        todo.append((rows[to_left], (own & left)[to_left]))
        todo.append((rows[to_right], (own & ~left)[to_right]))
    if not links_a:
        return np.arange(n)
    return spanning_star(n, np.concatenate(links_a), np.concatenate(links_b))


def near_links(fps: DataFrame, max_bits: int = 4, blocks: int = 4, shard: int = SHARD,
               chunk: int = CHUNK) -> DataFrame:
    """``fps`` (fp: long, distinct) -> links (a, b) that span every group of fingerprints within
    ``max_bits`` of each other: connected by them exactly when connected by all such pairs."""
    radius, masks = max_bits // blocks, _masks(blocks)
    n = fps.count()
    levels = min(MAX_LEVELS, max(0, (max(n, 1) // shard).bit_length()))
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()] if levels else [0],
                      np.int64).view(np.uint64)
    trees = top_trees(sample, blocks, levels, radius)

    def route(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            x = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            for row, b, leaf, home in _route(x, trees, levels, radius, blocks):
                yield pd.DataFrame({"block": b, "leaf": leaf, "home": home, "fp": x[row].view(np.int64)})

    routed = fps.select("fp").mapInPandas(route, "block int, leaf int, home boolean, fp long")
    # shards beyond a task's size (a dense group): a grid of tasks, each with two parts of the shard
    sizes = routed.groupBy("block", "leaf").count().filter(F.col("count") > chunk).select(
        "block", "leaf", F.ceil(F.col("count") / chunk).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp", F.lit(1)), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = (routed.join(sizes, ["block", "leaf"], "left").withColumn("p", part)
             .withColumn("o", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
             .select("block", "leaf", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "home", "fp"))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        lab = linked_groups(x, pdf["home"].to_numpy(bool), masks[int(pdf["block"].iloc[0])], radius, max_bits)
        off = np.flatnonzero(lab != np.arange(len(lab)))
        return pd.DataFrame({"a": x[off].view(np.int64), "b": x[lab[off]].view(np.int64)})

    return dealt.groupBy("block", "leaf", "i", "j").applyInPandas(local, "a long, b long")


def fingerprint_components(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """``fps`` (fp: distinct long) -> (fp, comp) for every fingerprint that has a near one."""
    return connected_components(near_links(fps, max_bits)).select(F.col("node").alias("fp"), "comp")


def simhash_groups(df: DataFrame, id_col: str, text_col: str, k: int = 4, max_bits: int = 4) -> DataFrame:
    """One row (id, fp, component) per row of ``df``.

    Texts whose fingerprints are linked by steps of at most ``max_bits`` bits share a component, named
    by its smallest id. Null and empty texts have fingerprint 0 and link like any other; null ids take
    part but never name a component unless it has no other (then null); repeated rows repeat; an empty
    table gives no rows; other columns are ignored.
    """
    rows = with_fingerprint(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "fp", k)
    rows = stored(rows.select("id", "fp"), "fingerprints")
    own = rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    comp = stored(fingerprint_components(own.select("fp"), max_bits), "components")
    linked = own.join(comp, "fp")
    named = linked.join(linked.groupBy("comp").agg(F.min("least").alias("group_least")), "comp").select(
        "fp", "group_least")
    to = own.join(named, "fp", "left").select("fp", "n", F.coalesce("group_least", "least").alias("component"))
    return join_spread(rows, to, "fp", "n", rows.count(), "id").select("id", "fp", "component")


def keep_one(df: DataFrame, id_col: str, text_col: str, k: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``df`` with one row of each near-duplicate group: that with the smallest id
    (null ids last; of equal ids the text with the smallest xxhash64; of equal rows any one).

    Null and empty texts are one group; an empty table gives no rows. Groups and their keepers are chosen on narrow
    rows with the places of their texts; the texts then meet the keepers' places alone, in one shuffle.
    """
    fp, row, of = fresh(df, "fp", "row", "of")
    placed = with_row(df, row)
    rank = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(text_col), F.col(row))
    narrow = stored(with_fingerprint(placed, text_col, fp, k).select(F.col(fp).alias("fp"), rank.alias("rank")), "fingerprints")
    reps = stored(narrow.groupBy("fp").agg(F.min("rank").alias("rank")), "representatives")
    linked = stored(reps.join(fingerprint_components(reps.select("fp"), max_bits), "fp"), "linked")
    alone = reps.join(linked.select("fp"), "fp", "left_anti").select("rank")
    kept = alone.unionAll(linked.groupBy("comp").agg(F.min("rank").alias("rank")).select("rank"))
    kept = kept.select(F.col(f"rank.{row}").alias(of))
    return placed.join(kept.hint("shuffle_hash"), F.col(row) == F.col(of), "left_semi").select(*df.columns)
