import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import types as T

from basketry.llm import turns
from basketry.llm.queries import ORACLE
from oracle import same

SHAPE = re.compile(r"(s?(ua)+)?")
COLUMNS = ["conv_id", *turns.COUNTS, "audit", "repaired_sha256"]


def brute(items, start=0, goals=(0, 3), closing=True, most=9):
    """All edit texts up to a length, priced and walked plainly: the cheapest, then the least. Inside a conversation
    (not ``closing``) none that could also begin the next chunk."""
    best = None
    n = sum(x[0] or 1 for x in items)
    flat = [(bool(x[0]), x[1], x[2]) for x in items for _ in range(x[0] or 1)]
    for length in range(n, min(n + 4, most) + 1):
        for audit in itertools.product("DIKR", repeat=length):
            if length - audit.count("I") != n or (not closing and re.search("ID|I$", "".join(audit))):
                continue
            i, state, cost = 0, start, 0
            for e in audit:
                forced, initial, extra = flat[i] if e != "I" else (False, "", 0)
                to = {"I": turns.NEXT[state], "R": turns.NEXT[state], "K": turns.STEP[state].get(initial), "D": state}[e]
                if to is None or (forced and e in "KR"):
                    break
                cost += {"I": 2, "R": 2 + extra, "K": extra, "D": 3}[e]
                i, state = i + (e != "I"), to
            else:
                if state in goals and (best is None or (cost, "".join(audit)) < best):
                    best = cost, "".join(audit)
    return best


def random_items(rnd, n):
    return [(rnd.randrange(1, 3), "", 0) if rnd.random() < 0.2 else (0, rnd.choice("uuaasx"), rnd.randrange(2)) for _ in range(n)]


def test_search_finds_the_cheapest_and_least():
    rnd = random.Random(4)
    for _ in range(60):
        items = random_items(rnd, rnd.randrange(0, 4))
        assert turns.Search(items, {0, 3}, True).run(0) == brute(items), items
    for _ in range(40):
        items, p, q = random_items(rnd, rnd.randrange(1, 3)), rnd.randrange(4), rnd.randrange(4)
        assert turns.Search(items, {q}, False).run(p) == brute(items, p, (q,), False, 7), (items, p, q)


def test_result_is_legal_and_priced():
    rnd = random.Random(6)
    for _ in range(300):
        items = random_items(rnd, rnd.randrange(0, 40))
        cost, audit = turns.Search(items, {0, 3}, True).run(0)
        lines = turns.apply(items, [({"u": "user", "a": "assistant", "s": "system"}.get(x[1], "x"), "t") for x in items], audit, 0)
        assert SHAPE.fullmatch("".join(line[0] for line in lines))


def test_chunks_compose_to_the_whole():
    rnd = random.Random(9)
    for _ in range(80):
        items = random_items(rnd, rnd.randrange(1, 30))
        cuts = sorted(rnd.sample(range(1, len(items)), min(len(items) - 1, rnd.randrange(0, 5)))) if len(items) > 1 else []
        parts = [items[i:j] for i, j in zip([0, *cuts], [*cuts, len(items)])]
        tables = []
        for part in parts:
            costs, audits = turns.all_pairs(part)
            tables.append((costs, turns.ranks(audits), audits))
        cost, path = turns.states([t[:2] for t in tables], 0, None)
        audit = "".join(t[2][4 * p + q] for t, p, q in zip(tables, path, path[1:])) + turns.CLOSING[path[-1]]
        assert (cost, audit) == turns.Search(items, {0, 3}, True).run(0)
        if len(tables) > 2:  # composed tables choose the same way
            first = turns.compose(tables[0][:2], tables[1][:2])
            cost2, path2 = turns.states([first, *[t[:2] for t in tables[2:]]], 0, None)
            assert (cost2, path2[1:]) == (cost, path[2:])


SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType()), T.StructField("h", T.StringType()), T.StructField("conv", T.StringType())])


def both(spark, rows, chunk, parts=3):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)
    got = turns.repair_damaged(df, "conv_id", "turn", "role", "text", chunk)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    if rows:
        con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = con.sql(ORACLE["op13_conversation_repair"]).project(", ".join(COLUMNS)).fetchall()
    key = lambda r: (r[0] is None, r[0] or 0)
    return sorted(map(tuple, got.collect()), key=key), sorted(want, key=key)


@pytest.mark.parametrize("chunk", [2, 7, 128])
def test_odd_conversations_equal_sql(spark, chunk):
    rnd = random.Random(chunk)
    roles, texts = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "User"], ["Yes.", "no", "What? ", None, "", " \n", "a b c!", "é.", "x.\t", "Yes."]
    rows = []
    for c in [None, *range(60)]:
        for t in range(rnd.randrange(1, 14)):
            rows.append((c, rnd.choice([t, t, t, None, t + 3, -t]), rnd.choice(roles), rnd.choice(texts)))
    # one conversation holds a third of the rows, many of them equal
    rows += [(99, t % 90, rnd.choice(roles[:5]), f"{t % 37}.") for t in range(len(rows) // 2)] + [(99, 5, "user", "same.")] * 60
    got, want = both(spark, rows, chunk)
    assert got == want


def test_long_texts_and_many_turns(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(1000)] + [(2, 0, "user", "long " * 200_000 + "."), (2, 1, "assistant", "ok.")]
    got, want = both(spark, rows, 128)
    assert got == want


def test_all_rows_dropped_and_empty_table(spark):
    import zlib
    gone = [i for i in range(400) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:3]
    got, want = both(spark, [(i, 0, "user", "a.") for i in gone], 128)
    assert got == want == [(i, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for i in gone]
    assert both(spark, [], 128) == ([], [])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    same(spark, "op13_conversation_repair", f"/root/testdata/{sf}")
