"""Repair the structure of conversations by iterative-deepening A* over edit sequences.

A conversation is legal when its role initials read ``(s?(ua)+)?``. ``Search`` walks a chunk of rows depth first, trying
the edits in ASCII order (Delete, Insert, Keep, Rerole) within a cost bound that rises to the least proven cost; nodes
that failed remember what they need at least. So the first accepting path is the cheapest, and of those the ASCII-least.

A conversation may hold any share of all rows. Equal rows collapse to one with a count, and only the first row of a role
and text brings its text along. The rows are then sorted over all tasks, which also splits long conversations. A task
solves what lies wholly in it and in one chunk. A longer conversation becomes chunks, each searched from every state to
every state: an edit sequence never ends a chunk with an insert, so no sequence of a chunk is the beginning of another,
and the cheapest, ASCII-least whole is made of such parts. Their costs and order compose to 4 x 4 tables, first of a
task's share, then of a conversation, and the chosen states go back the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.llm.common import stored

#: Rows of a conversation, those that must go not counted, that are searched at once.
CHUNK = 128
INF = 1 << 60
STATES = range(4)
#: States: nothing yet, after s, after u, after a. Where a kept row's initial leads, and where a new or reroled row does.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: Inserts that still complete a conversation in each state.
CLOSING = ("", "II", "I", "")
INSERT = REROLE = 2
DELETE, TRUNCATED = 3, 1
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
WORD = r"[^\x20\x09-\x0D]"

# ---------------------------------------------------------------- one chunk


class Search:
    """Cheapest edits of ``items`` that end in one of ``goals``; ``closing`` allows inserts after the last row.

    An item is (forced, initial, extra): so many rows that must be deleted, or else a row with its role's initial
    and the cost of leaving it. ``need`` is the least cost proven for a failed node (row, state, inserts so far).
    """

    def __init__(self, items: list[tuple[int, str, int]], goals: set[int], closing: bool):
        self.items, self.goals, self.closing, self.need = items, goals, closing, {}
        # a bound from the rows alone: deletions due, truncated rows, and two for each of the most disjoint pairs of
        # neighbours that may not follow each other, as such a pair takes an insert, a new role or a deletion
        self.low = [0] * (len(items) + 1)
        # the cost of deleting all rows, and whether a row could follow the beginning as s: no edit leads back to the
        # states before the first u
        self.gone, self.opener = [0] * (len(items) + 1), [False] * (len(items) + 1)
        due = pairs = pairs_after = 0
        after = None
        for i in range(len(items) - 1, -1, -1):
            forced, initial, extra = items[i]
            due += DELETE * forced + extra
            self.gone[i] = self.gone[i + 1] + DELETE * (forced or 1)
            self.opener[i] = self.opener[i + 1] or initial == "s"
            if not forced:
                clash = after is not None and (initial, after) not in LEGAL
                pairs, pairs_after = max(pairs, pairs_after + clash), pairs
                after = initial
            self.low[i] = due + 2 * pairs

    def least(self, i: int, state: int, inserts: int) -> int:
        known = self.need.get((i, state, inserts))
        if known is not None:
            return known
        if max(self.goals) > 1:
            return self.low[i]
        if state > max(self.goals):
            return INF
        if state in self.goals:
            return self.gone[i]
        return self.gone[i] - DELETE if self.opener[i] else INF

    def edits(self, i: int, state: int, inserts: int) -> Iterator[tuple[str, int, int, int, int]]:
        """(letters, cost, node) in ASCII order. Deletions come before inserts, which costs the same and is less;
        more inserts than one, or two at the beginning, lead back to where they were."""
        inside = i < len(self.items)
        forced, initial, extra = self.items[i] if inside else (0, "", 0)
        if inside and not inserts:
            n = forced or 1
            yield "D" * n, DELETE * n, i + 1, state, 0
        if forced:
            return
        if inserts < 2 and (inside or self.closing):
            yield "I", INSERT, i, NEXT[state], 1 if state < 2 else 2
        if inside:
            kept = STEP[state].get(initial)
            if kept is not None:
                yield "K", extra, i + 1, kept, 0
            if kept != NEXT[state]:
                yield "R", REROLE + extra, i + 1, NEXT[state], 0

    def within(self, node: tuple[int, int, int], left: int, path: list[str]) -> bool:
        if node[0] == len(self.items) and node[1] in self.goals:
            return True
        least = INF
        for letters, cost, *to in self.edits(*node):
            if cost + self.least(*to) <= left and self.within(tuple(to), left - cost, path):
                path.append(letters)
                return True
            least = min(least, cost + self.least(*to))
        self.need[node] = least
        return False

    def run(self, start: int) -> tuple[int, str] | None:
        """(cost, audit), or None if no edits lead from ``start`` to a goal."""
        root, path = (0, start, 0), []
        while (bound := self.least(*root)) < INF:
            if self.within(root, bound, path):
                return bound, "".join(reversed(path))
        return None


def apply(items: list[tuple[int, str, int]], rows: list[tuple[str, str]], audit: str, state: int) -> list[str]:
    """The repaired ``role:text`` lines of a chunk; ``rows`` has (role, text) for each item."""
    lines, i, left = [], 0, 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            lines.append(f"{ROLE[state]}:")
        elif letter == "D":
            left = (left or items[i][0] or 1) - 1
            i += not left
        else:
            role, text = rows[i]
            state = STEP[state][items[i][1]] if letter == "K" else NEXT[state]
            lines.append(f"{role if letter == 'K' else ROLE[state]}:{text}")
            i += 1
    return lines


# ---------------------------------------------------------------- chunks together

def all_pairs(items) -> tuple[list[int], list[str]]:
    """Cost (INF: none) and audit from every state to every state, row by row."""
    search = [Search(items, {q}, False) for q in STATES]
    got = [search[q].run(p) or (INF, "") for p in STATES for q in STATES]
    return [c for c, _ in got], [a for _, a in got]


def ranks(audits: list[str]) -> list[int]:
    return [sorted(audits[4 * p:4 * p + 4]).index(audits[4 * p + q]) for p in STATES for q in STATES]


def _best(cost: list[int], rank: list[int], c: list[int], r: list[int], to: int) -> tuple[int, int, int, int]:
    """Least (cost, order so far, order of the next part) and the state between."""
    return min((cost[q] + c[4 * q + to], rank[q], r[4 * q + to], q) for q in STATES)


def compose(a: tuple[list[int], list[int]], b: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    costs, order = [], []
    for p in STATES:
        best = [_best(a[0][4 * p:4 * p + 4], a[1][4 * p:4 * p + 4], *b, to) for to in STATES]
        costs += [min(x[0], INF) for x in best]
        place = sorted(x[1:3] for x in best)
        order += [place.index(x[1:3]) for x in best]
    return costs, order


def states(tables: list[tuple[list[int], list[int]]], start: int, end: int | None) -> tuple[int, list[int]]:
    """Cost and states before, between and after the parts, of the cheapest, ASCII-least way to ``end``
    (None: to the end of the conversation, where inserts may follow)."""
    cost, rank, back = [INF] * 4, [0] * 4, []
    cost[start] = 0
    for c, r in tables:
        best = [_best(cost, rank, c, r, to) for to in STATES]
        place = sorted(x[1:3] for x in best)
        cost, rank = [min(x[0], INF) for x in best], [place.index(x[1:3]) for x in best]
        back.append([x[3] for x in best])
    total = 0
    if end is None:
        total, _, end = min((cost[q] + INSERT * len(CLOSING[q]), rank[q], q) for q in STATES)
    path = [end]
    for b in reversed(back):
        path.append(b[path[-1]])
    return total or cost[end], path[::-1]


class Facts:
    """Counts over consecutive rows of a conversation; ``add`` takes those of the rows that follow."""

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")

    def __init__(self, blank=0, duplicate=0, truncated=0, illegal=0, turns=0, low=None, high=None, first=None, last=None):
        self.blank, self.duplicate, self.truncated, self.illegal = blank, duplicate, truncated, illegal
        self.turns, self.low, self.high, self.first, self.last = turns, low, high, first, last

    def add(self, x: "Facts") -> None:
        self.blank, self.duplicate, self.truncated = self.blank + x.blank, self.duplicate + x.duplicate, self.truncated + x.truncated
        self.illegal += x.illegal + (self.last is not None and x.first is not None and (self.last, x.first) not in LEGAL)
        self.turns += x.turns - (self.high is not None and self.high == x.low)
        self.low = x.low if self.low is None else self.low
        self.high = self.high if x.high is None else x.high
        self.first = x.first if self.first is None else self.first
        self.last = self.last if x.last is None else x.last

    def row(self) -> list:
        return [getattr(self, f) for f in self.FIELDS]

    def counts(self) -> tuple[int, int, int, int, int]:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


class _Chunk:
    """Rows of a conversation until they are searched."""

    def __init__(self):
        self.items, self.rows, self.facts, self.free = [], [], Facts(), 0

    def delete(self, n: int) -> None:
        if n and self.items and self.items[-1][0]:
            self.items[-1] = (self.items[-1][0] + n, "", 0)
        elif n:
            self.items.append((n, "", 0))
            self.rows.append((None, None))

    def group(self, turn, role: str, text: str | None, blank: bool, truncated: bool, n: int) -> None:
        """``n`` equal rows; ``text`` is given if the first of them is the first of its role and text."""
        initial, first = role[:1], text is not None
        if first:
            self.items.append((0, initial, TRUNCATED if truncated else 0))
            self.rows.append((role, text))
            self.free += 1
        self.delete(n - first)
        self.facts.add(Facts(n if blank else 0, 0 if blank else n - first, int(first and truncated), n - 1,
                             int(turn is not None), turn, turn, initial, initial))


# ---------------------------------------------------------------- on Spark

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text) after damage by crc32 of ``conv:turn`` modulo 20: 0 drops the row, 1 empties its text, 2
    takes its marks ``.!?`` out, 3 repeats it, 4 makes it a user's. Nulls count as one space there and in role and text."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(s(conv), F.lit(":"), s(turn)).cast("binary")) % 20
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), s(role).alias("role"), s(text).alias("text"), kind.alias("kind"))
    new_text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.filter("kind <> 0").select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), new_text.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def _events(rows: DataFrame) -> DataFrame:
    """Rows sorted by (conv, turn, role, text): for each group of equal rows one event with its count, and before it, if
    no earlier row has the role and text, one with the text. No join, and no key is hot after the partial counts."""
    blank = ~F.col("text").rlike(WORD)
    keyed = rows.select("conv", "turn", "role", F.md5(F.col("text").cast("binary")).alias("h"), blank.alias("blank"), "text")
    counts = keyed.groupBy("conv", "turn", "role", "h", "blank").agg(F.count(F.lit(1)).alias("n"))
    firsts = keyed.filter(~F.col("blank")).groupBy("conv", "role", "h").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn"))["turn"].alias("turn"), F.any_value("text").alias("text"))
    last = F.regexp_extract("text", rf"({WORD})[\x20\x09-\x0D]*\z", 1)
    firsts = firsts.select("conv", "turn", "role", "h", F.lit(False).alias("blank"), F.lit(0).cast("long").alias("n"), "text",
                           (~last.isin(".", "!", "?")).alias("truncated"))
    both = firsts.unionByName(counts.select("conv", "turn", "role", "h", "blank", "n", F.lit(None).cast("string").alias("text"),
                                            F.lit(None).cast("boolean").alias("truncated")))
    key = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "h")]
    return both.repartitionByRange(*key).sortWithinPartitions(*key, "n")


def _arrow(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema
    s = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(s)], schema=s)


def _solved(df: DataFrame, chunk: int) -> DataFrame:
    """Sorted events -> stored rows of three kinds: whole conversations with their answer, and of the others chunks
    with their rows and tables of edits, and each task's share (segment) with its composed table."""
    conv = df.schema["conv"]
    schema = T.StructType([conv, *_fields("kind string, part int, k int, facts array<string>, cost long, audit string, sha string, "
                                          "costs array<long>, order array<int>, audits array<string>, forced array<int>, "
                                          "extras array<int>, roles array<string>, texts array<string>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []
        now, held, edge, k, table, facts, text, truncated = None, None, True, 0, None, None, None, None

        def whole(c: _Chunk):
            cost, audit = Search(c.items, {0, 3}, True).run(0)
            sha = hashlib.sha256("\n".join(apply(c.items, c.rows, audit, 0)).encode()).hexdigest()
            return (now, "whole", part, 0, c.facts.row(), cost, audit, sha, *[None] * 7)

        def piece(c: _Chunk):
            nonlocal table
            costs, audits = all_pairs(c.items)
            mine = costs, ranks(audits)
            table = mine if table is None else compose(table, mine)
            facts.add(c.facts)
            return (now, "chunk", part, k, None, None, None, None, *mine, audits, [x[0] for x in c.items], [x[2] for x in c.items],
                    [r[0] for r in c.rows], [r[1] for r in c.rows])

        def end(last: bool):
            """Close the conversation; it may go on in another task if it is the first or last here."""
            nonlocal out
            if not (k or edge or last):
                out.append(whole(held))
            elif held.items or k:
                if held.items:
                    out.append(piece(held))
                out.append((now, "segment", part, k + 1, facts.row(), None, None, None, *table, *[None] * 5))

        for batch in batches:
            for conv_id, turn, role, _, blank, n, t, cut in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or conv_id != now:
                    if held is not None:
                        end(False)
                        edge = False
                    now, held, k, table, facts = conv_id, _Chunk(), 0, None, Facts()
                if not n:
                    text, truncated = t, cut
                    continue
                held.group(turn, role, text, blank, bool(truncated), n)
                text = truncated = None
                if held.free >= chunk:
                    out.append(piece(held))
                    k, held = k + 1, _Chunk()
            if len(out) >= 1000:
                yield _arrow(schema, [_plain(r) for r in out])
                out = []
        if held is not None:
            end(True)
        if out:
            yield _arrow(schema, [_plain(r) for r in out])

    return stored(df.select("conv", "turn", "role", "h", "blank", "n", "text", "truncated").mapInArrow(run, schema), "turns")


def _fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def _plain(row: tuple) -> tuple:
    """Facts as text, one column for numbers and initials."""
    return (*row[:4], None if row[4] is None else [None if x is None else str(x) for x in row[4]], *row[5:])


def _facts(values: list) -> Facts:
    return Facts(*[int(x) for x in values[:5]], *[None if x is None else int(x) for x in values[5:7]], *values[7:])


def _by_conversation(segments: DataFrame) -> DataFrame:
    """(conv, part, entry, exit, closing state, counts) of each segment; a conversation has at most one per task."""
    conv = segments.schema["conv"]
    schema = T.StructType([conv, *_fields("part int, entry int, leave int, end int, " + ", ".join(f"{c} long" for c in COUNTS))])

    def choose(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["part"])
        facts = Facts()
        for r in rows:
            facts.add(_facts(r["facts"]))
        cost, path = states([(r["costs"], r["order"]) for r in rows], 0, None)
        out = [(r["conv"], r["part"], p, q, path[-1], *facts.counts(), cost) for r, p, q in zip(rows, path, path[1:])]
        return pa.Table.from_batches([_arrow(schema, out)])

    return segments.select("conv", "part", "facts", "costs", "order").groupBy("conv").applyInArrow(choose, schema)


def _repaired(chunks: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv, part, k, audit, lines, end, counts) of each chunk, by the states that its segment enters and leaves."""
    schema = T.StructType([chunks.schema["conv"], *_fields("part int, k int, audit string, lines array<string>, end int, "
                                                           + ", ".join(f"{c} long" for c in COUNTS))])

    def fill(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["k"])
        _, path = states([(r["costs"], r["order"]) for r in rows], rows[0]["entry"], rows[0]["leave"])
        out = []
        for r, p, q in zip(rows, path, path[1:]):
            items = [(n, (role or "")[:1], x) for n, role, x in zip(r["forced"], r["roles"], r["extras"])]
            audit = r["audits"][4 * p + q]
            out.append((r["conv"], r["part"], r["k"], audit, apply(items, list(zip(r["roles"], r["texts"])), audit, p), r["end"],
                        *(r[c] for c in COUNTS)))
        return pa.Table.from_batches([_arrow(schema, out)])

    to = chosen.withColumnsRenamed({"conv": "of", "part": "of_part"})
    j = chunks.join(to, F.col("conv").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))).drop(
        "of", "of_part", "kind", "facts", "audit", "sha")
    return j.groupBy("conv", "part").applyInArrow(fill, schema)


def _joined(pieces: DataFrame) -> DataFrame:
    """(conv, counts, audit, sha) from the pieces in order; a hash is by its nature one pass, so the lines stream by."""
    schema = T.StructType([pieces.schema["conv"], *_fields(", ".join(f"{c} long" for c in COUNTS) + ", audit string, sha string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i in range(b.num_rows):
                    yield {n: c[i].as_py() for n, c in zip(b.schema.names, b.columns)}

        for conv, parts in groupby(rows(), key=lambda r: r["conv"]):
            digest, audit, glue = hashlib.sha256(), [], ""
            for r in parts:
                audit.append(r["audit"])
                for line in r["lines"]:
                    digest.update((glue + line).encode())
                    glue = "\n"
            state = r["end"]
            for _ in CLOSING[r["end"]]:
                state = NEXT[state]
                digest.update(f"{glue}{ROLE[state]}:".encode())
                glue = "\n"
            yield _arrow(schema, [(conv, *(r[c] for c in COUNTS), "".join(audit) + CLOSING[r["end"]], digest.hexdigest())])

    return pieces.repartition("conv").sortWithinPartitions("conv", "part", "k").mapInArrow(run, schema)


def repair(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``rows`` (conv, turn: long, role, text) -> one row (conv, gaps, blank, duplicate, truncated, illegal, cost, audit,
    sha) per conversation.

    Rows of a conversation are taken by turn, null turns first, then by role and by the md5 of the text. Role and text
    may not be null; a null conv is a conversation of its own. Repeated rows are duplicates; long texts stay whole; an
    empty table gives no rows.
    """
    solved = _solved(_events(rows), chunk)
    facts = F.transform(F.slice("facts", 1, 7), lambda x: x.cast("long"))
    f = [facts[i] for i in range(7)]
    gaps = F.when(f[4] > 0, f[6] - f[5] + 1 - f[4]).otherwise(F.lit(0))
    whole = solved.filter("kind = 'whole'").select("conv", gaps.cast("long").alias("gaps"), *[f[i].alias(c) for i, c in enumerate(COUNTS[1:5])],
                                                   "cost", "audit", "sha")
    chosen = _by_conversation(solved.filter("kind = 'segment'"))
    chunks = solved.filter("kind = 'chunk'").drop("cost")
    return whole.unionByName(_joined(_repaired(chunks, chosen)))


def repair_damaged(df: DataFrame, conv: str, turn: str, role: str, text: str, chunk: int = CHUNK) -> DataFrame:
    """``repair`` of the damaged rows, one row for every conversation of ``df``, null among them; one that lost all its
    rows has zeros, an empty audit and the hash of the empty text. Other columns are ignored."""
    got = repair(damaged(df, conv, turn, role, text), chunk).withColumnRenamed("conv", "of")
    every = df.select(F.col(conv).alias("conv")).distinct()
    j = every.join(got, F.col("conv").eqNullSafe(F.col("of")), "left")
    return j.select("conv", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("sha"))
