"""Secrets found by regexes behind a trigram inverted index, in DataFrame functions only.

Every rule's regex is turned into a Boolean query over lower-case trigrams that each match must
contain. The index holds postings (trigram, document) of the trigrams that some rule asks for; their
intersection per document names the candidates of each rule, and only those texts are fetched and
verified with the regex. A rule whose regex has no mandatory trigram scans all texts.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import fresh, stored


@dataclass(frozen=True)
class Rule:
    """``regex`` may use only what Java, RE2 and Python read alike; matches whose ``group`` is shorter
    than ``least`` code points are dropped after the leftmost non-overlapping matching."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The key words and key formats that are searched for.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
RULES = (
    Rule("assign", "(" + "|".join(map(any_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
)
BASE = ("assign", "access", "hex")

#: A query is a set of conjunctions, each a set of trigrams; one empty conjunction is always true.
ALWAYS = frozenset({frozenset()})
MOST_STRINGS, MOST_TERMS = 16, 64
#: Values that a running sum or a cut through a text takes at a time.
BLOCK = 256


def _either(a, b):
    q = a | b
    return frozenset(c for c in q if not any(o < c for o in q))


def _both(a, b):
    q = frozenset(x | y for x in a for y in b)
    return _either(q, frozenset()) if len(q) <= MOST_TERMS else min(a, b, key=len)


def _of_strings(strings):
    """Query that holds where one of ``strings`` occurs."""
    q = frozenset()
    for s in strings:
        q = _either(q, frozenset({frozenset(s[i:i + 3] for i in range(len(s) - 2))}))
    return q


@dataclass(frozen=True)
class _Info:
    """What is known of a regex's matches: all of them (``exact``), else how they begin and end; ``query``
    holds on each."""

    exact: frozenset | None
    begins: frozenset
    ends: frozenset
    query: frozenset = ALWAYS


_ANY = _Info(None, frozenset({""}), frozenset({""}))


def _exact(strings) -> _Info:
    strings = frozenset(strings)
    if len(strings) > MOST_STRINGS:
        return _ANY
    return _Info(strings, strings, strings)


def _open(x: _Info) -> _Info:
    """``x`` with its exact strings turned into a query."""
    return x if x.exact is None else _Info(None, x.begins, x.ends, _both(x.query, _of_strings(x.exact)))


def _product(a, b, keep):
    got = frozenset(keep(x + y) for x in a for y in b)
    return got if len(got) <= MOST_STRINGS else frozenset({""})


def _concat(x: _Info, y: _Info) -> _Info:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MOST_STRINGS:
        return _exact(a + b for a in x.exact for b in y.exact)
    begins = x.begins if x.exact is None else _product(x.exact, y.begins, lambda s: s)
    ends = y.ends if y.exact is None else _product(x.ends, y.exact, lambda s: s)
    seam = frozenset({frozenset()})
    if len(x.ends) * len(y.begins) <= MOST_STRINGS:
        seam = _of_strings(a[-2:] + b[:2] for a in x.ends for b in y.begins)
    return _Info(None, begins, ends, _both(_both(_open(x).query, _open(y).query), seam))


def _branch(x: _Info, y: _Info) -> _Info:
    if x.exact is not None and y.exact is not None and len(x.exact | y.exact) <= MOST_STRINGS:
        return _exact(x.exact | y.exact)
    a, b = _open(x), _open(y)
    cut = lambda s: s if len(s) <= MOST_STRINGS else frozenset({""})
    return _Info(None, cut(a.begins | b.begins), cut(a.ends | b.ends), _either(a.query, b.query))


def _info(op, arg) -> _Info:
    if op is rc.LITERAL:
        return _exact({chr(arg).lower()})
    if op is rc.IN:
        chars = set()
        for o, a in arg:
            if o is rc.LITERAL:
                chars.add(chr(a).lower())
            elif o is rc.RANGE and a[1] - a[0] < MOST_STRINGS:
                chars |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return _ANY
        return _exact(chars)
    if op is rc.SUBPATTERN:
        return _sequence(arg[3])
    if op is rc.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        out = parts[0]
        for p in parts[1:]:
            out = _branch(out, p)
        return out
    if op is rc.MAX_REPEAT:
        low, high, inner = arg
        x = _sequence(inner)
        if (low, high) == (0, 1):
            return _branch(_exact({""}), x)
        if low == 0:
            return _ANY
        if low == high == 1:
            return x
        x = _open(x)
        return _Info(None, x.begins, x.ends, x.query)
    return _ANY


def _sequence(parsed) -> _Info:
    out = _exact({""})
    for op, arg in parsed:
        out = _concat(out, _info(op, arg))
    return out


def trigram_query(regex: str) -> frozenset:
    """Conjunctions of lower-case trigrams, one of which every match's text has; ALWAYS if there are none."""
    q = _open(_sequence(rp.parse(regex))).query
    return ALWAYS if frozenset() in q else q


def trigram_index(df: DataFrame, id_col: str, text_col: str, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, id, text_key), stored; ``trigrams`` are lower-case ASCII."""
    # as a lambda's argument the lower-case text is made once, not once for each trigram
    held = F.transform(F.array(F.lower(text_col)), lambda low: F.filter(
        F.array(*map(F.lit, trigrams)), lambda t: F.contains(low, t)))[0]
    post = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.explode(held).alias("trigram"))
    return stored(post.select("trigram", "id", "text_key"), "postings")


def candidates(index: DataFrame, queries: dict[str, frozenset]) -> DataFrame:
    """(id, text_key, kinds) of the documents that satisfy a rule's query, by intersecting postings."""
    trigrams = sorted({t for q in queries.values() for c in q for t in c})
    place = {t: divmod(i, 60) for i, t in enumerate(trigrams)}
    words = range(-(-len(trigrams) // 60))
    bit = lambda w: F.create_map(*[F.lit(x) for t, (at, b) in place.items() if at == w for x in (t, 1 << b)])
    sets = index.groupBy("id", "text_key").agg(*[F.bit_or(F.coalesce(bit(w)[F.col("trigram")], F.lit(0).cast("long"))).alias(f"w{w}") for w in words])

    def holds(query) -> Column:
        any_of = F.lit(False)
        for conj in sorted(query, key=sorted):
            need = [sum(1 << b for at, b in map(place.get, conj) if at == w) for w in words]
            all_of = F.lit(True)
            for w, m in zip(words, need):
                all_of = all_of & (F.col(f"w{w}").bitwiseAND(F.lit(m).cast("long")) == m)
            any_of = any_of | all_of
        return any_of

    kinds = F.array_compact(F.array(*[F.when(holds(q), F.lit(k)) for k, q in queries.items()]))
    return sets.select("id", "text_key", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def running(values: Column, op, zero: Column) -> Column:
    """Inclusive running ``op`` (associative, with neutral ``zero``) over an array, in blocks of BLOCK values, so that
    a growing array is copied a bounded number of times; an empty array stays empty."""
    kind = lambda x: F.array(x)

    def grow(part: Column, start: Column) -> Column:
        first = F.struct(start.alias("acc"), F.slice(kind(start), 1, 0).alias("out"))
        return F.aggregate(part, first, lambda a, x: F.struct(op(a["acc"], x).alias("acc"), F.concat(a["out"], kind(op(a["acc"], x))).alias("out")))["out"]

    def over(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / F.lit(float(BLOCK))).cast("int") - 1),
                             lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        return _let(blocks, lambda bs: F.flatten(F.zip_with(
            bs, F.concat(kind(zero), grow(F.transform(F.slice(bs, 1, F.size(bs) - 1), lambda p: F.aggregate(p, zero, op)), zero)),
            grow)))

    return _let(values, lambda v: F.when(F.size(v) > 0, over(v)).otherwise(F.slice(kind(zero), 1, 0)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value made once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, stop, kind>> of the rule's matches; code points, stop exclusive."""
    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.regex, -1)
    lengths = F.zip_with(F.transform(found, F.length), F.transform(sized, F.length), lambda n, g: F.struct(n.alias("n"), g.alias("g")))
    parts = F.zip_with(lengths, F.transform(F.slice(gaps, 1, F.size(found)), F.length),
                       lambda x, gap: F.struct(x["n"].alias("n"), x["g"].alias("g"), (x["n"] + gap).alias("move")))
    spans = _let(parts, lambda ps: F.zip_with(ps, running(F.transform(ps, lambda p: p["move"]), lambda a, x: a + x, F.lit(0)),
                 lambda p, stop: F.when(p["g"] >= rule.least, F.struct((stop - p["n"]).alias("start"), F.lit(order).alias("order"),
                                                                       stop.alias("stop"), F.lit(rule.kind).alias("kind")))))
    return F.array_compact(spans)


_SPANS = "array<struct<start:int,order:int,stop:int,kind:string>>"


def scan(df: DataFrame, id_col: str, text_col: str, rules=RULES) -> DataFrame:
    """One row (id, text_key, spans) per row of ``df``; spans sorted by start, then by the rules' order.

    A null text is empty and has no spans; null ids and repeated rows stay as they are; ``text_key``
    (xxhash64 of the text) tells rows of one id apart; an empty table gives no rows; other columns are
    ignored. Texts are searched whole.
    """
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    keyed = {k: q for k, q in queries.items() if q != ALWAYS}
    full = [(i, r) for i, r in enumerate(rules) if r.kind not in keyed]
    none = F.array().cast(_SPANS)
    scanned = [F.when(F.col("text").rlike(r.regex), rule_spans(F.col("text"), r, i)).otherwise(none) for i, r in full]
    rows = docs.select("id", "text_key", F.concat(none, *scanned).alias("scanned"))
    if keyed:
        index = trigram_index(docs, "id", "text", sorted({t for q in keyed.values() for c in q for t in c}))
        picked = stored(candidates(index, keyed), "candidates")
        texts = docs.join(picked.withColumnsRenamed({"id": "of", "text_key": "of_key"}),
                          F.col("id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")))
        spans = F.concat(none, *[F.when(F.array_contains("kinds", r.kind), rule_spans(F.col("text"), r, i)).otherwise(none)
                                 for i, r in enumerate(rules) if r.kind in keyed])
        verified = texts.select("of", "of_key", spans.alias("verified")).filter(F.size("verified") > 0)
        verified = stored(verified.dropDuplicates(["of", "of_key"]), "verified")
        rows = rows.join(verified, F.col("id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")), "left").withColumn(
            "scanned", F.concat("scanned", F.coalesce("verified", none)))
    return rows.select("id", "text_key", F.array_sort("scanned").alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def without_spans(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with each run of overlapping ``spans`` (sorted by start) replaced by one ``mark``.

    A run begins where a span starts at or behind all earlier stops. The text is cut first into blocks of runs and
    these into pieces, so a piece is never looked for from the text's beginning."""
    def cut(found: Column) -> Column:
        return _let(running(F.transform(found, lambda s: s["stop"]), lambda a, x: F.greatest(a, x), F.lit(0)), lambda reach: behind(F.filter(
            F.zip_with(found, F.concat(F.array(F.lit(0)), reach), lambda s, r: F.struct(s["start"].alias("start"), r.alias("reach"))),
            lambda x: x["start"] >= x["reach"]), F.element_at(reach, -1)))

    def behind(runs: Column, last: Column) -> Column:
        """The pieces before each run, and the rest behind ``last``."""
        return _let(runs, lambda rs: F.concat(
            F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(F.size(rs) / F.lit(float(BLOCK))).cast("int") - 1),
                                  lambda b: _let(F.slice(rs, b * BLOCK + 1, F.lit(BLOCK)), pieces))),
            F.array(F.substring(text, last + 1, F.length(text)))))

    def pieces(part: Column) -> Column:
        begin = part[0]["reach"]
        return _let(F.substring(text, begin + 1, F.element_at(part, -1)["start"] - begin), lambda t: F.transform(
            part, lambda r: F.substring(t, r["reach"] - begin + 1, r["start"] - r["reach"])))

    return F.when(F.size(spans) > 0, F.array_join(cut(spans), mark)).otherwise(text)


def redact(df: DataFrame, id_col: str, text_col: str, rules=RULES, mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every found span replaced by ``mark`` (overlapping spans by one); all rows stay.

    A null text stays null; null ids and repeated rows stay as they are; any column names are allowed; an empty
    table gives no rows."""
    key, of, of_key, spans = fresh(df, "text_key", "of", "of_key", "spans")
    hit = scan(df, id_col, text_col, rules).filter(F.size("spans") > 0).dropDuplicates(["id", "text_key"])
    hit = stored(hit.select(F.col("id").alias(of), F.col("text_key").alias(of_key), F.col("spans").alias(spans)), "spans")
    text = F.col(text_col)
    j = df.withColumn(key, F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))).join(
        hit, F.col(id_col).eqNullSafe(F.col(of)) & (F.col(key) == F.col(of_key)), "left")
    j = j.withColumn(text_col, F.when(F.col(spans).isNull(), text).otherwise(without_spans(text, F.col(spans), mark)))
    return j.select(*df.columns)
