"""Registered queries of the text operators and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import fim, langid, lm, neighbours, packing, pieces, quality, secret_scan, toxicity, turns, warc
from basketry.llm.common import fold, read_table
from basketry.llm.mixing import systematic_copies
from basketry.llm.simhash import simhash_groups

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    g = simhash_groups(read_table(spark, sf_dir, "documents"), "doc_id", "text", k=4, max_bits=4)
    return g.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    F.col("component").alias("component_id"))


@query
def op5_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, with its source's size and target."""
    c = systematic_copies(read_table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return c.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                    (F.col("copies") * F.col("size")).alias("taken"))


# ranks by window; the targets as the first k sources, in the order in which they stop, for which
# the rate of the others stops none of them
ORACLE["op5_systematic_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '7') AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 2.0::DOUBLE * source_size AS most,
         row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, encode(source)) AS k FROM s),
p AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)
             - coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM o),
r AS (SELECT rate, k FROM p WHERE w * rate <= most ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN p.k < r.k THEN most ELSE w * r.rate END AS target FROM p, r),
u AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS per,
         ('0x' || substr(md5(coalesce(source, '') || (source IS NULL)::INT::VARCHAR || '7'), 1, 8))::BIGINT
         / 4294967296.0::DOUBLE AS off FROM t),
n AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, h, doc_id)::DOUBLE AS i FROM d)
SELECT doc_id, size, source_size, target,
       (least(floor(i * per + off) - floor((i - 1) * per + off), ceil(per))::BIGINT * size)::BIGINT AS taken
FROM n JOIN u ON n.source IS NOT DISTINCT FROM u.source
"""


@query
def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to an archive and read all of it back."""
    index = warc.write(read_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# base32 of a hex SHA-1: every five hex digits are four letters
ORACLE["op3_warc_archive"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, strlen(html) AS n, sha1(html) AS x FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM h)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  ((('0x' || substr(x, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)),
           'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m
"""


@query
def op4_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    weights = toxicity.fit(docs.filter(fold("doc_id", 4) != 2), labels.filter(fold("id", 4) != 2), "doc_id", "text")
    out = toxicity.score_toxicity(docs, weights, "doc_id", "text")
    return out.select(F.col("id").alias("doc_id"), (fold("id", 4) == 2).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(fold("doc_id", 5) != 0), "text", "lang", F.xxhash64("doc_id", F.lit(3)))
    out = langid.with_language(docs.select("doc_id", "text"), "text", model, "p")
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("p.lang").alias("lang_pred"),
                      F.col("p.score").alias("score"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document; strata are languages, holdouts the labelled ones."""
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("good"))
    v = quality.quality_verdicts(read_table(spark, sf_dir, "documents"), labels, "doc_id", "text", "lang")
    return v.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept")


@query
def op8_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours found for every hundredth vector."""
    e = read_table(spark, sf_dir, "embeddings")
    got = neighbours.search(e, "vec_id", "embedding", F.col("vec_id") % 100 == 0, k=10)
    return got.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document: counts of the base kinds, their digest, and all spans."""
    s = secret_scan.scan(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    of = lambda kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    return s.select(F.col("id").alias("doc_id"), *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in secret_scan.BASE],
                    F.sha2(secret_scan.spans_text(of(secret_scan.BASE)), 256).alias("base_sha256"),
                    secret_scan.spans_text(F.col("spans")).alias("spans"))


def _span_sql(rule, order: int) -> str:
    """List of a rule's spans: a match starts after all earlier pieces and matches."""
    r = rule.regex.replace("'", "''")
    return f"""list_filter(list_transform(range(len(regexp_extract_all(t, '{r}'))), lambda i: {{
      's': coalesce(list_sum(list_transform(string_split_regex(t, '{r}')[1:i + 1], lambda x: length(x))), 0)::BIGINT
         + coalesce(list_sum(list_transform(regexp_extract_all(t, '{r}')[1:i], lambda x: length(x))), 0)::BIGINT,
      'o': {order}, 'n': length(regexp_extract_all(t, '{r}')[i + 1]),
      'g': length(regexp_extract_all(t, '{r}', {rule.group})[i + 1]), 'k': '{rule.kind}'}}), lambda x: x.g >= {rule.least})"""


def _joined_sql(spans: str) -> str:
    return f"coalesce(array_to_string(list_transform({spans}, lambda x: x.k || ':' || x.s || ':' || (x.s + x.n)), ','), '')"


ORACLE["op2_secret_scan"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, list_sort(flatten([{', '.join(_span_sql(r, i) for i, r in enumerate(secret_scan.RULES))}])) AS a FROM d)
SELECT doc_id, {', '.join(f"len(list_filter(a, lambda x: x.k = '{k}'))::BIGINT AS n_{k}" for k in secret_scan.BASE)},
       sha256({_joined_sql("list_filter(a, lambda x: x.o < 3)")}) AS base_sha256, {_joined_sql("a")} AS spans
FROM s
"""


@query
def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and language-model score of every document, learned outside the held-out fold."""
    s = lm.score(read_table(spark, sf_dir, "documents"), "doc_id", "text", fold("doc_id", 5) == 1)
    return s.withColumnRenamed("id", "doc_id")


@query
def op6_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's encoding, whether it decodes to the text, and two segmentations drawn without replacement."""
    e = pieces.encode(read_table(spark, sf_dir, "documents"), "doc_id", "text", k=2)
    return e.select(F.col("id").alias("doc_id"), F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
                    "round_trip",
                    F.transform("sampled", lambda x: F.size(x)).alias("sample_pieces"), F.transform("sampled", lambda x: F.xxhash64(x)).alias("sample_hashes"),
                    "log_prob", "log_inclusion")


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into prefix, middle and suffix, its rewritten text and the text restored from it."""
    f = fim.fill_in_middle(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return f.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
                    F.sha2("output", 256).alias("output_sha256"),
                    F.sha2(fim.restore("output", "form"), 256).alias("restored_sha256"))


# lists of units and their slices in place of a counted match; the restored text is the text
ORACLE["op11_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
r AS (SELECT doc_id, t, u, len(u) AS n, list_transform(range(4), lambda i: ('0x' || substr(h, (8 * i + 1)::INT, 8))::BIGINT) AS x FROM d),
c AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 50 THEN 'plain'
                 WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b FROM r),
p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid,
         coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


@query
def op12_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2,048 tokens, all full."""
    p = packing.pack_documents(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return p.withColumnRenamed("id", "doc_id")


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, the cheapest edits that make it legal, and their result."""
    r = turns.repair_damaged(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return r.withColumnsRenamed({"conv": "conv_id", "sha": "repaired_sha256"})


def _repair_sql() -> str:
    """A fold over the rows that keeps, for each state, the least cost (nine digits) with its audit as one text."""
    more = lambda s, cost, letter: f"(lpad((substr({s}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({s}, 10) || '{letter}')"
    a = [f"a[{i}]" for i in range(1, 5)]
    # states before a row is kept or gets a new role, after inserts
    c = [a[0], a[1], f"least({a[2]}, {more(a[0], 2, 'I')}, {more(a[1], 2, 'I')}, {more(a[3], 2, 'I')})",
         f"least({a[3]}, {more(a[2], 2, 'I')}, {more(a[0], 4, 'II')}, {more(a[1], 4, 'II')})"]
    d = [more(s, 3, "D") for s in a]
    keep = lambda initial, s: f"CASE WHEN x[2] = '{initial}' THEN {more(s, 'x[3]::INT', 'K')} END"
    role = lambda s: more(s, "(2 + x[3]::INT)", "R")
    row = [d[0], f"least({d[1]}, {keep('s', c[0])})",
           "least(" + ", ".join([d[2], *[keep("u", c[i]) for i in (0, 1, 3)], *[role(c[i]) for i in (0, 1, 3)]]) + ")",
           f"least({d[3]}, {keep('a', c[2])}, {role(c[2])})"]
    end = f"least({a[0]}, {a[3]}, {more(a[2], 2, 'I')}, {more(a[1], 4, 'II')})"
    return f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
k AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
m AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295] || list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i::INT, 1))::BIGINT),
                         lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind FROM k, crc),
r AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM m WHERE kind <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM r)),
f AS (
  SELECT *, substr(role, 1, 1) AS c, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
              WHEN regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated'
              ELSE '' END AS fault FROM o),
g AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal,
         list([(fault IN ('blank', 'duplicate'))::INT::VARCHAR, c, (fault = 'truncated')::INT::VARCHAR] ORDER BY i) AS items,
         list({{'r': role, 't': text}} ORDER BY i) AS kept FROM f GROUP BY conv_id),
s AS (
  SELECT *, list_reduce([['000000000', NULL, NULL, NULL]] || items, lambda a, x:
    CASE WHEN x[1] = '1' THEN [{', '.join(d)}] ELSE [{', '.join(row)}] END) AS a FROM g),
e AS (SELECT *, substr({end}, 1, 9)::BIGINT AS cost, substr({end}, 10) AS audit FROM s),
p AS (
  SELECT *, list_transform(list_filter(range(1, length(audit) + 1), lambda j: substr(audit, j::INT, 1) <> 'D'), lambda j: {{
    'l': substr(audit, j::INT, 1), 'i': length(replace(substr(audit, 1, j::INT), 'I', '')),
    'left': length(replace(substr(audit, j::INT + 1), 'D', ''))}}) AS w FROM e),
q AS (
  SELECT *, coalesce(array_to_string(list_transform(w, lambda x:
    CASE WHEN x.l = 'K' THEN kept[x.i].r WHEN x.left % 2 = 0 THEN 'assistant' ELSE 'user' END || ':'
    || CASE WHEN x.l = 'I' THEN '' ELSE kept[x.i].t END), chr(10)), '') AS lines FROM p)
SELECT a.conv_id, {', '.join(f"coalesce(q.{c}, 0)::BIGINT AS {c}" for c in turns.COUNTS)}, coalesce(q.audit, '') AS audit,
       sha256(coalesce(q.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN q ON a.conv_id IS NOT DISTINCT FROM q.conv_id
"""


ORACLE["op13_conversation_repair"] = _repair_sql()
