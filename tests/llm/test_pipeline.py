import re
from collections import Counter, defaultdict

import sentencepiece
from test_langid import many_languages
from test_secret_scan import plain as plain_spans
from test_simhash import plain_fp, plain_groups

import corpus_pipeline as cp
from basketry.llm import langid
from basketry.llm.common import read_table, stored
from basketry.llm.pieces import MODEL

SF = "/root/testdata/sf0.001"
COLS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return [tuple(r) for r in df.select(COLS).collect()]


def test_stages_against_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    seen = {}
    for name, stage in cp.STAGES:
        seen[name] = docs
        docs = stored(stage(spark, docs, SF), name)
        if name != "piece_encoding":
            assert docs.columns == COLS
    inputs, outputs = seen, {a: b for a, b in zip(seen, [*list(seen.values())[1:], docs])}

    # language ID: all documents with a clear language stay as they were
    before, after = rows(inputs["language_id"]), rows(outputs["language_id"])
    assert not Counter(after) - Counter(before)
    gone = [r for r in before if r not in set(after)]
    assert len(gone) <= 0.02 * len(before) and all(len(re.findall(r"\w+", r[1] or "")) < 50 for r in gone)

    # near-duplicates: the smallest id of each group of linked fingerprints
    before, after = rows(inputs["simhash_dedup"]), rows(outputs["simhash_dedup"])
    fp = {r[0]: plain_fp(r[1]) for r in before}
    comp = plain_groups(set(fp.values()))
    least = {}
    for i, f in fp.items():
        least[comp[f]] = min(i, least.get(comp[f], i))
    assert sorted(after) == sorted(r for r in before if least[comp[fp[r[0]]]] == r[0])

    # secrets: the same documents with the spans replaced
    before, after = rows(inputs["secret_redaction"]), {r[0]: r for r in rows(outputs["secret_redaction"])}
    assert len(after) == len(before)
    for i, text, lang, source, _ in before:
        want, pos = "", 0
        for s, _, e, _ in plain_spans(text):
            if s >= pos:
                want += text[pos:s] + "[SECRET]"
            pos = max(pos, e)
        want += text[pos:]
        assert after[i] == (i, want, lang, source, len(want))

    # mix: whole rows, at most twice, near the targets
    before, after = rows(inputs["source_mix"]), Counter(rows(outputs["source_mix"]))
    assert set(after) <= set(before) and max(after.values()) <= 2
    size = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in before}
    total, taken = defaultdict(int), defaultdict(int)
    for r in before:
        total[r[3]] += size[r]
        taken[r[3]] += after[r] * size[r]
    most = max(size.values())
    assert abs(sum(taken.values()) - 1.5 * sum(total.values())) <= len(total) * most
    assert all(taken[s] <= 2 * total[s] + most for s in total)

    # pieces: the library's ids, two distinct samples that decode to the text
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r[0]: r[1] for r in rows(inputs["piece_encoding"])}
    got = docs.collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows(inputs["piece_encoding"]))
    for r in got:
        assert r.round_trip and r.ids == sp.encode(texts[r.doc_id])
        assert all(sp.decode(s) == texts[r.doc_id] for s in r.sampled)


def test_odd_rows_pass_every_stage(spark, docs):
    """Nulls, empty texts and repeated rows: letterless documents go first, the rest runs through."""
    en = "The word and some of the others are here "
    odd = [(1, None, "en"), (2, "", "en"), (3, "?! 12", None), (4, en + "password=abcdefghijkl", None), (4, en + "password=abcdefghijkl", None),
           (None, en * 3, None, None), (6, "w" * 100_000, "en", "s"), (7, en * 9_000, "en", "s", 5)]
    odd += [(100 + i, en * (1 + i % 5) + f"x{i} y{i} z{i}", "en", "s") for i in range(20)]
    df = docs(odd, extra="language").drop("language")
    assert {r.doc_id for r in cp.language_id(spark, df, SF).collect()}.isdisjoint({1, 2, 3})
    for name, stage in cp.STAGES[1:]:
        out = stage(spark, df, SF).collect()
        assert out, name
        assert len(out) == len(odd) or name in ("simhash_dedup", "source_mix")
    none = docs([]).select(COLS)
    for name, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0, name
    assert langid.fit(none, "text", "lang", cp.F.xxhash64("doc_id")) is None


def test_language_id_keeps_certain_documents_of_many_languages(spark, docs):
    """Twenty languages: every document of a clear language stays, one without letters goes."""
    texts = many_languages(20)
    df = docs([(i, t, lang, "s") for i, (lang, t) in enumerate(texts)] + [(9999, "12 34 " * 50, None, "s")], extra="language").drop("language")
    assert {r.doc_id for r in cp.language_id(spark, df, SF).collect()} == set(range(len(texts)))


def test_run(spark):
    assert cp.run(spark, SF).count() > 100
