import numpy as np
from pyspark.sql import functions as F

from basketry.llm import langid
from basketry.llm.queries import op7_language_id


def test_features_match_plain():
    text = b"Ab1 c"
    raw = b" ab  c "
    want = np.zeros(langid.DIM)
    for n in range(3):
        for i in range(len(raw) - n):
            g = raw[i] + 1
            for j in range(1, n + 1):
                g = (g * 259 + raw[i + j] + 1) % 2**32
            want[((g * 2654435761 + n * 97) % 2**32) >> (32 - langid.DIM_BITS)] += 1
    want = np.sqrt(want)
    assert np.allclose(langid.features(text), want / np.linalg.norm(want), atol=1e-6)


def test_families_join_close_languages():
    m = np.array([[1, 0.9, 0, 0], [0.9, 1, 0, 0.1], [0, 0, 1, 0.9], [0, 0.1, 0.9, 1]])
    assert sorted(langid.families(m, 2)) == [[0, 1], [2, 3]]


def test_edge_cases(spark, docs):
    rows = [(i, "das ist ein Satz und noch einer " * 3, "de") for i in range(20)]
    rows += [(i, "this is the other sentence of it " * 3, "en") for i in range(20, 40)]
    rows += [(50, None, "de"), (51, "", None), (52, "123 !!", "en"), (None, "the sentence of this", None), (54, "ein Satz " * 40_000, None),
             (55, "ein Satz", None), (55, "ein Satz", None)]
    df = docs(rows)
    model = langid.fit(df, "text", "lang", F.xxhash64("doc_id"))
    assert model.names == ["de", "en"]
    out = langid.with_language(df, "text", model, "lang_")
    assert out.columns == [*df.columns, "lang_"]
    got = [(r.doc_id, r.lang_.lang, r.lang_.score) for r in out.collect()]
    by = {i: (v, s) for i, v, s in got}
    assert len(got) == len(rows)
    assert [by[i] for i in (50, 51, 52)] == [("und", 0.0)] * 3
    assert by[None][0] == "en" and by[54][0] == by[55][0] == "de" and all(0 <= s <= 1 for _, _, s in got)
    assert langid.fit(df.filter("lang is null"), "text", "lang", F.xxhash64("doc_id")) is None
    assert {r.p.lang for r in langid.with_language(df, "text", None, "p").collect()} == {"und"}
    one = langid.fit(df.filter("lang = 'de'"), "text", "lang", F.xxhash64("doc_id"))
    assert {r.p.lang for r in langid.with_language(df, "text", one, "p").collect()} == {"und", "de"}
    assert langid.with_language(docs([]), "text", model, "p").count() == 0
    assert langid.fit(docs([]), "text", "lang", F.xxhash64("doc_id")) is None


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    j = op7_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert j.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    assert j.filter("score < 0 or score > 1 or score is null").count() == 0


def many_languages(n, docs_each=12, seed=0):
    """Texts of n made-up languages, each with words of its own."""
    rng = np.random.default_rng(seed)
    out = []
    for lang in range(n):
        words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(12)]
        out += [(f"l{lang:02d}", " ".join(rng.choice(words, 60))) for _ in range(docs_each)]
    return out


def test_certain_languages_score_high_for_any_number_of_languages():
    for n in (2, 5, 7, 13, 20, 45):
        got = many_languages(n)
        x, y = np.array([langid.features(t.encode()) for _, t in got]), [v for v, _ in got]
        lang, score = langid.LanguageModel(x, y).predict(x)
        assert lang == y and score.min() > 0.95 and score.max() <= 1, n


def test_a_guess_has_half_for_any_number_of_classes():
    x = np.eye(8, langid.DIM, dtype=np.float32)
    for k in (2, 3, 8):
        p = langid.Pairwise(x[:k], np.arange(k), k)
        p.w[:], p.b[:] = 0, 0
        assert np.allclose(p.choose(x)[1], 0.5)


def test_more_languages_than_a_sample_has_shares(spark, docs, monkeypatch):
    """Each of 230 languages is learned, though the sample allows a few texts of each."""
    texts = many_languages(230, docs_each=4)
    df = docs([(i, t, lang, "s") for i, (lang, t) in enumerate(texts)])
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 500)
    model = langid.fit(df, "text", "lang", F.xxhash64("doc_id"))
    assert model.names == sorted({lang for lang, _ in texts}) and len(model.names) == 230
    got = langid.with_language(df, "text", model, "p").select("lang", "p.lang").collect()
    assert sum(a == b for a, b in got) > 0.9 * len(got)


def test_query_against_plain_scoring(spark):
    """The query's predictions are those of the model applied to each text alone, in plain code."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(rows.filter(langid.F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0), "text", "lang", F.xxhash64("doc_id", F.lit(3)))
    got = {r.doc_id: (r.lang_pred, r.score) for r in op7_language_id(spark, sf).collect()}
    for r in rows.collect():
        raw = (r.text or "").encode()
        if not any(c.isalpha() for c in (r.text or "")):
            assert got[r.doc_id] == ("und", 0.0)
        else:
            lang, score = model.predict(np.array([langid.features(raw)]))
            assert got[r.doc_id][0] == lang[0] and abs(got[r.doc_id][1] - score[0]) < 1e-5
