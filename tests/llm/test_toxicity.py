import random

import numpy as np
from pyspark.sql import functions as F

from basketry.llm import toxicity
from basketry.llm.queries import op4_toxicity_ftrl


def test_grams_match_plain():
    from zlib import crc32
    ws = [b"a", b"bc", b"a", "é".encode(), b"x"]
    h = [crc32(w) for w in ws]
    m = 2**64
    want = [h[i] * 0x9E3779B97F4A7C15 % m for i in range(5)]
    for gap in (1, 2, 3):
        want += [(h[i] * 0xC2B2AE3D27D4EB4F + h[i + gap] + gap) * 0x9E3779B97F4A7C15 % m for i in range(5 - gap)]
    got = toxicity.grams("A, bc  a é\n(x)".encode())
    assert got.tolist() == [w >> (64 - toxicity.BITS) for w in want]
    assert len(toxicity.grams(b"")) == 0 and len(toxicity.grams(b"one")) == 1


def test_ftrl_matches_plain_updates():
    rnd, m = random.Random(2), toxicity.Ftrl(l1=0.2)
    z, n, bias = {}, {}, 1 << toxicity.BITS
    for _ in range(50):
        at = sorted(rnd.sample(range(30), 4))
        y = int(at[0] < 5)
        w = {}
        for i in [*at, bias]:
            zi, ni, l1 = z.get(i, 0.0), n.get(i, 0.0), 0 if i == bias else m.l1
            w[i] = 0.0 if abs(zi) <= l1 else -(zi - np.sign(zi) * l1) / ((m.beta + ni ** 0.5) / m.alpha + m.l2)
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in w:
            s = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / m.alpha
            z[i], n[i] = z.get(i, 0.0) + g - s * w[i], n.get(i, 0.0) + g * g
        m.learn(np.array(at, np.int32), y)
    assert all(abs(m.z[i] - z[i]) < 1e-9 for i in z)


def labelled(spark, docs):
    rnd = random.Random(0)
    words = "the of and lorem ipsum dolor sit amet".split()
    rows, labels = [], []
    for i in range(600):
        ws = [rnd.choice(words) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                ws[rnd.randrange(30)] = rnd.choice(["scoundrel", "rascal!"])
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    return docs(rows), spark.createDataFrame(labels + [(None, 1), (3, None), (99999, 1)], "id long, label int")


def test_learn_and_edge_cases(spark, docs):
    df, labels = labelled(spark, docs)
    w = toxicity.fit(df.filter("doc_id % 3 <> 0"), labels, "doc_id", "text")
    assert len(w[0]) < 2000
    got = {r.id: r.score for r in toxicity.score_toxicity(df, w, "doc_id", "text").collect()}
    right = [(got[i] >= 0.3) == (i % 5 == 0) for i in got if i % 3 == 0]
    assert sum(right) >= 0.95 * len(right)
    odd = docs([(None, None), (1, ""), (1, ""), (2, "rascal " * 50_000), (3, "!!! ###")])
    s = [(r.id, r.score) for r in toxicity.score_toxicity(odd, w, "doc_id", "text").collect()]
    assert len(s) == 5 and all(0 <= x <= 1 for _, x in s)
    assert len({x for i, x in s if i != 2}) == 1
    assert toxicity.fit(df, labels.filter("label = 0"), "doc_id", "text") is None
    assert {r.score for r in toxicity.score_toxicity(odd, None, "doc_id", "text").collect()} == {0.0}
    assert toxicity.score_toxicity(docs([]), w, "doc_id", "text").count() == 0


def test_score_is_at_the_labels_rate_for_any_sample(spark, docs, monkeypatch):
    """Texts that tell nothing score the rate of toxic labels, also where the classes are sampled apart."""
    df, labels = docs([(i, "") for i in range(1500)]), spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1500)], "id long, label int")
    for most in ((3000, 6000), (100, 200), (100, 100), (150, 200)):
        monkeypatch.setattr(toxicity, "POSITIVES", most[0])
        monkeypatch.setattr(toxicity, "NEGATIVES", most[1])
        w = toxicity.fit(df, labels, "doc_id", "text")
        assert abs(toxicity.score_toxicity(df, w, "doc_id", "text").first().score - 0.1) < 0.04, most


def plain_scores(docs, labels, order, seed=5, epochs=5):
    """The query's work in dictionaries: sample in ``order``, penalty by held-out loss, updates one by one."""
    from math import exp, log, log1p

    def features(text):
        return sorted(set(toxicity.grams((text or "").encode()).tolist()))

    def weight(m, i):
        z, n = m[0].get(i, 0.0), m[1].get(i, 0.0)
        l1 = 0 if i < 0 else m[2]
        return 0.0 if abs(z) <= l1 else -(z - (l1 if z > 0 else -l1)) / ((1 + n ** 0.5) + 0.1)

    def train(data, l1, passes):
        m, rng = ({}, {}, l1), np.random.default_rng(seed)
        for _ in range(passes):
            for j in rng.permutation(len(data)):
                x, y = data[j]
                w = {i: weight(m, i) for i in [*x, -1]}
                g = 1 / (1 + exp(-sum(w.values()))) - y
                for i, wi in w.items():
                    n = m[1].get(i, 0.0)
                    m[0][i] = m[0].get(i, 0.0) + g - ((n + g * g) ** 0.5 - n ** 0.5) * wi
                    m[1][i] = n + g * g
        return m

    def margin(m, x):
        return sum(weight(m, i) for i in [*x, -1])

    data = [(features(docs[i]), labels[i]) for i in order if i in docs]
    loss = {l1: sum(log1p(exp(-margin(m, x) if y else margin(m, x))) for x, y in data[::5])
            for l1 in toxicity.PENALTIES for m in [train([d for k, d in enumerate(data) if k % 5], l1, 2)]}
    l1 = min(sorted(loss, reverse=True), key=loss.get)
    m, p = train(data, l1, epochs), sum(y for _, y in data)
    ones = sum(labels[i] for i in order)
    move = log(ones / (len(order) - ones)) - log(p / (len(data) - p))
    return {i: 1 / (1 + exp(-(margin(m, features(t)) + move))) for i, t in docs.items()}


def test_query_against_plain_learning(spark, docs, tmp_path):
    df, labels = labelled(spark, docs)
    df.filter("doc_id < 300").unionByName(docs([(7001, ""), (7002, None), (7003, "rascal " * 70_000)])).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r.id, r.label) for r in labels.filter("id < 300 AND label IS NOT NULL").collect()] + [(7003, 1), (9000, 0)],
                          "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    learn = spark.read.parquet(f"{tmp_path}/labels.parquet").filter("crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2")
    rows = learn.orderBy(F.xxhash64("doc_id", F.lit(5))).collect()
    want = plain_scores(texts, {r.doc_id: r.toxic for r in rows}, [r.doc_id for r in rows])
    got = {r.doc_id: r for r in op4_toxicity_ftrl(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    from zlib import crc32
    for i, r in got.items():
        assert abs(r.score - want[i]) < 1e-5 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (crc32(str(i).encode()) % 4 == 2)


def test_sample_is_bounded_by_bytes_and_repeated_ids_count_once(spark, docs, monkeypatch):
    rows = [(i, f"w{i} x y") for i in range(40)] + [(3, "a much longer text of the same id")] * 50 + [(5, "long " * 60_000 + "text")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "id long, label int")
    one = labels.withColumn("o", F.xxhash64("id", F.lit(5)))
    order = [r.id for r in one.orderBy("o").collect()]
    data = toxicity.sample(docs(rows), one, "text", "doc_id")
    assert [y for _, y in data] == [i % 2 for i in order]
    longest = {i: t for i, t in sorted(rows, key=lambda r: len(np.unique(toxicity.grams(r[1].encode()))))}
    assert all(np.array_equal(x, np.unique(toxicity.grams(longest[i].encode()))) for (x, _), i in zip(data, order))
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", sum(x.nbytes for x, _ in data[:10]))
    assert len(toxicity.sample(docs(rows), one, "text", "doc_id")) == 10
    assert toxicity.sample(docs([]), one, "text", "doc_id") == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    j = op4_toxicity_ftrl(spark, sf).join(labels, "doc_id").filter("held_out")
    r = j.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert r[0] > 0.65 and r[1] < 0.03, r
