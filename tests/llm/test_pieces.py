import itertools
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from basketry.llm import pieces
from basketry.llm.pieces import MODEL, Lattice, encode_batch, units, vocab

TEXTS = ["", " ", "a", " a", "a ", "a  b", "\n", "\na", "a\n", "a \n b", "a\n\nb", "  \n  ", "Hello world, this is it.", "été ü 漢字 😀",
         "tab\tx", "the thndater of ofthstthor\nnd " * 30, "x" * 300, "a\x00b", "\r\n\x0b"]


def test_units_concatenate_to_the_text():
    rnd = random.Random(0)
    for _ in range(500):
        t = "".join(rnd.choice(" \nab▁") for _ in range(rnd.randrange(1, 12)))
        assert "".join(map(pieces.unit, units(t))) == " " + t


def test_encoding_is_the_library_s():
    v, sp = vocab(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    best, begin, _ = encode_batch(TEXTS, np.arange(len(TEXTS), dtype=np.uint64), 2, v)
    for t, a, b in zip(TEXTS, begin, begin[1:]):
        ids = best[a:b].tolist()
        assert v.decode(ids) == t.encode()
        if sp.decode(sp.encode(t)) == t:
            assert ids == sp.encode(t), t


def segmentations(unit, v):
    """All segmentations of a unit with their probability, by trying every cut."""
    s = unit.replace(" ", pieces.BLANK)
    ids = {v.sp.id_to_piece(i): i for i in range(v.sp.get_piece_size()) if v.weight[i] > -np.inf}
    out = {}
    for cuts in itertools.product([0, 1], repeat=len(s) - 1):
        parts, at = [], 0
        for i, c in enumerate([*cuts, 1]):
            if c:
                parts.append(s[at:i + 1])
                at = i + 1
        if all(p in ids for p in parts):
            out[tuple(ids[p] for p in parts)] = np.exp(sum(v.weight[ids[p]] for p in parts))
    total = sum(out.values())
    return {k: p / total for k, p in out.items()}


def test_sampling_without_replacement():
    """First samples follow the distribution; pairs that of drawing twice without replacement; scores match."""
    v, n, text = vocab(MODEL), 6000, "then"
    p = segmentations(" then", v)
    _, _, got = encode_batch([text] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919), 2, v)
    pairs = Counter((tuple(g[0][0]), tuple(g[1][0])) for g in got)
    assert all(a != b for a, b in pairs)
    for a in sorted(p, key=p.get)[-3:]:
        assert sum(c for (x, _), c in pairs.items() if x == a) / n == pytest.approx(p[a], abs=0.025)
        for b in sorted(p, key=p.get)[-3:]:
            if a != b:
                assert pairs[a, b] / n == pytest.approx(p[a] * p[b] / (1 - p[a]), abs=0.025)
    for ids, lp, li in got[0]:
        assert lp == pytest.approx(np.log(p[tuple(ids)]), abs=1e-4) and li <= 0
    # Horvitz-Thompson: with inclusion scores the samples' weights add up to 1 on average
    assert np.mean([sum(np.exp(lp - li) for _, lp, li in g) for g in got]) == pytest.approx(1, abs=0.05)


def test_all_segmentations_when_k_is_large():
    v = vocab(MODEL)
    p = segmentations(" the", v)
    _, _, got = encode_batch(["the"], np.array([5], np.uint64), len(p) + 3, v)
    assert {tuple(g[0]) for g in got[0]} == set(p) and all(li == 0 for _, _, li in got[0])


def test_samples_decode_and_do_not_depend_on_batches():
    v, rnd = vocab(MODEL), random.Random(3)
    texts = TEXTS + [" ".join("".join(rnd.choice("thenoréo▁") for _ in range(rnd.randrange(9))) for _ in range(40)) for _ in range(30)]
    keys = np.arange(len(texts), dtype=np.uint64) * np.uint64(31)
    _, _, got = encode_batch(texts, keys, 3, v)
    for i, (t, g) in enumerate(zip(texts, got)):
        assert len({tuple(x[0]) for x in g}) == len(g) >= 1
        assert all(v.decode(x[0].tolist()) == t.encode() for x in g)
        alone = encode_batch([t], keys[i:i + 1], 3, v)[2][0]
        assert [(x[0].tolist(), x[1]) for x in alone] == [(x[0].tolist(), x[1]) for x in g]


def test_long_unit():
    lat = Lattice([" " + "z" * 20_000], vocab(MODEL))
    assert np.isfinite(lat.cum).all() and (lat.cum[:, -1] == 1).all()


def test_edge_cases(spark, docs):
    rows = [(1, None), (2, ""), (None, "null id"), (4, "same row"), (4, "same row"), (5, "word " * 50_000), (6, "a▁b ▁ c")]
    df = docs(rows, extra="ids")
    e = pieces.with_pieces(df.drop("ids").withColumnsRenamed({"doc_id": "id"}), "id", "text", k=2, keep=["id", "text"])
    got = e.withColumn("back", pieces.decode(pieces.F.col("ids"))).collect()
    assert pieces.with_pieces(df, "doc_id", "text").columns == [*df.columns, "ids_", "sampled", "log_prob", "log_inclusion", "round_trip"]
    assert len(got) == len(rows)
    for r in got:
        assert r.back == (r.text or "") and r.round_trip and len(r.sampled) == len(r.log_prob) == len(r.log_inclusion) >= 1
    assert len({str((r.sampled, r.log_inclusion)) for r in got if r.id == 4}) == 1
    assert [r.sampled for r in got if r.id in (1, 2)] == [[[]], [[]]]
    assert pieces.encode(docs([]), "doc_id", "text").count() == 0


def test_round_trips_find_a_wrong_text():
    v = vocab(MODEL)
    best, begin, _ = encode_batch(["ab", "cd", ""], np.arange(3, dtype=np.uint64), 1, v)
    assert pieces.round_trips(["ab", "cd", ""], best, begin, v) == [True] * 3
    assert pieces.round_trips(["ab", "cx", ""], best, begin, v) == [True, False, True]


def test_query(spark):
    from basketry.llm.queries import op6_piece_sampling
    sf = "/root/testdata/sf0.001"
    got = op6_piece_sampling(spark, sf).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(texts) and all(r.round_trip for r in got)
    assert all(r.n_pieces == len(sp.encode(texts[r.doc_id])) for r in got)


def test_memory_of_a_batch():
    """A full batch of units that are all different stays small beside an executor's memory."""
    import tracemalloc
    rnd, v = random.Random(3), vocab(MODEL)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(pieces.BATCH)]
    texts = [" ".join(words[i:i + 500]) for i in range(0, len(words), 500)]
    tracemalloc.start()
    encode_batch(texts, np.arange(len(texts)).astype(np.uint64), 2, v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6, peak


def test_units_that_come_back_are_built_once(monkeypatch):
    built, old = [], pieces.Lattice
    monkeypatch.setattr(pieces, "Lattice", lambda distinct, v: built.extend(distinct) or old(distinct, v))
    v, rnd = pieces.Vocab(MODEL), random.Random(5)
    words = ["".join(rnd.choices("etaoin", k=7)) for _ in range(400)]
    for _ in range(5):
        encode_batch([" ".join(rnd.choices(words, k=2000))], np.array([1], np.uint64), 2, v)
    assert len(built) == len(set(built)) <= len(words)


def test_full_store_gives_the_same(monkeypatch):
    """Results, scores to the last bit, do not depend on what the store holds or on how often it was full."""
    rnd = random.Random(8)
    words = ["".join(rnd.choices(["the", "é", "漢", "ation", "inter", "x", "s", "▁"], k=rnd.randrange(1, 9))) for _ in range(3000)]
    texts = [*TEXTS, *[" ".join(words[min(int(rnd.expovariate(1 / 300)), 2999)] for _ in range(200)) for _ in range(60)]]
    keys = np.arange(len(texts), dtype=np.uint64) * np.uint64(77)
    plain = lambda got: [[(x[0].tolist(), x[1], x[2]) for x in g] for g in got]
    best, begin, got = encode_batch(texts, keys, 3, pieces.Vocab(MODEL))
    monkeypatch.setattr(pieces, "KEPT", 300)
    monkeypatch.setattr(pieces, "KEPT_CHARS", 4000)
    v = pieces.Vocab(MODEL)
    for i in range(0, len(texts), 3):
        b, at, g = encode_batch(texts[i:i + 3], keys[i:i + 3], 3, v)
        assert plain(g) == plain(got[i:i + 3])
        assert b.tolist() == best[begin[i]:begin[min(i + 3, len(texts))]].tolist()
        assert v.store.start.n == len(v.store.index) <= 300 + 600
        assert v.store.near.n == v.store.chars.n == v.store.size.all[:v.store.size.n].sum()


def test_memory_of_a_worker():
    """Many batches of units that are all different: four workers of an executor keep a small part of its memory."""
    import tracemalloc
    rnd, v = random.Random(4), vocab(MODEL)
    tracemalloc.start()
    for _ in range(-(-300_000 // pieces.BATCH)):
        words = ["".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(pieces.BATCH)]
        texts = [" ".join(words[i:i + 500]) for i in range(0, len(words), 500)]
        encode_batch(texts, np.arange(len(texts)).astype(np.uint64), 2, v)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 140e6 and kept < 110e6, (peak, kept)


def test_idle_worker_keeps_no_store(spark, docs):
    """After a task, a worker has its vocabulary and no units of the texts it saw."""
    import pyarrow as pa

    def kept(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([len(vocab(MODEL).store.index) + vocab(MODEL).store.ids.n] * b.num_rows, pa.int64())], ["n"])

    df = docs([(i, f"one two three {i}") for i in range(50)]).coalesce(1)
    assert pieces.encode(df, "doc_id", "text").filter("round_trip").count() == 50
    assert {r.n for r in df.select("doc_id").mapInArrow(kept, "n long").collect()} == {0}


def test_work_by_batch_not_by_text(monkeypatch):
    """Noise is drawn for all texts of a batch at once: as many calls for 200 texts as for 20."""
    calls, old = [], pieces.uniform
    monkeypatch.setattr(pieces, "uniform", lambda x: calls.append(len(x)) or old(x))
    v, n = pieces.Vocab(MODEL), []
    for texts in (20, 200):
        encode_batch(["the thonre ofstiont, anhe " * 5] * texts, np.arange(texts, dtype=np.uint64), 2, v)
        n.append(len(calls))
        calls.clear()
    assert n[1] <= n[0] + 10, n


def test_lattice_is_narrow():
    """A lattice has all lengths of the longest piece only for the states that need them, and equals sums by character."""
    import tracemalloc
    v, rnd = vocab(MODEL), random.Random(6)
    distinct = [" " + "".join(rnd.choices("etaoinshr", k=rnd.randrange(1, 14))) for _ in range(4000)] + [" 漢é", "\n", " ation", " the▁"]
    tracemalloc.start()
    lat = Lattice(distinct, v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * len(lat.chars), peak / len(lat.chars)
    ids = {v.sp.id_to_piece(i): i for i in range(v.sp.get_piece_size()) if v.weight[i] > -np.inf}
    cum = lat.cum
    for u, at in zip(distinct[-300:], lat.start[-301:].tolist()):
        s = "".join(pieces.BLANK if c == " " else "\0" if c == pieces.BLANK else c for c in u)
        beta = [0.0] * (len(s) + 1)
        for i in range(len(s) - 1, -1, -1):
            logs = [v.weight[ids[s[i:j]]] + beta[j] if s[i:j] in ids else -np.inf for j in range(i + 1, min(len(s), i + v.longest) + 1)]
            if logs[0] == -np.inf:
                logs[0] = v.byte_weight * len(u[i].encode()) + beta[i + 1]
            beta[i] = np.logaddexp.reduce(logs)
            want = np.cumsum(np.exp(np.array(logs) - beta[i]))
            got = np.append(cum[at + i], np.ones(v.longest))[:len(want)]
            assert got == pytest.approx(want, abs=1e-9)
