import hashlib
import re

import pytest

from basketry.llm import fim
from oracle import same

UNIT = re.compile(r"[ \t\n\v\f\r]*[^ \t\n\v\f\r]+|[ \t\n\v\f\r]+")


def plainly(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n, h = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    x = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((x[0] % (n + 1), x[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or x[2] % 100 >= 50:
        return n, "plain", None, None, text
    if x[3] % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_every_cut_equals_plain_slicing(spark, docs):
    texts = [None, "", " ", "\n\t ", "a", " a", "a ", "one two  three\nfour\x0b five ", "x<P>y", "a <S", "P> <M> b", "$1 \\2 {3}",
             " no cut \U0001f600\U0001f601 z", "<", "P>", "<P <M S>", "\x1c a", "w " * 3000, "x" * 20_000]
    rows = [(i, texts[i % len(texts)]) for i in range(len(texts) * 12)] + [(None, "a b c"), (None, None), (7, "t w o"), (7, "t w o")]
    got = fim.fill_in_middle(docs(rows, extra="parts"), "doc_id", "text").withColumn("back", fim.restore("output", "form")).collect()
    key = lambda r: (str(r[0]), r[-1])
    want = [(i, *plainly(i, t), t or "") for i, t in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_a_long_text_needs_no_stack(spark, docs):
    text = "word " * 400_000
    rows = fim.fill_in_middle(docs([(i, text) for i in range(12)]), "doc_id", "text").collect()
    assert sorted(map(tuple, rows)) == sorted((i, *plainly(i, text)) for i in range(12))
    assert any(r["form"] != "plain" for r in rows)


def test_empty_table(spark, docs):
    assert fim.fill_in_middle(docs([]), "doc_id", "text").count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    same(spark, "op11_fill_in_middle", f"/root/testdata/{sf}")
