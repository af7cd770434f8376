"""Compare a registered query with its DuckDB SQL on a data folder, as multisets of rows."""

from collections import Counter

import duckdb

from basketry.llm.queries import ORACLE, QUERIES


def views(sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def same(spark, name, sf):
    df = QUERIES[name](spark, sf)
    con = views(sf)
    rel = con.sql(ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = Counter(map(tuple, df.select(cols).collect()))
    want = Counter(rel.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
