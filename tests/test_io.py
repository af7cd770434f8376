"""Sources and sinks: explicit-schema CSV reads, Parquet/CSV/JSON writes, model text round trip."""

import json
import os
import tempfile



from basketry.functions.treemodel import SAVED_RANKER, model_text, parse_model_text, tree_score
from basketry.operators import patterns as pat
from basketry.sources import (load_tables, read_articles_csv, read_customers_csv, read_transactions_csv, write_csv,
                              write_json, write_parquet)

SF = "/root/testdata/sf0.001"


def test_csv_round_trip_with_explicit_schema(spark):
    t = load_tables(spark, SF)
    base = tempfile.mkdtemp(prefix="io-test-")
    tx = t.tx.select("t_dat", "customer_id", "article_id", "price")
    write_csv(tx, f"{base}/tx")
    back = read_transactions_csv(spark, f"{base}/tx")
    assert dict(back.dtypes) == {"customer_id": "string", "article_id": "string", "t_dat": "date", "price": "double"}
    assert back.count() == tx.count()
    assert back.exceptAll(tx.select(*back.columns)).count() == 0
    write_csv(t.articles, f"{base}/art")
    write_csv(t.customers, f"{base}/cust")
    assert read_articles_csv(spark, f"{base}/art").count() == t.articles.count()
    assert dict(read_customers_csv(spark, f"{base}/cust").dtypes)["age"] == "int"


def test_parquet_and_json_sinks(spark):
    t = load_tables(spark, SF)
    base = tempfile.mkdtemp(prefix="io-test-")
    write_parquet(t.tx, f"{base}/txp", partition_by=None)
    assert spark.read.parquet(f"{base}/txp").count() == t.tx.count()
    doc = pat.shopping_patterns_json(t.tx, t.customers, t.articles)
    write_json(doc, f"{base}/patterns", column="patterns")
    files = [f for f in os.listdir(f"{base}/patterns") if f.startswith("part-")]
    text = "".join(open(os.path.join(base, "patterns", f)).read() for f in files).strip()
    parsed = json.loads(text)
    assert set(parsed) == {"age_price_distribution", "age_category_distribution", "price_frequency_distribution",
                           "overall_frequency", "overall_category"}
    assert abs(sum(parsed["overall_frequency"].values()) - 100.0) < 1e-9


def test_model_text_round_trip(spark):
    m = parse_model_text(model_text(SAVED_RANKER))
    assert m.feature_names == SAVED_RANKER.feature_names and len(m.trees) == 1
    df = spark.createDataFrame([(5, 3, 1, 1500, 20), (80, 0, 2, 10, 900)],
                               "purchase_count long, recency long, purchase_frequency_encoded long, "
                               "popularity_rank long, sales_count long")
    a = [r[0] for r in df.select(tree_score(SAVED_RANKER)).collect()]
    b = [r[0] for r in df.select(tree_score(m)).collect()]
    assert a == b


def test_nested_write_once_tables_do_not_deadlock(spark):
    import threading
    t = load_tables(spark, SF + "/.")  # a fresh key: its transactions table is not written yet
    out = {}

    def work():
        out["n"] = t.derived("nested_probe", lambda: t.tx.groupBy("customer_id").count()).count()

    th = threading.Thread(target=work, daemon=True)
    th.start()
    th.join(180)
    assert not th.is_alive(), "building a derived table that reads another one must not block"
    assert out["n"] > 0
