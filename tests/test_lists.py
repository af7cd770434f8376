"""Per-user lists stay arrays: nothing groups, sorts or ranks users x list rows, and fusing them equals a plain merge."""

import pytest

import __spark_entry__ as E
from basketry.operators import candidates as cand
from basketry.operators import ranking as rk

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", ["merged_candidates", "low_activity_candidates", "recommend"])
def test_nothing_ranks_unfolded_lists(spark, key):
    lines = E.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    unfold = next(i for i, x in enumerate(lines) if "Generate inline" in x)
    assert not any(w in x for x in lines[:unfold] for w in ("Window", "Aggregate", "Sort")), key


def test_candidate_quality_never_unfolds_lists(spark):
    p = E.queries()["candidate_quality"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate inline" not in p


def test_arms_join_no_list_to_its_user_again(spark):
    """Segments are read from one table, and the lists of both branches carry their users along."""
    p = E.queries()["experiment_arms"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "60d" not in p and any("Relation [customer_id" in x and "segment#" in x for x in p.splitlines())


def _plain(cf, pop, total_k, pop_top, k=60):
    """One user's list: cf {item: pos}, pop items in order."""
    place = {}
    for i, x in enumerate(pop, 1):
        place.setdefault(x, i)
    union = {x for x in place if place[x] <= pop_top} | set(cf)
    fill = [x for x in sorted(place, key=place.get) if x not in union][:max(0, total_k - len(union))]
    rows = []
    for x in union | set(fill):
        c = 1 / (k + cf[x]) if x in cf else 0.0
        p = 1 / (k + place[x]) if x in place and (place[x] <= pop_top or x not in cf) else 0.0
        rows.append((0.15 * p + 0.70 * c, c, p, x))
    return [r[3] for r in sorted(rows, reverse=True)][:total_k]


@pytest.mark.parametrize("total_k", [3, 6, 9])
def test_fused_lists_equal_a_plain_merge(spark, mk, total_k):
    # an item listed twice, a CF item on the pop list, one on its expansion only, one on neither; a user without CF
    pop = ["a", "b", "b", "c", "d", "e", "f", "g"]
    itf = mk("article_id string, popularity_rank long, sales_count long", [(x, i, 100 - i) for i, x in enumerate(pop, 1)])
    own = {"u1": {"b": 1, "z": 2, "e": 3}, "u2": {"a": 1}}
    cf = mk("customer_id string, pos long, article_id string, popularity_rank long, sales_count long",
            [(u, p, x, None, 5) for u, m in own.items() for x, p in m.items()])
    users = mk("customer_id string", [("u1",), ("u2",), ("u3",), (None,)])
    out = cand.merged_candidates(users, None, itf, total_k, pop_top=4, cf_top=3, fallback_pop_expand=8, cf=cf,
                                 carry=("popularity_rank", "sales_count")).collect()
    for u in ("u1", "u2", "u3", None):
        got = [r.article_id for r in sorted((r for r in out if r.customer_id == u), key=lambda r: r.pos)]
        assert got == _plain(own.get(u, {}), pop, total_k, 4), u
    ranks = {(r.customer_id, r.article_id): r.popularity_rank for r in out}
    if total_k == 9:
        assert ranks["u1", "z"] is None and ranks["u1", "b"] == 3 and ranks["u3", "b"] == 3


@pytest.mark.parametrize("model", [rk.SAVED_RANKER, None])
def test_reranked_lists_equal_reranked_rows(spark, mk, model):
    item = "pos long, article_id string, popularity_rank long, sales_count long"
    rows = [("u1", [(1, "a", 600, 5), (2, "b", None, 5), (3, "c", 10, 900), (4, "d", 5, 300)]), ("u2", [(1, "a", None, 1), (2, "b", None, 2)]),
            ("u3", [(1, "a", 3, 5)]), (None, [(1, "a", 3, 5)]), ("u4", [])]
    lists = spark.createDataFrame(rows, f"customer_id string, list array<struct<{item.replace(' ', ':').replace(',:', ',')}>>")
    uf = mk("customer_id string, purchase_count long, recency long, purchase_frequency string", [("u1", 9, 3, "high"), ("u2", 2, None, "low"), ("u4", 1, 1, "low")])
    by_rows = rk.rerank_topk(lists.selectExpr("customer_id", "inline(list)"), uf, None, 3, model)
    by_lists = rk.rerank_lists(lists, uf, 3, model).selectExpr("customer_id", "inline(list)")
    assert sorted(map(str, by_lists.collect())) == sorted(map(str, by_rows.collect()))


def test_cf_rows_meet_in_one_shuffle_by_user(spark):
    """Gains are not grouped in another shuffle than the one the top-k needs, and bought items need no join."""
    p = E.queries()["cf_candidates"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in p and sum("hashpartitioning(customer_id" in x and "article_id" in x for x in p.splitlines()) == 1


def test_cf_leaves_out_bought_items_of_known_users(spark, mk):
    tx = mk("customer_id string, article_id string, t_dat date", [
        (u, x, "2024-01-01") for u, items in [("u1", "ab"), ("u2", "bc"), (None, "ab")] for x in items])
    itf = mk("article_id string, popularity_rank long", [("a", 1), ("b", 2)])
    cfw = cand.cf_window(tx, 28)
    rows = lambda **k: sorted((str(r.customer_id), r.article_id) for r in cand.cf_candidates(cfw, itf, **k).collect())
    # a row without a customer is nobody's purchase, as in a join on the id
    assert rows() == [("None", "a"), ("None", "b"), ("None", "c"), ("u1", "c"), ("u2", "a")]
    assert rows(exclude_already_purchased=False) == sorted([(u, x) for u in ("None", "u1", "u2") for x in "abc"])


def test_tasks_by_user_grow_with_the_rows(spark, mk, monkeypatch):
    """Rows of seeds x matrix, pairs and users' lists are dealt out to more tasks as there are more of them, with equal rows."""
    day = lambda i: f"2024-01-{1 + i % 20:02d}"
    tx = mk("customer_id string, article_id string, t_dat date", [(f"u{i % 9}", f"a{(i * 7) % 11}", day(i % 3)) for i in range(60)] + [(None, "a1", day(0))])
    itf = mk("article_id string, popularity_rank long, sales_count long", [(f"a{i}", i + 1, 50 - i) for i in range(11)])
    articles = mk("article_id string, product_group_name string", [(f"a{i}", f"g{i % 3}") for i in range(11)])
    uf = mk("customer_id string, purchase_count long, recency long, purchase_frequency string", [(f"u{i}", i, i, "high") for i in range(9)])
    segments = mk("customer_id string, segment string", [(f"u{i}", "active" if i % 2 else "low_activity") for i in range(9)])
    cfw = cand.cf_window(tx, 28)

    def runs():
        users, cooc = tx.select("customer_id"), cand.item_cooccurrence(cfw)
        return {"cooc": cooc, "cf": cand.cf_candidates(cfw, itf, top_k=5, cooc=cooc), "merged": cand.merged_candidates(users, cfw, itf, 8, 3, 5, cooc=cooc),
                "recommend": rk.recommend(users, tx, uf, itf, articles, segments, top_k=4, candidate_k=8, cooc=cooc)}

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    few = {k: sorted(map(str, df.collect())) for k, df in runs().items()}
    monkeypatch.setattr(cand, "TASK_ROWS", 5)
    monkeypatch.setattr(cand, "FEW_TASKS", 2)
    many = runs()
    assert {k: sorted(map(str, df.collect())) for k, df in many.items()} == few
    # 61 rows: 61 * 4 / 5 partitions of pairs; more of gains; 61 * 16 / 5 of users, and one more for the other branch
    assert "RepartitionByExpression [customer_id" in plan(many["cf"]) and ", 49" in plan(many["cooc"])
    assert all(", 196" in plan(many[k]) for k in ("merged", "recommend")) and ", 197" in plan(many["recommend"])
    assert cand.user_parts(cfw, 10) == 0 and cand.user_parts(cfw, 16) == 4 and cand.user_parts(cfw, 5000) == 1000
