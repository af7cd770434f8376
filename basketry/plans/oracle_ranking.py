"""Oracle SQL for the ranking dataset, tree scoring and metrics."""

from basketry.functions.treemodel import SAVED_RANKER, nodes_sql_values

FEATS = ["purchase_count", "recency", "purchase_frequency_encoded", "popularity_rank", "sales_count"]


def dataset_ctes(sample: int | None, pos: int, neg: int, window: int, pool: int, seed: int) -> str:
    """Everything per user as lists: purchases newest first, and the popularity pool without them in
    hash order; positives and negatives are heads of these lists. ``sample`` None takes all users."""
    some = f"[1:{int(sample)}]" if sample is not None else ""
    n_neg = int(neg) * int(pos)
    return f"""
history AS (SELECT customer_id, list(article_id ORDER BY t_dat DESC, article_id) AS items FROM tx
            WHERE t_dat + {int(window)} >= (SELECT max(t_dat) FROM tx) GROUP BY customer_id),
chosen AS (SELECT unnest(list(customer_id ORDER BY md5(customer_id || '{seed}'), customer_id){some}) AS customer_id FROM history),
rsample AS (SELECT customer_id FROM chosen),
rpos AS (SELECT customer_id, CAST(i AS BIGINT) AS rn, items[i] AS article_id, 1 AS label
         FROM (SELECT customer_id, items, unnest(range(1, {int(pos)} + 1)) AS i FROM history SEMI JOIN chosen USING (customer_id)
               WHERE len(items) >= {int(pos)})),
offer AS (SELECT list(article_id ORDER BY popularity_rank NULLS LAST, article_id)[1:{int(pool)}] AS pool FROM itf),
rneg AS (SELECT customer_id, unnest(list_transform(list_sort(list_transform(
                  list_filter(pool, lambda x: NOT list_contains(items, x)),
                  lambda x: {{'h': md5(customer_id || x || '{seed}'), 'a': x}}))[1:{n_neg}], lambda x: x.a)) AS article_id, 0 AS label
         FROM history SEMI JOIN chosen USING (customer_id), offer),
rds AS (SELECT customer_id, article_id, label, uf.purchase_count, uf.recency,
               CAST(coalesce(list_position(['medium', 'high'], uf.purchase_frequency), 0) AS BIGINT) AS purchase_frequency_encoded,
               itf.popularity_rank, itf.sales_count
        FROM (SELECT customer_id, article_id, label FROM rpos UNION ALL FROM rneg)
             JOIN uf USING (customer_id) JOIN itf USING (article_id))"""


def split_cte(seed: int, ratio: float = 0.2, src: str = "rds") -> str:
    return f"""
rsplit AS (SELECT customer_id,
                  CASE WHEN row_number() OVER (ORDER BY md5(customer_id || '{seed}'), customer_id)
                            <= floor((SELECT count(DISTINCT customer_id) FROM {src}) * {float(ratio)!r})
                       THEN 'val' ELSE 'train' END AS split
           FROM (SELECT DISTINCT customer_id FROM {src}))"""


def tree_ctes(src: str, keys: list[str], name: str = "scored") -> str:
    """Recursive walk over a node table: independent of the nested-CASE form used by Spark."""
    nodes, leaves = nodes_sql_values(SAVED_RANKER)
    fsel = "CASE n.f " + " ".join(f"WHEN {i} THEN coalesce(CAST(s.{c} AS DOUBLE), 0.0)"
                                  for i, c in enumerate(FEATS)) + " END"
    on = " AND ".join(f"s.{k} = w.{k}" for k in keys)
    kcols = ", ".join(keys)
    wk = ", ".join(f"w.{k}" for k in keys)
    return f"""
tnodes(t, i, f, thr, l, r) AS (VALUES {nodes}),
tleaves(t, i, v) AS (VALUES {leaves}),
walk({kcols}, t, node) AS (
  SELECT {kcols}, t, 0 FROM {src}, (SELECT DISTINCT t FROM tnodes)
  UNION ALL
  SELECT {wk}, w.t, CASE WHEN {fsel} <= n.thr THEN n.l ELSE n.r END
  FROM walk w JOIN tnodes n ON n.t = w.t AND n.i = w.node JOIN {src} s ON {on}
  WHERE w.node >= 0),
{name} AS (SELECT {wk}, sum(lv.v) AS score FROM walk w JOIN tleaves lv ON lv.t = w.t AND lv.i = -w.node - 1
           WHERE w.node < 0 GROUP BY {wk})"""


def metrics_ctes(src: str, k_values: list[int], name: str = "pum") -> str:
    """Per-user metrics (customer_id, metric, k, value) from rows (customer_id, article_id, label, score)."""
    parts = []
    for k in k_values:
        parts.append(f"""
SELECT customer_id, 'dcg' AS metric, {k} AS k, round(coalesce(dcg{k}, 0.0), 12) AS value FROM agg
UNION ALL SELECT customer_id, 'ndcg', {k}, round(CASE WHEN coalesce(idcg{k}, 0.0) > 0 THEN coalesce(dcg{k}, 0.0) / idcg{k}
                                                   ELSE 0.0 END, 12) FROM agg
UNION ALL SELECT customer_id, 'hit_rate', {k}, CASE WHEN coalesce(hit{k}, 0) > 0 THEN 1.0 ELSE 0.0 END FROM agg
UNION ALL SELECT customer_id, 'precision', {k}, round(CAST(coalesce(hit{k}, 0) AS DOUBLE) / {float(k)!r}, 12) FROM agg
UNION ALL SELECT customer_id, 'recall', {k}, round(CASE WHEN npos > 0 THEN CAST(coalesce(hit{k}, 0) AS DOUBLE) / npos
                                                  ELSE 0.0 END, 12) FROM agg
UNION ALL SELECT customer_id, 'mrr', {k}, round(CASE WHEN first_hit <= {k} THEN 1.0 / first_hit ELSE 0.0 END, 12) FROM agg""")
    aggs = ", ".join(f"sum(CASE WHEN p <= {k} THEN label * (1.0 / log2(p + 1)) END) AS dcg{k}, "
                     f"sum(CASE WHEN ip <= {k} THEN label * (1.0 / log2(ip + 1)) END) AS idcg{k}, "
                     f"sum(CASE WHEN p <= {k} THEN label END) AS hit{k}" for k in k_values)
    return f"""
mranked AS (SELECT customer_id, label,
                   row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id ASC, label DESC) AS p,
                   row_number() OVER (PARTITION BY customer_id ORDER BY label DESC, score DESC, article_id ASC) AS ip
            FROM {src}),
agg AS (SELECT customer_id, sum(label) AS npos, min(CASE WHEN label = 1 THEN p END) AS first_hit, {aggs}
        FROM mranked GROUP BY customer_id),
{name} AS ({' UNION ALL '.join(x.strip() for x in parts)})"""


def serving_ctes(top_k: int, low_total_k: int) -> str:
    """CTEs ending in ``recs``: (customer_id, pos, article_id, score, segment, strategy, fallback) for every
    customer. Needs, before it: segs, uf, itf, cfw (+_dmax), seeds, craw/cpr, cf300, pop1000, musers,
    lpoprec*, pref, lcat, lusers."""
    from basketry.plans.oracle_candidates import low_activity_sql, merged_sql
    return f"""
mc AS (SELECT * FROM ({merged_sql(300, cf='cf300')})),
rr AS (SELECT mc.customer_id, mc.pos AS cand_pos, mc.article_id, uf.purchase_count, uf.recency,
              CAST(CASE uf.purchase_frequency WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 0 END
                   AS BIGINT) AS purchase_frequency_encoded, itf.popularity_rank, itf.sales_count,
              (itf.popularity_rank IS NOT NULL AND itf.sales_count IS NOT NULL AND uf.purchase_count IS NOT NULL) AS ok
       FROM mc LEFT JOIN uf ON mc.customer_id = uf.customer_id LEFT JOIN itf ON mc.article_id = itf.article_id),
rra AS (SELECT *, max(CAST(ok AS INTEGER)) OVER (PARTITION BY customer_id) AS anyok FROM rr),
rok AS (SELECT * FROM rra WHERE ok),{tree_ctes('rok', ['customer_id', 'article_id'], 'rsc')},
arecs AS (SELECT * FROM (
  SELECT a.customer_id,
         CAST(row_number() OVER (PARTITION BY a.customer_id
              ORDER BY CASE WHEN a.anyok = 1 THEN s.score END DESC NULLS LAST, a.cand_pos ASC) AS BIGINT) AS pos,
         a.article_id, CASE WHEN a.anyok = 1 THEN s.score END AS score,
         'active' AS segment, 'cf_ranker' AS strategy, a.anyok = 0 AS fallback
  FROM rra a LEFT JOIN rsc s ON a.customer_id = s.customer_id AND a.article_id = s.article_id
  WHERE a.anyok = 0 OR a.ok) WHERE pos <= {int(top_k)}),
lrecs AS (SELECT customer_id, pos, article_id, CAST(NULL AS DOUBLE) AS score, 'low_activity' AS segment,
                 'enhanced_fallback' AS strategy, false AS fallback
          FROM ({low_activity_sql(low_total_k, 'lusers')})),
listed AS (SELECT * FROM arecs UNION ALL SELECT * FROM lrecs),
recs AS (SELECT * FROM listed UNION ALL
         SELECT customer_id, NULL, NULL, NULL, segment, CASE segment WHEN 'active' THEN 'cf_ranker' ELSE 'enhanced_fallback' END, true
         FROM segs WHERE customer_id NOT IN (SELECT customer_id FROM listed))"""
