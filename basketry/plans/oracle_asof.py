"""Oracle SQL for features as of a date and leak-free ranking data: straight from the transactions, without partial sums,
and with each user's distance to every item of the catalogue in place of a run."""


def end_cte(label_days: int) -> str:
    return f"""
feature_end AS (SELECT max(t_dat) - {int(label_days)} AS d FROM tx)"""


def user_cte(lookback: int, name: str = "ufa") -> str:
    return f"""
{name} AS (
  SELECT customer_id, CAST(count(*) AS BIGINT) AS purchase_count, CAST(len(list(DISTINCT article_id)) AS BIGINT) AS unique_items,
         round(sum(price) / count(*), 2) AS avg_price, CAST((SELECT d FROM feature_end) - max(t_dat) AS BIGINT) AS recency,
         ['low', 'medium', 'high'][1 + (count(*) >= 5)::INT + (count(*) >= 10)::INT] AS purchase_frequency,
         max(t_dat) AS last_purchase_date, min(t_dat) AS first_purchase_date
  FROM tx, feature_end WHERE t_dat BETWEEN d - {int(lookback)} AND d GROUP BY customer_id)"""


def item_cte(lookback: int, name: str = "ifa") -> str:
    return f"""
{name} AS (
  SELECT article_id, prod_name, CAST(row_number() OVER (ORDER BY n DESC, article_id) AS BIGINT) AS popularity_rank,
         CAST(n AS BIGINT) AS sales_count, CAST(u AS BIGINT) AS unique_customers, round(s / n, 2) AS avg_price, last_sold_date
  FROM (SELECT article_id, count(*) AS n, len(list(DISTINCT customer_id)) AS u, sum(price) AS s, max(t_dat) AS last_sold_date
        FROM tx, feature_end WHERE t_dat BETWEEN d - {int(lookback)} AND d GROUP BY article_id) JOIN articles USING (article_id))"""


def negatives_cte(users: str, n: int, window: int, seed: int, name: str = "cneg") -> str:
    return f"""
{name}_cat AS (SELECT article_id, row_number() OVER (ORDER BY md5(article_id || '{seed}'), article_id) - 1 AS place,
                      count(*) OVER () AS size FROM (SELECT DISTINCT article_id FROM articles)),
{name}_had AS (SELECT customer_id, list(DISTINCT article_id) AS had FROM tx
               WHERE t_dat >= (SELECT max(t_dat) - {int(window)} FROM tx) GROUP BY customer_id),
{name} AS (SELECT customer_id, article_id, 0 AS label FROM (
    SELECT u.customer_id, article_id,
           row_number() OVER (PARTITION BY u.customer_id ORDER BY
             (place - ('0x' || substr(md5(u.customer_id || '{seed}'), 1, 8))::BIGINT % size + size) % size) AS nth
    FROM {users} u LEFT JOIN {name}_had h USING (customer_id), {name}_cat
    WHERE h.had IS NULL OR NOT list_contains(h.had, article_id)) WHERE nth <= {int(n)})"""


def dataset_sql(pos: str, neg: str, lookback: int) -> str:
    return f"""
SELECT customer_id, article_id, label, coalesce(purchase_count, 0)::BIGINT AS purchase_count, coalesce(recency, {int(lookback) + 1})::BIGINT AS recency,
       coalesce(list_position(['medium', 'high'], purchase_frequency), 0)::BIGINT AS purchase_frequency_encoded,
       coalesce(popularity_rank, (SELECT count(*) + 1 FROM ifa))::BIGINT AS popularity_rank, coalesce(sales_count, 0)::BIGINT AS sales_count
FROM (SELECT customer_id, article_id, label FROM {pos} UNION ALL SELECT customer_id, article_id, label FROM {neg})
     LEFT JOIN ufa USING (customer_id) LEFT JOIN ifa USING (article_id)"""
