"""Oracle SQL fragments for feature tables (parameterised like the Spark operators)."""


def uf_cte(lookback_days: int = 28, name: str = "uf") -> str:
    return f"""
{name} AS (
  SELECT customer_id,
         CAST(count(*) AS BIGINT) AS purchase_count,
         CAST(count(DISTINCT article_id) AS BIGINT) AS unique_items,
         round(avg(price), 2) AS avg_price,
         CAST(date_diff('day', max(t_dat), (SELECT max(t_dat) FROM tx)) AS BIGINT) AS recency,
         CASE WHEN count(*) >= 10 THEN 'high' WHEN count(*) >= 5 THEN 'medium' ELSE 'low' END AS purchase_frequency,
         max(t_dat) AS last_purchase_date, min(t_dat) AS first_purchase_date
  FROM tx WHERE t_dat >= (SELECT max(t_dat) - {int(lookback_days)} FROM tx)
  GROUP BY customer_id)"""


def itf_cte(lookback_days: int = 7, name: str = "itf") -> str:
    return f"""
{name}_stats AS (
  SELECT article_id, count(*) AS sales_count, count(DISTINCT customer_id) AS unique_customers,
         avg(price) AS ap, max(t_dat) AS last_sold_date
  FROM tx WHERE t_dat >= (SELECT max(t_dat) - {int(lookback_days)} FROM tx)
  GROUP BY article_id),
{name} AS (
  SELECT s.article_id, a.prod_name,
         CAST(row_number() OVER (ORDER BY s.sales_count DESC, s.article_id ASC) AS BIGINT) AS popularity_rank,
         CAST(s.sales_count AS BIGINT) AS sales_count, CAST(s.unique_customers AS BIGINT) AS unique_customers,
         round(s.ap, 2) AS avg_price, s.last_sold_date
  FROM {name}_stats s JOIN articles a ON s.article_id = a.article_id)"""
