"""Shared SQL for the oracle: the same logical tables as ``basketry.sources`` written as CTEs over the
pre-registered TPC-H-style views (lineitem, orders, part, customer, events)."""

BASE_CTES = """
tx AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(l_partkey AS VARCHAR) AS article_id,
         CAST(o_orderdate AS DATE) AS t_dat, l_extendedprice / 1e6 AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
articles AS (
  SELECT CAST(p_partkey AS VARCHAR) AS article_id, p_name AS prod_name,
         p_type AS product_group_name, p_name AS product_type_name FROM part),
customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
         CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE CAST(15 + (c_custkey * 37) % 90 AS INTEGER) END AS age
  FROM customer),
exposures AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS day,
         CASE WHEN substr(md5(CAST(user_id AS VARCHAR) || ':exp1'), 1, 1) < '8' THEN 'A' ELSE 'B' END AS grp,
         max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) = 1 AS clicked,
         CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchase_count,
         CAST(count(*) AS BIGINT) AS num_items, min(ts) AS first_ts
  FROM events GROUP BY user_id, CAST(ts AS DATE)),
log AS (
  SELECT user_id, grp, bool_or(clicked) AS clicked, CAST(sum(purchase_count) AS BIGINT) AS purchase_count, min(day) AS day
  FROM exposures GROUP BY user_id, grp)
"""


def with_base(body: str, extra_ctes: str = "", recursive: bool = False) -> str:
    """Prefix ``body`` (a SELECT, optionally starting with its own WITH list) with the base tables
    and any shared CTEs (``extra_ctes`` is a comma-free-ended list such as ``a AS (...), b AS (...)``)."""
    body = body.strip()
    ctes = BASE_CTES.strip()
    if extra_ctes.strip():
        ctes += ",\n" + extra_ctes.strip().rstrip(",")
    head = "WITH RECURSIVE " if recursive else "WITH "
    if body[:4].upper() == "WITH":
        return head + ctes + ",\n" + body[4:].lstrip()
    return head + ctes + "\n" + body
