"""Derived "dirty" views over the test tables.

The driver tables have no nulls, padding or personal data, so fix operators are
exercised on columns derived from them.  Each view is one SQL text valid in Spark
and in DuckDB; in Spark the base table is bound as a DataFrame parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .readers import read_table

DIRTY_CUSTOMERS = """
SELECT
  c_custkey AS customer_id,
  CASE WHEN c_custkey % 11 = 0 THEN NULL
       WHEN c_custkey % 13 = 0 THEN ' User' || CAST(c_custkey AS STRING) || '@Example.com '
       WHEN c_custkey % 17 = 0 THEN 'not-an-address'
       ELSE 'user' || CAST(c_custkey AS STRING) || '@example.com' END AS email,
  CASE WHEN c_custkey % 9 = 0 THEN 'N/A' WHEN c_custkey % 9 = 1 THEN '--' WHEN c_custkey % 9 = 2 THEN ' none '
       WHEN c_custkey % 9 = 3 THEN '' WHEN c_custkey % 9 = 4 THEN NULL
       WHEN c_custkey % 9 = 5 THEN '  ' || c_mktsegment ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 4 = 0 THEN 'in-progress' WHEN c_custkey % 4 = 1 THEN 'ACTIVE'
       WHEN c_custkey % 4 = 2 THEN 'on hold' ELSE 'Closed' END AS account_status,
  CASE WHEN c_custkey % 101 = 0 THEN 'oops' ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING) END AS balance_text,
  CASE WHEN c_custkey % 97 = 0 THEN 'garbage' ELSE '2024-0' || CAST(1 + c_custkey % 9 AS STRING) || '-1' || CAST(c_custkey % 10 AS STRING) END AS created_date,
  CASE WHEN c_custkey % 10 = 0 THEN c_acctbal ELSE NULL END AS sparse_score,
  CASE WHEN c_custkey % 50 = 0 THEN 'please mail user' || CAST(c_custkey AS STRING) || '@example.com' ELSE 'no remark' END AS remark
FROM {customer}
"""

DIRTY_CONTACTS = """
SELECT
  s_suppkey AS contact_id,
  s_name AS full_name,
  '+1 555 01' || CAST(10 + s_suppkey % 90 AS STRING) || ' 4' || CAST(100 + s_suppkey % 900 AS STRING) AS phone,
  '10.0.' || CAST(s_suppkey % 256 AS STRING) || '.' || CAST(s_suppkey * 7 % 256 AS STRING) AS last_ip,
  CAST(s_suppkey % 100 AS STRING) || '.5%' AS discount_pct,
  '$' || CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS STRING) AS balance_usd,
  CAST(s_suppkey % 180 - 89 AS DOUBLE) AS latitude,
  CASE WHEN s_suppkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS opted_in,
  CASE WHEN s_suppkey % 20 = 0 THEN 'Untied States' WHEN s_suppkey % 3 = 0 THEN 'Canada' ELSE 'United States' END AS country,
  CAST(s_suppkey % 130 AS DOUBLE) - 10 AS usage_rate,
  CAST('constant' AS STRING) AS constant_col,
  CAST(NULL AS DOUBLE) AS empty_measure
FROM {supplier}
"""

# Order priorities with rare misspellings and case variants (category canonicalisation).
DIRTY_ORDERS = """
SELECT
  o_orderkey AS order_id,
  o_custkey AS customer_id,
  CASE WHEN o_orderkey % 53 = 0 THEN '4-NOT SPECIFED'
       WHEN o_orderkey % 59 = 0 THEN '2-HIHG'
       WHEN o_orderkey % 61 = 0 THEN lower(o_orderpriority)
       WHEN o_orderkey % 67 = 0 THEN 'URGENT!!'
       ELSE o_orderpriority END AS priority,
  o_totalprice AS amount,
  o_orderdate AS order_date
FROM {orders}
"""

VIEWS = {
    "dirty_customers": (DIRTY_CUSTOMERS, "customer"),
    "dirty_contacts": (DIRTY_CONTACTS, "supplier"),
    "dirty_orders": (DIRTY_ORDERS, "orders"),
}


def view_sql(name: str) -> str:
    """The view's SQL text with plain table names (for DuckDB)."""
    sql, base = VIEWS[name]
    return sql.replace("{" + base + "}", base)


def dirty_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, base = VIEWS[name]
    return spark.sql(sql, **{base: read_table(spark, sf_dir, base)})
