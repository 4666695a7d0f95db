"""Deterministic pairs of tables made from the test tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDERS_BASE = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
CAST(date_trunc('quarter', o_orderdate) AS DATE) AS batch,
year(o_orderdate) <> 1996 AS mut FROM {orders}"""

ORDERS_LEFT = """SELECT o_orderkey, batch, o_custkey,
CASE WHEN o_orderkey % 80 = 11 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
CASE WHEN o_orderkey % 40 = 9 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderpriority
FROM {base} WHERE batch <> DATE '2001-07-01'"""

ORDERS_RIGHT = """SELECT o_orderkey, batch, CASE WHEN mut AND o_orderkey % 33 = 13 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey,
CASE WHEN o_orderkey % 80 = 11 THEN NULL WHEN mut AND o_orderkey % 30 = 8 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
CASE WHEN o_orderkey % 40 = 9 AND NOT mut THEN NULL WHEN NOT mut THEN o_totalprice WHEN o_orderkey % 20 = 1 THEN o_totalprice + 10.5D
WHEN o_orderkey % 20 = 2 THEN o_totalprice + 0.25D WHEN o_orderkey % 20 = 4 THEN NULL ELSE o_totalprice END AS o_totalprice,
CASE WHEN mut AND o_orderkey % 25 = 5 THEN lower(o_orderpriority) WHEN mut AND o_orderkey % 25 = 6 THEN concat(' ', o_orderpriority, ' ') ELSE o_orderpriority END AS o_orderpriority
FROM {base} WHERE batch <> DATE '1995-01-01' AND NOT (mut AND o_orderkey % 50 = 3)
UNION ALL SELECT o_orderkey + 100000000, batch, o_custkey, o_orderstatus, o_totalprice, o_orderpriority
FROM {base} WHERE mut AND batch <> DATE '1995-01-01' AND o_orderkey % 60 = 7"""

#: A later state of the right side: more customers moved, fewer prices did.
ORDERS_LATER = """SELECT o_orderkey, batch, CASE WHEN mut AND o_orderkey % 11 = 2 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, o_orderstatus,
CASE WHEN mut AND o_orderkey % 40 = 1 THEN o_totalprice + 10.5D ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM {base}"""

EVENTS_LEFT = "SELECT event_id, date_trunc('day', ts) AS day, event_type, value, CASE WHEN event_id % 90 = 1 THEN NULL ELSE props END AS props FROM {events}"
EVENTS_RIGHT = """SELECT event_id, date_trunc('day', ts) AS day, event_type, CASE WHEN day(ts) % 5 = 2 AND event_id % 7 = 3 THEN value + 1.0D ELSE value END AS value,
CASE WHEN event_id % 90 = 1 THEN '__NULL__' ELSE props END AS props FROM {events} WHERE day(ts) <> 9"""

CUSTOMER_RIGHT = """SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment <> 'MACHINERY' AND c_custkey % 9 = 4 THEN c_acctbal + 5.0D ELSE c_acctbal END AS c_acctbal, c_mktsegment
FROM {customer} WHERE c_mktsegment <> 'FURNITURE'"""
PART_RIGHT = "SELECT p_partkey, p_name, p_brand, CASE WHEN p_size % 4 = 1 AND p_partkey % 6 = 1 THEN 'other' ELSE p_type END AS p_type, p_size, p_retailprice FROM {part} WHERE p_size <> 7"


def orders_pair(spark: SparkSession, orders: DataFrame, later: bool = False) -> tuple[DataFrame, DataFrame]:
    base = spark.sql(ORDERS_BASE, orders=orders)
    return spark.sql(ORDERS_LEFT, base=base), spark.sql(ORDERS_LATER if later else ORDERS_RIGHT, base=base)


def orders_sql(later: bool = False) -> str:
    """Common table expressions l and r for DuckDB."""
    plain = lambda sql: sql.format(orders="orders", base="base").replace("10.5D", "10.5").replace("0.25D", "0.25")
    return f"base AS ({plain(ORDERS_BASE)}), l AS ({plain(ORDERS_LEFT)}), r AS ({plain(ORDERS_LATER if later else ORDERS_RIGHT)})"


def plain_sql(left: str, right: str) -> str:
    """l and r for DuckDB from two texts over base tables."""
    names = {t: t for t in ("events", "customer", "part")}
    plain = lambda sql: sql.format(**names).replace("1.0D", "1.0").replace("5.0D", "5.0")
    return f"l AS ({plain(left)}), r AS ({plain(right)})"
