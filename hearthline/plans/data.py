"""Listings derived from the driver's tables: a property is a customer, an advert an order, a portal an order priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Portable between Spark and DuckDB; {orders} and {customer} are the tables.
LISTINGS_SQL = """
SELECT 'src' || substr(o_orderpriority, 1, 1) AS source, CAST(o_orderkey AS STRING) AS source_listing_id,
  'https://p' || substr(o_orderpriority, 1, 1) || '.example.com/l/' || CAST(o_orderkey AS STRING) AS url,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Casa ' || c_mktsegment END AS title,
  CASE c_custkey % 5 WHEN 0 THEN 'Ciudad Jardín' WHEN 1 THEN 'Pance' WHEN 2 THEN 'EL CANEY' WHEN 3 THEN 'Granada' END AS barrio,
  CASE WHEN c_custkey % 6 = 0 THEN 'Conjunto ' || c_mktsegment END AS conjunto,
  CASE WHEN c_nationkey % 3 = 0 THEN 'Cali' WHEN c_nationkey % 3 = 1 THEN 'Jamundí' ELSE 'Palmira' END AS city,
  CASE WHEN o_orderkey % 8 = 0 THEN 'Calle ' || CAST(c_custkey % 90 AS STRING) || ' # 5-10' END AS address,
  CASE WHEN c_custkey % 7 <> 0 THEN 3.3e0 + (c_custkey % 211) / 1000e0 END AS lat,
  CASE WHEN c_custkey % 7 <> 0 THEN -76.6e0 + (c_custkey % 97) / 1000e0 END AS lng,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'barrio_centroid' ELSE 'source' END AS geocode_precision,
  CASE WHEN o_orderkey % 29 <> 0 THEN CAST(40 + c_custkey % 160 AS DOUBLE) END AS area_m2,
  CASE WHEN c_custkey % 13 <> 0 THEN CAST(1 + c_custkey % 5 AS INT) END AS bedrooms,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(1 + o_orderkey % 3 AS INT) END AS bathrooms,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 4 AS INT) END AS parking,
  CASE WHEN o_orderkey % 31 <> 0 THEN CAST(800000 + (c_custkey % 97) * 50000 + (o_orderkey % 3) * 4000 AS DOUBLE) END AS price,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(100000 + (c_custkey % 9) * 10000 AS DOUBLE) END AS admin,
  CASE WHEN o_orderkey % 6 <> 0 THEN CAST(1 + c_custkey % 6 AS INT) END AS estrato,
  'COP' AS currency,
  CASE WHEN o_orderkey % 9 = 0 THEN 'Inmobiliaria ' || CAST(c_nationkey AS STRING) END AS agency,
  CASE WHEN o_orderkey % 4 = 0 THEN '300' || lpad(CAST(o_orderkey AS STRING), 7, '0') END AS phone,
  o_orderkey % 4 = 0 AS has_whatsapp, CAST(NULL AS STRING) AS raw_json,
  o_orderstatus <> 'F' AS is_active, o_orderdate AS last_seen
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

#: The view as a common table expression of an oracle.
LISTINGS_CTE = f"listings AS ({LISTINGS_SQL.format(orders='orders', customer='customer')}), active AS (SELECT * FROM listings WHERE is_active)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LISTINGS_SQL, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).where("is_active")
