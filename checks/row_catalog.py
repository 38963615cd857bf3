"""A catalog whose size grows with the data: every customer, order, part and supplier is a table.

Orders hold a column for their customer and two for each of their lines, and these are the
foreign keys. Suppliers and parts are hubs that many orders refer to. Customers also refer to
nations, which are left out of the catalog, so those keys have an unknown end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions import scores
from cartulary.operators.catalog import fit
from cartulary.operators.lineage import Graph, build_graph
from cartulary.session import spread
from checks.tables import table

DATABASE = "rows"
STAMP = "2024-02-01 00:00:00"


def stamp():
    return F.lit(STAMP).cast("timestamp_ntz")


def named(prefix: str, key: str):
    return F.concat(F.lit(prefix + "_"), F.col(key))


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(frame, prefix, key, count, quality, description, tags):
        return frame.select(
            named(prefix, key).alias("table_name"),
            F.coalesce(count, F.lit(0)).cast("bigint").alias("row_count"),
            quality.alias("quality_score"),
            description.alias("ai_description"),
            tags.alias("ai_tags"),
        )

    orders = table(spark, sf_dir, "orders")
    per_customer = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    per_order = (
        table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    )
    none = F.lit(None).cast("string")
    customers = table(spark, sf_dir, "customer").join(
        per_customer, F.col("c_custkey") == F.col("o_custkey"), "left"
    )
    placed = orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    found = (
        rows(customers, "customer", "c_custkey", F.col("n"), F.col("c_acctbal") / 100,
             F.col("c_mktsegment"), none)
        .unionByName(
            rows(placed, "order", "o_orderkey", F.col("n"), F.col("o_totalprice") / 5000,
                 F.col("o_orderstatus"), F.col("o_orderpriority"))
        )
        .unionByName(
            rows(table(spark, sf_dir, "part"), "part", "p_partkey", F.col("p_size"),
                 F.col("p_retailprice") / 10, F.col("p_name"), F.col("p_type"))
        )
        .unionByName(
            rows(table(spark, sf_dir, "supplier"), "supplier", "s_suppkey", F.col("s_nationkey"),
                 F.col("s_acctbal") / 100, none, none)
        )
    )
    graded = found.withColumns(
        {
            "quality_grade": scores.grade(F.col("quality_score")),
            "column_count": F.col("row_count") * 2 + 2,
            "schema_name": F.lit("public"),
            "last_crawled_at": stamp(),
            "created_at": stamp(),
        }
    )
    return fit(graded, "catalog_tables")


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(frame, prefix, key, column, is_key, refers):
        return frame.select(
            named(prefix, key).alias("table_name"),
            column.alias("column_name"),
            F.lit(is_key).alias("is_primary_key"),
            F.lit(refers).alias("is_foreign_key"),
        )

    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    lines = spread(lines, "l_orderkey", "l_linenumber").distinct()
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")

    def of_line(suffix):
        return F.concat(F.lit("l"), F.col("l_linenumber"), F.lit("_" + suffix))

    found = (
        rows(customers, "customer", "c_custkey", F.lit("c_custkey"), True, False)
        .unionByName(rows(customers, "customer", "c_custkey", F.lit("c_nationkey"), False, True))
        .unionByName(rows(orders, "order", "o_orderkey", F.lit("o_orderkey"), True, False))
        .unionByName(rows(orders, "order", "o_orderkey", F.lit("o_custkey"), False, True))
        .unionByName(rows(lines, "order", "l_orderkey", of_line("partkey"), False, True))
        .unionByName(rows(lines, "order", "l_orderkey", of_line("suppkey"), False, True))
        .unionByName(
            rows(table(spark, sf_dir, "part"), "part", "p_partkey", F.lit("p_partkey"), True, False)
        )
        .unionByName(
            rows(table(spark, sf_dir, "supplier"), "supplier", "s_suppkey", F.lit("s_suppkey"),
                 True, False)
        )
    )
    full = found.withColumns(
        {
            "clean_type": F.lit("integer"),
            "raw_type": F.lit("bigint"),
            "is_nullable": ~F.col("is_primary_key"),
            "null_pct": F.when(F.col("is_primary_key"), 0.0),
            "last_crawled_at": stamp(),
        }
    )
    return fit(full, "catalog_columns")


def catalog_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(frame, prefix, key, column, target, target_key, target_column):
        return frame.select(
            named(prefix, key).alias("source_table"),
            column.alias("source_column"),
            named(target, target_key).alias("target_table"),
            F.lit(target_column).alias("target_column"),
            F.lit("many_to_one").alias("relationship_type"),
        )

    lines = table(spark, sf_dir, "lineitem")
    line = F.concat(F.lit("l"), F.col("l_linenumber"))
    found = (
        rows(table(spark, sf_dir, "orders"), "order", "o_orderkey", F.lit("o_custkey"),
             "customer", "o_custkey", "c_custkey")
        .unionByName(
            rows(lines, "order", "l_orderkey", F.concat(line, F.lit("_partkey")),
                 "part", "l_partkey", "p_partkey")
        )
        .unionByName(
            rows(lines, "order", "l_orderkey", F.concat(line, F.lit("_suppkey")),
                 "supplier", "l_suppkey", "s_suppkey")
        )
        .unionByName(
            rows(table(spark, sf_dir, "customer"), "customer", "c_custkey", F.lit("c_nationkey"),
                 "nation", "c_nationkey", "n_nationkey")
        )
    )
    return fit(found.withColumn("last_crawled_at", stamp()), "catalog_relationships")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return build_graph(
        catalog_tables(spark, sf_dir),
        catalog_columns(spark, sf_dir),
        catalog_relationships(spark, sf_dir),
        DATABASE,
        stamp(),
    )


ROW_CATALOG_SQL = """
per_customer AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1),
per_order AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
listed AS (
  SELECT 'customer_' || c_custkey AS table_name, coalesce(n, 0) AS row_count,
         c_acctbal / 100 AS quality_score, c_mktsegment AS ai_description,
         CAST(NULL AS VARCHAR) AS ai_tags
  FROM customer LEFT JOIN per_customer ON k = c_custkey
  UNION ALL
  SELECT 'order_' || o_orderkey, coalesce(n, 0), o_totalprice / 5000, o_orderstatus,
         o_orderpriority
  FROM orders LEFT JOIN per_order ON k = o_orderkey
  UNION ALL
  SELECT 'part_' || p_partkey, p_size, p_retailprice / 10, p_name, p_type FROM part
  UNION ALL
  SELECT 'supplier_' || s_suppkey, s_nationkey, s_acctbal / 100, NULL, NULL FROM supplier
),
cat_tables AS (
  SELECT *, row_count * 2 + 2 AS column_count,
         CASE WHEN quality_score >= 90 THEN 'A' WHEN quality_score >= 80 THEN 'B'
              WHEN quality_score >= 70 THEN 'C' WHEN quality_score >= 60 THEN 'D'
              ELSE 'F' END AS quality_grade
  FROM listed
),
order_lines AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
cat_columns AS (
  SELECT 'customer_' || c_custkey AS table_name, 'c_custkey' AS column_name,
         true AS is_primary_key, false AS is_foreign_key FROM customer
  UNION ALL SELECT 'customer_' || c_custkey, 'c_nationkey', false, true FROM customer
  UNION ALL SELECT 'order_' || o_orderkey, 'o_orderkey', true, false FROM orders
  UNION ALL SELECT 'order_' || o_orderkey, 'o_custkey', false, true FROM orders
  UNION ALL SELECT 'order_' || l_orderkey, 'l' || l_linenumber || '_partkey', false, true
  FROM order_lines
  UNION ALL SELECT 'order_' || l_orderkey, 'l' || l_linenumber || '_suppkey', false, true
  FROM order_lines
  UNION ALL SELECT 'part_' || p_partkey, 'p_partkey', true, false FROM part
  UNION ALL SELECT 'supplier_' || s_suppkey, 's_suppkey', true, false FROM supplier
),
cat_rels AS (
  SELECT 'order_' || o_orderkey AS source_table, 'o_custkey' AS source_column,
         'customer_' || o_custkey AS target_table, 'c_custkey' AS target_column FROM orders
  UNION ALL
  SELECT 'order_' || l_orderkey, 'l' || l_linenumber || '_partkey', 'part_' || l_partkey,
         'p_partkey' FROM lineitem
  UNION ALL
  SELECT 'order_' || l_orderkey, 'l' || l_linenumber || '_suppkey', 'supplier_' || l_suppkey,
         's_suppkey' FROM lineitem
  UNION ALL
  SELECT 'customer_' || c_custkey, 'c_nationkey', 'nation_' || c_nationkey, 'n_nationkey'
  FROM customer
),
refs AS (
  SELECT DISTINCT r.* FROM cat_rels r
  JOIN cat_columns a ON a.table_name = source_table AND a.column_name = source_column
  JOIN cat_columns b ON b.table_name = target_table AND b.column_name = target_column
),
related AS (
  SELECT source_table, target_table, pair.a AS source_column, pair.b AS target_column
  FROM (
    SELECT source_table, target_table, max({'a': source_column, 'b': target_column}) AS pair
    FROM cat_rels GROUP BY 1, 2
  )
  WHERE source_table IN (SELECT table_name FROM cat_tables)
    AND target_table IN (SELECT table_name FROM cat_tables)
)
"""
