"""Reading the driver's tables, and the catalog view that joins them into rows of drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of drawings. A line of an order is a row of a drawing; the part gives code, description, group and subgroup; the
    customer is the model that the drawing belongs to, its nation the brand."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("description"), F.col("p_type").alias("grp"), F.col("p_brand").alias("subgroup"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    line = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("drawing"), F.col("l_partkey").alias("code"), F.col("l_linenumber").alias("position"), F.col("l_quantity").alias("quantity"))
    order = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("drawing"), F.col("o_custkey").alias("model"), F.col("o_orderpriority").alias("drawing_name"))
    customer = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("model"), F.col("c_nationkey").alias("brand"))
    return line.join(order, "drawing").join(part, "code").join(customer, "model", "left")


#: The same view in SQL, to head oracle queries.
CATALOG_SQL = """v AS (SELECT l_partkey AS code, p_name AS description, p_type AS grp, p_brand AS subgroup, p_size AS size, p_retailprice AS price,
  l_orderkey AS drawing, l_linenumber AS position, l_quantity AS quantity, o_custkey AS model, o_orderpriority AS drawing_name, c_nationkey AS brand
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey LEFT JOIN customer ON c_custkey = o_custkey)"""
