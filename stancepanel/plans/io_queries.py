"""Queries that write a table through the library's writers and read it back (IO2-IO9), and the report on crosswalks.

Each run writes into a new folder of the shared scratch folder, so runs do not meet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from stancepanel.plans.registry import R, query, rounded, table
from stancepanel.sources import tables
from stancepanel.sources.lexicon import clashing_codes, read_lexicon


def new_path(spark, name: str) -> str:
    return f"{tables.scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("io2_lexicon_csv", "SELECT DISTINCT lower(p_name) AS term FROM part")
def io2(spark, d):
    path = new_path(spark, "lexicon")
    tables.save_csv(table(spark, d, "part").select(F.initcap("p_name").alias("term")), path)
    return read_lexicon(spark, path, "term string", dedupe=True)


@query("io3_csv_columns", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def io3(spark, d):
    customer = table(spark, d, "customer")
    path = new_path(spark, "customers")
    tables.save_csv(customer, path)
    return tables.read_csv(spark, path, customer.schema, ["c_custkey", "c_mktsegment", "c_acctbal"])


@query("io4_parquet_glob", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
  WHERE year(o_orderdate) BETWEEN 1996 AND 1998""")
def io4(spark, d):
    path = new_path(spark, "orders-by-year")
    tables.save(table(spark, d, "orders").withColumn("o_year", F.year("o_orderdate")), path, ["o_year"])
    return tables.read_tokens(spark, f"{path}/o_year=199[6-8]", None, ["o_orderkey", "o_custkey", "o_totalprice"])


@query("io5_parquet_partitions", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def io5(spark, d):
    path = new_path(spark, "orders-by-status")
    tables.save(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"),
                path, ["o_orderstatus"])
    return spark.read.parquet(path)


@query("io6_ordered_csv", """SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place
  FROM customer""")
def io6(spark, d):
    """Rows get the place they have in the written files: files by name, lines as they stand in a file."""
    path = new_path(spark, "customers-by-balance")
    tables.save_csv(table(spark, d, "customer").select("c_custkey", "c_acctbal"), path,
                    [F.desc("c_acctbal"), "c_custkey"])
    lines = tables.read_csv(spark, path, "c_custkey bigint, c_acctbal double").select(
        "*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select(
        "file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = lines.withColumn("at", F.row_number().over(Window.partitionBy("file").orderBy("block", "line")))
    return numbered.join(offsets, "file").select("c_custkey", "c_acctbal", (F.col("before") + F.col("at")).alias("place"))


SUPPLIER_SUMS = f"""SELECT l_suppkey, count(*) AS n_lines, {R('sum(l_quantity)')} AS quantity
  FROM lineitem GROUP BY l_suppkey"""


def supplier_sums(spark, d):
    return rounded(table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity")))


@query("io7_staged_table", SUPPLIER_SUMS)
def io7(spark, d):
    return tables.stage(supplier_sums(spark, d), f"supplier-sums-{uuid.uuid4().hex}", tables.scratch_folder(spark))


@query("io8_reused_table", SUPPLIER_SUMS)
def io8(spark, d):
    """The second call finds the table of the first one, as long as its input files have not changed."""
    folder = tables.scratch_folder(spark)
    tables.stage(supplier_sums(spark, d), "supplier-sums", folder, reuse=True)
    return tables.stage(supplier_sums(spark, d), "supplier-sums", folder, reuse=True)


@query("io9_required_columns", """SELECT o_orderstatus, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers
  FROM orders GROUP BY o_orderstatus""")
def io9(spark, d):
    """The guard lets a table with all columns through and names those that another one lacks."""
    needed = ["o_orderkey", "o_custkey", "o_orderstatus"]
    orders = tables.require_columns(table(spark, d, "orders"), needed)
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"),
                                               F.countDistinct("o_custkey").alias("n_customers"))


@query("j1_clashing_codes", """SELECT p_name, count(DISTINCT p_brand) AS n_codes, min(p_brand) AS taken,
  max(p_brand) AS largest FROM part WHERE p_name IS NOT NULL GROUP BY p_name HAVING count(DISTINCT p_brand) > 1""")
def j1_clashes(spark, d):
    return clashing_codes(table(spark, d, "part"), "p_name", "p_brand")
