"""Stand-in panels, documents and events derived from the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancepanel.plans.registry import cte, table

# Document attributes from the document id; a ninth of the years is out of range on purpose.
DOC_NATION = "CAST((doc_id * 7) % 25 AS INT)"
DOC_AUTHOR = "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(floor(doc_id / 5) AS BIGINT) END"


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ut, addr_no, country: country names in mixed spelling, some unmapped."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ut"), F.expr(DOC_NATION).alias("k"),
                                         F.explode(F.array(F.lit(1), F.lit(2))).alias("addr_no"))
    name = (F.when(F.col("k") == 24, "Atlantis").when(F.col("k") == 23, "peoples r china")
            .when(F.col("ut") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")))
    return docs.join(nation, F.col("k") == F.col("n_nationkey")).select(
        "ut", "addr_no", name.alias("country"))


cte("addresses", f"""SELECT d.doc_id AS ut, a.addr_no,
  CASE WHEN d.k = 24 THEN 'Atlantis' WHEN d.k = 23 THEN 'peoples r china'
    WHEN d.doc_id % 2 = 0 THEN lower(n_name) ELSE n_name END AS country
  FROM (SELECT *, {DOC_NATION} AS k FROM documents) d
  JOIN nation ON n_nationkey = d.k, (VALUES (1), (2)) AS a(addr_no)""")


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country key to code; the last nation has no code, and China is an extra key."""
    nation = table(spark, sf_dir, "nation")
    code = F.concat(F.lit("C"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    key = F.when(F.col("n_nationkey") == 23, "CHINA").otherwise(F.upper("n_name"))
    return nation.where(F.col("n_nationkey") < 24).select(key.alias("name"), code.alias("iso3"))


cte("crosswalk", """SELECT CASE WHEN n_nationkey = 23 THEN 'CHINA' ELSE upper(n_name) END AS name,
  'C' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso3 FROM nation WHERE n_nationkey < 24""")


def documents_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ut, year, iso3, field of documents (codes already mapped)."""
    k = F.expr(DOC_NATION)
    return table(spark, sf_dir, "documents").where(k < 24).select(
        F.col("doc_id").alias("ut"), F.expr("CAST(1994 + doc_id % 9 AS INT)").alias("year"),
        F.concat(F.lit("C"), F.lpad(k.cast("string"), 2, "0")).alias("iso3"),
        F.col("source").alias("field"))


cte("meta", f"""SELECT doc_id AS ut, CAST(1994 + doc_id % 9 AS INT) AS year,
  'C' || lpad(CAST({DOC_NATION} AS VARCHAR), 2, '0') AS iso3, source AS field
  FROM documents WHERE {DOC_NATION} < 24""")


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ut"), F.expr(DOC_AUTHOR).alias("daisng_id"))


cte("authors", f"SELECT doc_id AS ut, {DOC_AUTHOR} AS daisng_id FROM documents")


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with nation and year: order, author (customer), nation, year, price."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("author"),
        F.col("c_nationkey").alias("unit"), F.year("o_orderdate").alias("year"),
        F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("status"))


cte("ord", """SELECT o_orderkey AS doc, o_custkey AS author, c_nationkey AS unit,
  CAST(year(o_orderdate) AS INT) AS year, o_totalprice AS price, o_orderpriority AS priority,
  c_mktsegment AS segment, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey""")

REGIME = "CAST(abs(unit * 7 + year * 3) % 4 AS INT)"
START = "CASE WHEN unit % 5 <> 0 THEN 1997 + unit % 4 END"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation-year panel with an outcome, a weight, a regime code and indices."""
    cells = order_cells(spark, sf_dir).groupBy("unit", "year").agg(
        (F.avg("price") / 1000).alias("y"), F.count(F.lit(1)).alias("n"),
        (F.max("price") / 1000).alias("gdp"), F.countDistinct("author").alias("pop"))
    return cells.withColumns({
        "regime": F.expr(REGIME), "polyarchy": (F.col("n") % 7) / F.lit(7.0),
        "autocracy": F.expr(f"CASE WHEN {REGIME} < 2 THEN 1 ELSE 0 END"),
        "start": F.expr(START), "iso3": F.concat(F.lit("C"), F.lpad(F.col("unit").cast("string"), 2, "0"))})


cte("panel", f"""SELECT *, {REGIME} AS regime, (n % 7) / 7.0::DOUBLE AS polyarchy,
  CASE WHEN {REGIME} < 2 THEN 1 ELSE 0 END AS autocracy, {START} AS start,
  'C' || lpad(CAST(unit AS VARCHAR), 2, '0') AS iso3
  FROM (SELECT unit, year, avg(price) / 1000 AS y, count(*) AS n, max(price) / 1000 AS gdp,
    count(DISTINCT author) AS pop FROM ord GROUP BY unit, year)""", "ord")
