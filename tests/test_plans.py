"""Plan-level rules: no all-pairs joins, pruned scans, bounded tasks."""

import pytest
from pyspark.sql import functions as F

from stancepanel.operators import clause as cl
from stancepanel.operators import sentence as se
from stancepanel.plans import all_queries
from stancepanel.plans import fixture_parse as fp

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Model fits end in a local table of coefficients; their plan says nothing.
LAZY = sorted(n for n in all_queries.QUERIES if n[0] != "f" and n.split("_")[0] not in
              ("e9", "e10", "d8", "g1", "g3", "g4", "g6", "g7", "h5", "h6"))


@pytest.mark.parametrize("name", LAZY)
def test_no_all_pairs_join_and_no_global_window(spark, name):
    text = plan(all_queries.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for line in text.splitlines():
        if "Window [" in line:
            assert "], [" in line or line.count("[") > 1, line


def test_sentence_counts_read_only_their_columns(spark):
    text = plan(se.sentence_counts(fp.tokens(spark, SF), fp.stance(spark)))
    schema = text.split("ReadSchema: ")[1].splitlines()[0]
    assert set(c.split(":")[0] for c in schema[schema.index("<") + 1:].rstrip(">").split(",")) == {
        "ut", "year", "field", "sent_id", "lemma", "upos"}
    assert "EqualTo(field,abstract)" in text
    assert "BroadcastHashJoin" in text and text.count("Exchange hashpartitioning") == 1


def test_document_contrast_has_no_sort_merge_join(spark):
    text = plan(cl.document_contrast(fp.tokens(spark, SF), fp.power(spark), fp.stance(spark)))
    assert "SortMergeJoin" not in text and text.count("Exchange hashpartitioning") == 3


def test_hot_document_is_spread(spark):
    """One document with most tokens: the restricted tokens still use many partitions."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        toks = spark.range(4000).select(F.lit(1).alias("ut"), (F.col("id") % 500).cast("int").alias("sent_id"))
        kept = se.restrict_documents(toks, spark.createDataFrame([(1,), (2,)], "ut int"))
        sizes = kept.groupBy(F.spark_partition_id()).count().collect()
        assert kept.count() == 4000 and len(sizes) >= 4 and max(r["count"] for r in sizes) < 2500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
