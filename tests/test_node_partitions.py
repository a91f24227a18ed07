from functools import partial

from pyspark.sql import functions as F

from stancepanel.operators import clause
from stancepanel.sources.tables import more_partitions


def test_tree_nodes_are_dealt_by_the_size_of_the_input(spark, tmp_path, monkeypatch):
    """A task's share of the nodes does not grow with the input; rows and values stay the same."""
    path = str(tmp_path / "tokens")
    rows = [(f"d{i % 40}", i % 7, t, max(t - 1 - i % 3, 0), "x" if (i + t) % 3 else None) for i in range(400)
            for t in range(1, 6)] + [(None, 0, 1, 0, "x"), ("d1", None, None, None, "y")]
    spark.createDataFrame(rows, "ut string, sent_id int, tok_id int, head int, v string").repartition(4).write.parquet(path)
    tokens = spark.read.parquet(path)
    size = tokens.select("*", "_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(
        F.max("file_size").alias("n")).agg(F.sum("n")).first()[0]
    more = int(spark.conf.get("spark.sql.shuffle.partitions")) + 5

    def nodes():
        return clause.tree_nodes(tokens, own={"own": F.col("v")}, child={"child": F.col("v")})

    plain = sorted(nodes().collect(), key=str)
    monkeypatch.setattr(clause, "more_partitions", partial(more_partitions, share=size // more))
    dealt = nodes()
    assert dealt.rdd.getNumPartitions() >= more
    assert sorted(dealt.collect(), key=str) == plain
    memory = spark.createDataFrame(rows[:3], tokens.schema)
    assert more_partitions(memory, "ut", share=1) is memory and more_partitions(tokens, "ut") is tokens
