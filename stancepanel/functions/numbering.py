"""Numbering of rows in the order of a key, without one task that sees them all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stancepanel.sources.tables import scratch_folder, stage


def number_rows(df: DataFrame, key: str, name: str) -> DataFrame:
    """Numbers 1..n in the order of `key`, whose values are distinct; a null key comes first.

    Rows are dealt by ranges of the key and numbered within their range; the rows of earlier ranges are added. The ranges
    come from a sample, so they are written once: both uses, and tasks that run again, see the same ones. The window
    over the ranges holds one row for each.
    """
    dealt = df.repartitionByRange(F.col(key)).withColumn("_range", F.spark_partition_id())
    dealt = stage(dealt, f"numbered-{uuid.uuid4().hex}", scratch_folder(df.sparkSession))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return (dealt.withColumn("_within", within).join(offsets, "_range")
            .select(*df.columns, (F.col("_before") + F.col("_within")).alias(name)))
