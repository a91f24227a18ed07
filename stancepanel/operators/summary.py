"""Summaries: grouped statistics, exact quantiles, correlations, shares (A, W4, W5)."""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stancepanel.sources.tables import scratch_folder, stage


def share_within(df: DataFrame, within, by) -> DataFrame:
    """Counts per (within, by) and their percentage inside `within`.

    The window runs over the aggregated counts, never over the rows.
    """
    w = Window.partitionBy(*within)
    return (df.groupBy(*within, *by).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(w)))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its number of rows."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n")
             for n, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def ranked_values(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """none, name (the group), v, m, before, size: each different value of a group, its number of rows, the rows of
    smaller values and the rows of the group.

    Equal values are counted first, so that one frequent value is one row. The rest is dealt by ranges of group and
    value, written once, and numbered within the ranges; the rows of a group's earlier ranges are added. A group may
    span many ranges and a range hold many groups. NaN comes last, -0.0 counts as 0.0.
    """
    group = ([F.col(by).isNull().alias("none"), F.coalesce(F.col(by).cast("string"), F.lit("")).alias("name")]
             if by else [F.lit(False).alias("none"), F.lit("all").alias("name")])
    values = df.where(F.col(value).isNotNull()).select(*group, (F.col(value).cast("double") + 0.0).alias("v"))
    keys = ["none", "name"]
    dealt = (values.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("m")).repartitionByRange(*keys, "v")
             .withColumn("_range", F.spark_partition_id()))
    dealt = stage(dealt, f"ranked-{uuid.uuid4().hex}", scratch_folder(df.sparkSession))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, "_range").agg(F.sum("m").alias("s"))
    offsets = sizes.select(*keys, "_range", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("first"),
                           F.sum("s").over(Window.partitionBy(*keys)).alias("size"))
    within = Window.partitionBy(*keys, "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.withColumn("inside", F.coalesce(F.sum("m").over(within), F.lit(0))).join(offsets, [*keys, "_range"])
            .select(*keys, "v", "m", (F.col("first") + F.col("inside")).alias("before"), "size"))


def exact_quantiles(df: DataFrame, value: str, probs, by: str | None = None) -> DataFrame:
    """Exact interpolated quantiles of any number of groups, found by rank; no group is gathered and no row reaches the
    driver. Null groups stay apart from all others; infinite values are values like others."""
    at = (F.col("size") - 1) * F.col("prob")
    rows = ranked_values(df, value, by).withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    rows = rows.withColumns({"low": F.floor(at), "part": at - F.floor(at)})
    rows = rows.withColumn("high", F.least(F.col("low") + 1, F.col("size") - 1))

    def holds(rank):
        return (F.col("before") <= F.col(rank)) & (F.col(rank) < F.col("before") + F.col("m"))

    ends = rows.where(holds("low") | holds("high")).groupBy("none", "name", "prob").agg(
        F.max("part").alias("part"), *[F.max(F.when(holds(e), F.col("v"))).alias(e) for e in ("low", "high")])
    low, high, part = F.col("low"), F.col("high"), F.col("part")
    between = (F.when((part == 0) | (low == high), low)
               .when(F.abs(low) < float("inf"), low + (high - low) * part)
               .otherwise(low * (1 - part) + high * part))
    return ends.select(F.when(~F.col("none"), F.col("name")).alias(by or "group"), "prob", between.alias("quantile"))


def describe_groups(df: DataFrame, group: str, value: str, unit: str) -> DataFrame:
    """A5: n, units, mean, sd, min, median, max by group."""
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    out = rows.groupBy(group).agg(
        F.count(value).alias("n"), F.countDistinct(unit).alias("units"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    median = exact_quantiles(rows, value, [0.5], group).select(
        F.col(group).alias("_g"), F.col("quantile").alias("median"))
    return out.join(median, F.col(group).cast("string") == F.col("_g")).drop("_g")


def quantile_bins(df: DataFrame, value: str, n: int = 4, name: str = "bin") -> DataFrame:
    """Bin 1..n by exact cut points of the pooled distribution."""
    probs = [i / n for i in range(1, n)]
    cuts = exact_quantiles(df, value, probs).agg(F.struct(*[
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"q{i}") for i, p in enumerate(probs)]).alias("cuts")).scalar()
    number = sum((F.when(F.col(value) > cuts[f"q{i}"], 1).otherwise(0) for i in range(len(probs))), F.lit(1))
    return df.where(F.col(value).isNotNull()).withColumn(name, number)


def describe_bins(df: DataFrame, value: str, by: str, unit: str, share: str, n: int = 4) -> DataFrame:
    """Per quantile bin: range of `by`, n, units, mean, sd, mean of `by`, percent of `share`."""
    rows = quantile_bins(df.where(F.col(value).isNotNull()), by, n)
    return rows.groupBy("bin").agg(
        F.min(by).alias("low"), F.max(by).alias("high"), F.count(F.lit(1)).alias("n"),
        F.countDistinct(unit).alias("units"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.avg(by).alias("mean_by"), (F.avg(share) * 100.0).alias("pct"))


def correlations(df: DataFrame, columns) -> DataFrame:
    """Pairwise correlations over complete pairs, in one aggregate; lower triangle, long."""
    pairs = list(combinations(columns, 2))
    def pair(a, b):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        return F.corr(F.when(both, F.col(a)).cast("double"), F.when(both, F.col(b)).cast("double"))
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), pair(a, b).alias("r"))
                           for a, b in pairs]).alias("p"))
    return row.select(F.explode("p").alias("p")).select("p.*")


def weighted_moments(df: DataFrame, value: str, weight: str, by=()) -> DataFrame:
    """Weighted mean and sd with denominator (sum of weights - 1).

    The spread is summed around each group's mean in a second pass, so that a large common offset does not cancel it.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    x, w, keys = F.col(value), F.col(weight), list(by)
    means = rows.groupBy(*keys).agg((F.sum(w * x) / F.sum(w)).alias("_mean"))
    if keys:
        named = means.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_mean")
        same = reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        rows = rows.join(named, same)
    else:
        rows = rows.withColumn("_mean", means.scalar())
    around = x - F.col("_mean")
    out = rows.groupBy(*keys).agg(F.sum(w).alias("w"), F.max("_mean").alias("mean"), F.sum(w * around * around).alias("q"),
                                  F.count(F.lit(1)).alias("n"))
    return out.select(*keys, "n", "mean", F.sqrt(F.try_divide(F.col("q"), F.col("w") - 1)).alias("sd"))


def column_profile(df: DataFrame, columns) -> DataFrame:
    """Min, quartiles, mean, max, and missing count, one row per column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value")
    base = long.groupBy("column").agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"),
        F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"))
    cuts = exact_quantiles(long, "value", [0.25, 0.5, 0.75], "column")
    wide = cuts.groupBy("column").agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
                                        for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    return base.join(wide, "column", "left")


def largest_residuals(df: DataFrame, y: str, x: str, key: str, k: int = 8) -> DataFrame:
    """The k rows furthest from the fitted line (ties by key); a top-k, not a ranking."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    line = rows.agg(F.struct(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a")).alias("l")).scalar()
    residual = F.col(y) - (line["a"] + line["b"] * F.col(x))
    return rows.withColumn("residual", residual).orderBy(F.abs("residual").desc(), key).limit(k)


def trend(df: DataFrame, time: str, group: str, value: str) -> DataFrame:
    """A5: mean and count by time and group."""
    return df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(time, group).agg(
        F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
