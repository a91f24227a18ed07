"""Lookup tables: lexicons and crosswalks.

Nothing here hints a broadcast. Inline tables become local relations and files
carry their size, so Spark broadcasts a lookup exactly when its size is under
`spark.sql.autoBroadcastJoinThreshold` and shuffles otherwise.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancepanel.functions import fixed_values as fixed
from stancepanel.sources.tables import require_columns


def small_table(spark: SparkSession, columns: dict[str, list], types: dict | None = None) -> DataFrame:
    """Inline table with exact size statistics (a local relation)."""
    types = types or {}
    return spark.createDataFrame(pa.table(
        {name: pa.array(values, type=types.get(name)) for name, values in columns.items()}))


def read_lexicon(spark: SparkSession, path: str, schema, key: str = "term",
                 dedupe: bool = False) -> DataFrame:
    """IO2: small CSV with header, key lower-cased, optionally distinct."""
    table = spark.read.schema(schema).csv(path, header=True)
    table = require_columns(table, [key]).withColumn(key, F.lower(F.col(key)))
    return table.dropDuplicates([key]) if dedupe else table


def stance_lexicon(spark: SparkSession, terms: dict | None = None) -> DataFrame:
    rows = [(w, kind, sub) for (kind, sub), text in (terms or fixed.STANCE_TERMS).items()
            for w in fixed.words(text)]
    return small_table(spark, dict(zip(("term", "type", "subtype"), map(list, zip(*rows)))))


def power_lexicon(spark: SparkSession, strict: str | None = None,
                  loose: str | None = None) -> DataFrame:
    s = fixed.words(fixed.POWER_STRICT if strict is None else strict)
    n = fixed.words(fixed.POWER_LOOSE if loose is None else loose)
    return small_table(spark, {"term": s + n, "in_strict_list": [1] * len(s) + [0] * len(n)},
                       {"in_strict_list": pa.int32()})


def term_list(spark: SparkSession, text: str) -> DataFrame:
    return small_table(spark, {"term": sorted(set(fixed.words(text.lower())))})


def stance_by_upos(lexicon: DataFrame, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per (term, part of speech) in which a term counts.

    Turns "the subtype allows this part of speech" into an equality key, so a
    token finds its entry with a hash lookup.
    """
    allowed = fixed.STANCE_UPOS if allowed is None else allowed
    choices = F.create_map(*[x for sub, upos in allowed.items()
                             for x in (F.lit(sub), F.array(*map(F.lit, upos)))])
    return (lexicon.where(F.col("subtype").isin(list(allowed)))
            .select("term", "type", "subtype", F.explode(choices[F.col("subtype")]).alias("upos")))


def map_codes(df: DataFrame, crosswalk: DataFrame, key: str, code: str,
              to: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Attach a code from a crosswalk (key, code); drop and report unmapped keys.

    Returns the mapped rows and the distinct keys that found no code. Of several codes of one key the smallest is
    taken; `clashing_codes` reports such keys.
    """
    to = to or code
    table = crosswalk.groupBy(F.col(key).alias("_key")).agg(F.min(code).alias(to))
    joined = df.join(table, F.col(key) == F.col("_key"), "left").drop("_key")
    mapped = joined.where(F.col(to).isNotNull())
    unmapped = joined.where(F.col(to).isNull() & F.col(key).isNotNull()).select(key).distinct()
    return mapped, unmapped


def clashing_codes(crosswalk: DataFrame, key: str, code: str) -> DataFrame:
    """Keys of a crosswalk with more than one code: how many, the one that `map_codes` takes, and the largest."""
    return (crosswalk.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.countDistinct(code).alias("n_codes"), F.min(code).alias("taken"), F.max(code).alias("largest"))
        .where(F.col("n_codes") > 1))
