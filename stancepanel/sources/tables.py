"""Readers, writers and staging (IO operators)."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_SCHEMA = T.StructType([
    T.StructField("ut", T.StringType()), T.StructField("year", T.IntegerType()),
    T.StructField("field", T.StringType()), T.StructField("sent_id", T.IntegerType()),
    T.StructField("tok_id", T.IntegerType()), T.StructField("head", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("lemma", T.StringType()),
    T.StructField("upos", T.StringType()), T.StructField("deprel", T.StringType()),
    T.StructField("feats", T.StringType()),
])


def require_columns(df: DataFrame, columns) -> DataFrame:
    """IO9: stop early, naming every missing column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_tokens(spark: SparkSession, path, field: str | None = "abstract",
                columns=None) -> DataFrame:
    """IO1/IO4: token table from a Parquet path or glob (or list of them).

    The field filter and the column list reach the Parquet scan.
    """
    tokens = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if field is not None:
        tokens = tokens.where(F.col("field") == field)
    return tokens if columns is None else require_columns(tokens, columns).select(*columns)


def read_csv(spark: SparkSession, path: str, schema, columns=None) -> DataFrame:
    """IO3: CSV with header under an explicit schema, keeping some columns."""
    table = spark.read.schema(schema).csv(path, header=True)
    return table if columns is None else require_columns(table, columns).select(*columns)


def save(df: DataFrame, path: str, partition_by=(), mode: str = "errorifexists", **options) -> None:
    """IO5: Parquet output."""
    writer = df.write.mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_csv(df: DataFrame, path: str, order_by=(), single_file: bool = False,
             mode: str = "errorifexists") -> None:
    """IO6: CSV with header, globally ordered.

    A global sort leaves range partitions, so part files are in order. One
    single file is only for results known to be small.
    """
    out = df.orderBy(*order_by) if order_by else df
    (out.coalesce(1) if single_file else out).write.mode(mode).csv(path, header=True)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, from spark.checkpoint.dir."""
    folder = (spark.conf.get("spark.checkpoint.dir", None)
              or spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    if not folder:
        raise ValueError("spark.checkpoint.dir is not set; staging needs a shared folder")
    return folder.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder; only a local master without one gets a temporary folder."""
    try:
        return shared_folder(spark)
    except ValueError:
        if not spark.sparkContext.master.startswith("local"):
            raise
        folder = tempfile.mkdtemp(prefix="stancepanel-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def input_key(df: DataFrame, version: str = "") -> str:
    """A short key of what a table is made from: its input files with their sizes and times, its schema, a code version.

    The files are listed by Spark, and their hashes are combined without regard to order, so no list of files is
    gathered. A table without input files is keyed by its schema and version alone.
    """
    spark, files = df.sparkSession, df.inputFiles()
    seen = "none"
    if files:
        listed = spark.read.format("binaryFile").load(sorted(files)).select(
            F.xxhash64("path", "length", F.unix_micros("modificationTime")).alias("h"), "length")
        seen = repr(tuple(listed.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor("h")).first()))
    return hashlib.sha256("\n".join([seen, df.schema.json(), version]).encode()).hexdigest()[:24]


def more_partitions(df: DataFrame, *keys: str, share: int = 32 << 20) -> DataFrame:
    """Rows dealt by `keys` so that a partition holds those of about `share` bytes of input files.

    The session's number of partitions stays the same however large the input is, and with it grows what one task
    holds. Where that number is enough, or rows come from no files, they are left as they are.
    """
    spark, files = df.sparkSession, df.inputFiles()
    if not files:
        return df
    size = spark.read.format("binaryFile").load(sorted(files)).agg(F.sum("length")).first()[0]
    parts = -(-size // share)
    return df if parts <= int(spark.conf.get("spark.sql.shuffle.partitions")) else df.repartition(parts, *keys)


def stage(df: DataFrame, name: str, folder: str | None = None, reuse: bool = False,
          partition_by=(), version: str = "", **options) -> DataFrame:
    """IO7/IO8: write an intermediate once and read it back.

    Cuts lineage with a table in a shared folder, so losing an executor costs
    nothing. With `reuse`, a completed earlier result is read instead, but only
    one made from the same input files, schema and code `version`: the key of
    these is part of the folder's name, and a run that did not finish has left
    no success marker. A changed input goes to a folder of its own, so earlier
    readers keep theirs. `name` stands for the computation; give another
    version when its code changes.
    """
    spark = df.sparkSession
    path = f"{folder.rstrip('/') if folder else shared_folder(spark)}/{name}"
    if reuse:
        path = f"{path}-{input_key(df, version)}"
    if not (reuse and _exists(spark, path)):
        save(df, path, partition_by, mode="overwrite", **options)
    return spark.read.parquet(path)
