"""Batch model scoring of sentences with a pluggable scorer, and a scorer that is fitted in Spark."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stancepanel.sources.tables import scratch_folder, stage

Scorer = Callable[[list[str]], list[float]]


def score_sentences(sentences: DataFrame, scorer_factory: Callable[[], Scorer],
                    text: str = "sentence", score: str = "certainty",
                    batch_size: int = 128) -> DataFrame:
    """All columns except the text, plus one score per row.

    The factory runs once per Python worker and returns a function from a
    list of texts to a list of scores; missing texts are scored as "".
    Partitions stream through in Arrow batches, so nothing is gathered.
    """
    kept = [c for c in sentences.columns if c != text]
    schema = T.StructType([sentences.schema[c] for c in kept] + [T.StructField(score, T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            scores: list[float] = []
            for i in range(0, len(texts), batch_size):
                scores.extend(scorer(texts[i:i + batch_size]))
            yield frame[kept].assign(**{score: scores})

    return sentences.mapInPandas(run, schema)


HEX_DIGITS = 3
BIAS = 16 ** HEX_DIGITS  # the feature every sentence has, after the hashed words


def word_bucket(word: Column) -> Column:
    """A word's feature: the first hex digits of its MD5."""
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, HEX_DIGITS), 16, 10).cast("int")


def feature_rows(tokens: DataFrame, sentence=("ut", "sent_id"), word: str = "text") -> DataFrame:
    """One row per sentence: `features`, the share `x` of its words in each bucket they have, and the bias of 1."""
    counts = tokens.groupBy(*sentence, word_bucket(F.col(word)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy(*sentence).agg(F.collect_list(F.struct("bucket", F.col("n").cast("int").alias("n"))).alias("_w"),
                                         F.sum("n").alias("_n"))
    shares = F.transform("_w", lambda w: F.struct(w["bucket"].alias("bucket"), (w["n"] / F.col("_n")).alias("x")))
    bias = F.array(F.struct(F.lit(BIAS).alias("bucket"), F.lit(1.0).alias("x")))
    return rows.select(*sentence, F.concat(shares, bias).alias("features"))


def sentence_features(tokens: DataFrame, sentence=("ut", "sent_id"), word: str = "text") -> DataFrame:
    """One row per sentence and feature: what `feature_rows` lists."""
    return feature_rows(tokens, sentence, word).select(*sentence, F.inline("features"))


def labelled_sentences(tokens: DataFrame, labels: DataFrame, label: str, bound: int | None = None, doc: str = "ut",
                       sentence=("ut", "sent_id")) -> DataFrame:
    """Sentences of labelled documents with their document's label `y` and a weight `c` that balances the labels.

    All of them; with a bound, at most so many of each label, those with the smallest MD5 of their key. Rows without a
    label do not count.
    """
    kept = tokens.join(labels.select(doc, F.col(label).alias("y")).where(F.col(label).isNotNull()), doc).select(
        *sentence, "y").distinct()
    if bound is not None:
        first = Window.partitionBy("y").orderBy(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in sentence])
                                                      .cast("binary")), *sentence)
        kept = kept.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= bound).drop("_r")
    sizes = kept.groupBy("y").agg(F.count(F.lit(1)).alias("_n"))
    return kept.join(sizes, "y").select(*sentence, F.col("y").cast("double").alias("y"), (1.0 / F.col("_n")).alias("c"))


def gradient_sums(x: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Sum over sentences (labels, c, cy, features) of what each adds to the gradient; a task sends one sum a feature.

    `labels` is a sentence's number of labels, `c` and `cy` are the sums of their weights and of weight times label.
    """
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BIAS + 1)
        for batch in batches:
            found = batch.column("features")
            sizes = np.diff(found.offsets.to_numpy())
            bucket, share = (a.to_numpy(zero_copy_only=False) for a in found.flatten().flatten())
            own = np.repeat(np.arange(len(sizes)), sizes)
            labels, c, cy = (batch.column(n).to_numpy() for n in ("labels", "c", "cy"))
            odds = labels * np.bincount(own, weights[bucket] * share, len(sizes))
            sums += np.bincount(bucket, (cy - c / (1 + np.exp(-odds)))[own] * share, BIAS + 1)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "g": pa.array(sums[at])})

    out = np.zeros(BIAS + 1)
    rows = x.select("labels", "c", "cy", "features").mapInArrow(step, "bucket int, g double")
    for r in rows.groupBy("bucket").agg(F.sum("g").alias("g")).collect():
        out[r["bucket"]] = r["g"]
    return out


def fit_hashed_scorer(tokens: DataFrame, labels: DataFrame, label: str, bound: int | None = None, steps: int = 12,
                      shrink: float = 1e-5, doc: str = "ut", sentence=("ut", "sent_id"),
                      word: str = "text") -> np.ndarray:
    """Weights of a logistic model of `label` on hashed words, by a fixed number of descent steps.

    Features of all labelled sentences (of a sample only if a `bound` is given, see `labelled_sentences`) are written
    once, one row a sentence of at most BIAS + 1 features. Each step is one Spark job that reads these rows and sums the
    gradient over all partitions; at most BIAS + 1 sums reach the driver. A sentence's features add up to 2, so the step
    `gradient / (sum of x / 2 + shrink)` never raises the loss. A feature that no labelled sentence has weighs 0.
    Without labelled sentences all weights are 0, hence all scores 0.5.
    """
    keys = list(sentence)
    marked = labelled_sentences(tokens, labels, label, bound, doc, sentence).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("labels"), F.sum("c").alias("c"), F.sum(F.col("c") * F.col("y")).alias("cy"))
    marked = stage(marked, f"sample-{uuid.uuid4().hex}", scratch_folder(tokens.sparkSession))
    own = tokens.join(marked.select(*keys), keys, "left_semi")
    found = feature_rows(own, sentence, word).withColumn(
        "features", F.filter("features", lambda f: f["bucket"].isNotNull()))
    x = stage(found.join(marked, keys), f"features-{uuid.uuid4().hex}", scratch_folder(tokens.sparkSession))
    scale = np.zeros(BIAS + 1)
    for r in x.select("c", F.explode("features").alias("f")).groupBy("f.bucket").agg(
            F.sum(F.col("c") * F.col("f.x") / 2).alias("h")).collect():
        scale[r["bucket"]] = r["h"]
    w = np.zeros(BIAS + 1)
    for _ in range(steps):
        w = w + (gradient_sums(x, w) - shrink * w) / (scale + shrink)
    return w


def hashed_scorer(weights: np.ndarray, remembered: int = 200_000) -> Callable[[], Scorer]:
    """A factory for `score_sentences`: the fitted model over words split at blanks; an empty text has only the bias."""
    def factory() -> Scorer:
        known: dict[str, float] = {}

        def weigh(word: str) -> float:
            if word not in known:
                if len(known) >= remembered:
                    known.clear()
                known[word] = float(weights[int(hashlib.md5(word.encode()).hexdigest()[:HEX_DIGITS], 16)])
            return known[word]

        def score(texts: list[str]) -> list[float]:
            words = [[w for w in t.split(" ") if w] for t in texts]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            flat = np.fromiter(map(weigh, chain.from_iterable(words)), np.float64, sizes.sum())
            sums = np.bincount(np.repeat(np.arange(len(words)), sizes), flat, len(words))
            return (1 / (1 + np.exp(-(weights[BIAS] + sums / np.maximum(sizes, 1))))).tolist()
        return score
    return factory
