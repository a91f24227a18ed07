"""Document quality from a conditional random field over lines.

Every line has features of itself and of its neighbours. A linear-chain field labels lines good or bad; the quality of a
document is the mean of the lines' forward-backward marginals, weighted by their lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancepanel.llm.common import arrow_map, id_and_text, in_fold
from stancepanel.llm.crf import Chain

SPACE, UPPER, LOWER, DIGIT, MARK, BAR, STOP, OTHER = range(8)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)  # bytes of other scripts
    out[33:48] = out[58:65] = out[91:97] = out[123:127] = MARK
    out[[9, 11, 12, 13, 28, 29, 30, 31, 32]] = SPACE
    out[65:91], out[97:123], out[48:58] = UPPER, LOWER, DIGIT
    out[ord("|")] = BAR
    out[[ord("."), ord(",")]] = STOP
    return out


CLASS = _classes()
OWN = 18
FEATURES = OWN + 2 * 4 + 3
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def line_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, new_doc: np.ndarray) -> np.ndarray:
    """Features of the lines [starts, ends) of UTF-8 bytes; lines where `new_doc` holds have no line before them.

    Counts come from running sums over the bytes, so no line is cut into Python strings.
    """
    kind = CLASS[data]
    size = np.maximum(ends - starts, 1).astype(np.float64)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(mask, dtype=np.int64)]
        return (total[ends] - total[starts]).astype(np.float64)

    n = {k: share(kind == k) for k in (UPPER, LOWER, DIGIT, MARK, BAR, STOP, OTHER)}
    # Words: runs without white space; a line end also splits them.
    word = (kind != SPACE) & (data != 10)
    begin = np.flatnonzero(word & ~np.r_[False, word[:-1]])
    stop = np.flatnonzero(word & ~np.r_[word[1:], False]) + 1
    words = np.searchsorted(begin, ends) - np.searchsorted(begin, starts)
    value = np.zeros(len(begin), np.uint64)  # a hash of each word
    if len(begin):
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int((stop - begin).max()), MULTIPLIER, np.uint64))
            inside = np.flatnonzero(word)
            place = inside - np.repeat(begin, stop - begin)
            value = np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * powers[place],
                                    np.cumsum(stop - begin) - (stop - begin))
    same = np.zeros(len(begin), bool)
    if len(begin) > 1:
        same[1:] = value[1:] == value[:-1]
        owner = np.searchsorted(starts, begin, side="right")
        same[1:] &= owner[1:] == owner[:-1]
    at_word = np.zeros(len(data), bool)
    at_word[begin[same]] = True
    repeated = share(at_word) / np.maximum(words, 1)
    spelled = np.zeros(len(data), bool)  # words of three or more bytes that end in a mark other than a full stop
    if len(begin):
        spelled[begin[(kind[stop - 1] == MARK) & (stop - begin > 2)]] = True
    marked = share(spelled) / np.maximum(words, 1)
    letters = np.maximum(n[UPPER] + n[LOWER] + n[OTHER], 1)
    upper, marks = n[UPPER] / letters, n[MARK] / size
    bars, digits = n[BAR] / size, n[DIGIT] / size
    length = (n[UPPER] + n[LOWER] + n[OTHER]) / np.maximum(words, 1)
    own = np.stack([np.ones(len(starts)), upper, upper > 0.5, marks, marks > 0.08, bars, bars > 0.01, digits, repeated,
                    repeated > 0.3, marked, marked > 0.5, np.minimum(length, 20) / 10, n[STOP] / np.maximum(words, 1),
                    np.log1p(size) / 5, words < 4, n[OTHER] / size, ends == starts], axis=1)
    core = own[:, [2, 4, 6, 9]]
    first, last = new_doc, np.r_[new_doc[1:], True]
    before = np.where(first[:, None], 0, np.r_[np.zeros((1, 4)), core[:-1]])
    after = np.where(last[:, None], 0, np.r_[core[1:], np.zeros((1, 4))])
    alike = np.r_[False, np.abs(own[1:, 12] - own[:-1, 12]) < 0.02] & ~first
    return np.concatenate([own, before, after, np.stack([first, last, alike], axis=1)], axis=1)


def document_lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line features of some documents, the lines of each, and each line's bytes. An empty text is one empty line."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.r_[0, ends[:-1] + 1]
    doc_end = np.cumsum([len(t) + 1 for t in texts]) - 1
    lines = np.diff(np.r_[0, np.searchsorted(ends, doc_end, side="right")])
    new_doc = np.zeros(len(starts), bool)
    new_doc[np.cumsum(lines) - lines] = True
    return line_features(data, starts, ends, new_doc), lines, ends - starts


def byte_slices(texts: list[bytes], limit: int = 2_000_000):
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > limit:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


class QualityModel:
    """The field and the logistic curve from mean marginals to the share of good documents."""

    def __init__(self, chain: Chain, slope: float = 1.0, level: float = 0.0):
        self.chain, self.slope, self.level = chain, slope, level

    def raw(self, texts: list[bytes]) -> np.ndarray:
        out = []
        for part in byte_slices(texts):
            x, lines, size = document_lines(part)
            p, _, _ = self.chain.marginals(x, lines)
            first = np.cumsum(lines) - lines
            weight = size + 1.0
            out.append(np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first))
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        odds = _logit(self.raw(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * odds + self.level, -500, 500)))


def _logit(p: np.ndarray) -> np.ndarray:
    q = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, bound: int, max_chars: int | None = None) -> DataFrame:
    """At most `bound` labelled documents of each label, chosen by the hash of their key: label, text, weight.

    The weight restores the share of each label among all labelled rows. The sample has a fixed bound, so it is
    broadcast to the documents. Only model fitting reads it. Its texts are whole; where `max_chars` is given, documents
    of more characters are not in it.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col("doc_id").alias("key"), F.col(label_col).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(bound)
             .withColumn("weight", F.lit(max(1.0, n / bound))) for y, n in sorted(counts.items())]
    if not parts:
        parts = [known.withColumn("weight", F.lit(1.0)).limit(0)]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionAll(part)
    sample = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["key"])
    if max_chars is not None:
        sample = sample.where(F.length("text") <= max_chars)
    return sample.select(F.col("y").cast("int"), "text", "weight")


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = 3000, max_chars: int = 200_000) -> QualityModel:
    """Fit on at most `bound` labelled documents of each label (a documented bound; see `labelled_sample`).

    Every line of a training document takes the document's label. Without labels of both kinds every score is 0.5.
    """
    rows = labelled_sample(docs, labels, "quality", bound, max_chars).toArrow()
    texts = [t.encode() for t in rows.column("text").to_pylist()]
    y = np.array(rows.column("y").to_pylist(), np.int64)
    model = QualityModel(Chain(FEATURES))
    if not len(y) or y.min() == y.max():
        return model
    parts = [document_lines(p) for p in byte_slices(texts)]
    x, lines = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    model.chain.fit(x, lines, np.repeat(y, lines))
    weight, odds = np.array(rows.column("weight").to_pylist()), _logit(model.raw(texts))
    slope, level = 1.0, 0.0
    for _ in range(50):  # Newton steps of a weighted logistic regression on the one score, with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(slope * odds + level, -500, 500)))
        r, h = weight * (y - p), weight * p * (1 - p)
        grad = np.array([(r * odds).sum() - (slope - 1), r.sum() - 0.01 * level])
        hess = np.array([[(h * odds * odds).sum() + 1, (h * odds).sum()], [(h * odds).sum(), h.sum() + 0.01]])
        step = np.linalg.solve(hess, grad)
        slope, level = slope + step[0], level + step[1]
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.level = float(max(slope, 1e-3)), float(level)
    return model


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher is better) and predicted of every whole text.

    Null and empty texts are scored as one empty line. Rows are scored one by one, so equal texts get equal scores and
    repeated rows and null keys stay; an empty table gives an empty result. Only key and text are read.
    """
    def step(batch: pa.RecordBatch) -> pa.Table:
        scores = model.score([t.encode() for t in batch.column("text").to_pylist()])
        return pa.table({"doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64())})

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return (arrow_map(rows, step, f"doc_id {kind}, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, bound: int = 3000) -> DataFrame:
    """Scores of all documents by a model that never sees the labels of the held-out fold."""
    usable = labels.where(in_fold(F.col("doc_id"), folds) != held)
    model = fit_quality(id_and_text(docs), usable, bound)
    out = score_quality(docs, model)
    return out.select("doc_id", (in_fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted")
