"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over the terms of the benchmark, weighted by counts over all documents. A randomised singular
value decomposition, whose products with the passage matrix are sums over Spark partitions, gives the latent space.
Every window of every document is compared there with every benchmark passage; close ones are confirmed by the longest
common subsequence of their words, with a check of the item's answer for paraphrases.

The benchmark is a stated query set: it is taken in blocks of items, and each block goes over all documents.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancepanel.llm.common import arrow_map, id_and_text, slices, stage

WORD = re.compile(r"\w+")
STEP = 32  # words; a window is two steps
PASSAGE = 48  # words of a benchmark passage at most
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def coded_words(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """doc_id and words of every document: 32-bit numbers of its words in order, -1 for words that are no terms."""
    def step(batch: pa.RecordBatch) -> pa.Table:
        get = terms.get
        found = [np.fromiter(map(get, ws, repeat(-1)), np.int32, len(ws)).tobytes()
                 for ws in (words_of(t.as_py()) for t in batch.column("text"))]
        return pa.table({"doc_id": batch.column("doc_id"), "words": pa.array(found, pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), step, f"doc_id {kind}, words binary")


def numbers(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The word numbers of each row."""
    return [np.frombuffer(w, np.int32) for w in batch.column("words").to_pylist()]


def term_frequencies(coded: DataFrame, terms: dict[str, int]) -> dict[str, int]:
    """In how many documents each benchmark term occurs. Only as many rows as there are terms reach the driver."""
    names = list(terms)

    def run(batches):
        counts = np.zeros(len(names) + 1, np.int64)  # the last one is that of -1
        for batch in batches:
            for own in numbers(batch):
                counts[np.unique(own)] += 1
        there = np.flatnonzero(counts[:-1])
        yield pa.RecordBatch.from_pydict({"term": pa.array(there.astype(np.int32)), "n": pa.array(counts[there])})

    found = coded.select("words").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {names[r["term"]]: r["n"] for r in found.collect()}


def passage_rows(items: DataFrame, terms: dict[str, int], idf: np.ndarray) -> DataFrame:
    """item_id, n, terms and weights of each passage of the benchmark items; weights have length 1."""
    def step(batch: pa.RecordBatch) -> pa.Table:
        keys, number, columns, weights = [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            for n, part in enumerate(passages(words_of(text))):
                counts: dict[int, int] = defaultdict(int)
                for w in part:
                    if w in terms:
                        counts[terms[w]] += 1
                at = np.array(sorted(counts), np.int32)
                w = np.array([counts[c] for c in at]) * idf[at]
                keys.append(i)
                number.append(n)
                columns.append(at)
                weights.append(w / max(np.linalg.norm(w), 1e-12))
        return pa.table({"item_id": batch.column("item_id").take(pa.array(keys, pa.int64())),
                         "n": pa.array(number, pa.int32()), "terms": pa.array(columns, pa.list_(pa.int32())),
                         "weights": pa.array(weights, pa.list_(pa.float64()))})

    kind = items.schema["item_id"].dataType.simpleString()
    return arrow_map(items, step, f"item_id {kind}, n int, terms array<int>, weights array<double>")


def passages(words: list[str]) -> list[list[str]]:
    """An item's words in nearly equal parts of at most PASSAGE words."""
    parts = max(1, -(-len(words) // PASSAGE))
    edge = [round(len(words) * i / parts) for i in range(parts + 1)]
    return [words[a:b] for a, b in zip(edge, edge[1:])]


def gram_product(rows: DataFrame, vectors: np.ndarray) -> np.ndarray:
    """Transposed matrix times matrix times `vectors`, summed over partitions; the result has one row per term."""
    width = vectors.shape[1]

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, w in zip(batch.column("terms").to_pylist(), batch.column("weights").to_pylist()):
                if at:
                    image = np.array(w) @ vectors[at]
                    for c, x in zip(at, w):
                        total[c] = total.get(c, 0.0) + x * image
        if total:
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(total), pa.int32()),
                                              "v": pa.array([t.tolist() for t in total.values()],
                                                            pa.list_(pa.float64()))})

    sums = (rows.select("terms", "weights").mapInArrow(run, "term int, v array<double>").groupBy("term")
            .agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(width)]))
    out = np.zeros_like(vectors)
    for r in sums.collect():
        out[r["term"]] = r[1:]
    return out


def latent_space(rows: DataFrame, n_terms: int, rank: int, passes: int = 2) -> np.ndarray:
    """Right singular vectors (terms by rank) of the passage matrix by randomised subspace iteration, fixed seed."""
    width = min(rank, n_terms)
    basis = np.linalg.qr(np.random.default_rng(20).standard_normal((n_terms, width)))[0]
    for _ in range(passes):
        basis = np.linalg.qr(gram_product(rows, basis))[0]
    image = basis.T @ gram_product(rows, basis)
    values, turn = np.linalg.eigh((image + image.T) / 2)
    kept = values[::-1] > max(values.max(initial=0), 1e-12) * 1e-9
    return basis @ turn[:, ::-1][:, kept]


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two word lists, with one bit per word of `a`."""
    places: dict[str, int] = defaultdict(int)
    for i, w in enumerate(a):
        places[w] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for at in filter(None, map(places.get, b)):  # other words leave the row as it is
        hit = row & at
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


class Item:
    def __init__(self, key, text: str):
        self.key, self.words = key, words_of(text)
        sentences = [words_of(s) for s in SENTENCE.split(text.strip())]
        self.answer = next((s for s in reversed(sentences) if s), [])


class Index:
    """What tasks need of one block of the benchmark: terms, projected passages, and the items' words."""

    def __init__(self, terms, weights, basis, owners, starts, vectors, items):
        self.terms = terms
        self.scaled = (weights[:, None] * basis).astype(np.float32)  # a term's weight, projected
        norms = np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)
        self.passage = (vectors / norms[:, None]).astype(np.float32)
        self.size = norms.astype(np.float32)
        self.owners, self.starts, self.items = owners, starts, items
        counts = [Counter(terms[w] for w in i.words) for i in items]
        self.own = [(np.array(list(c), np.int64), np.array(list(c.values()), np.int64)) for c in counts]

    def candidates(self, documents: list[np.ndarray], reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first step of the window and passage, where the cosine is at least `reach` times the ratio of the
        passage's length to the window's: a window that holds a passage has one of about that ratio."""
        steps = [-(-max(len(d), 1) // STEP) for d in documents]
        first = np.cumsum(steps) - steps
        known = [np.flatnonzero(d >= 0) for d in documents]
        at = np.concatenate([k // STEP + f for k, f in zip(known, first)])
        term = np.concatenate([d[k] for d, k in zip(documents, known)])
        blocks = np.zeros((sum(steps) + 1, self.scaled.shape[1]), np.float32)
        if len(at):
            edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            for a in range(0, len(edge), 2000):
                lo, hi = edge[a], edge[a + 2000] if a + 2000 < len(edge) else len(at)
                blocks[at[edge[a:a + 2000]]] = np.add.reduceat(self.scaled[term[lo:hi]], edge[a:a + 2000] - lo, axis=0)
        last = np.zeros(len(blocks) - 1, bool)
        last[np.cumsum(steps) - 1] = True
        windows = blocks[:-1] + np.where(last[:, None], 0, blocks[1:])
        out = []
        for a in range(0, len(windows), 8192):
            # the cosine times the window's length is the product with the passage of length 1
            w, p = np.nonzero(windows[a:a + 8192] @ self.passage.T >= reach * self.size[None, :])
            out.append((w + a, p))
        w, p = (np.concatenate([o[i] for o in out]) for i in (0, 1)) if out else (np.zeros(0, int),) * 2
        owner = np.searchsorted(first, w, side="right") - 1
        return owner, w - first[owner], p

    def confirm(self, words: list[str], coded: np.ndarray, step: int, passage: int, share: float,
                answered: float) -> tuple | None:
        """Item, its common subsequence as a share of its words, and whether its answer is there; None if too little."""
        item: Item = self.items[self.owners[passage]]
        begin = self.starts[passage]  # where in the item the passage starts
        room = max(8, len(item.words) // 4) + STEP
        first, last = max(0, step * STEP - begin - room), step * STEP + 2 * STEP + len(item.words) - begin + room
        # a common subsequence has no more words than both hold, in whatever order
        terms, counts = self.own[self.owners[passage]]
        held = np.bincount(coded[first:last] + 1, minlength=len(self.terms) + 1)[terms + 1]
        if np.minimum(held, counts).sum() / len(item.words) < answered:
            return None
        region = words[first:last]
        found = common_subsequence(item.words, region) / len(item.words)
        if found < answered:
            return None
        # words spread over a region much longer than the item are no passage: look at windows of the item's length
        width = len(item.words) + max(4, len(item.words) // 4)
        hop = max(1, len(item.words) // 8)
        if len(region) > width:
            found = max(common_subsequence(item.words, region[i:i + width])
                        for i in range(0, len(region) - width + hop, hop)) / len(item.words)
        answer = bool(item.answer) and common_subsequence(item.answer, region) >= 0.8 * len(item.answer)
        return (item.key, found, answer) if found >= share or (found >= answered and answer) else None


def build_index(items: DataFrame, docs: DataFrame, rank: int, written: bool = True) -> tuple[Index, DataFrame] | None:
    """The index of one block of items and the documents' words as its numbers. `items` is small: its rows are read by
    the driver. The numbers are written, so that texts are split once, or else made again for each of two reads."""
    held = [Item(r["item_id"], r["text"]) for r in items.collect()]
    held = [i for i in held if i.words]
    if not held:
        return None
    terms = {w: n for n, w in enumerate(sorted({w for i in held for w in i.words}))}
    coded = coded_words(docs, terms)
    if written:
        coded = stage(coded, "coded-words")
    frequency = term_frequencies(coded, terms)
    total = coded.count() if written else docs.count()
    idf = np.array([np.log((total + 1) / (frequency.get(w, 0) + 1)) + 1e-3 for w in terms])
    rows = passage_rows(items, terms, idf)
    basis = latent_space(rows, len(terms), rank)
    owners, starts, vectors = [], [], []
    for n, item in enumerate(held):
        at = 0
        for part in passages(item.words):
            columns = [terms[w] for w in part]
            owners.append(n)
            starts.append(at)
            vectors.append((idf[columns][:, None] * basis[columns]).sum(axis=0))
            at += len(part)
    return Index(terms, idf, basis, owners, starts, np.array(vectors), held), coded


def search(coded: DataFrame, index: Index, reach: float, share: float, answered: float, item_kind: str) -> DataFrame:
    kind = coded.schema["doc_id"].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.Table | None:
        row, found = 0, []
        names = np.array([*index.terms, ""], object)  # no word is empty, so -1 equals no word of an item
        for part in slices(numbers(batch), 250_000):
            best: dict[tuple[int, int], tuple] = {}
            words, of = [], -1
            for d, s, p in zip(*(c.tolist() for c in index.candidates(part, reach))):
                if d != of:
                    words, of = names[part[d]].tolist(), d
                hit = index.confirm(words, part[d], s, p, share, answered)
                if hit and hit[1] > best.get((d, index.owners[p]), (0, -1.0))[1]:
                    best[d, index.owners[p]] = hit
            found += [(row + d, *hit) for (d, _), hit in sorted(best.items())]
            row += len(part)
        if not found:
            return None
        return pa.table({"doc_id": batch.column("doc_id").take(pa.array([f[0] for f in found])),
                         "item_id": pa.array([f[1] for f in found], batch_type),
                         "common_share": pa.array([f[2] for f in found], pa.float64()),
                         "has_answer": pa.array([f[3] for f in found], pa.bool_())})

    batch_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_kind]
    return arrow_map(coded, step, f"doc_id {kind}, item_id {item_kind}, common_share double, has_answer boolean")


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.75, answered: float = 0.6, reach: float = 0.4,
          rank: int = 128, block_items: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, common_share, has_answer: documents that hold a benchmark item, one row per pair.

    A document holds an item if the longest common subsequence of their words covers `share` of the item, or `answered`
    of it where the item's last sentence is there too. Items without words match nothing; null and empty texts hold
    nothing. Repeated document rows give repeated results, repeated items too; rows with null keys are searched like
    others. An empty table on either side gives an empty result. Other columns are not read.
    """
    rows = id_and_text(docs, id_col, text_col)
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    total = items.count()
    blocks = max(1, -(-total // block_items))
    out = None
    for n in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n)
        built = build_index(block, rows, rank, written=blocks == 1)  # not as many copies as there are blocks
        if built is not None:
            index, coded = built
            found = search(coded, index, reach, share, answered, kind)
            out = found if out is None else out.unionAll(found)
    if out is None:
        out = rows.limit(0).select("doc_id", F.lit(None).cast(kind).alias("item_id"),
                                   F.lit(0.0).alias("common_share"), F.lit(False).alias("has_answer"))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of the documents that hold no benchmark item. Null keys stand for a row each, by its text."""
    keyed = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    found = leaks(keyed, benchmark, id_col="__row").select("doc_id").distinct()
    return keyed.join(found, keyed["__row"] == found["doc_id"], "left_anti").select(*docs.columns)
