"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned: words and word beginnings that labelled toxic documents have far more often than others. Its
trie, walked with at most one edit, becomes one deterministic automaton that finds exact and misspelled terms in a
single pass over a word. Each find is weighed by its context window, the line it stands in: between quotation marks or
not. A logistic model over the weighed finds gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancepanel.llm.common import arrow_map, id_and_text, in_fold, slices, stage
from stancepanel.llm.quality_classifier import labelled_sample

WORD = re.compile(r"[^\W\d_]+(?:[*@$!013457][^\W\d_]+)*")
#: Signs that stand for letters in disguised words.
DISGUISE = str.maketrans("@$!013457", "asioiesat")
QUOTES = "\"“”„«»‹›"
MARK = re.compile(f"[{QUOTES}\n]")
FEATURES = 7
#: Different words whose finds a task remembers, characters whose words it holds at once, rows that it filters at once.
REMEMBERED, HELD_CHARS, ROWS = 200_000, 1_000_000, 500


def spelled(word: str) -> str:
    return word.lower().translate(DISGUISE)


def beginnings(word: str) -> list[str]:
    """The word itself, marked as whole, and its beginnings of four to eight letters, marked as open."""
    return [word + "."] + [word[:n] + "-" for n in range(4, min(8, len(word)) + 1)]


def term_counts(sample: DataFrame) -> DataFrame:
    """term, y, n: in how many sampled documents of each label a word or beginning occurs."""
    def step(batch: pa.RecordBatch) -> pa.Table:
        counts: Counter = Counter()
        for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
            terms: set[str] = set()
            for word in set(map(spelled, WORD.findall(text))):
                terms.update(beginnings(word))
            counts.update((t, y) for t in terms)
        keys = list(counts)
        return pa.table({"term": pa.array([t for t, _ in keys], pa.string()),
                         "y": pa.array([y for _, y in keys], pa.int32()),
                         "n": pa.array([counts[k] for k in keys], pa.int64())})

    return (arrow_map(sample.select("y", "text"), step, "term string, y int, n long").groupBy("term")
            .agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"),
                 F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean")))


def gain(toxic: Column, clean: Column, n_toxic: Column, n_clean: Column) -> Column:
    """Log-likelihood ratio of the two rates against one common rate."""
    def part(k: Column, n: Column, rate: Column) -> Column:
        return F.when(k > 0, k * F.log(rate)).otherwise(0.0) + F.when(n > k, (n - k) * F.log(1 - rate)).otherwise(0.0)

    both = (toxic + clean) / (n_toxic + n_clean)
    return 2 * (part(toxic, n_toxic, toxic / n_toxic) + part(clean, n_clean, clean / n_clean)
                - part(toxic, n_toxic, both) - part(clean, n_clean, both))


def choose_terms(rows: list[tuple[str, int, int, float]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms and their weights from (term, toxic, clean, gain): the strongest first, none that begins another chosen
    one or is begun by it."""
    chosen: dict[str, float] = {}
    stems: set[str] = set()
    begun: set[str] = set()  # every beginning of a chosen stem
    for term, a, b, _ in sorted(rows, key=lambda r: (-round(r[3], 9), -len(r[0]), r[0])):
        stem = term[:-1]
        own = {stem[:n] for n in range(len(stem) + 1)}
        if stem not in begun and stems.isdisjoint(own):
            chosen[term] = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
            stems.add(stem)
            begun |= own
    return chosen


def learn_lexicon(sample: DataFrame, least_gain: float = 20.0, ratio: float = 12.0) -> dict[str, float]:
    """All terms with a gain of `least_gain` that are `ratio` times as frequent in toxic documents of the sample.

    Only these reach the driver. Each is in several of the bounded number of toxic documents and hardly in others.
    """
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return {}
    strong = (term_counts(sample).where((F.col("toxic") >= 3)
                                        & (F.col("toxic") * n_clean >= ratio * F.col("clean") * n_toxic))
              .withColumn("gain", gain(F.col("toxic"), F.col("clean"), F.lit(n_toxic), F.lit(n_clean)))
              .where(F.col("gain") >= least_gain))
    return choose_terms([(r.term, r.toxic, r.clean, r.gain) for r in strong.collect()], n_toxic, n_clean)


class Automaton:
    """All terms of a lexicon with up to one edit, as one deterministic automaton.

    A state is a set of (trie node, edits). Terms of at least `least` letters may be misspelled. Whole words are
    accepted at their end; open beginnings as soon as they are read, whatever follows.
    """

    def __init__(self, terms, least: int = 5):
        self.terms = sorted(terms)
        self.least = least
        self.children: list[dict[str, int]] = [{}]
        self.depth, self.word, self.open, self.longest = [0], [-1], [-1], [0]
        for number, term in enumerate(self.terms):
            node = 0
            for n, c in enumerate(term[:-1]):
                self.longest[node] = max(self.longest[node], len(term) - 1)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.depth.append(n + 1)
                    self.word.append(-1)
                    self.open.append(-1)
                    self.longest.append(0)
                node = self.children[node][c]
            self.longest[node] = max(self.longest[node], len(term) - 1)
            (self.word if term[-1] == "." else self.open)[node] = number
        self.letters = sorted({c for t in self.terms for c in t[:-1]})
        self._build()

    def _closure(self, places) -> frozenset:
        """Adds what skipping one letter of a term reaches; drops places that another one covers."""
        best: dict[int, int] = {}
        for node, edits in places:
            best[node] = min(edits, best.get(node, 9))
        for node, edits in list(best.items()):
            if edits == 0:
                for child in self.children[node].values():
                    if self.longest[child] >= self.least:
                        best.setdefault(child, 1)
        return frozenset(best.items())

    def _read(self, state: frozenset, letter: str | None) -> frozenset:
        out = []
        for node, edits in state:
            kids = self.children[node]
            if letter in kids:
                out.append((kids[letter], edits))
            if edits == 0 and self.longest[node] >= self.least:
                out.append((node, 1))  # an added letter
                out += [(child, 1) for child in kids.values() if self.longest[child] >= self.least]  # another letter
        return self._closure(out)

    def _found(self, state: frozenset, held: list[int], exact: bool) -> int:
        hits = [held[node] for node, edits in state
                if held[node] >= 0 and (edits == 0 if exact else len(self.terms[held[node]]) - 1 >= self.least)]
        return min(hits, default=-1)

    def _build(self) -> None:
        start = self._closure([(0, 0)])
        index, queue, rows = {start: 0}, [start], []
        while queue:
            state = queue.pop(0)
            row = []
            for letter in [*self.letters, None]:
                after = self._read(state, letter)
                if after not in index:
                    index[after] = len(index)
                    queue.append(after)
                row.append(index[after])
            rows.append(row)
        states = list(index)
        self.table = np.array(rows, np.int32)
        self.found = {(kind, exact): np.array([self._found(s, held, exact) for s in states], np.int32)
                      for kind, held in (("word", self.word), ("open", self.open)) for exact in (True, False)}
        self.code = {c: i for i, c in enumerate(self.letters)}

    def run(self, words: list[str]) -> list[tuple[int, int] | None]:
        """For each word the term and whether it is misspelled (0 or 1), or None; exact finds come first."""
        out: list[tuple[int, int] | None] = [None] * len(words)
        if not self.terms or not words:
            return out
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lookup = np.full(int(points.max(initial=0)) + 1, len(self.letters), np.int32)
        for c, i in self.code.items():
            if ord(c) < len(lookup):
                lookup[ord(c)] = i
        flat = lookup[points]
        first = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        state = np.zeros(len(words), np.int32)
        exact, near = np.full(len(words), -1, np.int32), np.full(len(words), -1, np.int32)
        live = order
        for t in range(int(lengths.max(initial=0))):
            live = live[:np.searchsorted(-lengths[live], -t, side="left")]
            state[live] = self.table[state[live], flat[first[live] + t]]
            for held, is_exact in ((exact, True), (near, False)):
                hit = self.found["open", is_exact][state[live]]
                held[live] = np.where(held[live] < 0, hit, held[live])
        for held, is_exact in ((exact, True), (near, False)):
            hit = self.found["word", is_exact][state]
            held[:] = np.where(hit >= 0, hit, held)
        for i in np.flatnonzero((exact >= 0) | (near >= 0)):
            out[i] = (int(exact[i]), 0) if exact[i] >= 0 else (int(near[i]), 1)
        return out


def quotations(text: str, spans: Iterable[tuple[int, int]]) -> Iterator[bool]:
    """For each of the ascending spans: whether an odd number of quotation marks stands before it on its line and one
    more after it on the same line, however long the line is. One pass over the marks of the text."""
    marks = MARK.finditer(text)
    mark, opened = next(marks, None), 0
    for start, end in spans:
        while mark and mark.start() < start:
            opened = 0 if mark[0] == "\n" else opened + 1
            mark = next(marks, None)
        yield opened % 2 == 1 and mark is not None and mark[0] != "\n"


class ToxicityModel:
    def __init__(self, lexicon: dict[str, float]):
        self.automaton = Automaton(lexicon)
        self.weight = [lexicon[t] for t in self.automaton.terms]
        self.coefficients = np.zeros(FEATURES)
        self.known: dict[str, tuple[int, int] | None] = {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: a constant; finds and their weight, exact and misspelled, outside quotation; finds in quotation."""
        words = [set(WORD.findall(t)) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*words).difference(self.known))
        self.known.update(zip(new, self.automaton.run([spelled(w) for w in new])))
        out = np.zeros((len(texts), FEATURES))
        out[:, 0] = 1
        for row, text, own in zip(out, texts, words):
            finds = {w: f for w in own if (f := self.known[w]) is not None}
            if not finds:
                continue
            found = [(m.span(), find) for m in WORD.finditer(text) if (find := finds.get(m[0])) is not None]
            for in_quotes, (_, find) in zip(quotations(text, [span for span, _ in found]), found):
                at = 5 + find[1] if in_quotes else 1 + 2 * find[1]
                row[at] += 1
                if not in_quotes:
                    row[at + 1] = max(row[at + 1], self.weight[find[0]])
        out[:, [1, 3, 5, 6]] = np.log1p(out[:, [1, 3, 5, 6]])
        return out

    def all_features(self, texts: list[str]) -> np.ndarray:
        """Features of whole texts, about HELD_CHARS characters at a time."""
        return np.concatenate([np.zeros((0, FEATURES)), *(self.features(part) for part in slices(texts, HELD_CHARS))])

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.all_features(texts) @ self.coefficients, -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Weighted logistic regression, shrunk towards `prior`, by damped Newton steps."""
    b = prior.astype(float).copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        grad = x.T @ (weight * (y - p)) - l2 * (b - prior)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(b))
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = 6000) -> ToxicityModel:
    """Learn lexicon and scores on at most `bound` labelled documents of each label (a documented bound), whole texts.

    Texts stay in Spark: the driver gets the chosen terms and the different rows of features. Without labels
    of both kinds the lexicon is empty and every text gets the same score.
    """
    sample = stage(labelled_sample(docs, labels, "toxic", bound), "toxic-sample")
    model = ToxicityModel(learn_lexicon(sample))

    def step(batch: pa.RecordBatch) -> pa.Table:
        x = model.all_features(batch.column("text").to_pylist())
        return pa.table({"y": batch.column("y"), "weight": batch.column("weight"),
                         "x": pa.array(list(x), pa.list_(pa.float64()))})

    counted = (arrow_map(sample, step, "y int, weight double, x array<double>").groupBy("y", "weight", "x")
               .agg(F.count("*").alias("n")).collect())
    rows = sorted(counted, key=lambda r: (r.y, r.weight, r.x))  # sums of floats do not depend on the order of tasks
    x = np.array([r.x for r in rows], np.float64).reshape(-1, FEATURES)
    y = np.array([r.y for r in rows], np.float64)
    weight = np.array([r.weight * r.n for r in rows], np.float64)
    share = (weight * y).sum() / weight.sum() if len(y) else 0.0
    prior = np.array([math.log((share + 1e-3) / (1 - share + 1e-3)) - 1.0, 1.0, 0.4, 0.5, 0.2, 0.0, 0.0])
    if not len(y) or y.min() == y.max():
        model.coefficients = np.r_[prior[0], np.zeros(FEATURES - 1)]
        return model
    model.coefficients = fit_logistic(x, y, weight, prior)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher is more toxic) and predicted of every whole text.

    Null and empty texts have no finds and get the lowest score. Rows are scored one by one: equal texts get equal
    scores, repeated rows and null keys stay, an empty table gives an empty result. Only key and text are read. Texts of
    any length are read whole.
    """
    def step(batch: pa.RecordBatch) -> pa.Table:
        return pa.table({"doc_id": batch.column("doc_id"),
                         "score": pa.array(model.score(batch.column("text").to_pylist()), pa.float64())})

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return (arrow_map(rows, step, f"doc_id {kind}, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, bound: int = 6000) -> DataFrame:
    """Scores of all documents by a model that never sees the labels of the held-out fold."""
    usable = labels.where(in_fold(F.col("doc_id"), folds) != held)
    out = score_toxicity(docs, fit_toxicity(id_and_text(docs), usable, bound))
    return out.select("doc_id", (in_fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, bound: int = 6000, threshold: float = 0.3) -> DataFrame:
    """All rows and columns of the documents that are not toxic. The text alone decides, so copies fare alike.

    Null and empty texts have no finds. Repeated rows, null keys and further columns of any name stay as they are; an
    empty table gives an empty result. Texts of any length are read whole.
    """
    model = fit_toxicity(id_and_text(docs), labels, bound)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                texts = [t or "" for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(model.score(texts) < threshold, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
