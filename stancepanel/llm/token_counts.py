"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancepanel.llm.bpe import RankMerger
from stancepanel.llm.common import arrow_map, id_and_text, slices

#: White space other than single blanks and line ends between words.
IRREGULAR = re.compile(r"\s\s|[^\S \n]|\s\Z")
#: Above this code point libraries differ in the version of their character tables.
STABLE = "՗"


class Counter:
    """Counts tokens in one Python process. Counts of distinct words are remembered, in bounded memory."""

    def __init__(self, path: str, remembered: int = 1_500_000):
        import regex
        from tokenizers import Tokenizer

        self.merger, self.remembered, self.known = RankMerger(path), remembered, {}
        self.split_library = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.pattern = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.special = re.compile("|".join(map(re.escape, self.merger.specials))) if self.merger.specials else None

    def pre_tokens(self, text: str) -> list[str]:
        if max(text, default="") <= STABLE:
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.split_library(text)]

    def units(self, text: str) -> list[str]:
        """Parts of a text that are tokenised independently of each other."""
        if IRREGULAR.search(text):
            return self.pre_tokens(text)
        out: list[str] = []
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append("\n")
            head, *words = line.split(" ")
            if head:
                out.append(head)
            out += [f" {w}" for w in words]
        return out

    def count(self, texts: list[str]) -> list[int]:
        plain, extra = [], []
        for text in texts:
            parts = self.special.split(text) if self.special and self.special.search(text) else [text]
            extra.append(len(parts) - 1)
            plain.append([u for part in parts if part for u in self.units(part)])
        if len(self.known) > self.remembered:
            self.known.clear()
        new = list(set().union(*plain).difference(self.known))
        split = [self.pre_tokens(u) for u in new]
        _, sizes = self.merger.encode([p.encode() for pieces in split for p in pieces])
        at, sizes = 0, sizes.tolist()
        for unit, pieces in zip(new, split):
            self.known[unit] = sum(sizes[at:at + len(pieces)])
            at += len(pieces)
        get = self.known.__getitem__
        return [more + sum(map(get, units)) for more, units in zip(extra, plain)]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every whole text.

    `vocabulary` is the path of a byte-level file of the tokenizers library, there on every executor. Null and empty
    texts have no bytes and no tokens. Rows are scored one by one, so repeated rows, repeated keys and null keys are
    kept as they are. An empty table gives an empty result. Other columns are not read.
    """
    def step(batch: pa.RecordBatch) -> pa.Table:
        texts = batch.column("text").to_pylist()
        counts: list[int] = []
        for part in slices(texts):
            counts += counter(vocabulary).count(part)
        return pa.table({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"),
                         "n_tokens": pa.array(counts, pa.int64())})

    rows = id_and_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return (arrow_map(rows, step, f"doc_id {kind}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
