"""Alignment of two tokenizers' tokens of the same text.

Both sides cut the same bytes into tokens, so a token is a range of bytes. In every batch one as-of merge a side, keyed
by document, finds the token of the other side that covers each token's start; the two directions together give every
pair of overlapping tokens. Places where tokens of both sides end cut them into groups.

An identifier pair can end together only if one token's bytes are the end of the other's. The vocabularies therefore
bound the number of different linked pairs (`possible_pairs`), and counts over the whole corpus are one array of that
length however many documents there are.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancepanel.llm.bpe import byte_characters
from stancepanel.llm.common import arrow_map, id_and_text, slices, small_batches, stage

#: Characters of a batch's texts that are aligned together.
TOGETHER = 250_000
#: Texts of an Arrow batch. A text has some four links to ten of its bytes, and several arrays are as long as these.
BATCH = 500
#: Above this code point the two byte-level libraries differ in the version of their character tables.
STABLE = "՗"
#: How the byte-level file cuts words; checked against the file.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library, on the text with a blank before it.

    Its ids are the ranks of its merges; where that holds, texts of common scripts go through the faster rank library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bytes_of = [b""] * (max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        cut = spec["pre_tokenizer"] or {}
        ranked = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and spec["normalizer"] is None \
            and not cut.get("add_prefix_space") and [vocab.get(m) for m in merges] == list(range(256, 256 + len(merges)))
        self.ranks = tiktoken.Encoding("own", pat_str=WORDS, special_tokens={}, mergeable_ranks={
            b: i for i, b in enumerate(self.bytes_of) if b}) if ranked else None

    def encode(self, texts: list[str]) -> list:
        out = []
        for text in texts:
            if self.ranks is not None and (text.isascii() or max(text) <= STABLE):
                out.append(self.ranks.encode_ordinary(" " + text))
            else:
                out.append(self.library.encode(" " + text, add_special_tokens=False).ids)
        return out


class Pieces:
    """A sentencepiece vocabulary, which puts a blank before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            self.bytes_of.append(bytes([int(piece[3:-1], 16)]) if self.library.is_byte(i)
                                 else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list:
        return self.library.encode(texts, num_threads=1)


@lru_cache(4)
def load(path: str) -> ByteLevel | Pieces:
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


@lru_cache(4)
def possible_pairs(path_a: str, path_b: str) -> np.ndarray:
    """All a * B + b, sorted, of which one token's bytes end the other's: no other tokens can end together."""
    a, b = load(path_a).bytes_of, load(path_b).bytes_of

    def ends(longer: list[bytes], shorter: list[bytes]) -> Iterator[tuple[int, int]]:
        of: dict[bytes, list[int]] = {}
        for i, s in enumerate(shorter):
            if s:
                of.setdefault(s, []).append(i)
        for i, s in enumerate(longer):
            for k in range(len(s)):
                for j in of.get(s[k:], ()):
                    yield i, j

    codes = chain((i * len(b) + j for i, j in ends(a, b)), (j * len(b) + i for i, j in ends(b, a)))
    return np.unique(np.fromiter(codes, np.int64))


class Aligned:
    """The tokens of some texts by both sides: those with tokens stand one after the other on one line of bytes.

    `live` has the places of texts with tokens. A side has ids, starts and ends, and `doc`, the place in `live`.
    """

    def __init__(self, texts: list[str], path_a: str, path_b: str):
        sides = [load(path_a), load(path_b)]
        self.live = [i for i, t in enumerate(texts) if t]
        want = [b" " + texts[i].encode() for i in self.live]
        ids, counts, ok = [], [], np.ones(len(want), bool)
        for side, path in zip(sides, (path_a, path_b)):
            found = side.encode([texts[i] for i in self.live])
            n = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int64, int(n.sum()))
            ok &= self._same_bytes(path, flat, n, want)
            ids.append(flat)
            counts.append(n)
        for k in (0, 1):  # texts whose bytes one side changes have no tokens
            if not ok.all():
                ids[k] = ids[k][np.repeat(ok, counts[k])]
                counts[k] = counts[k][ok]
        self.live = [i for i, good in zip(self.live, ok) if good]
        self.ids, self.counts = ids, counts
        sizes = [_sizes(p)[x] for p, x in zip((path_a, path_b), ids)]
        self.ends = [np.cumsum(s) for s in sizes]
        self.starts = [e - s for e, s in zip(self.ends, sizes)]
        self.doc = [np.repeat(np.arange(len(self.live)), n) for n in counts]

    @staticmethod
    def _same_bytes(path: str, flat: np.ndarray, counts: np.ndarray, want: list[bytes]) -> np.ndarray:
        """Of each text whether its tokens' bytes joined are the wanted ones."""
        taken = _byte_table(path).take(pa.array(flat))
        held, at = taken.buffers()[2], np.frombuffer(taken.buffers()[1], np.int64)[taken.offset:]
        data = memoryview(held or b"").cast("B")
        edge = at[np.r_[0, np.cumsum(counts)]] if len(flat) else np.zeros(len(counts) + 1, np.int64)
        return np.array([data[s:e].tobytes() == w for s, e, w in zip(edge[:-1], edge[1:], want)], bool).reshape(len(want))

    def overlaps(self) -> tuple[np.ndarray, np.ndarray]:
        """Places (in a's and b's tokens) of all pairs that share bytes, by where the shared bytes start."""
        frames = [pd.DataFrame({"start": s, "doc": d, "token": np.arange(len(s))}) for s, d in zip(self.starts, self.doc)]
        if not len(frames[0]) or not len(frames[1]):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cover = [pd.merge_asof(frames[k], frames[1 - k], on="start", by="doc", suffixes=("", "_other"))
                 ["token_other"].to_numpy(np.int64) for k in (0, 1)]
        own = np.arange(len(frames[1]))
        late = self.starts[0][cover[1]] < self.starts[1]  # equal starts are in the first direction already
        a, b = np.r_[np.arange(len(cover[0])), cover[1][late]], np.r_[cover[0], own[late]]
        order = np.argsort(np.maximum(self.starts[0][a], self.starts[1][b]), kind="stable")
        return a[order], b[order]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Overlapping pairs that end together, in order."""
        a, b = self.overlaps()
        together = self.ends[0][a] == self.ends[1][b]
        return a[together], b[together]

    def groups(self, a: np.ndarray, b: np.ndarray) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text in `live`: ids of a and b between places where both sides end (the links)."""
        last = [np.zeros(len(x), bool) for x in self.ids]
        last[0][a] = last[1][b] = True
        group = [np.cumsum(x) - x for x in last]
        # Ids are written in the order: a's tokens of a group, b's tokens of it, and so on.
        at = [np.arange(len(group[0])) + np.r_[0, b + 1][group[0]], np.arange(len(group[1])) + (a + 1)[group[1]]]
        n = len(self.ids[0]) + len(self.ids[1])
        number, sign = np.empty(n, np.int64), np.zeros(n, np.int64)
        for k in (0, 1):
            number[at[k]] = self.ids[k]
            sign[at[k]] = last[k] * (k + 1)
        table, width = _written(int(number.max(initial=0)).bit_length())
        taken = table.take(pa.array(number + width * sign))
        if not n:
            return []
        data, edge = taken.buffers()[2], np.frombuffer(taken.buffers()[1], np.int64)[taken.offset:]
        ends = edge[np.r_[0, np.cumsum(self.counts[0] + self.counts[1])]]
        view = memoryview(data)
        return [str(view[s:e - 1], "ascii") for s, e in zip(ends[:-1], ends[1:])]  # without the last sign


@lru_cache(4)
def _byte_table(path: str) -> pa.Array:
    return pa.array(load(path).bytes_of, pa.large_binary())


@lru_cache(4)
def _sizes(path: str) -> np.ndarray:
    return np.array([len(b) for b in load(path).bytes_of], np.int64)


@lru_cache(4)
def _written(bits: int) -> tuple[pa.Array, int]:
    """All numbers below 2 ** bits as text, followed by a comma, then by a bar, then by a semicolon."""
    width = 1 << bits
    return pa.array([f"{i}{sign}".encode() for sign in ",|;" for i in range(width)], pa.large_binary()), width


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every pair of overlapping tokens: doc_id, a_at, b_at (places in the text's tokens), a, b (ids), first, last (the
    shared bytes, end exclusive, of the text with a blank before it) and together (whether both end there).

    Null and empty texts, and texts whose bytes a side changes, have no rows. Rows are aligned one by one: repeated rows
    and null keys stay as they are, an empty table gives an empty result, other columns are not read. Texts of any
    length are aligned whole.
    """
    def step(batch: pa.RecordBatch) -> pa.Table | None:
        texts, out, at = batch.column("text").to_pylist(), [], 0
        for part in slices(texts, TOGETHER):
            x = Aligned(part, path_a, path_b)
            a, b = x.overlaps()
            if len(a):
                first = [np.cumsum(n) - n for n in x.counts]
                doc = x.doc[0][a]
                began = x.starts[0][first[0]][doc]
                keys = batch.column("doc_id").take(pa.array(np.array(x.live)[doc] + at))
                out.append(pa.table({
                    "doc_id": keys, "a_at": a - first[0][doc], "b_at": b - first[1][doc],
                    "a": x.ids[0][a], "b": x.ids[1][b],
                    "first": np.maximum(x.starts[0][a], x.starts[1][b]) - began,
                    "last": np.minimum(x.ends[0][a], x.ends[1][b]) - began, "together": x.ends[0][a] == x.ends[1][b]}))
            at += len(part)
        return pa.concat_tables(out) if out else None

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, step, f"doc_id {kind}, a_at long, b_at long, a long, b long, first long, last long, "
                                 "together boolean")


def described(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 and links: the place in possible_pairs of each link of the text."""
    def step(batch: pa.RecordBatch) -> pa.Table:
        known, width = possible_pairs(path_a, path_b), len(load(path_b).bytes_of)
        out, at = [], 0
        for part in slices(batch.column("text").to_pylist(), TOGETHER):
            x = Aligned(part, path_a, path_b)
            a, b = x.links()
            numbers = {c: np.zeros(len(part), np.int64) for c in ("n_a", "n_b", "n_groups")}
            numbers["n_a"][x.live], numbers["n_b"][x.live] = x.counts
            numbers["n_groups"][x.live] = np.bincount(x.doc[0][a], minlength=len(x.live))
            digests = [""] * len(part)
            for i, text in zip(x.live, x.groups(a, b)):
                digests[i] = hashlib.sha256(text.encode()).hexdigest()
            links = np.searchsorted(known, x.ids[0][a] * width + x.ids[1][b]).astype(np.int32)
            edge = np.r_[0, np.cumsum(numbers["n_groups"])].astype(np.int32)
            out.append(pa.table({"doc_id": batch.column("doc_id").slice(at, len(part)), **numbers,
                                 "groups_sha256": pa.array(digests, pa.string()),
                                 "links": pa.ListArray.from_arrays(pa.array(edge), pa.array(links))}))
            at += len(part)
        return pa.concat_tables(out)

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, step, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, "
                                 "links array<int>")


def link_counts(rows: DataFrame, pairs: int) -> np.ndarray:
    """How often each possible pair is linked in all rows' `links`. Every partition sums into one array of `pairs`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(pairs, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("links").flatten().to_numpy(), minlength=pairs)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(seen, pa.int32()), "n": pa.array(total[seen])})

    found = (rows.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
             .toArrow())  # at most `pairs` rows
    out = np.zeros(pairs, np.int64)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text.

    A link is a pair of tokens that end together; the count of its id pair is the number of links of the whole table
    that hold it. n_best: links whose count is the highest of their b id, ties included; count_sum: the links' counts.
    Null and empty texts, and texts whose bytes a side changes, have zeros and an empty groups_sha256. Each repeated row
    counts. Null keys stay, an empty table gives an empty result, other columns are not read, texts of any length are
    aligned whole.
    """
    spark, known = docs.sparkSession, possible_pairs(path_a, path_b)
    with small_batches(spark, BATCH):
        rows = stage(described(docs, path_a, path_b, id_col, text_col), "aligned")
        count = link_counts(rows, len(known))
    b = known % len(load(path_b).bytes_of)
    most = np.zeros(b.max(initial=0) + 1, np.int64)
    np.maximum.at(most, b, count)
    best = count == most[b]
    of_pair = spark.sparkContext.broadcast((count, best))  # as long as possible_pairs, whatever the rows

    def step(batch: pa.RecordBatch) -> pa.Table:
        counts, bests = of_pair.value
        links = batch.column("links")
        edge = np.asarray(links.offsets) - links.offsets[0].as_py()
        flat = links.flatten().to_numpy()
        sums = [np.r_[0, np.cumsum(x[flat])][edge] for x in (bests.astype(np.int64), counts)]
        names = ["doc_id", "n_a", "n_b", "n_groups"]
        return pa.table({**{c: batch.column(c) for c in names}, "n_links": np.diff(edge).astype(np.int64),
                         "n_best": np.diff(sums[0]), "count_sum": np.diff(sums[1]),
                         "groups_sha256": batch.column("groups_sha256")})

    kind = rows.schema["doc_id"].dataType.simpleString()
    with small_batches(spark, BATCH):
        return stage(arrow_map(rows, step, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, "
                                           "n_best long, count_sum long, groups_sha256 string"), "counted")
