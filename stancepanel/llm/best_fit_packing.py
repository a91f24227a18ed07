"""Best-fit packing of tokenised documents by exact-complement hashing.

Only the number of pieces of each length decides the plan, and there are at most `capacity` lengths. So the plan is
made from one small histogram; Spark numbers the pieces of every length and joins them to the plan.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stancepanel.llm.bpe import RankMerger
from stancepanel.llm.common import arrow_map, id_and_text, slices, small_batches, stage

#: Characters whose words are looked up together: a word that comes several times in them is looked up once.
TOGETHER = 16_000_000
#: Words whose ids a Python process remembers.
REMEMBERED = 1_500_000

Pattern = tuple[tuple[int, ...], int]


class Encoder:
    """Ids of texts in one Python process, as little-endian bytes. Ids of distinct words are remembered."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import regex
        from tokenizers import Tokenizer

        self.merger, self.remembered, self.known = RankMerger(path), remembered, {}
        self.library = Tokenizer.from_file(path)
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        #: Words with these are left to the library: its normal forms matter there, or its special tokens.
        self.odd = re.compile("[^\x00-ɏ]|" + "|".join(map(re.escape, self.merger.specials)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Words are cut, numbered and put together again by Arrow; Python sees each different word once."""
        spaced = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " ")
        words = pc.split_pattern(spaced, " ")
        coded = words.values.dictionary_encode()
        different = coded.dictionary.to_pylist()
        if len(self.known) > self.remembered:
            self.known.clear()
        ids = list(map(self.known.get, different))
        new = [i for i, own in enumerate(ids) if own is None]
        self.learn([different[i] for i in new])
        for i in new:
            ids[i] = self.known[different[i]]
        flat = pa.array(ids, pa.large_binary()).take(coded.indices)
        if not len(flat):
            return [b""] * len(texts)
        edge = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:][words.offsets.to_numpy()].tolist()
        held = memoryview(flat.buffers()[2] or b"")
        return [bytes(held[i:j]) for i, j in zip(edge, edge[1:])]

    def learn(self, new: list[str]) -> None:
        """Ids of words that are not known yet."""
        odd = [w for w in new if self.odd.search(w)]
        for start in range(0, len(odd), 1000):
            part = odd[start:start + 1000]
            for w, e in zip(part, self.library.encode_batch(part, add_special_tokens=False)):
                self.known[w] = np.array(e.ids, "<u4").tobytes()
        plain = [w for w in new if w not in self.known] if odd else new
        low = [w.lower() for w in plain]
        lower = dict.fromkeys(low)
        alone = [w for w in lower if w.isalpha()]  # one piece
        number = dict(zip(alone, range(len(alone))))
        mixed = {w: [number.setdefault(p, len(number)) for p in self.pattern.findall(w)]
                 for w in lower if not w.isalpha()}
        ids, sizes = self.merger.encode([p.encode() for p in number])
        raw, edge = ids.astype("<u4").tobytes(), [0, *(4 * np.cumsum(sizes)).tolist()]
        cut = [raw[i:j] for i, j in zip(edge, edge[1:])]
        lower.update(zip(alone, cut))
        for w, own in mixed.items():
            lower[w] = b"".join([cut[i] for i in own])
        for w, own in zip(plain, low):
            self.known[w] = lower[own]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    if (path, remembered) not in _ENCODERS:
        _ENCODERS[path, remembered] = Encoder(path, remembered)
    return _ENCODERS[path, remembered]


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0, id_col: str = "doc_id",
           text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and an end id, cut only where over `capacity`."""
    def step(batch: pa.RecordBatch) -> pa.Table:
        ids, keys = batch.column("doc_id"), []
        piece, start, length, crc = [], [], [], []
        row, width, end = 0, 4 * capacity, int(end_id).to_bytes(4, "little")
        for part in slices(batch.column("text").to_pylist(), TOGETHER):
            for raw in encoder(vocabulary, remembered).encode(part):
                raw += end
                for n, at in enumerate(range(0, len(raw), width)):
                    cut = raw[at:at + width]
                    keys.append(row)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
                row += 1
        return pa.table({"doc_id": ids.take(pa.array(keys, pa.int64())), "piece": pa.array(piece, pa.int32()),
                         "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                         "ids_crc32": pa.array(crc, pa.int64())})

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, step, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Stock:
    """Pieces left of each length, with an index of which sums two lengths can make."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] += n
        self.capacity = capacity
        self.pair_sums = np.zeros(capacity + 1, np.int64)  # ordered pairs of present lengths with that sum
        for length in np.flatnonzero(self.left):
            there = self.left[:capacity + 1 - length] > 0
            self.pair_sums[length:][there] += 1

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for length in lengths:
            self.left[length] -= times
        for length in set(lengths):
            if self.left[length] == 0:  # the length is used up: its pairs go from the index
                room = self.capacity + 1 - length
                others = self.left[:room] > 0
                self.pair_sums[length:][others] -= 2
                if 2 * length <= self.capacity:
                    self.pair_sums[2 * length] -= 1

    def available(self, lengths: tuple[int, ...]) -> int:
        """How often the combination can be taken."""
        return min((int(self.left[x]) // lengths.count(x) for x in set(lengths)), default=0)

    def pair(self, total: int, besides: tuple[int, ...]) -> tuple[int, int] | None:
        if total < 2:
            return None
        big = np.arange((total + 1) // 2, total)
        for a in big[(self.left[big] > 0) & (self.left[total - big] > 0)][::-1]:
            found = (int(a), int(total - a))
            if self.available(found + besides):
                return found
        return None

    def exact(self, length: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap beside `length` exactly."""
        gap = self.capacity - length
        if gap > 0 and self.available((length, gap)):
            return (length, gap)
        if gap > 1 and self.pair_sums[gap] and (two := self.pair(gap, (length,))):
            return (length, *two)
        thirds = np.arange(1, gap - 1)
        thirds = thirds[(self.left[thirds] > 0) & (self.pair_sums[gap - thirds] > 0)]
        for c in thirds[::-1]:
            if 3 * c >= gap and (two := self.pair(gap - int(c), (length, int(c)))):
                return (length, int(c), *two)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns of lengths and how many sequences follow each; together they use every piece once."""
    stock, out = Stock(counts, capacity), []
    if stock.left[capacity]:
        n = int(stock.left[capacity])
        out.append(((capacity,), n))
        stock.take((capacity,), n)
    for length in range(capacity - 1, 0, -1):
        while stock.left[length] and (found := stock.exact(length)):
            n = stock.available(found)
            stock.take(found, n)
            out.append((found, n))
    return out + best_fit({int(x): int(stock.left[x]) for x in np.flatnonzero(stock.left)}, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counts: alike sequences are kept as one pattern with a number."""
    open_: dict[int, list[list]] = defaultdict(list)  # room left: [pattern, number]
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            room = min((r for r, held in open_.items() if r >= length and held), default=None)
            if room is None:
                per = capacity // length
                whole, rest = divmod(n, per)
                if whole:
                    open_[capacity - per * length].append([(length,) * per, whole])
                if rest:
                    open_[capacity - rest * length].append([(length,) * rest, 1])
                n = 0
                continue
            pattern, there = open_[room].pop()
            used = min(n, there)
            if there > used:
                open_[room].append([pattern, there - used])
            open_[room - length].append([pattern + (length,), used])
            n -= used
    return [(pattern, n) for held in open_.values() for pattern, n in held]


def assignments(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """length, first and last+1 rank among its pieces, first sequence, place in the sequence."""
    used, rows, sequence = defaultdict(int), [], 0
    for lengths, n in patterns:
        at = 0
        for x in lengths:
            rows.append((x, used[x], used[x] + n, sequence, at))
            used[x] += n
            at += x
        sequence += n
    return rows


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, group_rows: int = 500,
         id_col: str = "doc_id", text_col: str = "text", batch: int | None = None,
         remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and one end id, so a null or empty text is one piece of length 1. Pieces of repeated rows or
    repeated keys are packed each for itself; ties are broken by doc_id and piece. Null keys are kept. An empty table
    gives an empty result. Pieces of one length are numbered in groups by the hash of their key, of about `group_rows`
    or the square root of their number, whichever is more: no length has to be in one task, and groups are few too.
    A `batch` of fewer texts than Spark's takes less memory, and some more time, as words are merged in smaller lots;
    fewer `remembered` words do too, as more are merged again.
    """
    spark = docs.sparkSession
    with small_batches(spark, batch) if batch else nullcontext():
        cut = stage(pieces(docs, vocabulary, capacity, end_id, id_col, text_col, remembered), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = spark.createDataFrame([(x, -(-n // max(group_rows, math.isqrt(n)))) for x, n in counts.items()],
                                  "length long, parts long")  # one row for each length
    salted = cut.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), "parts"))
    sizes = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (salted.withColumn("rank", F.row_number().over(within)).join(firsts, ["length", "part"])
              .select("doc_id", "piece", "start", "length", "ids_crc32",
                      (F.col("first") + F.col("rank") - 1).alias("rank")))
    ranges = spark.createDataFrame(assignments(plan(counts, capacity)), T.StructType([
        T.StructField(c, T.LongType()) for c in ("of_length", "lo", "hi", "first_sequence", "offset")]))
    inside = ((F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return ranked.join(ranges, inside).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
