"""Spelling variants: words that are one inserted, deleted or replaced code point apart.

A word is cut into `SEGMENTS` parts; one edit leaves all parts but one as they are, so two near words share the text
before and after one of the parts. Words are dealt by these keys, and inside a key's group blocks of words are compared
as padded code-point matrices: common prefix plus common suffix reaching the longer length minus one is a single edit.
A pair is counted only under the first key both words have, so the counts of groups add up; groups send on one row a
word, never a pair. A group of more than `PART` words is dealt as block pairs of its parts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancepanel.llm.common import id_and_text, slices, stage

LEAST, SEGMENTS, PART = 7, 4, 1024
#: Groups of up to so many words are compared along shifts of all rows at once, larger ones in tiles of this side.
TILE = 128
#: Words held by a Python worker before their counts go on.
HELD = 300_000
LETTERS = "A-Za-zÀ-ÿ"
LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                every: int = 31) -> DataFrame:
    """word, n: occurrences of the runs of letters with `least` code points or more, as `altered` leaves them."""
    runs = re.compile(f"[{LETTERS}]{{{least},}}")  # starts at a run's first letter, as shorter runs do not match at all

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()),
                                              "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            at = 0
            for part in slices(batch.column("text").to_pylist()):
                for key, text in zip(keys[at:at + len(part)], part):
                    held.update(altered(key, runs.findall(text.encode().translate(LOWER_ASCII).decode()), least, every))
                at += len(part)
                if len(held) > HELD:
                    yield sent()
        if held:
            yield sent()

    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def altered(key: str, found: list[str], least: int = LEAST, every: int = 31) -> list[str]:
    """The runs of one document: where `every` divides the crc32 h of `<key>:<run>`, code point h % length is deleted."""
    start, crc, out = zlib.crc32(f"{key}:".encode()), zlib.crc32, []
    for word in found:
        h = crc(word.encode(), start)
        if h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
            if len(word) < least:
                continue
        out.append(word)
    return out


def cuts(length: int) -> list[int]:
    """Where words of this length are cut."""
    return [i * length // SEGMENTS for i in range(SEGMENTS + 1)]


def keyed(words: DataFrame) -> DataFrame:
    """key, length (of the shorter words of the group), segment, word, n: a row for each group a word is in."""
    size = F.length("word")
    dealt = (words.select("word", "n", F.explode(F.array(size, size - 1)).alias("length")).where("length > 0")
             .select("*", F.explode(F.expr(f"sequence(0, {SEGMENTS - 1})")).alias("segment")))
    before = F.expr(f"segment * length div {SEGMENTS}").cast("int")
    after = F.expr(f"length - (segment + 1) * length div {SEGMENTS}").cast("int")
    return dealt.withColumns({"before": before, "after": after}).select(
        F.xxhash64("length", "segment", F.substr("word", F.lit(1), F.col("before")),
                   F.when(F.col("after") > 0, F.right("word", F.col("after"))).otherwise("")).alias("key"),
        "length", "segment", "word", "n")


def tiles(rows: DataFrame, part: int = PART) -> DataFrame:
    """The rows with `low`, `high` and `side`: groups of more than `part` words as pairs of parts, others as one."""
    large = stage(rows.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > part)
                  .select("key", F.ceil(F.col("members") / part).cast("int").alias("parts")), "large-groups")
    dealt = (rows.join(large, "key", "left")
             .withColumn("parts", F.coalesce("parts", F.lit(1)))
             .withColumn("side", F.pmod(F.xxhash64("word", "length"), "parts").cast("int"))
             .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))))
    return dealt.select("key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side",
                        "length", "segment", "word", "n")


class Block:
    """Words as two padded code-point matrices, one from the left and one from the right."""

    def __init__(self, words: list[str]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(self.size.max(initial=0))
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        kind = np.uint8 if flat.max(initial=0) < 256 else np.uint32
        first = np.cumsum(self.size) - self.size
        place = np.arange(width)
        inside = place < self.size[:, None]
        self.left = np.zeros((len(words), width), kind)
        self.right = np.zeros((len(words), width), kind)
        self.left[inside] = flat
        self.right[inside] = flat[((first + self.size - 1)[:, None] - place)[inside]]  # from the last code point on

    def common(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the common prefixes and suffixes of rows x and y, which broadcast against each other."""
        shortest = np.minimum(self.size[x], self.size[y])
        return tuple(np.minimum(_agreeing(side[x], side[y]), shortest) for side in (self.left, self.right))


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the first columns agree, along the last axis."""
    if not a.shape[-1]:
        return np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), np.int64)
    same = a == b
    first = np.argmin(same, axis=-1)
    return np.where(same.all(axis=-1), a.shape[-1], first)


def near_pairs(words: list[str], group: np.ndarray, side: np.ndarray, crossed: np.ndarray, length: np.ndarray,
               segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group that are one edit apart, each under the first key it has.

    Rows of a group are next to each other. In a crossed group only rows of different sides are compared.
    """
    block = Block(words)
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    sizes = np.diff(edge)
    end = np.repeat(edge[1:], sizes)
    cut = np.array([cuts(k) for k in range(int(length.max(initial=0)) + 1)], np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(x: np.ndarray, y: np.ndarray, prefix: np.ndarray, suffix: np.ndarray) -> None:
        a, b = block.size[x], block.size[y]
        longer, shorter = np.maximum(a, b), np.minimum(a, b)
        ok = (longer - shorter <= 1) & (shorter == length[x]) & (prefix + suffix >= longer - 1) & (prefix < longer)
        ok &= (length[x] == length[y]) & (segment[x] == segment[y])  # else only the hashes of two keys are equal
        ok &= ~crossed[x] | (side[x] != side[y])
        x, y, prefix, suffix = x[ok], y[ok], prefix[ok], suffix[ok]
        own, n, first = segment[x], length[x], np.zeros(len(x), bool)
        earlier = np.zeros(len(x), bool)
        for i in range(SEGMENTS):
            has = (prefix >= cut[n, i]) & (suffix >= n - cut[n, i + 1])
            first |= (own == i) & has & ~earlier
            earlier |= has
        found.append((x[first], y[first]))

    small = np.repeat(sizes <= TILE, sizes)
    alive, shift = np.flatnonzero(small), 0
    while True:  # all rows against the rows `shift` further on
        shift += 1
        alive = alive[alive + shift < end[alive]]
        if not len(alive):
            break
        for at in range(0, len(alive), 1 << 16):
            x = alive[at:at + (1 << 16)]
            keep(x, x + shift, *block.common(x, x + shift))
    for s, e in zip(edge[:-1][sizes > TILE], edge[1:][sizes > TILE]):
        for i in range(s, e, TILE):
            rows = np.arange(i, min(e, i + TILE))
            for j in range(i, e, TILE):
                others = np.arange(j, min(e, j + TILE))
                prefix, suffix = block.common(rows[:, None], others[None, :])
                near = (prefix + suffix >= np.maximum(block.size[rows][:, None], block.size[others][None, :]) - 1)
                p, q = np.nonzero(near & (rows[:, None] < others[None, :]))
                keep(rows[p], others[q], prefix[p, q], suffix[p, q])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def best_near(table: pa.Table) -> pa.Table:
    """word, n_near, best_n, best: of each row with near words how many, and the one of largest n, then smallest word.

    Groups of about the same word length share matrices, so that one long word does not widen them all.
    """
    scale = np.log2(np.maximum(table.column("length").to_numpy(), 1)).astype(np.int64)
    return pa.concat_tables(_best_near(table.filter(pa.array(scale == s))) for s in np.unique(scale))


def _best_near(table: pa.Table) -> pa.Table:
    names = ("key", "low", "high", "side", "length", "segment", "n")
    key, low, high, side, length, segment, n = (table.column(c).to_numpy().astype(np.int64) for c in names)
    change = np.r_[True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
    group = np.cumsum(change)
    words = table.column("word").combine_chunks()
    x, y = near_pairs(words.to_pylist(), group, side, low != high, length, segment)
    of, other = np.r_[x, y], np.r_[y, x]
    place = np.empty(len(n), np.int64)
    place[pc.sort_indices(words).to_numpy()] = np.arange(len(n))  # UTF-8 order is code-point order
    order = np.lexsort((place[other], -n[other], of))
    of, other = of[order], other[order]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    return pa.table({"word": words.take(pa.array(of[first])), "n_near": np.diff(np.r_[first, len(of)]).astype(np.int64),
                     "best_n": n[other[first]], "best": words.take(pa.array(other[first]))})


def near_words(words: DataFrame, part: int = PART) -> DataFrame:
    """word, n_near, best_n, best of every word (word, n) that has near words among the others."""
    dealt = tiles(keyed(words), part).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # ends with a group that may go on: at most two parts of `part` words
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            keys = [table.column(c).to_numpy() for c in ("key", "low", "high")]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if whole:
                yield from best_near(table.slice(0, whole)).to_batches(max_chunksize=50_000)
                held = table.slice(whole).to_batches()
        if held:
            yield from best_near(pa.Table.from_batches(held)).to_batches(max_chunksize=50_000)

    found = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                     F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b"))
    return best.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """word, root of every word with a form (word, form), whose chains have at most `longest` forms.

    Every round joins the table with itself, so chains shrink by half.
    """
    current = stage(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max(0, longest - 1).bit_length()):
        step = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        current = stage(current.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root")),
                        "roots")
    return current


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, fewest: int = 2,
             ratio: int = 10, every: int = 31) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of `least` code points and `fewest` occurrences or more.

    Null and empty texts have no words; a null key is an empty one where keys are hashed. Repeated rows count each time,
    an empty table gives an empty result, other columns are not read, texts of any length are read whole. Of near words
    with the same largest n the smallest in code-point order is the form.
    """
    words = stage(word_counts(docs, id_col, text_col, least, every).where(F.col("n") >= fewest), "words")
    found = words.join(near_words(words), "word", "left").withColumn(
        "has", F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False)))
    found = stage(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                               F.when(F.col("has"), F.col("best")).alias("form"),
                               F.when(F.col("has"), F.col("best_n")).alias("form_n")), "variants")
    most = found.agg(F.max("n")).first()[0] or 1
    longest = 0  # each form has `ratio` times the occurrences of the one before
    while fewest * ratio ** (longest + 1) <= most:
        longest += 1
    out = found.join(roots(found.where("form is not null"), longest), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
