"""Removal of repeated passages with an enhanced suffix array.

Suffixes are compared at anchors (see anchors.py) instead of at every byte: all occurrences of a repeat of `window`
bytes have an anchor at the same place in them, so grouping by the anchors' k-grams brings them together. An anchor's
context is all text that windows over it can reach. Occurrences with equal contexts are one class. In each group with
several classes a suffix array of the contexts is built with its common prefixes; a stack scan walks its tree of
common-prefix intervals. An interval is a repeat that extends as far to the right as its members agree; how far each
member agrees with others to the left tells whether the repeat can be extended that way, and so which windows it holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stancepanel.llm.anchors import Selector
from stancepanel.llm.common import arrow_map, stage

WINDOW, GRAM = 200, 64
LEFT = WINDOW - GRAM  # bytes before an anchor that a window over it can reach
WIDTH = LEFT + WINDOW
#: One text of so many is looked at for frequent k-grams, which come so often in these.
SAMPLED, OFTEN = 64, 100
PAD = b"\xff"  # never a byte of UTF-8 text
_SELECTOR: list[Selector] = []


def selector() -> Selector:
    if not _SELECTOR:
        _SELECTOR.append(Selector(WINDOW, GRAM))
    return _SELECTOR[0]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and a 96-bit key of both (r1, r2), which tells rows apart that share a doc_id."""
    base = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return base.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("r1"), F.hash("doc_id", "text").alias("r2"))


def anchors(rows: DataFrame) -> DataFrame:
    """r1, r2, pos, gram (hash of the k-gram) and class (hash of k-gram and context) of every anchor of every text."""
    def step(batch: pa.RecordBatch) -> pa.Table:
        texts = [t.encode() for t in batch.column("text").to_pylist()]
        at_row, places, grams, classes = [], [], [], []
        part: list[int] = []
        size = 0
        for i, text in enumerate([*texts, None]):
            if part and (text is None or size + len(text) > 1_000_000):
                buffer = b"".join(x for j in part for x in (PAD * LEFT, texts[j], PAD * WINDOW))
                lengths = np.array([len(texts[j]) for j in part], np.int64)
                starts = np.cumsum(lengths + WIDTH) - lengths - WINDOW
                pos, gram = selector().select(np.frombuffer(buffer, np.uint8), starts, starts + lengths)
                owner = np.searchsorted(starts, pos, side="right") - 1
                at_row.append(np.array(part)[owner])
                places.append(pos - starts[owner])
                grams.append(gram)
                classes.append(np.fromiter((xxhash.xxh64_intdigest(buffer[p - LEFT:p + WINDOW], 7)
                                            for p in pos.tolist()), np.uint64, len(pos)))
                part, size = [], 0
            if text is not None and len(text) >= WINDOW:
                part.append(i)
                size += len(text)
        if not at_row:
            return None
        rows_ = pa.array(np.concatenate(at_row))
        return pa.table({"r1": batch.column("r1").take(rows_), "r2": batch.column("r2").take(rows_),
                         "pos": pa.array(np.concatenate(places).astype(np.int32)),
                         "gram": pa.array(np.concatenate(grams).view(np.int64)),
                         "class": pa.array(np.concatenate(classes).view(np.int64))})

    return arrow_map(rows.where(F.octet_length("text") >= WINDOW).select("text", "r1", "r2"), step,
                     "r1 long, r2 int, pos int, gram long, class long")


def common_prefixes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def intervals(prefixes: list[int], least: int):
    """Stack scan over the common prefixes of neighbours: (length, first, last) of each interval of at least `least`."""
    stack = [(0, 0)]
    for i, length in enumerate([*prefixes, -1], 1):
        first = i - 1
        while stack and stack[-1][0] > length:
            held, first = stack.pop()
            if held >= least:
                yield held, first, i - 1
        if length >= 0 and (not stack or stack[-1][0] < length):
            stack.append((length, first))


def group_windows(contexts: np.ndarray) -> np.ndarray:
    """For each of the different contexts of one group (rows of bytes), which windows over the anchor occur in another.

    Column j of the result is the window that starts LEFT - j bytes before the anchor.
    """
    n = len(contexts)
    edges = np.zeros((n, LEFT + 2), np.int32)  # +1 where a run of windows starts, -1 after its end
    right, left = contexts[:, LEFT:], np.ascontiguousarray(contexts[:, LEFT - 1::-1] if LEFT else contexts[:, :0])
    if n == 2:
        agree_right = int(common_prefixes(right[:1], right[1:])[0])
        agree_left = int(common_prefixes(left[:1], left[1:])[0])
        if agree_right >= GRAM and agree_right + agree_left >= WINDOW:
            edges[:, LEFT - agree_left] += 1
            edges[:, LEFT + agree_right - WINDOW + 1] -= 1
        return np.cumsum(edges[:, :-1], axis=1) > 0
    rows = [r.tobytes() for r in right]
    array = np.array(sorted(range(n), key=rows.__getitem__))
    prefixes = common_prefixes(right[array[1:]], right[array[:-1]]).tolist()
    rows = [r.tobytes() for r in left]
    by_left = np.array(sorted(range(n), key=rows.__getitem__))
    left_rank = np.empty(n, np.int64)
    left_rank[by_left] = np.arange(n)
    steps = [common_prefixes(left[by_left[1:]], left[by_left[:-1]])]  # minima over 1, 2, 4, ... neighbours
    while len(steps[-1]) > (half := 1 << (len(steps) - 1)):
        steps.append(np.minimum(steps[-1][:-half], steps[-1][half:]))
    for length, first, last in intervals(prefixes, GRAM):
        members = array[first:last + 1]
        ranks = np.sort(left_rank[members])
        span = np.diff(ranks)
        level = np.frompyfunc(int.bit_length, 1, 1)(span).astype(np.int64) - 1
        between = np.empty(len(span), np.int64)
        for k in np.unique(level):
            on = level == k
            between[on] = np.minimum(steps[k][ranks[:-1][on]], steps[k][ranks[1:][on] - (1 << k)])
        # No left-extension diversity within reach: every member agrees with another one all the way.
        agree = np.maximum(np.r_[between, 0], np.r_[0, between])
        whole = agree + length >= WINDOW
        if whole.any():
            who = by_left[ranks[whole]]
            edges[who, LEFT - agree[whole]] += 1
            edges[who, LEFT + length - WINDOW + 1] -= 1
    return np.cumsum(edges[:, :-1], axis=1) > 0


def runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of set cells."""
    wide = np.zeros((len(marked), marked.shape[1] + 2), np.int8)
    wide[:, 1:-1] = marked
    change = np.diff(wide, axis=1)
    row, lo = np.nonzero(change == 1)
    _, hi = np.nonzero(change == -1)
    return row, lo, hi - 1


def contexts_of(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """r1, r2, pos, gram, big and the context bytes of the wanted anchors."""
    places = wanted.groupBy("r1", "r2").agg(F.collect_list(F.struct("pos", "gram", "big")).alias("places"))
    held = rows.select("r1", "r2", "text").join(places, ["r1", "r2"])

    def step(batch: pa.RecordBatch) -> pa.Table:
        places_ = batch.column("places")
        owner = np.repeat(np.arange(batch.num_rows), np.diff(places_.offsets.to_numpy()))
        flat = places_.flatten()
        padded = [PAD * LEFT + t.encode() + PAD * WINDOW for t in batch.column("text").to_pylist()]
        pos = flat.field("pos")
        cut = [padded[i][p:p + WIDTH] for i, p in zip(owner.tolist(), pos.to_pylist())]
        at = pa.array(owner)
        return pa.table({"r1": batch.column("r1").take(at), "r2": batch.column("r2").take(at), "pos": pos,
                         "gram": flat.field("gram"), "big": flat.field("big"), "context": pa.array(cut, pa.binary())})

    return arrow_map(held.select("text", "r1", "r2", "places"), step,
                     "r1 long, r2 int, pos int, gram long, big boolean, context binary")


def windows_of_groups(contexts: DataFrame) -> DataFrame:
    """r1, r2, pos, lo, hi: windows from pos+lo to pos+hi occur elsewhere. Groups come whole, in sorted partitions."""
    def solve(gram: np.ndarray, data: np.ndarray, keys: list[np.ndarray]) -> pa.RecordBatch | None:
        edge = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1], True])
        who, los, his = [], [], []
        for a, b in zip(edge[:-1], edge[1:]):
            if b - a > 1:
                row, lo, hi = runs(group_windows(data[a:b]))
                who.append(row + a)
                los.append(lo)
                his.append(hi)
        if not who:
            return None
        at = np.concatenate(who)
        return pa.RecordBatch.from_pydict({
            **{k: pa.array(v[at]) for k, v in zip(("r1", "r2", "pos"), keys)},
            "lo": pa.array((np.concatenate(los) - LEFT).astype(np.int16)),
            "hi": pa.array((np.concatenate(his) - LEFT).astype(np.int16))})

    def run(batches):
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("gram", "r1", "r2", "pos")]
            part.append(np.frombuffer(b"".join(batch.column("context").to_pylist()), np.uint8).reshape(-1, WIDTH))
            whole = [np.concatenate(c) for c in zip(*held, part)] if held else part
            cut = int(np.searchsorted(whole[0], whole[0][-1]))
            held = [[c[cut:] for c in whole]]
            if cut and (out := solve(whole[0][:cut], whole[4][:cut], [c[:cut] for c in whole[1:4]])):
                yield out
        if held and (out := solve(held[0][0], held[0][4], held[0][1:4])):
            yield out

    dealt = (contexts.select("gram", "r1", "r2", "pos", "context").repartition("gram")
             .sortWithinPartitions("gram"))
    return dealt.mapInArrow(run, "r1 long, r2 int, pos int, lo smallint, hi smallint")


def neighbour_agreement(contexts: DataFrame, side: str, name: str) -> DataFrame:
    """Adds how far each context agrees with its nearest one of the group on one side of the anchor.

    Contexts are sorted across the cluster. At the ends of a sorted partition the neighbour is not seen, and full
    agreement is assumed: the result is never too low.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in contexts.schema) + f", {name} int"
    key = F.substring("context", LEFT + 1, WINDOW) if side == "right" else F.reverse(F.hex(F.substring("context", 1, LEFT)))
    dealt = contexts.withColumn("__side", key)
    dealt = dealt.repartitionByRange("gram", "__side").sortWithinPartitions("gram", "__side").drop("__side")

    def sides(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(batch.column("context").to_pylist()), np.uint8).reshape(-1, WIDTH)
        return batch.column("gram").to_numpy(), data[:, LEFT:] if side == "right" else data[:, LEFT - 1::-1]

    def agreed(before, batch: pa.RecordBatch, own, after):
        """Agreement with the row before and after each row; `before` and `after` are sides of neighbouring batches."""
        gram, data = own
        step = np.full(len(gram) + 1, data.shape[1])
        step[1:-1] = np.where(gram[1:] == gram[:-1], common_prefixes(data[1:], data[:-1]), 0)
        if before is not None:
            step[0] = common_prefixes(data[:1], before[1][-1:])[0] if before[0][-1] == gram[0] else 0
        if after is not None:
            step[-1] = common_prefixes(data[-1:], after[1][:1])[0] if after[0][0] == gram[-1] else 0
        most = np.maximum(step[1:], step[:-1]).astype(np.int32)
        return pa.table(batch).append_column(name, pa.array(most)).to_batches()

    def run(batches):
        before = held = own = None
        for batch in batches:
            if not batch.num_rows:
                continue
            after = sides(batch)
            if held is not None:
                yield from agreed(before, held, own, after)
            before, held, own = own, batch, after
        if held is not None:
            yield from agreed(before, held, own, None)

    return dealt.mapInArrow(run, schema)


def windows_of_big_groups(contexts: DataFrame) -> DataFrame:
    """The same for groups too large for one task: neighbours bound which windows can repeat, equal windows are counted.

    With contexts sorted by their right side, no context agrees with another one further than with a neighbour; the same
    holds for the left side. Only windows within both bounds are hashed and counted; in most groups these are few.
    """
    bounded = neighbour_agreement(neighbour_agreement(contexts, "right", "agree_right"), "left", "agree_left")

    def step(batch: pa.RecordBatch) -> pa.Table | None:
        data = batch.column("context").to_pylist()
        right, left = (batch.column(c).to_numpy() for c in ("agree_right", "agree_left"))
        lo, hi = LEFT - left, np.minimum(LEFT + right - WINDOW, LEFT)
        n = np.maximum(hi - lo + 1, 0)
        if not n.sum():
            return None
        owner = np.repeat(np.arange(len(n)), n)
        column = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + lo[owner]
        digest = np.fromiter((xxhash.xxh64_intdigest(data[i][j:j + WINDOW], 11)
                              for i, j in zip(owner.tolist(), column.tolist())), np.uint64, len(owner))
        at = pa.array(owner)
        return pa.table({**{k: batch.column(k).take(at) for k in ("r1", "r2", "pos", "gram")},
                         "lo": pa.array((column - LEFT).astype(np.int16)), "same": pa.array(digest.view(np.int64))})

    possible = stage(arrow_map(bounded, step, "r1 long, r2 int, pos int, gram long, lo smallint, same long"), "windows")
    several = possible.groupBy("gram", "lo", "same").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return possible.join(several, ["gram", "lo", "same"], "left_semi").select("r1", "r2", "pos", "lo", F.col("lo").alias("hi"))


def repeated_anchors(anchors_found: DataFrame) -> DataFrame:
    """The anchors whose k-gram comes again: r1, r2, pos, gram, first of its class, again (its class has others too),
    several (its gram has several classes).

    Most k-grams come once and go no further. Anchors are shuffled once, by k-gram; a task sorts them and looks at
    neighbours. K-grams that are frequent in a sample of the texts would be one task's: they go class by class. Rows of one class are still sorted by one task.
    """
    found = stage(anchors_found, "anchors")
    often = stage(found.where(F.pmod(F.xxhash64("r1", "r2"), F.lit(SAMPLED)) == 0).groupBy("gram")
                  .agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).select("gram", F.lit(True).alias("often")), "often")
    wide = stage(found.join(often, "gram", "left").where("often").groupBy("gram")
                 .agg((F.min("class") < F.max("class")).alias("wide")), "wide")
    dealt = found.join(wide, "gram", "left").withColumn("part", F.when(F.col("wide").isNotNull(), F.col("class"))
                                                        .otherwise(0))
    group = Window.partitionBy("gram", "part")
    in_order = group.orderBy("class", "r1", "r2", "pos")
    before, after = (F.coalesce(side("class").over(in_order) == F.col("class"), F.lit(False)) for side in (F.lag, F.lead))
    several = F.coalesce("wide", F.min("class").over(group) < F.max("class").over(group))
    marked = dealt.select("r1", "r2", "pos", "gram", (~before).alias("first"), (before | after).alias("again"),
                          several.alias("several"))
    return stage(marked.where("again or several"), "repeated")


def repeated_windows(rows: DataFrame, most_classes: int = 20_000) -> DataFrame:
    """r1, r2, pos, lo, hi: every window of a text that starts anywhere else too, as runs beside anchors.

    Groups with more than `most_classes` different contexts (of 336 bytes each) are not gathered in one task.
    """
    found = repeated_anchors(anchors(rows))
    classes = found.where("several and first")
    groups = classes.groupBy("gram").agg(F.count("*").alias("classes"))
    edges = classes.join(groups, "gram").select("r1", "r2", "pos", "gram", (F.col("classes") > most_classes).alias("big"))
    contexts = stage(contexts_of(edges, rows), "contexts")
    few = windows_of_groups(contexts.where("not big").drop("big"))
    many = windows_of_big_groups(contexts.where("big").drop("big"))
    # A class with several occurrences repeats in all its windows, whatever the others of its group do.
    copies = found.where("again").select("r1", "r2", "pos", F.lit(-LEFT).cast("smallint").alias("lo"),
                                         F.lit(0).cast("smallint").alias("hi"))
    return copies.unionAll(few).unionAll(many)


def remove_repeats(docs: DataFrame, most_classes: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256: texts without the bytes of repeated 200-byte strings.

    Texts are UTF-8 bytes; a null text is empty; texts under 200 bytes and empty ones lose nothing. Copies of a text in
    several rows repeat each other, also under one doc_id or a null one. Overlapping occurrences within one text count.
    Empty tables give empty results; other columns are not read.
    """
    rows = keyed(docs, id_col, text_col)
    spans = (repeated_windows(rows, most_classes).groupBy("r1", "r2")
             .agg(F.collect_list(F.struct("pos", "lo", "hi")).alias("spans")))
    held = rows.join(spans, ["r1", "r2"], "left").select("doc_id", "text", "spans")
    kind = held.schema["doc_id"].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.Table:
        column = batch.column("spans")
        flat = column.values
        pos, lo, hi = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("pos", "lo", "hi"))
        offsets = column.offsets.to_numpy()
        size, gone, pieces, digests = [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            raw = text.encode()
            size.append(len(raw))
            a, b = offsets[i], offsets[i + 1]
            if a == b:
                gone.append(0)
                pieces.append(0)
                digests.append(hashlib.sha256(raw).hexdigest())
                continue
            first = np.maximum(pos[a:b] + lo[a:b], 0)
            last = np.minimum(pos[a:b] + hi[a:b], len(raw) - WINDOW)
            real = first <= last
            change = np.zeros(len(raw) + 1, np.int32)
            np.add.at(change, first[real], 1)
            np.add.at(change, last[real] + WINDOW, -1)
            out = np.cumsum(change[:-1]) > 0
            gone.append(int(out.sum()))
            pieces.append(int((out & ~np.r_[False, out[:-1]]).sum()))
            digests.append(hashlib.sha256(np.frombuffer(raw, np.uint8)[~out].tobytes()).hexdigest())
        return pa.table({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(size, pa.int64()),
                         "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(pieces, pa.int64()),
                         "kept_sha256": pa.array(digests, pa.string())})

    return arrow_map(held, step, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
