"""SimHash near-duplicates with pivot distance tables.

Texts with one fingerprint are one node from the start. Two fingerprints that differ in at most 4 bits agree on at least
3 of 7 blocks of bits, so candidates are those that share one of the 35 choices of 3 blocks; none is missed. Within
such a group, distances to reference fingerprints are precomputed: a pair whose distances to any reference differ by
more than the radius cannot be linked, and only the rest is compared. References come from the group itself, so that
members within the radius of one are linked to it at once and a dense group needs few of them.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancepanel.llm.common import arrow_map, id_and_text, stage
from stancepanel.llm.components import components

RADIUS, BLOCKS, EQUAL = 4, 7, 3
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
UPPER = bytes(range(65, 91))
LOWER_ASCII = bytes.maketrans(UPPER, UPPER.lower())


def fingerprint(text: bytes, words: int = 4) -> int:
    """64-bit SimHash of UTF-8 text: a bit is set if it is set in over half of the shingles' hashes."""
    found = WORD.findall(text.translate(LOWER_ASCII))
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), 42)
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(b"%b %b %b %b" % s, 42) for s in zip(found, found[1:], found[2:], found[3:]))
                    if words == 4 else (hashed(b" ".join(found[i:i + words]), 42)
                                        for i in range(len(found) - words + 1)),
                    np.uint64, len(found) - words + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        bits = np.unpackbits(h[at:at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long. Null and empty texts have fingerprint 0."""
    def step(batch: pa.RecordBatch) -> pa.Table:
        prints = np.array([fingerprint(t.encode(), words) for t in batch.column("text").to_pylist()], np.uint64)
        return pa.table({"doc_id": batch.column("doc_id"), "fp": pa.array(prints.view(np.int64), pa.int64())})

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, step, f"doc_id {kind}, fp long")


def block_masks(blocks: int = BLOCKS, equal: int = EQUAL) -> list[int]:
    """The bits of each choice of `equal` blocks out of `blocks` nearly equal ones."""
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]
    return [sum(c) for c in combinations(one, equal)]


def distances(prints: np.ndarray, pivot: np.uint64) -> np.ndarray:
    return np.bitwise_count(prints ^ pivot).astype(np.int16)


def link_group(prints: np.ndarray, radius: int = RADIUS, pivots: int = 16) -> list[tuple[int, int]]:
    """Links that join exactly what is joined by all pairs within the radius: a spanning set, not all of them.

    Pivots are members of the group, each the first one that no earlier pivot links. Members linked to a pivot form
    its ball and are linked to it. What is left to compare is pairs of different balls, and the table of distances to
    the pivots discards those whose largest coordinate difference is over the radius.
    """
    n, links = len(prints), []
    if n == 2:
        return [(0, 1)] if int(prints[0] ^ prints[1]).bit_count() <= radius else []
    ball = np.full(n, -1)
    table = []
    while (ball < 0).any():
        p = int(np.argmax(ball < 0))
        d = distances(prints, prints[p])
        if len(table) < pivots:
            table.append(d)
        near = (d <= radius) & (ball < 0)
        links += [(p, int(i)) for i in np.flatnonzero(near) if i != p]
        ball[near] = p
    if (ball == ball[0]).all():
        return links
    coordinates = np.stack(table, axis=1)
    root = {int(b): int(b) for b in np.unique(ball)}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    order = np.argsort(coordinates[:, 0], kind="stable")  # linked members are near each other on the first coordinate
    first = coordinates[order, 0]
    ends = np.searchsorted(first, first + radius, side="right")
    for a in range(n):
        i = order[a]
        rest = order[a + 1:ends[a]]
        rest = rest[ball[rest] != ball[i]]
        if not len(rest):
            continue
        rest = rest[np.abs(coordinates[rest] - coordinates[i]).max(axis=1) <= radius]
        for j in rest[distances(prints[rest], prints[i]) <= radius]:
            x, y = find(int(ball[i])), find(int(ball[j]))
            if x != y:
                root[x] = y
                links.append((int(i), int(j)))
    return links


def candidate_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between nodes (fp, node) of different fingerprints, found in all block groups.

    A group's rows come one after the other in sorted partitions; a group of one is passed over without Python work.
    A group holds one row of 16 bytes for each different fingerprint in it.
    """
    # agreeing on EQUAL of BLOCKS blocks follows from a radius of BLOCKS - EQUAL bits
    if radius > BLOCKS - EQUAL:
        raise ValueError("the radius is larger than the block choice allows")
    masks = block_masks()
    keys = F.explode(F.array(*[F.struct(F.lit(n).cast("byte").alias("choice"),
                                        F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))).alias("part"))
                               for n, m in enumerate(masks)]))
    keyed = nodes.select("fp", "node", keys.alias("k")).select(
        F.xxhash64("k.choice", "k.part").alias("key"), "k.choice", "k.part", "fp", "node")
    dealt = keyed.select("key", "fp", "node").repartition("key").sortWithinPartitions("key", "fp")

    def pairs_of(key: np.ndarray, fp: np.ndarray, node: np.ndarray):
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        size = np.diff(edge)
        twos = edge[:-1][size == 2]
        near = np.bitwise_count(fp[twos] ^ fp[twos + 1]) <= radius
        out = [(node[twos[near]], node[twos[near] + 1])]
        for at, n in zip(edge[:-1][size > 2], size[size > 2]):
            found = link_group(fp[at:at + n], radius)
            if found:
                i = np.array(found) + at
                out.append((node[i[:, 0]], node[i[:, 1]]))
        a, b = (np.concatenate([o[k] for o in out]) for k in (0, 1))
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            held.append((key, fp.view(np.uint64), node))
            last = np.searchsorted(key, key[-1])  # the last group may go on in the next batch
            if last == 0 and len(held) > 1 and held[0][0][0] == key[-1]:
                continue
            whole = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(whole[0], key[-1]))
            held = [tuple(c[cut:] for c in whole)]
            if cut:
                yield pairs_of(*(c[:cut] for c in whole))
        if held:
            yield pairs_of(*(np.concatenate(c) for c in zip(*held)))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest doc_id reachable over links.

    Null and empty texts and texts of white space have fingerprint zero and are linked like any other. Keys are whole
    numbers; a repeated key is one node, which joins the groups of its texts. A row with a null key keeps its fingerprint
    and joins no group but that of its fingerprint's other rows; alone, its component is null. Empty tables give empty
    results.
    """
    prints = fingerprints(docs, id_col, text_col)
    prints = stage(prints, "fingerprints")
    known = prints.where("doc_id is not null")
    nodes = known.groupBy("fp").agg(F.min("doc_id").cast("long").alias("node"))
    links = candidate_links(nodes)
    # A key with several texts links their fingerprints' nodes.
    several = known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    joined = (known.join(several, "doc_id", "left_semi").join(nodes, "fp")
              .select(F.col("node").alias("a"), F.col("doc_id").cast("long").alias("b")))
    found = components(links.unionAll(joined))
    of_print = (nodes.join(found, "node", "left")
                .select("fp", F.coalesce("component", "node").alias("component_id")))
    return prints.join(of_print, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
