"""Order MinHash held against plain Python: fingerprints bin by bin, neighbours of unevenly spread keys."""

import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from stancepanel.llm import order_minhash as om

SIGNED = 1 << 63
UNSPACED = re.compile("([一-鿿぀-ヿ])")


def chain(*parts):
    seed = 42
    for p in parts:
        if p is not None:
            data = p.encode() if isinstance(p, str) else struct.pack("<i", p[0]) if isinstance(p, tuple) else struct.pack("<Q", p)
            seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed


def plain_fingerprint(text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", UNSPACED.sub(r" \1 ", text)) if w]
    seen, bins = {}, {b: [] for b in range(om.BINS)}
    for place, w in enumerate(words):
        h = chain(w, words[place + 1] if place + 1 < len(words) else None) >> 24 << 24
        seen[h] = seen.get(h, 0) + 1
        if seen[h] > 1:
            h = chain(h, (seen[h],)) >> 24 << 24
        bins[h >> 58].append((h, place))
    out = []
    for b in range(om.BINS):
        value = 0
        for h, _ in sorted(sorted(bins[b])[:om.PER_TUPLE], key=lambda k: k[1]):
            value = chain(value, h)
        out.append(f"{value & 0xffffffff:08x}" if bins[b] else om.NOTHING)
    return "".join(out)


def test_fingerprints_take_the_smallest_of_every_bin(spark):
    rng = random.Random(5)
    texts = ["", " ", "one", "a b a b a b a b", "字" * 50, "日本語の文 and words 文"]
    texts += [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)) for n in (3, 40, 900)]
    texts += [" ".join(f"w{rng.randint(0, n)}" for _ in range(n)) for n in (200, 3000, 20000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    got = {r.id: r.f for r in rows.select("id", om.fingerprint(F.col("text")).alias("f")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == plain_fingerprint(text), text[:40]
    assert om.NOTHING not in got[len(texts) - 1] and om.NOTHING not in got[len(texts) - 2]


def test_one_changed_sign_of_an_unspaced_text(spark):
    rng = random.Random(8)
    text = "".join(chr(rng.randint(0x4e00, 0x9000)) for _ in range(400))
    rows = spark.createDataFrame([(1, text), (2, text[:200] + "一" + text[201:])], "doc_id long, text string")
    assert all(r.near_next > 0.8 for r in om.order_minhash(rows).collect())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_neighbours_of_unevenly_spread_keys(spark, kind):
    ids = list(range(1500)) + [10 ** 15, 10 ** 15 + 1, -7]
    rows = [(i if kind == "long" else f"k{i}", f"text {i}") for i in ids]
    random.Random(2).shuffle(rows)
    table = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(5)
    dealt = om.with_next(table, ["text"])
    got = {r.doc_id: r.next_text for r in dealt.collect()}
    order = sorted(rows)
    assert got == {k: order[(n + 1) % len(order)][1] for n, (k, _) in enumerate(order)}


def test_repeated_and_null_keys_are_spread(spark):
    rows = [(None, f"n{i}") for i in range(700)] + [(5, f"t{i}") for i in range(300)] + [(6, "same")] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = om.with_next(table, ["text", "doc_id"], group_rows=50).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((k or 0, t) for k, t in rows)
    # every row follows exactly one row, and keys are in ascending order with nulls first
    assert sorted(r.next_text for r in got) == sorted(t for _, t in rows)
    steps = [(r.doc_id, r.next_doc_id) for r in got if r.doc_id != r.next_doc_id]
    assert sorted(steps, key=str) == sorted([(None, 5), (5, 6), (6, None)], key=str)


def test_likeness_of_fingerprints_is_that_of_their_tuples(spark):
    texts = ["a b c d", "a b c e", "", "x", "a b c d e f g h i j k l m n o p"]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    both = rows.select(om.likeness(om.fingerprint(F.col("a")), om.fingerprint(F.col("b"))).alias("written"),
                       om.same_share(om.tuples(F.col("a")), om.tuples(F.col("b"))).alias("whole"), (F.col("a") == F.col("b")).alias("same"))
    for r in both.collect():
        assert r.written == r.whole and (not r.same or r.whole == 1.0)
