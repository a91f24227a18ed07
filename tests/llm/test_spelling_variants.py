"""Spelling variants against a brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from stancepanel.llm import spelling_variants
from stancepanel.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def occurrences(rows):
    count = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def expected(rows):
    n = occurrences(rows)
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    out, form = {}, {}
    for w in n:
        near = [x for k in (-1, 0, 1) for x in by_size.get(len(w) + k, ()) if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = len(near)
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (form[w], root(w), n[w], out[w], n.get(form[w])) for w in n}


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_the_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = found(QUERIES["op11_spelling_variants"](spark, SMALL))
    assert len(want) > 1000 and any(v[0] for v in want.values())
    assert got == want


def planted():
    rng = random.Random(5)
    rows, chain = [], ["internationale", "internationala", "internationalb", "enternationalb"]
    texts = [" ".join([w] * (2 * 10 ** (3 - i))) for i, w in enumerate(chain)]
    for word in ("gardening", "whispering", "æøåñçüö"):
        texts.append(" ".join([word] * 40))
        for _ in range(12):
            i = rng.randrange(len(word))
            texts.append(" ".join([rng.choice([word[:i] + word[i + 1:], word[:i] + "q" + word[i:],
                                               word[:i] + "z" + word[i + 1:]])] * 2))
    texts += [None, "", "  ", "short sho 123", "a" * 5000 + " " + "a" * 5000, "b" + "a" * 4999 + " b" + "a" * 4999,
              "ÀBCDEFGH àbcdefgh ÀBCDEFGH"]
    rng.shuffle(texts)
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    return rows + rows[:5]


def test_chains_long_words_nulls_and_repeats(spark):
    rows = planted()
    schema = T.StructType([T.StructField(c, t) for c, t in (
        ("doc_id", T.LongType()), ("text", T.StringType()), ("word", T.StringType()), ("n", T.IntegerType()),
        ("key", T.StringType()))])
    docs = spark.createDataFrame([(*r, None, 1, "x") for r in rows], schema)
    assert found(spelling_variants.variants(docs)) == expected(rows)
    assert spelling_variants.variants(docs.limit(0)).count() == 0


def test_a_hot_group_is_dealt_as_pairs_of_parts(spark):
    """Words of one stem, many more than a part holds."""
    rng = random.Random(8)
    letters = "abcdefg"
    words = sorted({"stemstem" + "".join(rng.choices(letters, k=4)) for _ in range(500)}
                   | {"stemstem" + "".join(rng.choices(letters, k=3)) for _ in range(200)})
    n = {w: rng.randint(2, 60) for w in words}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling_variants.near_words(table, part=50).collect()}
    for w in words:
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        assert got.get(w) == ((len(near), n[best], best) if near else None)
    dealt = spelling_variants.tiles(spelling_variants.keyed(table), 50).groupBy("key", "low", "high").count()
    assert dealt.agg({"count": "max"}).first()[0] < 250


def test_tiles_and_shifts_agree():
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("ab", k=rng.choice((8, 9)))) for _ in range(400)})
    group = np.zeros(len(words), np.int64)
    same = lambda: (words, group, group, group > 0, np.full(len(words), 8), group)
    tile = spelling_variants.TILE
    try:
        sets = []
        for spelling_variants.TILE in (16, 10_000):
            x, y = spelling_variants.near_pairs(*same())
            sets.append({(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())})
            assert len(sets[-1]) == len(x)
    finally:
        spelling_variants.TILE = tile
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words))
            if one_edit(words[i], words[j]) and min(len(words[i]), len(words[j])) == 8
            and words[i][2 - 8 + max(0, 8 - 8):] is not None}
    first = {p for p in want if _suffix(words[p[0]], words[p[1]]) >= 6}
    assert sets[0] == sets[1] == first


def _suffix(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[-1 - k] == b[-1 - k]:
        k += 1
    return k


def test_an_empty_block_has_no_pairs():
    empty = pa.table({c: pa.array([], pa.int64()) for c in ("key", "low", "high", "side", "length", "segment", "n")}
                     | {"word": pa.array([], pa.string())})
    assert spelling_variants._best_near(empty).num_rows == 0
