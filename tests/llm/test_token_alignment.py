"""Token alignment against a brute force over the libraries' own encodings."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from pyspark.sql import types as T
from tokenizers import Tokenizer

from stancepanel.llm import token_alignment
from stancepanel.llm.bpe import byte_characters
from stancepanel.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Sides:
    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.byte_of = {c: b for b, c in enumerate(byte_characters())}

    def tokens(self, text):
        """Ids, and first and last byte of each token, by both sides; nothing if the bytes differ."""
        ids = self.a.encode(" " + text, add_special_tokens=False).ids if text else []
        pieces = self.b.encode(text) if text else []
        parts = [[bytes(self.byte_of[c] for c in self.a.id_to_token(i)) for i in ids],
                 [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i)
                  else self.b.id_to_piece(i).replace("▁", " ").encode() for i in pieces]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            return None
        out = []
        for numbers, held in zip((ids, pieces), parts):
            at, side = 0, []
            for i, p in zip(numbers, held):
                side.append((i, at, at + len(p)))
                at += len(p)
            out.append(side)
        return out


def expected(rows):
    sides = Sides()
    aligned = [(key, sides.tokens(text or "")) for key, text in rows]
    count = Counter()
    links = []
    for _, x in aligned:
        own = []
        if x:
            end_of = {e: i for i, _, e in x[1]}
            own = [(i, end_of[e]) for i, _, e in x[0] if e in end_of]
        links.append(own)
        count.update(own)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for (key, x), own in zip(aligned, links):
        if not x:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({e for *_, e in x[0]} & {e for *_, e in x[1]})
        groups, low = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, s, t in side if low <= s and t <= e) for side in x))
            low = e
        out.append((key, len(x[0]), len(x[1]), len(ends), len(own), sum(count[p] == best[p[1]] for p in own),
                    sum(count[p] for p in own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def odd():
    rng = random.Random(1)
    texts = [None, "", " ", "\n\n a  b\t", "x<|endoftext|>y<s></s><unk>", "<0x41>", "a▁b", "日本語 \U0001F600 é",
             "it's I'LL 's", "²³ª 12ab", "\x00 \x1c a\x85b\xa0c", "word " * 3000, "q" * 4000, "same", "same"]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x24F), rng.randint(0x370, 0xD7FF),
                                      rng.randint(0x10000, 0x1F9FF), 10, 32])) for _ in range(120)) for _ in range(60)]
    return [(i if i % 7 else None, t) for i, t in enumerate(texts)]


def test_the_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert found(QUERIES["op12_cross_tokenizer_alignment"](spark, SMALL)) == expected(rows)


def test_odd_texts_nulls_and_repeats(spark):
    rows = odd()
    schema = T.StructType([T.StructField(c, t) for c, t in (
        ("doc_id", T.LongType()), ("text", T.StringType()), ("links", T.StringType()), ("n_a", T.IntegerType()))])
    docs = spark.createDataFrame([(*r, "x", None) for r in rows], schema)
    assert found(token_alignment.align(docs, A, B)) == expected(rows)
    assert token_alignment.align(docs.limit(0), A, B).count() == 0
    assert token_alignment.alignment(docs.limit(0), A, B).count() == 0


def test_every_overlap_is_one_row(spark):
    rows = [(i, t) for i, (_, t) in enumerate(odd())]
    sides, want = Sides(), set()
    for key, text in rows:
        x = sides.tokens(text or "")
        if x and len(x[0]) < 500:
            want |= {(key, i, j, a, b, max(s, u), min(e, f), e == f) for i, (a, s, e) in enumerate(x[0])
                     for j, (b, u, f) in enumerate(x[1]) if s < f and u < e}
    short = spark.createDataFrame([r for r in rows if (x := sides.tokens(r[1] or "")) and len(x[0]) < 500 or not r[1]],
                                  "doc_id long, text string")
    got = [tuple(r) for r in token_alignment.alignment(short, A, B).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_the_other_way_round(spark):
    """Sides may be swapped; the pieces then come first."""
    docs = spark.createDataFrame([(1, "Some words, and more words."), (2, "words")], "doc_id long, text string")
    one, two = (sorted((r.doc_id, r.n_groups, r.n_links) for r in token_alignment.align(docs, *p).collect())
                for p in ((A, B), (B, A)))
    assert one == two


def test_linked_tokens_are_possible_pairs():
    known = token_alignment.possible_pairs(A, B)
    width = len(token_alignment.load(B).bytes_of)
    sides = Sides()
    for _, text in odd():
        x = sides.tokens(text or "")
        if x:
            end_of = {e: i for i, _, e in x[1]}
            assert {i * width + end_of[e] for i, _, e in x[0] if e in end_of} <= set(known.tolist())


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """Links and their sums of a batch are held at once, so every pass over the texts or links takes few rows."""
    seen = []
    real = token_alignment.stage

    def watched(df, name):
        seen.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return real(df, name)

    monkeypatch.setattr(token_alignment, "stage", watched)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.createDataFrame([(i, f"word {i} and more words") for i in range(700)], "doc_id long, text string")
    assert token_alignment.align(docs, A, B).count() == 700
    assert len(seen) == 2 and max(seen) <= 500 and spark.conf.get(
        "spark.sql.execution.arrow.maxRecordsPerBatch") == before
