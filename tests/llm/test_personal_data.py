"""Personal data: base rules by brute force, further spans by held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from stancepanel.llm import personal_data
from stancepanel.llm.queries import QUERIES
from stancepanel.llm.shape_crf import ShapeChain, Words

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, span):
    digits = [int(c) for c in span if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (2 * d > 9) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return True


def base(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@pytest.fixture(scope="module")
def chain(spark):
    return personal_data.model(spark.read.parquet(f"{MIDDLE}/documents.parquet"))


def odd():
    rng = random.Random(4)
    texts = [None, "", " \n", "a@b.c-x_y@z.w a@b..c @x.y a.b@c", "1.2.3.4.5 256.1.1.1 01.002.3.255 1.2.3 1.2.3.4",
             "4111 1111 1111 1111", "4111-1111-1111-1112 4111111111111111", "+1 (706) 555-3138 170.106.47.218",
             "+49 30 123 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 ", "x" * 4_000 + "@" + "y" * 4_000, "9" * 4_000,
             "1." * 3_000, "+1" + " " * 9_000, "a@" * 2000 + "b.c", "日@x.y éa@b.co 1٣.2.3.4"]
    texts += ["".join(rng.choices("0123456789.+-() @ab\n", k=300)) for _ in range(150)]
    return [(i if i % 6 else None, t) for i, t in enumerate(texts)]


def test_base_rules_equal_brute_force(spark, chain):
    rows = odd()
    schema = T.StructType([T.StructField(c, t) for c, t in (
        ("doc_id", T.LongType()), ("text", T.StringType()), ("spans", T.StringType()), ("n_ip", T.IntegerType()))])
    docs = spark.createDataFrame([(*r, "x", None) for r in rows + rows[:4]], schema)
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)
                  for r in personal_data.scan(docs, chain).collect()), key=str)
    want = []
    for key, text in rows + rows[:4]:
        spans = base(text)
        want.append((key, *(sum(s[0] == k for s in spans) for k in PATTERNS),
                     hashlib.sha256(joined(spans).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert personal_data.scan(docs.limit(0)).count() == 0


def test_the_query_keeps_base_spans_and_adds_disjoint_ones(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op13_pii"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        own = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(own).encode()).hexdigest()
        assert set(own) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (list(PATTERNS).index(s[0]), s[1]))
        for k, a, b in set(spans) - set(own):
            assert all(b <= s or e <= a for _, s, e in own) and personal_data.confirmed(k, texts[r.doc_id][a:b])


HELD_OUT = [("call me on (415) 555-2671 tomorrow", "phone"), ("thing 706-555-3138 thth.", "phone"),
            ("ring 020 7946 0018", "phone"), ("my tel: 0171 555 8899, thanks", "phone"),
            ("dial 1-800-555-0177.", "phone"), ("host 8[.]8[.]4[.]4 is dns", "ip"), ("from 10(.)9(.)8(.)7 again", "ip"),
            ("pay 4242.4242.4242.4242 now", "card"), ("with 5105/1051/0510/5100 or cash", "card"),
            ("ask nina [at] corp [dot] de about it", "email"), ("mail leo (at) shore (dot) net please", "email"),
            ("write to kim at lake dot org soon", "email")]
CLEAN = ["version 7.2.1 of 2021-03-04 took 12:30:45", "order 98765432 of lot 12-34", "between 1850 and 1870 some 2,500,000",
         "section 3.4.5 on page 12", "we met at the dot at nine", "price 12.50 or 13.75 a piece", "room 12, floor 4, house 9"]


def test_other_ways_of_writing_are_found(chain):
    hits = 0
    for text, kind in HELD_OUT:
        [(own, more)] = personal_data.all_spans(chain, [text])
        assert not own
        hits += [k for k, _, _ in more] == [kind]
    assert hits >= 9, hits
    assert not [more for _, more in personal_data.all_spans(chain, CLEAN) if more]


def test_long_runs_take_linear_time():
    for text in ("x" * 2_000_000, "9" * 2_000_000, "999." * 500_000, "a@" * 300_000, "+1" + "(" * 2_000_000):
        assert not personal_data.base_spans(text + " @")


def test_documents_without_personal_data_are_left_alone(spark, chain):
    texts = [r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()]
    added = [(k, t[a:b]) for t, (_, more) in zip(texts, personal_data.all_spans(chain, texts)) for k, a, b in more]
    assert len(added) <= 3, added


def test_viterbi_and_marginals_equal_brute_force():
    words = Words(["ab 12 c\n+1 (2) x", "", "q"])
    chain = ShapeChain(3)
    chain.learn_values(words, 1)
    rng = np.random.default_rng(0)
    chain.emit, chain.move, chain.open = rng.normal(size=chain.emit.shape), rng.normal(size=(3, 3)), rng.normal(size=3)
    score, label = chain.scores(words), chain.decode(words)
    first, alive = chain.layout(words.first, words.lengths)
    p, moves = chain._expected(score, first, alive, words)
    want = np.zeros((3, 3))
    for f, n in zip(words.first, words.lengths):
        paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)
        value = chain.open[paths[:, 0]] + sum(score[f + i][paths[:, i]] for i in range(n)) \
            + sum(chain.move[paths[:, i], paths[:, i + 1]] for i in range(n - 1))
        assert label[f:f + n].tolist() == paths[value.argmax()].tolist()
        weight = np.exp(value) / np.exp(value).sum()
        for i in range(n):
            assert np.allclose(p[f + i], [weight[paths[:, i] == y].sum() for y in range(3)])
        for i in range(n - 1):
            np.add.at(want, (paths[:, i], paths[:, i + 1]), weight)
    assert np.allclose(moves, want)
    assert [len(x) for x in (words.start, words.first)] == [7, 3]


def test_marked_lines_and_their_variants_hold_up():
    rng = np.random.default_rng(3)
    for line in personal_data.LINES:
        text, spans = personal_data.marked(line)
        for kind, a, b in spans:
            assert personal_data.confirmed(kind, text[a:b]) or (kind, a, b) in personal_data.base_spans(text), line
            new = personal_data.varied(kind, text[a:b], ["anna", "paul"], rng)
            assert kind == "ip" or personal_data.confirmed(kind, new) or personal_data.base_spans(new), new
