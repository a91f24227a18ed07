import random

import numpy as np

from stancepanel.llm import decontamination
from stancepanel.llm.decontamination import Index, Item


def test_regions_with_too_few_words_of_an_item_are_not_walked(monkeypatch):
    """Where a region shares too few words with an item, no subsequence is looked for; all others are found as before."""
    random.seed(4)
    items = [Item(n, " ".join(random.choices("abcdefgh", k=20)) + ".") for n in range(5)]
    terms = {w: n for n, w in enumerate("abcdefgh")}
    index = Index(terms, np.ones(8), np.eye(8), list(range(5)), [0] * 5, np.ones((5, 8)), items)
    walked, found = [], decontamination.common_subsequence
    monkeypatch.setattr(decontamination, "common_subsequence", lambda a, b: (walked.append(len(b)), found(a, b))[1])
    passed_over = 0
    for _ in range(300):
        words = random.choices("abcdefgh" + "z" * random.choice((0, 8, 40)), k=random.randint(0, 60))
        coded = np.array([terms.get(w, -1) for w in words], np.int32)
        for n, item in enumerate(items):
            walked.clear()
            got = index.confirm(words, coded, 0, n, 0.75, 0.6)
            shared = sum(min(words.count(w), item.words.count(w)) for w in terms)
            assert bool(walked) == (shared >= 12)
            passed_over += not walked
            whole = found(item.words, words)
            assert whole >= 12 or got is None
            assert got is not None or whole < 15 or len(words) > 25
    assert passed_over


def test_texts_are_split_once_and_blocks_find_the_same(spark, tmp_path):
    """A single block reads the written numbers of the words, several blocks the texts; both find the same."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["É", "İx", "ß"]
    items = [" ".join(rng.choices(words, k=30)) + "." for _ in range(6)]
    texts = [" ".join([*rng.choices(words, k=50), item, *rng.choices(["zz", "yy"], k=90)]) for item in items]
    texts += ["", None, "  ", texts[0], items[1].upper(), " ".join(items[:3]), "none of these"]
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    one, several = decontamination.leaks(docs, bench), decontamination.leaks(docs, bench, block_items=2)
    assert one.inputFiles() and not set(one.inputFiles()) & set(docs.inputFiles())
    assert set(several.inputFiles()) == set(docs.inputFiles())
    found = sorted(map(tuple, one.collect()))
    assert found == sorted(map(tuple, several.collect()))
    assert {(i, i) for i in range(6)} | {(9, 0), (10, 1)} | {(11, i) for i in range(3)} <= {f[:2] for f in found}


def test_numbers_of_words(spark):
    docs = spark.createDataFrame([(1, "B a, c A"), (2, ""), (None, "a a")], "doc_id long, text string")
    coded = decontamination.coded_words(docs, {"a": 0, "b": 1})
    rows = {r.doc_id: np.frombuffer(r.words, np.int32).tolist() for r in coded.collect()}
    assert rows == {1: [1, 0, -1, 0], 2: [], None: [0, 0]}
    assert decontamination.term_frequencies(coded, {"a": 0, "b": 1}) == {"a": 2, "b": 1}
