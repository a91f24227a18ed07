"""Hand-made sentences with known answers, and properties of the tree operators."""

import random

import pytest
from pyspark.sql import functions as F

from stancepanel.operators import clause as cl
from stancepanel.operators import contrast as ct
from stancepanel.operators import mentions as me
from stancepanel.operators import scoring
from stancepanel.operators import sentence as se
from stancepanel.operators import vocab as vo
from stancepanel.sources.lexicon import power_lexicon, small_table, stance_lexicon, term_list
from stancepanel.functions import fixed_values as fixed

COLUMNS = ("ut string, year int, field string, sent_id int, tok_id int, head int, text string, lemma string, "
           "upos string, deprel string, feats string")


def parse(spark, *sentences):
    """Sentences as lists of (lemma, upos, head, deprel[, text[, feats]]); the document is d<i>."""
    rows = []
    for i, s in enumerate(sentences):
        for k, tok in enumerate(s):
            lemma, upos, head, deprel, *rest = tok
            text = rest[0] if rest else lemma
            feats = rest[1] if len(rest) > 1 else None
            rows.append((f"d{i}", 2000, "abstract", 1, k + 1, head, text, lemma, upos, deprel, feats))
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def lists(spark):
    return (stance_lexicon(spark), power_lexicon(spark), term_list(spark, fixed.METHODS_PREDICATES),
            term_list(spark, fixed.BASELINE_ORGANISATIONS))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_lexicon_sizes(lists):
    stance, power, methods, baseline = lists
    assert stance.count() == 103 and power.count() == 35 and baseline.count() == 20
    assert power.where("in_strict_list = 1").count() == 25 and methods.count() == 78


def test_stance_needs_the_right_part_of_speech(spark, lists):
    t = parse(spark, [("may", "AUX", 2, "aux"), ("rise", "VERB", 0, "root"), ("may", "PROPN", 2, "obl"),
                      ("must", "AUX", 2, "aux"), ("about", "ADV", 2, "advmod"), ("Show", "VERB", 2, "conj"),
                      (".", "PUNCT", 2, "punct")])
    r = one(se.sentence_counts(t, lists[0]))
    assert (r["n_words"], r["n_hedge_core"], r["n_hedge_all"], r["n_booster_core"], r["n_booster_all"]) == (6, 1, 2, 0, 1)


@pytest.mark.parametrize("group,token", [
    ("explicit_su", ("unclear", "ADJ", 0, "root")), ("modality", ("can", "AUX", 0, "aux")),
    ("conditional", ("whether", "SCONJ", 0, "mark")), ("hypothesis", ("assumption", "NOUN", 0, "obj")),
    ("prediction", ("expect", "VERB", 0, "root")), ("interrogative", ("?", "PUNCT", 0, "punct")),
    ("non_generalisable", ("tentative", "ADJ", 0, "amod")), ("adverbial_su", ("arguably", "ADV", 0, "advmod")),
    ("negation", ("no", "DET", 0, "det")), ("subjectivity", ("view", "VERB", 0, "root")),
    ("conjectural", ("likely", "ADJ", 0, "amod")), ("disagreement", ("debate", "NOUN", 0, "obj"))])
def test_each_uncertainty_group_alone(spark, group, token):
    r = one(se.uncertainty_patterns(parse(spark, [token, ("thing", "NOUN", 1, "dep")])))
    assert [g for g in fixed.UNCERTAINTY_GROUPS if r[g]] == [group]
    assert r["n_groups_matched"] == 1 and r["is_su_expression"] == 1


def test_confirmation_cancels_the_verdict_only(spark):
    r = one(se.uncertainty_patterns(parse(spark, [("may", "AUX", 2, "aux"), ("clearly", "ADV", 1, "advmod")])))
    assert r["n_groups_matched"] == 1 and r["is_su_expression"] == 0 and r["confirmation_cue"] == 1


def test_negation_alternatives(spark):
    near = [("no", "INTJ", 0, "advmod"), ("not", "PART", 1, "det"), ("expect", "NOUN", 1, "obj")]
    assert one(se.uncertainty_patterns(parse(spark, near)))["n_groups_matched"] == 0


def test_features(spark, lists):
    t = parse(spark, [("we", "PRON", 2, "nsubj", "We"), ("show", "VERB", 0, "root", "showed", "Tense=Past|VerbForm=Fin"),
                      ("large", "ADJ", 4, "amod", "larger", "Degree=Cmp"), ("nation", "NOUN", 2, "obj"),
                      ("3", "NUM", 4, "nummod"), ("be", "AUX", 2, "ccomp", "are", "Tense=Pres"), (".", "PUNCT", 2, "punct")])
    r = one(se.sentence_features(t, lists[0]))
    assert {k: v for k, v in r.items() if k not in ("ut", "sent_id") and v} == {
        "n_tokens": 6, "n_booster": 1, "n_verb": 1, "n_first_person": 1, "n_past_tense": 1, "n_present_tense": 1,
        "n_comparative": 1, "n_adjective": 1, "n_nominalisation": 1, "n_number": 1, "n_subclause": 1}


def test_clause_table(spark, lists):
    agentless = [("government", "NOUN", 2, "nsubj:pass"), ("analyse", "VERB", 0, "root")]
    power_agent = [("law", "NOUN", 2, "nsubj:pass"), ("pass", "VERB", 0, "root"), ("state", "NOUN", 2, "obl:agent")]
    modifier = [("law", "NOUN", 2, "nsubj:pass"), ("pass", "VERB", 0, "root"), ("member", "NOUN", 2, "obl:agent"),
                ("parliament", "NOUN", 3, "nmod")]
    two_hops = [("law", "NOUN", 2, "nsubj:pass"), ("pass", "VERB", 0, "root"), ("member", "NOUN", 2, "obl:agent"),
                ("branch", "NOUN", 3, "nmod"), ("parliament", "NOUN", 4, "nmod")]
    twice = [("law", "NOUN", 2, "nsubj:pass"), ("pass", "VERB", 0, "root"), ("court", "NOUN", 4, "nsubj:pass"),
             ("close", "VERB", 2, "conj"), ("army", "NOUN", 2, "obl:agent")]
    got = {(r["ut"], r["predicate_id"]): r for r in cl.clause_table(
        parse(spark, agentless, power_agent, modifier, two_hops, twice), lists[1], lists[2]).collect()}
    assert len(got) == 6

    def view(key):
        r = got[key]
        return (r["agent_expressed"], r["power_sentence_keyword"], r["power_sentence_outside_agent"],
                r["power_predicate_argument"], r["predicate_is_methods_verb"])
    assert view(("d0", 2)) == (0, 1, 1, 1, 1)
    assert view(("d1", 2)) == (1, 1, 0, 0, 0) and got[("d1", 2)]["power_sentence_keyword_strict"] == 0
    assert view(("d2", 2)) == (1, 1, 0, 0, 0)
    assert view(("d3", 2)) == (1, 1, 1, 0, 0)
    assert view(("d4", 2)) == (1, 1, 1, 0, 0) and view(("d4", 4)) == (0, 1, 1, 1, 0)
    assert got[("d4", 4)]["predicate_lemma"] == "close"


def test_power_arguments(spark, lists):
    kinds = ["nsubj", "nsubj:pass", "obj", "iobj", "obl", "obl:agent", "nmod"]
    t = parse(spark, *[[("act", "VERB", 0, "root"), ("court", "NOUN", 1, k)] for k in kinds],
              [("act", "VERB", 0, "root"), ("court", "VERB", 1, "obj")])
    assert sorted(r["ut"] for r in cl.power_arguments(t, lists[1]).collect()) == ["d0", "d1", "d2", "d3", "d4"]


def test_nominalisations(spark, lists):
    t = parse(spark, [("court", "NOUN", 2, "nsubj"), ("use", "VERB", 0, "root"), ("state", "NOUN", 4, "nmod:poss"),
                      ("closure", "NOUN", 2, "obj"), ("union", "NOUN", 6, "compound"), ("meeting", "NOUN", 2, "obl"),
                      ("training", "NOUN", 1, "nmod"), ("thing", "NOUN", 2, "obl")],
              [("closure", "NOUN", 0, "root")])
    got = {r["tok_id"]: r for r in cl.nominalisation_table(t, lists[1], lists[2]).collect()}
    assert sorted(got) == [4, 6, 7]  # the document without a power clause is out, 5-letter words too

    def view(i):
        return tuple(got[i][c] for c in ("is_gerund", "actor_expressed", "in_power_clause", "is_methods_predicate"))
    assert view(4) == (0, 1, 1, 1) and view(6) == (1, 1, 1, 1) and view(7) == (1, 0, 0, 0)


def test_clause_walk_hops(spark):
    chain = [("a", "VERB", 0, "root"), ("b", "NOUN", 1, "obj"), ("c", "NOUN", 2, "nmod"), ("d", "NOUN", 3, "nmod"),
             ("e", "NOUN", 4, "nmod"), ("f", "NOUN", 1, "conj"), ("g", "VERB", 5, "conj"), ("h", "NOUN", 7, "obj")]
    got = {r["tok_id"]: r["clause_head_id"] for r in cl.clause_heads(parse(spark, chain)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 6: 1, 7: 7, 8: 7}


def test_clause_walk_equals_walk_by_dictionary(spark):
    rng = random.Random(3)
    sentences = []
    for size in [rng.randint(1, 40) for _ in range(30)] + [6000]:  # one sentence is very long
        sentences.append([(rng.choice("abc"), rng.choice(["VERB", "NOUN"]), 0 if k == 0 else rng.randint(0, size),
                           rng.choice(["root", "conj", "obj", "ccomp", "nmod", "nmod"])) for k in range(size)])
    t = parse(spark, *sentences)
    gaps = t.where("tok_id % 7 <> 0 OR ut > 'd2'")  # some sentences lose token ids
    for frame in (t, gaps):
        rows = {(r["ut"], r["sent_id"], r["tok_id"]): (r["head"], r["h"]) for r in
                frame.select("*", cl.is_clause_head().alias("h")).collect()}
        want = set()
        for ut, sent, tok in rows:
            at = tok
            for _ in range(4):
                head, is_head = rows.get((ut, sent, at), (None, False))
                if is_head:
                    want.add((ut, sent, tok, at))
                    break
                at = head
        got = [(r["ut"], r["sent_id"], r["tok_id"], r["clause_head_id"]) for r in cl.clause_heads(frame).collect()]
        assert len(got) == len(want) and set(got) == want


def test_clause_walk_shuffles_tokens_once(spark):
    t = parse(spark, [("a", "VERB", 0, "root"), ("b", "NOUN", 1, "obj")])
    text = cl.clause_heads(t)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_clause_walk_meets_repeated_and_null_ids_like_joins(spark, batch):
    rng = random.Random(5)
    rows = [(rng.choice(["u", "v", None]), rng.choice([0, 1, None]), rng.choice([1, 2, 3, 4, 5, None]),
             rng.choice([0, 1, 2, 3, 4, 9, None]), rng.choice(["VERB", "NOUN"]), rng.choice(["root", "conj", "nmod", "obj"]))
            for _ in range(80)]
    t = spark.createDataFrame(rows, "ut string, sent_id int, tok_id int, head int, upos string, deprel string")
    want = []
    for ut, sent, tok, head, upos, deprel in rows:
        def is_head(r):
            return r[5] == "root" or r[5] in fixed.CLAUSE_RELATIONS or (r[5] == "conj" and r[4] == "VERB")
        walk = [(head, tok if is_head((ut, sent, tok, head, upos, deprel)) else None)]
        for _ in range(3):
            step = []
            for at, found in walk:
                met = [r for r in rows if None not in (ut, sent, at) and r[:3] == (ut, sent, at)]
                step += [(r[3], at if found is None and is_head(r) else found) for r in met] or [(None, found)]
            walk = step
        want += [(ut, sent, tok, f) for _, f in walk if f is not None]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [tuple(r) for r in cl.clause_heads(t).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) > 40


def test_a_term_listed_twice_is_one_parent(spark):
    chain = [("may", "AUX", 0, "root"), ("b", "NOUN", 1, "obj"), ("c", "NOUN", 2, "nmod")]
    twice = spark.createDataFrame([("may", "hedge", "modal"), ("may", "booster", "modal")],
                                  "term string, type string, subtype string")
    got = cl.clause_words(parse(spark, chain), twice).collect()
    assert [(r["clause_head_id"], r["n_words"], r["n_hedge_core"]) for r in got] == [(1, 4, 1)]


def test_reference_levels(spark, lists):
    t = parse(spark, [("court", "NOUN", 3, "nsubj"), ("Supreme", "PROPN", 1, "compound"), ("rule", "VERB", 0, "root")],
              [("court", "NOUN", 3, "nsubj"), ("turkish", "ADJ", 1, "amod", "Turkish"), ("rule", "VERB", 0, "root")],
              [("court", "NOUN", 3, "nsubj"), ("high", "ADJ", 1, "amod"), ("rule", "VERB", 0, "root")],
              [("bank", "PROPN", 0, "root")],
              [("court", "NOUN", 0, "root"), ("turkish", "ADJ", 1, "amod", "Turkish"), ("X", "PROPN", 1, "flat")])
    got = {r["ut"]: (r["mention_class"], r["reference_level"], r["in_strict_list"]) for r in
           cl.reference_levels(t, lists[1], lists[3]).collect()}
    assert got == {"d0": ("power", "named", 1), "d1": ("power", "modified", 1), "d2": ("power", "bare", 1),
                   "d3": ("baseline", "named", 0), "d4": ("power", "named", 1)}


def test_term_on_both_lists_is_power(spark, lists):
    t = parse(spark, [("court", "NOUN", 0, "root")])
    both = term_list(spark, "court bank")
    assert one(cl.reference_levels(t, lists[1], both))["mention_class"] == "power"


def gazetteer(spark, forms):
    iso3, form, kind = zip(*forms)
    return small_table(spark, {"iso3": list(iso3), "match_form": list(form), "form_type": list(kind),
                               "n_tokens": [len(f.replace("-", " ").split()) for f in form]})


def test_longest_match_and_gaps(spark):
    g = gazetteer(spark, [("USA", "united states", "name"), ("XXX", "united", "alias"), ("YYY", "states", "alias"),
                          ("GNB", "guinea-bissau", "name")])
    near = [("United", "PROPN", 0, "root"), ("States", "PROPN", 1, "flat")]
    apart = [("United", "PROPN", 0, "root"), ("of", "ADP", 3, "case"), ("States", "PROPN", 1, "flat")]
    hyphen = [("Guinea", "PROPN", 0, "root"), ("Bissau", "PROPN", 1, "flat")]
    t = parse(spark, near, apart, hyphen)
    got = sorted((r["ut"], r["tok_id"], r["iso3"]) for r in me.country_mentions(t, g).collect())
    assert got == [("d0", 1, "USA"), ("d0", 2, "YYY"), ("d1", 1, "XXX"), ("d1", 3, "YYY")]
    got = [(r["ut"], r["iso3"]) for r in me.country_mentions(t, g, normalise_hyphens=True).collect()]
    assert ("d2", "GNB") in got


def test_spans_cross_block_borders(spark):
    g = gazetteer(spark, [("AAA", "x y z", "name")])
    n = me.BLOCK + 3
    words = [("w", "NOUN", 0, "dep")] * (n - 5) + [("x", "PROPN", 0, "dep"), ("y", "PROPN", 0, "dep"), ("z", "PROPN", 0, "dep")]
    for shift in range(5):
        t = parse(spark, words[shift:])
        assert [r["iso3"] for r in me.country_mentions(t, g).collect()] == ["AAA"]


def test_gazetteer_rules(spark):
    names = spark.createDataFrame([("AAA", "The Land", "Landish"), ("BBB", "Union", None), ("CCC", "Abc", ""),
                                   ("DDD", "Very Long Country Name", "Samish"), ("EEE", "Eland", "Samish")],
                                  "iso3 string, name string, demonym string")
    aliases = spark.createDataFrame([("AAA", "land"), ("EEE", "East-Eland")], "iso3 string, alias string")
    got = {(r["iso3"], r["match_form"], r["form_type"], r["n_tokens"]) for r in
           me.build_gazetteer(names, aliases, names.limit(0).select("iso3", names["name"].alias("surface_form"))).collect()}
    assert got == {("AAA", "land", "name", 1), ("AAA", "landish", "demonym", 1), ("EEE", "eland", "name", 1),
                   ("EEE", "east-eland", "alias", 2)}


def test_contrast_floors_and_symmetry(spark):
    df = spark.createDataFrame([(5, 100, 2, 0), (1, 19, 3, 20), (1, 20, 3, 20)],
                               "h_power int, w_power int, h_other int, w_other int")
    got = [r[0] for r in df.select(ct.rate_contrast("h", "w", floor=20)).collect()]
    assert got[:2] == [None, None] and abs(got[2] - (50 - 150)) < 1e-9
    back = df.select(ct.rate_contrast("h", "w", 20, names=("power", "other"))).collect()[2][0]
    assert abs(back + got[2]) < 1e-9
    ones = df.select(ct.deletion_contrast("h", "w")).collect()
    assert ones[0][0] is None and ones[1][0] is not None


def test_association_is_base_ten(spark):
    terms = spark.createDataFrame([(i, "w", 1) for i in range(3)] + [(9, "w", 2)], "ut int, lemma string, n int")
    flags = spark.createDataFrame([(i, int(i < 4)) for i in range(10)], "ut int, has_power_clause int")
    r = one(vo.term_association(terms, flags))
    import math
    want = math.log10(3.5 / 1.5) - math.log10(1.5 / 5.5)
    assert abs(r["power_proximity"] - want) < 1e-12


def test_scorer_runs_in_batches_and_fills_blanks(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(10)], "k int, sentence string")

    def factory():
        def score(texts):
            assert len(texts) <= 4
            return [float(len(t)) for t in texts]
        return score
    got = {r["k"]: r["certainty"] for r in scoring.score_sentences(df, factory, batch_size=4).collect()}
    assert got == {i: (0.0 if i == 3 else float(i)) for i in range(10)}


def test_fitted_scorer_tells_held_out_documents_apart(spark):
    from stancepanel.plans import fixture_parse, token_queries
    sf = "/root/testdata/sf0.01"
    texts = scoring.sentence_features(fixture_parse.tokens(spark, sf))
    weights = token_queries.fitted_weights(spark, sf)
    toks = fixture_parse.tokens(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("ut"), "quality")
    held = labels.where(token_queries.HELD_OUT.replace("VARCHAR", "STRING")).where("quality is not null")
    scored = scoring.score_sentences(se.sentence_text(toks.join(held, "ut", "left_semi")), scoring.hashed_scorer(weights))
    rows = scored.groupBy("ut").agg(F.avg("certainty").alias("s")).join(held, "ut").collect()
    good, bad = ([r["s"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(good) > 20 and len(bad) > 5
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    print("held-out AUC", auc)
    assert auc > 0.8
    assert texts.where("bucket <> 4096").groupBy("ut", "sent_id").agg(F.sum("x").alias("s")).where("abs(s - 1) > 1e-9").isEmpty()


def test_fitted_scorer_equals_dense_descent(spark):
    import hashlib

    import numpy as np
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    rows = [(d, s, t, words[rng.integers(0, 12) if d % 2 else rng.integers(0, 8)]) for d in range(20) for s in range(2)
            for t in range(int(rng.integers(1, 9)))]
    tokens = spark.createDataFrame(rows, "ut int, sent_id int, tok_id int, text string")
    labels = spark.createDataFrame([(d, None if d == 19 else d % 2) for d in range(20)], "ut int, q int")
    got = scoring.fit_hashed_scorer(tokens, labels, "q", bound=15, steps=5)
    keys = sorted({(d, s) for d, s, *_ in rows if d != 19}, key=lambda k: hashlib.md5(f"{k[0]}:{k[1]}".encode()).hexdigest())
    keys = [k for q in (0, 1) for k in [k for k in keys if k[0] % 2 == q][:15]]
    x = np.zeros((len(keys), scoring.BIAS + 1))
    x[:, scoring.BIAS] = 1
    for i, k in enumerate(keys):
        own = [w for d, s, _, w in rows if (d, s) == k]
        for w in own:
            x[i, int(hashlib.md5(w.encode()).hexdigest()[:3], 16)] += 1 / len(own)
    y = np.array([k[0] % 2 for k in keys], float)
    c = np.where(y == 1, 1 / y.sum(), 1 / (1 - y).sum())
    w, losses = np.zeros(scoring.BIAS + 1), []
    for _ in range(5):
        p = 1 / (1 + np.exp(-x @ w))
        losses.append(-(c * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + 1e-5 * (w @ w) / 2)
        w = w + ((c * (y - p)) @ x - 1e-5 * w) / ((c[:, None] * x).sum(0) / 2 + 1e-5)
    assert np.abs(got - w).max() < 1e-9 and losses == sorted(losses, reverse=True)


def test_fitted_scorer_without_labels(spark):
    tokens = spark.createDataFrame([(1, 1, 1, "a")], "ut int, sent_id int, tok_id int, text string")
    weights = scoring.fit_hashed_scorer(tokens, spark.createDataFrame([], "ut int, q int"), "q", steps=2)
    assert not weights.any()
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "k int, sentence string")
    assert {r["certainty"] for r in scoring.score_sentences(df, scoring.hashed_scorer(weights)).collect()} == {0.5}


def test_fitted_scorer_learns_from_every_labelled_sentence(spark):
    """A word of the last sentence by MD5 among 2,100 of its label has a weight, and each sentence counts once."""
    import hashlib
    last = max(range(1, 4200, 2), key=lambda d: hashlib.md5(f"{d}:0".encode()).hexdigest())
    tokens = spark.createDataFrame([(d, 0, 1, "odd" if d % 2 else "even") for d in range(4200)] + [(last, 0, 2, "rare")],
                                   "ut int, sent_id int, tok_id int, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(4200)], "ut int, q int")
    found = scoring.labelled_sentences(tokens, labels, "q").collect()
    assert len(found) == 4200 and {r["c"] for r in found} == {1 / 2100}
    weights = scoring.fit_hashed_scorer(tokens, labels, "q", steps=3)
    assert weights[int(hashlib.md5(b"rare").hexdigest()[:3], 16)] > 0


def test_mean_score_by_flag_is_fitted_on_whole_labelled_documents(spark, tmp_path):
    """Two labelled documents of 2,200 lines: a word of the line that comes last by MD5 has a weight; SQL agrees."""
    import hashlib

    import duckdb

    import __spark_entry__ as entry
    from stancepanel.plans import token_queries
    one, two = [i for i in range(1, 60) if i % 3 and hashlib.md5(str(i).encode()).hexdigest()[0] not in "012"][:2]
    last = max(range(2200), key=lambda k: hashlib.md5(f"{one}:{k}".encode()).hexdigest())
    texts = {one: "\n".join("rare words" if k == last else f"ther w{k % 7}" for k in range(2200)),
             two: "\n".join(f"thing v{k % 5}" for k in range(2200))}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(one, 1), (two, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    weights = token_queries.fitted_weights(spark, str(tmp_path))
    assert weights[int(hashlib.md5(b"rare").hexdigest()[:3], 16)] > 0
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = entry.queries()["t11_mean_score_by_flag"](spark, str(tmp_path)).collect()
    want = con.execute(entry.oracle_sql()["t11_mean_score_by_flag"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r["n"] for r in got) == 4400
