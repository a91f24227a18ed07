"""Sentence-level measures over a token table (T operators).

Every measure is one conditional aggregate on (ut, sent_id). Spark combines
partial results before the shuffle, and the key is a sentence, so a document
that holds a large share of all tokens is still spread over the cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancepanel.functions import fixed_values as fixed
from stancepanel.functions.scalars import ends_with_any, flag
from stancepanel.sources.lexicon import stance_by_upos

SENTENCE = ["ut", "sent_id"]


def lemma(c: str = "lemma") -> Column:
    return F.lower(F.col(c))


def match_stance(tokens: DataFrame, lexicon: DataFrame, allowed: dict | None = None) -> DataFrame:
    """Tokens with `type` and `subtype` of the stance term they realise, else NULL."""
    terms = stance_by_upos(lexicon, allowed).withColumnsRenamed({"term": "_term", "upos": "_upos"})
    return tokens.join(terms, (lemma() == F.col("_term")) & (F.col("upos") == F.col("_upos")),
                       "left").drop("_term", "_upos")


def stance_counts() -> dict[str, Column]:
    """Aggregates over the output of `match_stance`."""
    hedge, booster = F.col("type") == "hedge", F.col("type") == "booster"
    return {
        "n_words": F.count_if(F.col("upos") != "PUNCT"),
        "n_hedge_core": F.count_if(hedge & (F.col("subtype") != "approximator")),
        "n_hedge_all": F.count_if(hedge),
        "n_booster_core": F.count_if(booster & (F.col("subtype") == "emphatic")),
        "n_booster_all": F.count_if(booster),
    }


def sentence_counts(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words, hedges and boosters per sentence."""
    return match_stance(tokens, lexicon).groupBy(*SENTENCE).agg(
        F.max("year").alias("year"), *[c.alias(n) for n, c in stance_counts().items()])


def feature_conditions(modals=fixed.FEATURE_MODALS, negations=fixed.FEATURE_NEGATIONS,
                       first_person=fixed.FEATURE_FIRST_PERSON,
                       suffixes=fixed.FEATURE_NOMINAL_SUFFIXES) -> dict[str, Column]:
    upos, deprel, feats = F.col("upos"), F.col("deprel"), F.col("feats")
    hedge, approximator = F.col("type") == "hedge", F.col("subtype") == "approximator"
    return {
        "n_tokens": upos != "PUNCT",
        "n_hedge": hedge & ~approximator,
        "n_approximator": hedge & approximator,
        "n_booster": F.col("type") == "booster",
        "n_modal": (upos == "AUX") & lemma().isin(modals),
        "n_negation": (deprel == "advmod") & lemma().isin(negations),
        "n_passive": deprel == fixed.PASSIVE_SUBJECT,
        "n_agent_phrase": deprel == fixed.AGENT,
        "n_nominalisation": (upos == "NOUN") & ends_with_any(lemma(), suffixes),
        "n_number": upos == "NUM",
        "n_propn": upos == "PROPN",
        "n_adjective": upos == "ADJ",
        "n_adverb": upos == "ADV",
        "n_verb": upos == "VERB",
        "n_subordinator": upos == "SCONJ",
        "n_first_person": F.lower("text").isin(first_person),
        "n_past_tense": feats.contains("Tense=Past"),
        "n_present_tense": feats.contains("Tense=Pres"),
        "n_comparative": feats.contains("Degree=Cmp") | feats.contains("Degree=Sup"),
        "n_subclause": deprel.isin(fixed.SUBCLAUSE_RELATIONS),
    }


def sentence_features(tokens: DataFrame, lexicon: DataFrame, **word_lists) -> DataFrame:
    """Twenty linguistic counts per sentence."""
    return match_stance(tokens, lexicon).groupBy(*SENTENCE).agg(
        *[F.count_if(c).alias(n) for n, c in feature_conditions(**word_lists).items()])


def rule_condition(alternatives: list[dict[str, str]]) -> Column:
    """OR over alternatives, AND inside one; a value is a blank-separated word set."""
    def one(rule):
        return reduce(lambda a, b: a & b,
                      [(lemma() if c == "lemma" else F.col(c)).isin(fixed.words(w))
                       for c, w in rule.items()])
    return reduce(lambda a, b: a | b, [one(r) for r in alternatives])


def uncertainty_patterns(tokens: DataFrame, groups: dict | None = None,
                         confirmation: list | None = None,
                         prior_work: list | None = None) -> DataFrame:
    """T4/T5: twelve 0/1 pattern groups, two cues, group count and verdict per sentence."""
    groups = groups or fixed.UNCERTAINTY_GROUPS
    rules = {**groups, "confirmation_cue": confirmation or fixed.CONFIRMATION_CUE,
             "prior_work_reference": prior_work or fixed.PRIOR_WORK_CUE}
    found = tokens.groupBy(*SENTENCE).agg(
        *[F.max(flag(rule_condition(r))).alias(n) for n, r in rules.items()],
        F.count(F.lit(1)).alias("n_tokens"))
    total = reduce(lambda a, b: a + b, [F.col(g) for g in groups])
    return found.withColumn("n_groups_matched", total).withColumn(
        "is_su_expression",
        flag((F.col("n_groups_matched") > 0) & (F.col("confirmation_cue") == 0)))


def attach_sentence_flag(sentences: DataFrame, flagged: DataFrame,
                         name: str = "is_power_sentence") -> DataFrame:
    """1 where the sentence occurs in `flagged`, else 0."""
    marks = flagged.select(*SENTENCE).distinct().withColumn("_hit", F.lit(1))
    return (sentences.join(marks, SENTENCE, "left")
            .withColumn(name, F.coalesce("_hit", F.lit(0))).drop("_hit"))


def restrict_documents(tokens: DataFrame, documents: DataFrame, key: str = "ut",
                       spread: int = 16) -> DataFrame:
    """Tokens of the listed documents.

    A document's sentences meet `spread` copies of its entry, so a document
    that holds a large share of all tokens is not one task when the join
    shuffles and later steps keep its partitioning.
    """
    copies = documents.select(key).distinct().withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return (tokens.withColumn("_part", F.pmod(F.col("sent_id"), F.lit(spread)))
            .join(copies, [key, "_part"], "left_semi").drop("_part"))


def power_tokens(tokens: DataFrame, power: DataFrame) -> DataFrame:
    """Nouns and proper nouns whose lemma is a power term, with `in_strict_list`."""
    terms = power.select(F.col("term").alias("_term"), "in_strict_list")
    return (tokens.where(F.col("upos").isin("NOUN", "PROPN"))
            .join(terms, lemma() == F.col("_term")).drop("_term"))


def power_sentences(tokens: DataFrame, power: DataFrame) -> DataFrame:
    """Distinct sentences that contain a power term as a noun."""
    return power_tokens(tokens, power).select(*SENTENCE).distinct()


def sentence_text(tokens: DataFrame, sentences: DataFrame | None = None,
                  max_chars: int | None = None) -> DataFrame:
    """The sentence rebuilt from its tokens in order.

    The output value is the whole sentence, so gathering its tokens is inherent.
    """
    if sentences is not None:
        tokens = tokens.join(sentences.select(*SENTENCE).distinct(), SENTENCE, "left_semi")
    parts = F.array_sort(F.collect_list(F.struct("tok_id", "text")))
    text = F.array_join(F.transform(parts, lambda t: t["text"]), " ")
    if max_chars is not None:
        text = F.substring(text, 1, max_chars)
    return tokens.groupBy(*SENTENCE).agg(text.alias("sentence"))


def mean_by(scores: DataFrame, by: str, score: str, name: str | None = None) -> DataFrame:
    """Mean score and row count by flag or variant."""
    return scores.groupBy(by).agg(F.avg(score).alias(name or f"mean_{score}"),
                                  F.count(score).alias("n"))
