"""Vocabulary association with flagged documents (V operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancepanel.operators.sentence import lemma


def document_terms(tokens: DataFrame, upos, min_chars: int = 3) -> DataFrame:
    """Occurrences per (document, lemma) for some parts of speech."""
    return (tokens.where(F.col("upos").isin(upos) & (F.length("lemma") >= min_chars))
            .groupBy("ut", lemma().alias("lemma")).agg(F.count(F.lit(1)).alias("n")))


def frequent_terms(doc_terms: DataFrame, min_documents: int = 100) -> DataFrame:
    """V1: lemmas by document frequency; rows are already distinct per document."""
    return (doc_terms.groupBy("lemma").agg(F.count(F.lit(1)).alias("document_frequency"))
            .where(F.col("document_frequency") >= min_documents))


def kept_document_terms(doc_terms: DataFrame, min_documents: int = 100) -> DataFrame:
    """V2: document-term counts of the frequent lemmas."""
    return doc_terms.join(frequent_terms(doc_terms, min_documents).select("lemma"), "lemma", "left_semi")


def document_power_flag(doc_terms: DataFrame, arguments: DataFrame) -> DataFrame:
    """V3: power-clause count and flag for every document that has a counted term."""
    clauses = arguments.groupBy("ut").agg(F.count(F.lit(1)).alias("n_power_clauses"))
    return (doc_terms.select("ut").distinct().join(clauses, "ut", "left")
            .fillna(0, ["n_power_clauses"])
            .withColumn("has_power_clause", (F.col("n_power_clauses") > 0).cast("int")))


def exclude_terms(doc_terms: DataFrame, terms: DataFrame) -> DataFrame:
    """Drop listed lemmas (the nouns that define the flag must not score it)."""
    return doc_terms.join(terms.select(F.lower("term").alias("lemma")), "lemma", "left_anti")


def term_association(doc_terms: DataFrame, flags: DataFrame, name: str = "power_proximity",
                     flag_column: str = "has_power_clause", min_documents: int = 1) -> DataFrame:
    """V4: smoothed base-10 log-odds of a term in flagged against other documents.

    One aggregation by lemma gives the document frequency, for the floor, and
    both counts; the frequent terms need not be found beforehand.
    """
    sizes = flags.agg(F.struct(F.sum(flag_column).alias("a"),
                               (F.count(F.lit(1)) - F.sum(flag_column)).alias("b")).alias("s")).scalar()
    a, b = F.col("in_power_documents"), F.col("in_other_documents")
    counts = doc_terms.join(flags.select("ut", flag_column), "ut", "left").groupBy("lemma").agg(
        F.count(F.lit(1)).alias("_df"), F.count_if(F.col(flag_column) == 1).alias("in_power_documents"),
        F.count_if(F.col(flag_column) == 0).alias("in_other_documents"))
    odds = (F.log10((a + 0.5) / (sizes["a"] - a + 0.5)) - F.log10((b + 0.5) / (sizes["b"] - b + 0.5)))
    return counts.where((F.col("_df") >= min_documents) & (a + b > 0)).drop("_df").withColumn(name, odds)


def document_score(doc_terms: DataFrame, scores: DataFrame, score: str = "power_proximity",
                   name: str = "power_proximity_score", size: str = "n_noun_tokens") -> DataFrame:
    """V5: count-weighted mean of the term scores of a document."""
    return doc_terms.join(scores.select("lemma", score), "lemma").groupBy("ut").agg(
        (F.sum(F.col("n") * F.col(score)) / F.sum("n")).alias(name), F.sum("n").alias(size))


def extreme_terms(scores: DataFrame, k: int, score: str = "power_proximity", floor: int = 1,
                  support: str = "in_power_documents", highest: bool = True) -> DataFrame:
    """V6: k best or worst terms with enough support (ties by lemma)."""
    order = F.col(score).desc() if highest else F.col(score).asc()
    return scores.where(F.col(support) >= floor).orderBy(order, "lemma").limit(k)
