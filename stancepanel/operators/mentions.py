"""Country gazetteer and mention matching (M operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stancepanel.functions import fixed_values as fixed
from stancepanel.functions.scalars import first_word, flag, joined_span, n_name_parts, strip_article
from stancepanel.operators.sentence import SENTENCE
from stancepanel.sources.lexicon import small_table

POSITION = [*SENTENCE, "tok_id"]
BLOCK = 1024


def build_gazetteer(names: DataFrame, aliases: DataFrame, historical: DataFrame | None = None,
                    min_chars: int = 4, max_parts: int = 3) -> DataFrame:
    """M1: cleaned surface forms from names (iso3, name, demonym) and aliases (iso3, alias).

    Ambiguous words and forms shared by several countries are dropped. A form
    listed twice for one country keeps its first type: name, demonym, alias, historical.
    """
    spark = names.sparkSession
    if historical is None:
        iso3, form = zip(*fixed.HISTORICAL_FORMS)
        historical = small_table(spark, {"iso3": list(iso3), "surface_form": list(form)})

    def part(df, column, kind, rank):
        return df.select("iso3", F.col(column).alias("surface_form"), F.lit(kind).alias("form_type"),
                         F.lit(rank).alias("_rank")).where(F.col(column).isNotNull() & (F.col(column) != ""))

    forms = (part(names, "name", "name", 0).unionByName(part(names, "demonym", "demonym", 1))
             .unionByName(part(aliases, "alias", "alias", 2))
             .unionByName(part(historical, "surface_form", "historical", 3)))
    forms = (forms.withColumn("surface_form", strip_article("surface_form"))
             .withColumn("match_form", F.lower("surface_form"))
             .where(F.length("surface_form") >= min_chars)
             .where(~F.col("match_form").isin(fixed.words(fixed.AMBIGUOUS_FORMS))))
    # One pass: the first entry per country, and whether the form is shared.
    best = forms.groupBy("match_form", "iso3").agg(
        F.min(F.struct("_rank", "surface_form", "form_type")).alias("b"))
    shared = best.groupBy("match_form").agg(F.count(F.lit(1)).alias("n"),
                                            F.min(F.struct("iso3", "b")).alias("x"))
    return (shared.where(F.col("n") == 1)
            .select("x.iso3", "x.b.surface_form", "x.b.form_type", "match_form",
                    n_name_parts("match_form").alias("n_tokens"))
            .where(F.col("n_tokens") <= max_parts))


def candidate_spans(tokens: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """M2: one to three-word spans of adjacent proper nouns and adjectives.

    A span starts at a token whose word starts some form. Neighbours come from
    `lead` over blocks of token ids: the first two tokens of a block are also
    sent to the block before, so spans cross block borders and no window group
    exceeds the block size however long a sentence is.
    """
    word = (tokens.where(F.col("upos").isin("PROPN", "ADJ"))
            .select(*POSITION, F.lower("text").alias("word")))
    own = F.floor(F.col("tok_id") / BLOCK)
    blocks = F.when(F.col("tok_id") % BLOCK < 2, F.array(own, own - 1)).otherwise(F.array(own))
    word = word.withColumn("block", F.explode(blocks))
    w = Window.partitionBy(*SENTENCE, "block").orderBy("tok_id")
    nxt, after = F.lead(F.struct("tok_id", "word"), 1).over(w), F.lead(F.struct("tok_id", "word"), 2).over(w)
    seen = word.withColumns({"_n1": nxt, "_n2": after}).where(F.floor(F.col("tok_id") / BLOCK) == F.col("block"))

    def at(offset, *places):
        return F.coalesce(*[F.when(p["tok_id"] == F.col("tok_id") + offset, p["word"]) for p in places])

    w2, w3 = at(1, F.col("_n1")), at(2, F.col("_n1"), F.col("_n2"))
    starts = gazetteer.select(first_word("match_form").alias("word")).distinct()
    return seen.select(*POSITION, "word", F.col("word").alias("span_1"),
                       joined_span("word", w2).alias("span_2"),
                       joined_span("word", w2, w3).alias("span_3")).join(
        starts, "word", "left_semi").drop("word")


def country_mentions(tokens: DataFrame, gazetteer: DataFrame,
                     normalise_hyphens: bool = False) -> DataFrame:
    """M3: dictionary match of the span of a form's length; the longest form per start wins.

    Each length is looked up on its own, and the longest hit is a coalesce, so
    there is no ranking window. A shorter form starting one token later still
    counts. Forms with hyphens only match with `normalise_hyphens`.
    """
    form = F.col("match_form")
    forms = gazetteer.withColumn("match_form", F.regexp_replace(form, "-", " ") if normalise_hyphens else form)
    hit = candidate_spans(tokens, forms)
    for n in (3, 2, 1):
        same = F.col("n_tokens") == n if n < 3 else ~F.col("n_tokens").isin(1, 2)
        table = forms.where(same).groupBy(F.col("match_form").alias(f"span_{n}")).agg(
            F.min(F.struct("iso3", "form_type")).alias(f"hit_{n}"))
        hit = hit.join(table, f"span_{n}", "left")
    return (hit.withColumn("hit", F.coalesce("hit_3", "hit_2", "hit_1"))
            .where(F.col("hit").isNotNull()).select(*POSITION, "hit.iso3", "hit.form_type"))


def document_countries(mentions: DataFrame) -> DataFrame:
    """M4: mention counts per document and country, by any form and by name."""
    demonym = F.col("form_type") == "demonym"
    return mentions.groupBy("ut", "iso3").agg(
        F.count(F.lit(1)).alias("n_mentions"), F.count_if(~demonym).alias("n_name_mentions"),
        F.max(flag(demonym)).alias("by_demonym"))


def power_sentence_countries(arguments: DataFrame, mentions: DataFrame) -> DataFrame:
    """M5: countries named in a sentence that has a power clause."""
    return (mentions.select(*SENTENCE, F.col("iso3").alias("mentioned_iso3")).distinct()
            .join(arguments.select(*SENTENCE).distinct(), SENTENCE, "left_semi"))


def _own_and_any(documents: DataFrame, countries: DataFrame, own: str) -> DataFrame:
    """Per document: does a mention equal `own`, and is any country named at all?"""
    named = countries.select("ut", F.col("iso3").alias("_named")).distinct()
    home = documents.select("ut", F.col(own).alias("_named")).distinct()
    return named.join(home.withColumn("_is_own", F.lit(1)), ["ut", "_named"], "left").groupBy("ut").agg(
        F.max(F.coalesce("_is_own", F.lit(0))).alias("names_own"), F.lit(1).alias("names_any"))


def referent_class(documents: DataFrame, countries: DataFrame, own: str = "iso3") -> DataFrame:
    """M6: own country / foreign country only / no country named."""
    marks = _own_and_any(documents, countries, own)
    return documents.join(marks, "ut", "left").fillna(0, ["names_own", "names_any"]).withColumn(
        "referent", F.when(F.col("names_own") == 1, "own country")
        .when(F.col("names_any") == 1, "foreign country only").otherwise("no country named"))


def naming_measures(documents: DataFrame, countries: DataFrame, own: str = "iso3") -> DataFrame:
    """M7: names the own country, names it by name, number of countries named."""
    home = documents.select("ut", F.col(own).alias("iso3"), F.lit(1).alias("_own"))
    marks = countries.join(home, ["ut", "iso3"], "left").groupBy("ut").agg(
        F.max(F.coalesce("_own", F.lit(0))).alias("names_own_country"),
        F.max(flag((F.col("_own") == 1) & (F.col("n_name_mentions") > 0))).alias("names_own_country_by_name"),
        F.count(F.lit(1)).alias("n_countries_named"))
    return documents.join(marks, "ut", "left").fillna(
        0, ["names_own_country", "names_own_country_by_name", "n_countries_named"])


def power_side_flags(documents: DataFrame, power_countries: DataFrame, own: str = "iso3") -> DataFrame:
    """M8: power clause about the own country, and about a foreign one."""
    named = power_countries.select("ut", "mentioned_iso3").distinct()
    home = documents.select("ut", F.col(own).alias("_own"))
    same = F.col("mentioned_iso3") == F.col("_own")
    marks = named.join(home, "ut").groupBy("ut").agg(
        F.max(flag(same)).alias("has_domestic_power"), F.max(flag(~same)).alias("has_foreign_power"))
    return documents.join(marks, "ut", "left").fillna(0, ["has_domestic_power", "has_foreign_power"])


def writes_about_origin(papers: DataFrame, countries: DataFrame,
                        origin: str = "origin_iso3") -> DataFrame:
    """M9: 1 when the paper names its author's country of origin."""
    named = countries.select("ut", F.col("iso3").alias(origin)).distinct().withColumn(
        "writes_about_origin", F.lit(1))
    return papers.join(named, ["ut", origin], "left").fillna(0, ["writes_about_origin"])
