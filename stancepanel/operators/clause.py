"""Clause and dependency-tree measures (C operators).

Most questions about a predicate are questions about a tree node and its
children. `tree_nodes` answers them with one aggregation: each token reports
once for itself (at its own id) and once to its parent (at `head`), and the
reports meet under the key (ut, sent_id, node). That replaces a chain of
self-joins, and its key is so fine that no document or sentence can make a
partition hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stancepanel.functions import fixed_values as fixed
from stancepanel.functions.scalars import ends_with_any, flag, is_capitalised, zero_if_missing
from stancepanel.operators.sentence import (
    SENTENCE, lemma, match_stance, power_tokens, restrict_documents,
)
from stancepanel.sources.tables import more_partitions

NODE = [*SENTENCE, "node"]
DEFINITIONS = {
    "sentence_keyword": "power_sentence_keyword",
    "sentence_outside_agent_phrase": "power_sentence_outside_agent",
    "predicate_argument": "power_predicate_argument",
}


def tree_nodes(tokens: DataFrame, own: dict[str, Column], child: dict[str, Column]) -> DataFrame:
    """One row per tree node: maxima of its own values and of its children's values."""
    names = [*own, *child]
    typed = tokens.select(*SENTENCE, "tok_id", "head",
                          *[c.alias(n) for n, c in {**own, **child}.items()])

    def report(node, filled):
        return F.struct(F.col(node).alias("node"), *[
            (F.col(n) if n in filled else F.lit(None).cast(typed.schema[n].dataType)).alias(n)
            for n in names])

    reports = typed.select(*SENTENCE, F.explode(F.array(report("tok_id", own),
                                                        report("head", child))).alias("r"))
    # A report without content would only widen the shuffle.
    has_content = reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names])
    reports = reports.select(*SENTENCE, "r.*").where(has_content)
    return more_partitions(reports, *NODE).groupBy(*NODE).agg(*[F.max(n).alias(n) for n in names])


def _only(condition: Column, value: Column | None = None) -> Column:
    return F.when(condition, F.lit(1) if value is None else value)


def passive_clauses(tokens: DataFrame) -> DataFrame:
    """Distinct predicates that have a passive subject."""
    return (tokens.where(F.col("deprel") == fixed.PASSIVE_SUBJECT)
            .select(*SENTENCE, F.col("head").alias("predicate_id")).distinct())


def expressed_agents(tokens: DataFrame) -> DataFrame:
    """Agent tokens and the predicate they attach to."""
    return (tokens.where(F.col("deprel") == fixed.AGENT)
            .select(*SENTENCE, "tok_id", F.col("head").alias("predicate_id")))


def power_mentions(tokens: DataFrame, power: DataFrame) -> DataFrame:
    """Power tokens, flagged when they are an agent or hang directly on one."""
    agents = expressed_agents(tokens).select(*SENTENCE, F.col("tok_id").alias("head"),
                                             F.lit(1).alias("_agent"))
    hits = power_tokens(tokens, power).select(*SENTENCE, "tok_id", "head", "deprel",
                                              "in_strict_list")
    inside = (F.col("deprel") == fixed.AGENT) | F.col("_agent").isNotNull()
    return (hits.join(agents, [*SENTENCE, "head"], "left")
            .withColumn("inside_agent_phrase", flag(inside)).drop("_agent"))


def _power_lookup(tokens: DataFrame, power: DataFrame) -> DataFrame:
    """Tokens with `_strict` filled for nouns that are power terms."""
    terms = power.select(F.col("term").alias("_p"), F.col("in_strict_list").alias("_strict"))
    noun = F.col("upos").isin("NOUN", "PROPN")
    return tokens.join(terms, (lemma() == F.col("_p")) & noun, "left").drop("_p")


def _agent_own() -> dict[str, Column]:
    return {"is_agent": _only(F.col("deprel") == fixed.AGENT)}


def _power_child() -> dict[str, Column]:
    return {"any_power": F.col("_strict"),
            "free_power": _only(F.col("deprel") != fixed.AGENT, F.col("_strict"))}


def _passive_child() -> dict[str, Column]:
    return {"passive": _only(F.col("deprel") == fixed.PASSIVE_SUBJECT),
            "agent": _only(F.col("deprel") == fixed.AGENT)}


def _power_nodes(tokens: DataFrame, power: DataFrame) -> DataFrame:
    """Nodes with power children or that are agents; few tokens take part."""
    t = _power_lookup(tokens, power).where((F.col("deprel") == fixed.AGENT) | F.col("_strict").isNotNull())
    return tree_nodes(t, own=_agent_own(), child=_power_child())


def _passive_nodes(tokens: DataFrame, power: DataFrame) -> DataFrame:
    """Nodes with passive, agent or power children."""
    t = _power_lookup(tokens, power).where(
        F.col("deprel").isin(fixed.PASSIVE_SUBJECT, fixed.AGENT) | F.col("_strict").isNotNull())
    return tree_nodes(t, own=_agent_own(), child={**_passive_child(), **_power_child()})


def _clause_nodes(tokens: DataFrame, power: DataFrame, methods: DataFrame) -> DataFrame:
    """Nodes with passive, agent or power children, and the lemma of verbs."""
    verb = F.col("upos").isin("VERB", "AUX")
    verbs = methods.select(F.col("term").alias("_m")).distinct()
    t = (_power_lookup(tokens, power)
         .where(F.col("deprel").isin(fixed.PASSIVE_SUBJECT, fixed.AGENT) | verb | F.col("_strict").isNotNull())
         .join(verbs, (lemma() == F.col("_m")) & verb, "left"))
    own = {**_agent_own(), "predicate_lemma": _only(verb, lemma()),
           "methods": _only(verb, flag(F.col("_m").isNotNull()))}
    return tree_nodes(t, own=own, child={**_passive_child(), **_power_child()})


def _outside(strict: str) -> Column:
    """Strictness of a power child that is outside any agent phrase, else NULL."""
    return F.when(F.col("is_agent").isNull(), F.col(strict))


def _power_flags(nodes: DataFrame) -> DataFrame:
    outside = _outside("free_power")
    return nodes.where(F.col("any_power").isNotNull()).groupBy(*SENTENCE).agg(
        F.lit(1).alias("has_power_lemma"),
        F.max("any_power").alias("has_power_lemma_strict"),
        F.max(flag(outside.isNotNull())).alias("has_power_lemma_outside_agent"),
        F.max(zero_if_missing(outside)).alias("has_power_lemma_outside_agent_strict"))


def power_sentence_flags(tokens: DataFrame, power: DataFrame) -> DataFrame:
    """C4: per sentence with a power term: strict, outside an agent phrase, both."""
    return _power_flags(_power_nodes(tokens, power))


def power_predicates(tokens: DataFrame, power: DataFrame) -> DataFrame:
    """Passive predicates with a power term as direct, non-agent argument."""
    nodes = _passive_nodes(tokens, power)
    argument = _outside("free_power")
    return (nodes.where(F.col("passive").isNotNull() & argument.isNotNull())
            .select(*SENTENCE, F.col("node").alias("predicate_id"),
                    F.lit(1).alias("power_is_predicate_argument"),
                    argument.alias("power_is_predicate_argument_strict")))


def predicate_lemmas(tokens: DataFrame, methods: DataFrame) -> DataFrame:
    """Verbs and auxiliaries with a methods-verb flag."""
    terms = methods.select(F.col("term").alias("_m")).distinct()
    return (tokens.where(F.col("upos").isin("VERB", "AUX"))
            .join(terms, lemma() == F.col("_m"), "left")
            .select(*SENTENCE, F.col("tok_id").alias("predicate_id"),
                    lemma().alias("predicate_lemma"),
                    flag(F.col("_m").isNotNull()).alias("predicate_is_methods_verb")))


def clause_table(tokens: DataFrame, power: DataFrame, methods: DataFrame) -> DataFrame:
    """One row per passive clause with agent, power and methods flags."""
    nodes = _clause_nodes(tokens, power, methods)
    argument = _outside("free_power")
    clauses = nodes.where(F.col("passive").isNotNull()).select(
        *SENTENCE, F.col("node").alias("predicate_id"),
        flag(F.col("agent").isNotNull()).alias("agent_expressed"),
        flag(argument.isNotNull()).alias("power_predicate_argument"),
        zero_if_missing(argument).alias("power_predicate_argument_strict"),
        zero_if_missing("methods").alias("predicate_is_methods_verb"), "predicate_lemma")
    renamed = {"has_power_lemma": "power_sentence_keyword",
               "has_power_lemma_strict": "power_sentence_keyword_strict",
               "has_power_lemma_outside_agent": "power_sentence_outside_agent",
               "has_power_lemma_outside_agent_strict": "power_sentence_outside_agent_strict"}
    flags = power_sentence_flags(tokens, power).withColumnsRenamed(renamed)
    return clauses.join(flags, SENTENCE, "left").fillna(0, list(renamed.values()))


def power_arguments(tokens: DataFrame, power: DataFrame,
                    relations=fixed.ARGUMENT_RELATIONS) -> DataFrame:
    """Predicates of any kind with a power term as argument (agents excluded)."""
    return (power_tokens(tokens, power).where(F.col("deprel").isin(relations))
            .groupBy(*SENTENCE, F.col("head").alias("predicate_id"))
            .agg(F.max("in_strict_list").alias("in_strict_list")))


def power_clause_documents(arguments: DataFrame) -> DataFrame:
    """Documents with at least one power clause."""
    return arguments.select("ut").distinct()


def is_nominalisation(suffixes=fixed.NOMINALISATION_SUFFIXES) -> Column:
    return ((F.col("upos") == "NOUN") & ends_with_any(lemma(), suffixes)
            & (F.length(lemma()) > 5))


def nominalisations(tokens: DataFrame) -> DataFrame:
    """Nouns made from verbs, with a gerund flag."""
    return tokens.where(is_nominalisation()).select(
        *SENTENCE, "tok_id", F.col("head").alias("predicate_id"),
        flag(lemma().endswith("ing")).alias("is_gerund"))


def actor_modified(tokens: DataFrame) -> DataFrame:
    """C11: heads of a possessive or compound noun."""
    return (tokens.where(F.col("upos").isin("NOUN", "PROPN")
                         & F.col("deprel").isin(fixed.ACTOR_RELATIONS))
            .select(*SENTENCE, F.col("head").alias("tok_id")).distinct())


def nominalisation_table(tokens: DataFrame, power: DataFrame, methods: DataFrame) -> DataFrame:
    """Nominalisations in documents with a power clause, with actor, clause and methods flags.

    One tree aggregation over nominalisations and actor modifiers gives the
    actor flag. Power clauses and methods verbs meet under their token id, and
    a nominalisation looks its head up there.
    """
    arguments = power_arguments(tokens, power)
    actor = F.col("upos").isin("NOUN", "PROPN") & F.col("deprel").isin(fixed.ACTOR_RELATIONS)
    nouns = restrict_documents(tokens.where(is_nominalisation() | actor), arguments)
    nominal = tree_nodes(
        nouns,
        own={"is_gerund": _only(is_nominalisation(), flag(lemma().endswith("ing"))),
             "predicate_id": _only(is_nominalisation(), F.col("head"))},
        child={"actor": _only(actor)}).where(F.col("is_gerund").isNotNull())
    verbs = predicate_lemmas(tokens.where(F.col("upos") == "VERB"), methods).where(
        "predicate_is_methods_verb = 1").select(*SENTENCE, "predicate_id", F.lit(1).alias("is_methods_predicate"))
    clauses = arguments.select(*SENTENCE, "predicate_id", F.lit(1).alias("in_power_clause"))
    heads = clauses.unionByName(verbs, allowMissingColumns=True).groupBy(*SENTENCE, "predicate_id").agg(
        F.max("in_power_clause").alias("in_power_clause"),
        F.max("is_methods_predicate").alias("is_methods_predicate"))
    return (nominal.select(*SENTENCE, F.col("node").alias("tok_id"), "predicate_id", "is_gerund",
                           flag(F.col("actor").isNotNull()).alias("actor_expressed"))
            .join(heads, [*SENTENCE, "predicate_id"], "left")
            .fillna(0, ["in_power_clause", "is_methods_predicate"]))


def is_clause_head() -> Column:
    return F.col("deprel").isin(fixed.CLAUSE_RELATIONS) | (
        (F.col("deprel") == "conj") & F.col("upos").isin("VERB", "AUX"))


#: Stands for a null id.
NO_ID = np.iinfo(np.int64).min


def _same_sentence(rows: pa.RecordBatch) -> np.ndarray:
    """Whether each row but the first is of the sentence of the row before it. A null key is of no sentence."""
    pairs = [pc.equal(rows.column(c).slice(1), rows.column(c).slice(0, rows.num_rows - 1)) for c in SENTENCE]
    return pc.fill_null(pc.and_(*pairs), False).to_numpy(zero_copy_only=False)


def _walked(rows: pa.RecordBatch, max_hops: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and the clausal heads they reach, for whole sentences sorted by (ut, sent_id, tok_id).

    As in a join, a row goes on once for each row that has its parent's id, and null ids and keys meet nothing.
    """
    tok, head = (pc.fill_null(rows.column(c).cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)
                 for c in ("tok_id", "head"))
    is_head = pc.fill_null(rows.column("is_head"), False).to_numpy(zero_copy_only=False)
    known = pc.and_(*(rows.column(c).is_valid() for c in SENTENCE)).to_numpy(zero_copy_only=False)
    sentence = np.r_[0, np.cumsum(~_same_sentence(rows))]
    parents = np.flatnonzero(known & (tok != NO_ID))
    if "token_row" in rows.schema.names:
        parents = parents[np.sort(np.unique(rows.column("token_row").to_numpy()[parents], return_index=True)[1])]
    ids = np.unique(np.r_[tok[parents], 0])
    keys = sentence[parents] * len(ids) + np.searchsorted(ids, tok[parents])
    repeated = bool((keys[1:] == keys[:-1]).any())
    row, at, found = np.arange(len(tok)), head, np.where(is_head, tok, NO_ID)
    out = []
    for _ in range(max_hops):
        if not repeated:  # who has arrived would only be joined to one parent more
            there = found != NO_ID
            out.append((row[there], found[there]))
            row, at, found = row[~there], at[~there], found[~there]
        place = np.minimum(np.searchsorted(ids, at), len(ids) - 1)
        key = np.where(known[row] & (ids[place] == at), sentence[row] * len(ids) + place, -1)
        first = np.searchsorted(keys, key)
        many = np.searchsorted(keys, key, side="right") - first
        times = np.maximum(many, 1) if repeated else many
        of = np.repeat(np.arange(len(row)), times)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        row, at, found, met = row[of], at[of], found[of], many[of] > 0
        parent = np.full(len(of), -1)
        parent[met] = parents[(first[of] + nth)[met]]
        found = np.where((found == NO_ID) & met & is_head[parent], at, found)
        at = np.where(met, head[parent], NO_ID)
    there = found != NO_ID
    out.append((row[there], found[there]))
    return np.concatenate([r for r, _ in out]), np.concatenate([f for _, f in out])


def clause_heads(tokens: DataFrame, keep=(), max_hops: int = 3, token_row: str | None = None) -> DataFrame:
    """Each token with its nearest clausal head within `max_hops` parents.

    One shuffle deals narrow rows by sentence, and all hops are made in the sorted partition. A task holds the ids of
    one sentence and a batch, some 40 bytes a token, so sentences are bounded by their text, which is one value anyway.
    `token_row` names a column that is the same in rows made from one token; such rows are one parent.
    """
    slim = tokens.select(*SENTENCE, "tok_id", "head", is_clause_head().alias("is_head"), *keep,
                         *([] if token_row is None else [F.col(token_row).alias("token_row")]))
    reached = slim.select(*SENTENCE, "tok_id", *keep, F.coalesce("tok_id", "head").alias("clause_head_id")).schema
    kind = "long" if reached["clause_head_id"].dataType.simpleString() == "bigint" else "int"

    def heads(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(rows).combine_chunks().to_batches(max_chunksize=None)[0]
        row, found = _walked(whole, max_hops)
        table = pa.Table.from_batches([whole]).select([*SENTENCE, "tok_id", *keep]).take(pa.array(row))
        yield from table.append_column("clause_head_id", pa.array(found, pa.int64() if kind == "long" else pa.int32())
                                       ).to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of a sentence that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.flatnonzero(~_same_sentence(batch)) + 1
            last = int(starts[-1]) if len(starts) else 0
            edge = held and pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])
            if held and (last or not _same_sentence(edge)[0]):
                yield from heads([*held, batch.slice(0, last)])
                held = []
            elif last:
                yield from heads([batch.slice(0, last)])
            held.append(batch.slice(last))
        if held:
            yield from heads(held)

    dealt = slim.repartition(*SENTENCE).sortWithinPartitions(*SENTENCE, "tok_id")
    return dealt.mapInArrow(run, reached)


CLAUSE_STANCE_UPOS = {s: fixed.STANCE_UPOS[s]
                      for s in ("modal", "epistemic_verb", "epistemic_adjadv", "emphatic")}


def _stance_flags(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    hits = match_stance(tokens, lexicon, CLAUSE_STANCE_UPOS)
    return hits.withColumns({
        "is_word": flag(F.col("upos") != "PUNCT"),
        "is_hedge": flag((F.col("type") == "hedge") & (F.col("subtype") != "approximator")),
        "is_booster": flag((F.col("type") == "booster") & (F.col("subtype") == "emphatic"))})


def clause_words(tokens: DataFrame, lexicon: DataFrame, **walk) -> DataFrame:
    """C14: words, hedges and boosters per clause head."""
    numbered = tokens.withColumn("token_row", F.monotonically_increasing_id())  # a term may be listed twice
    walked = clause_heads(_stance_flags(numbered, lexicon), ["is_word", "is_hedge", "is_booster"],
                          token_row="token_row", **walk)
    return walked.groupBy(*SENTENCE, "clause_head_id").agg(
        F.sum("is_word").alias("n_words"), F.sum("is_hedge").alias("n_hedge_core"),
        F.sum("is_booster").alias("n_booster_core"))


def document_clause_hedging(tokens: DataFrame, power: DataFrame, lexicon: DataFrame,
                            **walk) -> DataFrame:
    """Clause totals per document, power clauses apart from the others.

    Clause counts and power marks meet in one aggregation on the clause key. Documents without a power clause go when
    only a row for each document and side is left: a mark always makes one of the power side.
    """
    counts = ("n_words", "n_hedge_core", "n_booster_core")
    clauses = (clause_words(tokens, lexicon, **walk).where(F.col("ut").isNotNull() & F.col("sent_id").isNotNull())
               .withColumn("is_power", F.lit(None).cast("int")))
    marks = power_arguments(tokens, power).select(
        *SENTENCE, F.col("predicate_id").alias("clause_head_id"), F.lit(1).alias("is_power"))
    merged = clauses.unionByName(marks, allowMissingColumns=True).groupBy(
        *SENTENCE, "clause_head_id").agg(*[F.sum(c).alias(c) for c in counts], F.max("is_power").alias("is_power"))
    sides = merged.groupBy("ut", zero_if_missing("is_power").alias("in_power_clause")).agg(
        F.count("n_words").alias("n_clauses"), *[F.sum(c).alias(c) for c in counts])
    marked = F.max("in_power_clause").over(Window.partitionBy("ut")) == 1
    return (sides.withColumn("_marked", marked)
            .where(F.col("_marked") & (F.col("n_clauses") > 0) & F.col("ut").isNotNull()).drop("_marked"))


def agency_slots(tokens: DataFrame, power: DataFrame) -> DataFrame:
    """Grammatical slots that power terms fill, per document."""
    deprel = F.col("deprel")
    slots = {
        "n_active_subject": deprel == "nsubj", "n_passive_subject": deprel == fixed.PASSIVE_SUBJECT,
        "n_object": deprel.isin("obj", "iobj"), "n_oblique": deprel == "obl",
        "n_expressed_agent": deprel == fixed.AGENT}
    return (power_tokens(tokens, power).where(deprel.isin(*fixed.ARGUMENT_RELATIONS, fixed.AGENT))
            .groupBy("ut").agg(F.count(F.lit(1)).alias("n_power_arguments"),
                               *[F.count_if(c).alias(n) for n, c in slots.items()]))


def power_action_verbs(tokens: DataFrame, power: DataFrame) -> DataFrame:
    """C17: verbs by the number of power terms that are their active subject."""
    verb = F.col("upos") == "VERB"
    terms = power.select(F.col("term").alias("_p"))
    subject = (F.col("_p").isNotNull() & (F.col("deprel") == "nsubj")
               & F.col("upos").isin("NOUN", "PROPN"))
    t = tokens.join(terms, lemma() == F.col("_p"), "left").where(verb | subject)
    at_verb = t.select(*SENTENCE, F.explode(F.array(
        F.struct(F.when(verb, F.col("tok_id")).alias("node"), lemma().alias("verb"),
                 F.lit(0).alias("n")),
        F.struct(F.when(subject, F.col("head")).alias("node"), F.lit(None).cast("string").alias("verb"),
                 F.lit(1).alias("n")))).alias("r"))
    return (at_verb.select(*SENTENCE, "r.*").where(F.col("node").isNotNull())
            .groupBy(*NODE).agg(F.max("verb").alias("verb"), F.sum("n").alias("n"))
            .where(F.col("verb").isNotNull() & (F.col("n") > 0))
            .groupBy("verb").agg(F.sum("n").alias("n")))


def reference_levels(tokens: DataFrame, power: DataFrame, baseline: DataFrame) -> DataFrame:
    """Power and baseline mentions as named, modified or bare."""
    noun = F.col("upos").isin("NOUN", "PROPN")
    p = power.select(F.col("term").alias("_p"), F.col("in_strict_list").alias("_strict"))
    b = baseline.select(F.lower("term").alias("_b")).distinct()
    naming = (F.col("upos") == "PROPN") & F.col("deprel").isin(fixed.NAMING_RELATIONS)
    adjective = ((F.col("upos") == "ADJ") & (F.col("deprel") == "amod")
                 & is_capitalised("text"))
    mention = F.coalesce("_p", "_b").isNotNull()
    t = (tokens.join(p, (lemma() == F.col("_p")) & noun, "left")
         .join(b, (lemma() == F.col("_b")) & noun, "left")
         .where(mention | naming | adjective))
    nodes = tree_nodes(
        t,
        own={"mention_class": F.when(F.col("_p").isNotNull(), "power").when(
                F.col("_b").isNotNull(), "baseline"),
             "in_strict_list": _only(mention, zero_if_missing("_strict")),
             "proper": _only(mention, flag(F.col("upos") == "PROPN"))},
        child={"named_by": _only(naming), "modified_by": _only(adjective)})
    level = (F.when((F.col("proper") == 1) | F.col("named_by").isNotNull(), "named")
             .when(F.col("modified_by").isNotNull(), "modified").otherwise("bare"))
    return nodes.where(F.col("mention_class").isNotNull()).select(
        *SENTENCE, F.col("node").alias("tok_id"), "mention_class", "in_strict_list",
        level.alias("reference_level"))


def document_specificity(mentions: DataFrame) -> DataFrame:
    """Mention counts per document by class and level."""
    power, base = F.col("mention_class") == "power", F.col("mention_class") == "baseline"
    named, bare = F.col("reference_level") == "named", F.col("reference_level") == "bare"
    strict = F.col("in_strict_list") == 1
    counts = {
        "n_power_mentions": power, "n_power_named": power & named, "n_power_bare": power & bare,
        "n_power_strict": power & strict, "n_power_strict_named": power & strict & named,
        "n_baseline_mentions": base, "n_baseline_named": base & named,
        "n_baseline_bare": base & bare}
    return mentions.groupBy("ut").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def sentence_profile(tokens: DataFrame, power: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Per sentence: words and stance, power flags, and passive clauses with their agents.

    Token counts and tree nodes meet in one aggregation on the sentence. All
    clauses of a sentence share its flags, so nothing has to be joined.
    """
    counts = {c: flag(x) for c, x in {
        "n_words": F.col("upos") != "PUNCT",
        "n_hedge_core": (F.col("type") == "hedge") & (F.col("subtype") != "approximator"),
        "n_booster_core": (F.col("type") == "booster") & (F.col("subtype") == "emphatic")}.items()}
    words = match_stance(tokens, lexicon).select(*SENTENCE, "year", *[c.alias(n) for n, c in counts.items()])
    outside = _outside("free_power")
    passive, agent = F.col("passive").isNotNull(), F.col("agent").isNotNull()
    clauses = {"n_passive": passive, "n_agent": passive & agent, "n_passive_pa": passive & outside.isNotNull(),
               "n_agent_pa": passive & agent & outside.isNotNull()}
    flags = {"has_power_lemma": F.col("any_power").isNotNull(), "has_power_lemma_strict": F.col("any_power") == 1,
             "has_power_lemma_outside_agent": outside.isNotNull()}
    nodes = _passive_nodes(tokens, power).select(
        *SENTENCE, *[flag(c).alias(n) for n, c in {**clauses, **flags}.items()])
    return words.unionByName(nodes, allowMissingColumns=True).groupBy(*SENTENCE).agg(
        F.max("year").alias("year"), *[F.sum(n).alias(n) for n in counts],
        *[F.sum(zero_if_missing(n)).alias(n) for n in clauses],
        *[F.max(zero_if_missing(n)).alias(n) for n in flags])


def document_contrast(tokens: DataFrame, power: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words, stance and passive clauses by side for each document.

    A document without passive clauses has NULL clause counts.
    """
    flags = {"kw": "has_power_lemma", "oa": "has_power_lemma_outside_agent"}
    sides = (("power", 1), ("other", 0))
    measures = {"words": "n_words", "hedge": "n_hedge_core", "booster": "n_booster_core"}

    def total(column, condition=None):
        return F.sum(F.col(column) if condition is None else F.when(condition, F.col(column)).otherwise(0))
    words = {"n_words_total": total("n_words")}
    passive = {}
    for tag, column in flags.items():
        for side, value in sides:
            on = F.col(column) == value
            words |= {f"n_{label}_{side}_{tag}": total(m, on) for label, m in measures.items()}
            passive |= {f"n_passive_{side}_{tag}": total("n_passive", on), f"n_agent_{side}_{tag}": total("n_agent", on)}
    for stem in ("passive", "agent"):
        passive[f"n_{stem}_power_pa"] = total(f"n_{stem}_pa")
        passive[f"n_{stem}_other_pa"] = total(f"n_{stem}") - total(f"n_{stem}_pa")
    any_clause = total("n_passive") > 0
    return sentence_profile(tokens, power, lexicon).groupBy("ut").agg(
        F.max("year").alias("year"), *[c.alias(n) for n, c in words.items()],
        *[F.when(any_clause, c).alias(n) for n, c in passive.items()])


def pooled_baseline(tokens: DataFrame, power: DataFrame, lexicon: DataFrame) -> DataFrame:
    """A3: pooled rates for each definition and side of it."""
    variants = {"sentence_keyword": "has_power_lemma",
                "sentence_outside_agent_phrase": "has_power_lemma_outside_agent",
                "sentence_keyword_strict": "has_power_lemma_strict"}
    rows = fan_out(sentence_profile(tokens, power, lexicon), variants)
    passive = F.sum("n_passive")
    return rows.groupBy("definition", "is_power_side").agg(
        F.count(F.lit(1)).alias("n_sentences"), passive.alias("n_passive_clauses"),
        (1 - F.try_divide(F.sum("n_agent"), passive)).alias("agent_deletion_rate"),
        F.try_divide(F.sum("n_hedge_core") * 1000.0, F.sum("n_words")).alias("hedges_per_1k_words"),
        F.try_divide(F.sum("n_booster_core") * 1000.0, F.sum("n_words")).alias("boosters_per_1k_words"))


def fan_out(df: DataFrame, variants: dict[str, str]) -> DataFrame:
    """A4: each row once per variant, with the side it falls on."""
    pairs = F.array(*[F.struct(F.lit(n).alias("definition"), F.col(c).alias("is_power_side"))
                      for n, c in variants.items()])
    return df.withColumn("_v", F.explode(pairs)).select(*df.columns, "_v.*")


def clause_variants(clauses: DataFrame) -> DataFrame:
    """A4: per document, clause counts for every definition x side x methods filter."""
    rows = fan_out(clauses, DEFINITIONS).withColumn(
        "exclude_methods_predicates", F.explode(F.array(F.lit(0), F.lit(1))))
    keep = (F.col("exclude_methods_predicates") == 0) | (F.col("predicate_is_methods_verb") == 0)
    return rows.where(keep).groupBy(
        "ut", "definition", "is_power_side", "exclude_methods_predicates").agg(
        F.count(F.lit(1)).alias("n_passive"), F.sum("agent_expressed").alias("n_agent_expressed"))


def methods_share(clauses: DataFrame) -> DataFrame:
    """A4: share of methods predicates for every definition and side."""
    n = F.sum("predicate_is_methods_verb")
    return fan_out(clauses, DEFINITIONS).groupBy("definition", "is_power_side").agg(
        n.alias("n_methods_predicate"), F.count(F.lit(1)).alias("n_passive"),
        (n * 100.0 / F.count(F.lit(1))).alias("pct_methods"))
