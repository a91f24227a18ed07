"""Deterministic pseudo-parse of the `documents` table, and lexicons that fit it.

The test prose is invented, so it has no real parse. These rules assign parts
of speech, heads and relations from word shape and position, identically in
Spark and in SQL. A head always precedes its token, so trees have no cycles.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stancepanel.plans.registry import cte, table
from stancepanel.sources.lexicon import power_lexicon, small_table, stance_lexicon, term_list
from stancepanel.sources.tables import read_tokens, scratch_folder, stage

# Words of any script, numbers, and any other sign by itself.
TOKEN_PATTERN = r"\p{L}+|\p{N}+|[^ \t\r\n\p{L}\p{N}]"

# Pseudo-parse rules, shared word for word by both engines.
UPOS = """CASE WHEN length(w) = 1 AND w < '\u00aa' AND NOT w BETWEEN 'a' AND 'z' AND NOT w BETWEEN '0' AND '9' THEN 'PUNCT'
  WHEN w >= '0' AND w < ':' THEN 'NUM'
  WHEN w IN ('the', 'a', 'this') THEN 'DET'
  WHEN w IN ('of', 'to', 'in', 'for', 'on', 'with', 'by', 'at', 'from') THEN 'ADP'
  WHEN w IN ('is', 'was', 'be', 'are') THEN 'AUX'
  WHEN w IN ('that', 'as') THEN 'SCONJ' WHEN w IN ('and', 'or') THEN 'CCONJ'
  WHEN w LIKE '%ly' THEN 'ADV' WHEN w LIKE '%ble' THEN 'ADJ' WHEN w LIKE '%ed' THEN 'VERB'
  WHEN n % 5 = 0 THEN 'PROPN' WHEN n % 5 = 1 THEN 'VERB' ELSE 'NOUN' END"""
HEAD = "CASE WHEN tok_id = 1 THEN 0 ELSE greatest(1, tok_id - 1 - (n % 3)) END"
DEPREL = """CASE WHEN tok_id = 1 THEN 'root'
  WHEN upos IN ('NOUN', 'PROPN') THEN CASE (tok_id + n) % 11 WHEN 0 THEN 'nsubj' WHEN 1 THEN 'nsubj:pass'
    WHEN 2 THEN 'obj' WHEN 3 THEN 'obl' WHEN 4 THEN 'obl:agent' WHEN 5 THEN 'compound' WHEN 6 THEN 'nmod'
    WHEN 7 THEN 'nmod:poss' WHEN 8 THEN 'iobj' WHEN 9 THEN 'flat' ELSE 'appos' END
  WHEN upos = 'VERB' THEN CASE (tok_id + n) % 6 WHEN 0 THEN 'advcl' WHEN 1 THEN 'ccomp' WHEN 2 THEN 'conj'
    WHEN 3 THEN 'acl:relcl' WHEN 4 THEN 'xcomp' ELSE 'dep' END
  WHEN upos = 'ADJ' THEN 'amod' WHEN upos = 'ADV' THEN 'advmod' WHEN upos = 'AUX' THEN 'aux'
  WHEN upos = 'ADP' THEN 'case' WHEN upos = 'SCONJ' THEN 'mark' WHEN upos = 'CCONJ' THEN 'cc'
  WHEN upos = 'NUM' THEN 'nummod' WHEN upos = 'PUNCT' THEN 'punct' ELSE 'det' END"""
FEATS = """CASE WHEN upos = 'VERB' AND w LIKE '%ed' THEN 'Tense=Past|VerbForm=Fin'
  WHEN upos = 'VERB' THEN 'Tense=Pres|VerbForm=Fin'
  WHEN upos IN ('ADJ', 'ADV') AND n % 4 = 0 THEN 'Degree=Cmp'
  WHEN upos IN ('ADJ', 'ADV') AND n % 4 = 1 THEN 'Degree=Sup' END"""
FIELD = "CASE WHEN sent_id = 0 AND ut % 3 = 0 THEN 'title' ELSE 'abstract' END"
YEAR = "CAST(1994 + ut % 9 AS INT)"


# The same rules for Spark, with a number for each part of speech and lists for what depends on a remainder. As spelled
# out above, a token is compared with a part of speech and with each remainder over and over, at three times the time.
TAGS = ["PUNCT", "NUM", "DET", "ADP", "AUX", "SCONJ", "CCONJ", "ADV", "ADJ", "VERB", "PROPN", "NOUN"]
TAG = {t: i for i, t in enumerate(TAGS)}
RELATIONS = ["punct", "nummod", "det", "case", "aux", "mark", "cc", "advmod", "amod", None, None, None]
VERB_RELATIONS = ["advcl", "ccomp", "conj", "acl:relcl", "xcomp", "dep"]
NOUN_RELATIONS = ["nsubj", "nsubj:pass", "obj", "obl", "obl:agent", "compound", "nmod", "nmod:poss", "iobj", "flat",
                  "appos"]
CLOSED = [("DET", "the a this"), ("ADP", "of to in for on with by at from"), ("AUX", "is was be are"),
          ("SCONJ", "that as"), ("CCONJ", "and or")]


def tag_number() -> Column:
    """Place in TAGS of the part of speech that UPOS gives for the lower-cased word `w` of `n` characters."""
    w, n = F.col("w"), F.col("n")

    def chosen(pairs, last):
        out = last
        for condition, tag in reversed(pairs):
            out = F.when(condition, F.lit(TAG[tag]) if isinstance(tag, str) else tag).otherwise(out)
        return out

    closed = chosen([(w.isin(words.split()), tag) for tag, words in CLOSED[:-1]], F.lit(TAG[CLOSED[-1][0]]))
    sign = (n == 1) & (w < "\u00aa") & ~w.between("a", "z") & ~w.between("0", "9")
    return chosen([(sign, "PUNCT"), ((w >= "0") & (w < ":"), "NUM"),
                   (w.isin(" ".join(words for _, words in CLOSED).split()), closed),
                   (w.endswith("ly"), "ADV"), (w.endswith("ble"), "ADJ"), (w.endswith("ed"), "VERB")],
                  F.when(n % 5 == 0, TAG["PROPN"]).when(n % 5 == 1, TAG["VERB"]).otherwise(TAG["NOUN"]))


def parsed(words: DataFrame) -> DataFrame:
    """Tokens of words (ut, sent_id, tok_id, text): what UPOS, HEAD, DEPREL, FEATS, FIELD and YEAR say."""
    def listed(names, at):
        return F.get(F.array(*map(F.lit, names)), at)

    t, n, tok_id = F.col("t"), F.col("n"), F.col("tok_id")
    verb, noun = t == TAG["VERB"], t >= TAG["PROPN"]
    deprel = (F.when(tok_id == 1, "root").when(noun, listed(NOUN_RELATIONS, (tok_id + n) % len(NOUN_RELATIONS)))
              .when(verb, listed(VERB_RELATIONS, (tok_id + n) % len(VERB_RELATIONS))).otherwise(listed(RELATIONS, t)))
    feats = (F.when(verb & F.col("w").endswith("ed"), "Tense=Past|VerbForm=Fin").when(verb, "Tense=Pres|VerbForm=Fin")
             .when(t.isin(TAG["ADJ"], TAG["ADV"]), listed(["Degree=Cmp", "Degree=Sup"], n % 4)))
    tagged = (words.withColumn("w", F.lower("text")).withColumn("n", F.length("w")).withColumn("t", tag_number()))
    return tagged.select("ut", F.expr(YEAR).alias("year"), F.expr(FIELD).alias("field"), "sent_id", "tok_id",
                         F.expr(HEAD).alias("head"), "text", F.col("w").alias("lemma"), listed(TAGS, t).alias("upos"),
                         deprel.alias("deprel"), feats.alias("feats"))


def all_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ut"), "text")
    # Outer explodes: an inner one makes Spark split the text twice, to check for empty arrays.
    # Lines are dealt out one by one, so neither a long document nor a large file is one task.
    lines = (docs.select("ut", F.posexplode_outer(F.split("text", "\n")).alias("sent_id", "line"))
             .repartition("ut", "sent_id"))
    found = F.regexp_extract_all("line", F.lit(TOKEN_PATTERN), F.lit(0))
    toks = (lines.select("ut", "sent_id", F.posexplode_outer(found).alias("p", "text"))
            .where(F.col("text").isNotNull()).withColumn("tok_id", F.col("p") + 1))
    return parsed(toks)


_STAGED: dict[tuple[str, str], str] = {}


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token table as operators get it: Parquet, one row per token.

    The parse is written once per application and input folder, so every query
    scans a columnar table with pruning and pushdown instead of parsing again.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STAGED:
        folder = scratch_folder(spark)
        name = f"tokens-{key[0]}-{hashlib.md5(sf_dir.encode()).hexdigest()[:12]}"
        stage(all_tokens(spark, sf_dir), name, folder, compression="zstd")
        _STAGED[key] = f"{folder}/{name}"
    return read_tokens(spark, _STAGED[key])


cte("line", """SELECT doc_id AS ut, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS sent_id FROM documents""")
cte("word", f"""SELECT ut, CAST(sent_id AS INT) AS sent_id, unnest(ws) AS text,
  CAST(generate_subscripts(ws, 1) AS INT) AS tok_id
  FROM (SELECT ut, sent_id, regexp_extract_all(line, '{TOKEN_PATTERN}') AS ws FROM line)""", "line")
cte("tagged", f"""SELECT *, {UPOS} AS upos FROM
  (SELECT *, lower(text) AS w, CAST(length(text) AS INT) AS n FROM word)""", "word")
cte("tok_all", f"""SELECT ut, {YEAR} AS year, {FIELD} AS field, sent_id, tok_id,
  CAST({HEAD} AS INT) AS head, text, w AS lemma, upos, {DEPREL} AS deprel, {FEATS} AS feats
  FROM tagged""", "tagged")
cte("tok", "SELECT * FROM tok_all WHERE field = 'abstract'", "tok_all")

# Fixture lexicons: words that occur in the test prose with a fitting pseudo part of speech.
STANCE = {
    ("hedge", "approximator"): "thly erly only anly",
    ("hedge", "modal"): "is was",
    ("hedge", "epistemic_verb"): "ered oned attion",
    ("hedge", "epistemic_adjadv"): "thble erble rely",
    ("booster", "reporting"): "thed aned ertion",
    ("booster", "emphatic"): "ly ble are onble",
}
STRICT, LOOSE = "ther rewh thing anea erin", "thon ering onan"
METHODS = "ed ered reed eriner thanea attion is"
BASELINE = "eron erat oning anon rewh"
GROUPS = {
    "explicit_su": [{"lemma": "thon eran"}],
    "modality": [{"upos": "AUX VERB", "lemma": "is be ed"}],
    "conditional": [{"deprel": "mark", "lemma": "that"}],
    "hypothesis": [{"lemma": "eren erer"}],
    "prediction": [{"upos": "VERB", "lemma": "ered attion"}],
    "interrogative": [{"text": "! ?"}],
    "non_generalisable": [{"lemma": "thsh onin"}],
    "adverbial_su": [{"upos": "ADV", "lemma": "thly rely"}],
    "negation": [{"deprel": "advmod", "lemma": "ly"}, {"deprel": "det", "lemma": "a"}],
    "subjectivity": [{"upos": "VERB", "lemma": "thed oned"}],
    "conjectural": [{"lemma": "onan onre"}],
    "disagreement": [{"lemma": "ersh anin"}],
}
CONFIRMATION = [{"upos": "ADV ADJ", "lemma": "ble erly"}]
PRIOR_WORK = [{"lemma": "ther thing er", "deprel": "amod nmod nsubj obl"}]
FEATURE_WORDS = {"modals": ["is", "was"], "negations": ["ly", "rely"],
                 "first_person": ["he", "it", "an"], "suffixes": ["tion", "ing", "er"]}
NAMES = [("C00", "The Thing", "Thble"), ("C01", "Ering", "Erble"), ("C02", "Oning", "Onble"),
         ("C03", "Ering-Thing", None), ("C04", "Thing Ering", ""), ("C05", "The Usa", "Anble"),
         ("C06", "Oning the", "Reble")]
ALIASES = [("C07", "anble"), ("C00", "Ther"), ("C08", "Union"), ("C09", "Stble"), ("C00", "thble"),
           ("C10", "A Very Long Name"), ("C04", "Erble Thble")]


def stance(spark):
    return stance_lexicon(spark, STANCE)


def power(spark):
    return power_lexicon(spark, STRICT, LOOSE)


def methods(spark):
    return term_list(spark, METHODS)


def baseline(spark):
    return term_list(spark, BASELINE)


def country_names(spark):
    iso3, name, demonym = map(list, zip(*NAMES))
    return small_table(spark, {"iso3": iso3, "name": name, "demonym": demonym}, {"demonym": pa.string()})


def country_aliases(spark):
    iso3, alias = map(list, zip(*ALIASES))
    return small_table(spark, {"iso3": iso3, "alias": alias})


def values(rows, columns: str) -> str:
    def lit(v):
        return "NULL" if v is None else (str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'")
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({columns})"


cte("lex", values([(w, k, s) for (k, s), t in STANCE.items() for w in t.split()], "term, type, subtype"))
cte("power", values([(w, 1) for w in STRICT.split()] + [(w, 0) for w in LOOSE.split()],
                    "term, in_strict_list"))
cte("methods", values([(w,) for w in METHODS.split()], "term"))
cte("baseline", values([(w,) for w in BASELINE.split() if w not in STRICT.split() + LOOSE.split()], "term"))
