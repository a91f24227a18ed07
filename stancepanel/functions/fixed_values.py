"""Word lists and label tables that results depend on.

Everything in this module is data that must equal the published measure
definition for results to be comparable. Lists are in plain text, in the
order in which the definition gives them.
"""

# Stance lexicon (type, subtype) -> terms.
STANCE_TERMS = {
    ("hedge", "approximator"): """about almost approximately around broadly essentially fairly
        generally largely mainly mostly often quite rather relatively roughly sometimes somewhat
        typical typically usually""",
    ("hedge", "modal"): "could may might ought should would",
    ("hedge", "epistemic_verb"): """appear argue assume claim doubt estimate feel guess indicate
        postulate seem suggest suppose suspect tend""",
    ("hedge", "epistemic_adjadv"): """apparent apparently doubtful likely maybe perhaps plausible
        plausibly possible possibly presumable presumably probable probably uncertain uncertainly
        unclear unclearly unlikely""",
    ("booster", "reporting"): "believe demonstrate establish find know prove realize show think",
    ("booster", "emphatic"): """actually always certain certainly clear clearly conclusively
        decidedly definite definitely doubtless evident evidently incontestable incontestably
        incontrovertible incontrovertibly indeed indisputable indisputably must never obvious
        obviously really sure surely true truly undeniable undeniably undisputedly undoubtedly""",
}

# Parts of speech in which a stance subtype counts.
STANCE_UPOS = {
    "modal": ["AUX", "VERB"],
    "epistemic_verb": ["VERB"],
    "reporting": ["VERB"],
    "epistemic_adjadv": ["ADJ", "ADV"],
    "approximator": ["ADJ", "ADV"],
    "emphatic": ["ADJ", "ADV"],
}

# Power-holder lemmas, strict list and looser additions.
POWER_STRICT = """government ministry minister police court parliament president presidency military
    prosecutor regime judiciary army senate congress governor legislature mayor politician censor
    dictator junta politburo chancellor premier"""
POWER_LOOSE = """state party authority official council administration agency security leadership
    cabinet"""

# Predicates that describe research methods.
METHODS_PREDICATES = """analyse analyze examine investigate explore study measure assess evaluate test
    estimate calculate compute collect gather obtain sample survey interview administer conduct
    perform undertake employ use utilize utilise base derive compare contrast classify categorize
    categorise code score rate rank weight aggregate model fit control adjust match select recruit
    include exclude define operationalize operationalise validate replicate review describe present
    report discuss summarize summarise outline organize structure divide group illustrate
    demonstrate show find observe note identify propose develop construct design draw"""

# Organisations used as a naming baseline.
BASELINE_ORGANISATIONS = """university college school hospital clinic company firm bank corporation
    association institute foundation union society newspaper journal museum laboratory charity
    enterprise"""

# Dependency relations.
PASSIVE_SUBJECT = "nsubj:pass"
AGENT = "obl:agent"
ARGUMENT_RELATIONS = ["nsubj", "nsubj:pass", "obj", "iobj", "obl"]
CLAUSE_RELATIONS = ["root", "advcl", "ccomp", "xcomp", "acl", "acl:relcl", "parataxis"]
SUBCLAUSE_RELATIONS = ["advcl", "ccomp", "xcomp", "acl", "acl:relcl"]
NAMING_RELATIONS = ["compound", "nmod", "flat", "appos"]
ACTOR_RELATIONS = ["nmod:poss", "compound"]

# Nominal suffixes.
NOMINALISATION_SUFFIXES = ["tion", "sion", "ment", "ance", "ence", "ure", "ing"]
FEATURE_NOMINAL_SUFFIXES = ["tion", "ment", "ance"]

# Closed word classes of the sentence features.
FEATURE_MODALS = ["may", "might", "could", "would", "should", "can"]
FEATURE_NEGATIONS = ["not", "never"]
FEATURE_FIRST_PERSON = ["we", "our", "us", "i", "my"]

# Sentence features that are expressed per token.
SENTENCE_FEATURES = """n_hedge n_approximator n_booster n_modal n_negation n_passive n_agent_phrase
    n_nominalisation n_number n_propn n_adjective n_adverb n_verb n_subordinator n_first_person
    n_past_tense n_present_tense n_comparative n_subclause"""

# Uncertainty groups. A group is a list of alternatives; an
# alternative is a conjunction of membership conditions on token columns.
UNCERTAINTY_GROUPS = {
    "explicit_su": [{"lemma": """unclear unknown uncertain uncertainty controversial debatable
        ambiguous inconclusive contested unresolved unsettled undetermined unexplained puzzling
        elusive"""}],
    "modality": [{"upos": "AUX VERB", "lemma": "may might could would should can"}],
    "conditional": [{"deprel": "mark", "lemma": "if unless whether provided assuming"}],
    "hypothesis": [{"lemma": """hypothesise hypothesize hypothesis hypotheses assume assumption
        presume posit postulate conjecture"""}],
    "prediction": [{"upos": "VERB", "lemma": "predict forecast project anticipate expect"}],
    "interrogative": [{"text": "?"}],
    "non_generalisable": [{"lemma": """generalise generalize generalisability generalizability
        preliminary tentative exploratory indicative"""}],
    "adverbial_su": [{"upos": "ADV", "lemma": """possibly probably perhaps apparently presumably
        arguably seemingly allegedly potentially conceivably maybe"""}],
    "negation": [{"deprel": "advmod", "lemma": "not never n't"}, {"deprel": "det", "lemma": "no"}],
    "subjectivity": [{"upos": "VERB", "lemma": "believe feel think argue view consider regard"}],
    "conjectural": [{"lemma": """speculate speculation suspect guess suppose surmise conceivable
        plausible likely unlikely"""}],
    "disagreement": [{"lemma": """disagree disagreement dispute contest contradict contradictory
        conflicting inconsistent debate controversy"""}],
}
CONFIRMATION_CUE = [{"upos": "ADV ADJ", "lemma": """clearly definitely certainly conclusively
    undoubtedly unambiguously robustly"""}]
PRIOR_WORK_CUE = [{"lemma": "previous prior literature scholar researcher study",
                   "deprel": "amod nmod nsubj obl"}]

# Gazetteer forms for former states and forms that name no country.
HISTORICAL_FORMS = [
    ("RUS", "Soviet Union"), ("RUS", "USSR"), ("SRB", "Yugoslavia"), ("SRB", "Yugoslavian"),
    ("CZE", "Czechoslovakia"), ("DEU", "West Germany"), ("DEU", "East Germany"),
]
AMBIGUOUS_FORMS = """states state union republic kingdom island islands federation emirates north
    south east west central new guinea america american european african asian western eastern
    northern southern national people peoples democratic socialist arab commonwealth"""

# Address country names that are recoded before mapping.
COUNTRY_ALIASES = {
    "PEOPLES R CHINA": "CHINA", "ENGLAND": "UK", "SCOTLAND": "UK", "WALES": "UK",
    "NORTH IRELAND": "UK", "UNITED KINGDOM": "UK",
}

# Regime codes.
REGIME_LABELS = {0: "Closed autocracy", 1: "Electoral autocracy",
                 2: "Electoral democracy", 3: "Liberal democracy"}


def words(text: str) -> list[str]:
    return text.split()
