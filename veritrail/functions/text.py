"""Text functions as Column builders: normalisers, quote verification, mentions, classifiers of reasons and certainty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the classifiers.
EFFICACY = (
    r"lack of efficacy|inefficac|ineffective|futilit|futile|no (benefit|efficacy|improvement|clinical benefit)|did not (meet|show|demonstrate)"
    r"|failed to (meet|show|demonstrate)|(insufficient|inadequate|limited|poor) (efficacy|response|activity)|efficacy (reasons?|concerns?|criteria)"
    r"|(primary )?(end ?point|outcome)[^.]{0,30}(not met|failed)"
)
SAFETY = (
    r"toxicit|hepatotox|cardiotox|nephrotox|neurotox|safety (signal|concern|issue|reason)|serious adverse|unacceptable|dose[- ]limiting|\bdlt\b|\bsae\b"
    r"|(increased|excess) (death|mortalit)|qt prolong"
)
NEGATED = (
    r"no (safety|toxicity|serious|significant|adverse|efficacy)[^.]{0,20}(concern|issue|signal|problem)?s?|without (safety|toxicity|efficacy)"
    r"|not (due to|related to|because of|for) (safety|toxicity|efficacy)|unrelated to (safety|efficacy|toxicity)|non[- ]?(safety|efficacy|toxicity)|no concerns?"
)
OPERATIONAL = (
    r"accrual|enroll|recruit|funding|budget|sponsor decision|business|administrative|staffing|logistic|supply|manufactur|covid|pandemic"
    r"|investigator (left|departure)|pi (left|departure)|strateg"
)
COMPARATOR = r"(active )?(control|comparator|reference) (drug|arm|agent|group)|other (arm|group)|concomitant (drug|medication)"
MODE_ADMIN = r"accrual|enrollment|recruit|business reason"
MODE_TOXIC = r"toxicit|safety|mortalit|adverse"
MODE_EFFICACY = r"futilit|lack of efficac|no benefit|did not meet|failed to demonstrate|insufficient activity|efficacy"
MODE_OTHER = r"from other studies|in a preceding study"
STOP_EFFICACY = r"futility|lack of efficacy|no (benefit|efficacy)|did not meet|failed to (meet|show|demonstrate)|interim analysis|safety|toxicit|adverse event|harm"
RESULT = (
    r"significant|superior|inferior|greater|better|worse|shorter|longer|higher|lower|improv|reduc|increas|decreas|declin|prolong|effective|efficac|benefit"
    r"|response rate|remission|surviv|no difference|did not|failed to|lack of|futil|ineffective|no longer|not recommend|versus|compared with|compared to|vs\.?\s"
    r"|\bp\s*[=<>]|\bhr\b|\bor\b\s*[=(]|\brr\b|95%\s*ci|odds ratio|hazard ratio|risk ratio|mean difference|\bsmd\b|\bnnt\b"
)
DESIGN = (
    r"was measured using|were measured using|measured by|assessed using|(was|were|is|are) defined|defined as|were enrolled|were randomi|patients received|can inform"
    r"|will be|aim(ed)? to|objective of|primary outcome was|is (a|an) (new|novel)|is increasingly|has been used|study was|distributions? for|scores? for|rates? for"
    r"|measure(s|d)? by|outcome measure|endpoint (was|is)|assessment of"
)
GRADE_HIGH = r"little or no difference|high[- ]certainty|results in (a |an )?(large |slight |small )?(reduction|increase|decrease)"
GRADE_LOW = (
    r"\b(may|might)\s+(slightly\s+)?(reduce|increase|improve|decrease|result|lead|have)|low[- ]certainty|very low[- ]certainty|low[- ]quality evidence"
    r"|uncertain|insufficient evidence|evidence is (very )?uncertain"
)
GRADE_MODERATE = r"\bprobably\b|moderate[- ]certainty"
NUMBER = r"-?\d+(?:\.\d+)?"
TRIAL_ID = r"\b(NCT\d{8})\b"
CHIRAL = ["dex", "levo", "lev", "es", "ar", "dl", "rac"]
#: Words that do not tell indications apart.
STOP_WORDS = [
    "disease", "diseases", "disorder", "disorders", "syndrome", "syndromes", "of", "the", "and", "or", "with", "in", "to", "nos", "unspecified", "malignant",
    "benign", "neoplasm", "neoplasms", "carcinoma", "cancer", "tumor", "tumour", "type", "stage", "grade", "primary", "secondary", "chronic", "acute", "severe",
    "moderate", "mild", "advanced",
]
#: Publication types from the most to the least decisive design.
PUBLICATION_TYPES = [
    ("Meta-Analysis", "meta"), ("Systematic Review", "meta"), ("Randomized Controlled Trial", "rct"), ("Clinical Trial, Phase III", "rct"),
    ("Clinical Trial, Phase II", "rct"), ("Controlled Clinical Trial", "rct"), ("Clinical Trial", "trial"), ("Observational Study", "observational"), ("Review", "review"),
]
MIN_QUOTE, MIN_STRUCTURED = 25, 12


def matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike("(?i)" + pattern), F.lit(False))


def fold(c: Column) -> Column:
    """White space squeezed, trimmed, lower case: the join key of names."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("||", fold(a), fold(b))


def indication_tokens(c: Column) -> Column:
    """The sorted distinct content words of a name."""
    words = F.regexp_extract_all(fold(c), F.lit("[a-z0-9]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_sort(F.array_distinct(F.filter(words, lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))))


def numbers(c: Column) -> Column:
    """Numbers without their signs."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, "^-+", ""))


def trial_ids(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TRIAL_ID), F.lit(1))))


def study_type(publication_types: Column) -> Column:
    return F.coalesce(*[F.when(F.array_contains(publication_types, name), kind) for name, kind in PUBLICATION_TYPES])


def comparative(kind: Column, publication_types: Column) -> Column:
    """Randomised, and not of phase 1 only."""
    upper = F.transform(F.coalesce(publication_types, F.array().cast("array<string>")), lambda x: F.upper(x))
    phases = F.filter(upper, lambda x: x.startswith("PHASE"))
    early = (F.size(phases) > 0) & F.forall(phases, lambda x: x.contains("PHASE1"))
    return (F.coalesce(kind == "rct", F.lit(False)) | F.array_contains(upper, "RANDOMIZED")) & ~early


def occurs(needle: Column, hay: Column) -> Column:
    """Contains ``needle`` other than behind a prefix that makes it another compound. Both are alphanumeric."""
    guarded = F.concat(F.lit("(?<!" + "|".join(CHIRAL) + ")"), needle)
    return (F.length(needle) > 0) & F.regexp_like(hay, guarded)


def names_subject(subject: Column, hay: Column) -> Column:
    """Whether a text names the subject, a long word of it, or a stem of seven letters. An unknown subject is not a mismatch."""
    name = F.lower(F.trim(F.coalesce(subject, F.lit(""))))
    words = F.filter(F.split(name, "[^a-z0-9]+"), lambda w: (F.length(w) > 4) & ~w.isin("acid", "sodium", "hydrochloride", "beta"))
    candidates = F.filter(F.array_distinct(F.concat(F.array(alnum(name)), words)), lambda w: w != "")
    text = alnum(hay)
    found = F.exists(candidates, lambda c: occurs(c, text) | ((F.length(c) > 7) & occurs(F.substring(c, 1, 7), text)))
    return F.when(name == "", True).otherwise((text != "") & found)


def has_result(quote: Column, structured: bool = False) -> Column:
    """Whether a quote states a result rather than only a design."""
    prose = matches(quote, RESULT) & ~(matches(quote, DESIGN) & ~matches(quote, NUMBER))
    return ((F.size(numbers(quote)) >= 2) | prose) if structured else prose


def certainty(quote: Column) -> Column:
    return F.when(matches(quote, GRADE_HIGH), "high").when(matches(quote, GRADE_LOW), "low").when(matches(quote, GRADE_MODERATE), "moderate")


def failure_reason(c: Column) -> Column:
    """efficacy, operational, safety or unknown; negated phrases are cut out first, comparators' failures are unknown."""
    text = F.trim(F.coalesce(c, F.lit("")))
    negated = matches(text, NEGATED)
    rest = F.when(negated, F.regexp_replace(text, "(?i)" + NEGATED, " ")).otherwise(text)
    return (
        F.when((text == "") | (F.upper(text) == "NA") | matches(text, COMPARATOR), "unknown")
        .when(negated & ~matches(rest, EFFICACY) & ~matches(rest, SAFETY), F.when(matches(text, OPERATIONAL), "operational").otherwise("unknown"))
        .when(matches(rest, EFFICACY), "efficacy")
        .when(matches(rest, OPERATIONAL), "operational")
        .when(matches(rest, SAFETY), "safety")
        .otherwise("unknown")
    )


def failure_mode(why: Column, detail: Column) -> Column:
    """The order of the rules is the rule."""
    d, w = F.coalesce(detail, F.lit("")), F.coalesce(why, F.lit(""))
    return (
        F.when(matches(d, MODE_ADMIN), "administrative")
        .when(matches(d, MODE_TOXIC) & ~matches(d, MODE_EFFICACY), "safety")
        .when(matches(d, MODE_OTHER), "other studies")
        .when(matches(F.concat(d, F.lit(" "), w), MODE_EFFICACY), "efficacy")
        .otherwise("undecidable")
    )


def stop_reason(status: Column, why: Column) -> Column:
    """Null unless the study stopped; efficacy (with safety) outweighs operational."""
    s = F.upper(F.coalesce(status, F.lit("")))
    return F.when(
        s.contains("TERMINAT") | s.contains("WITHDRAWN"),
        F.when(F.trim(F.coalesce(why, F.lit(""))) == "", "unknown").when(matches(why, STOP_EFFICACY), "efficacy").when(matches(why, OPERATIONAL), "operational").otherwise("unknown"),
    )


def verify_quote(quote: Column, document: Column) -> Column:
    """struct(ok, how, confirmed, unconfirmed): whether a prose quote stands in a document, and the longest confirmed prefix.

    Both sides are folded. Quotes under MIN_QUOTE characters cannot be verified; a quote whose first half stands in the
    document is partial.
    """
    q, d = fold(quote), fold(document)
    half = F.greatest(F.lit(MIN_QUOTE), F.floor(F.length(q) / 2).cast("int"))
    longest = F.array_max(F.transform(F.sequence(half, F.length(q)), lambda i: F.when(d.contains(F.left(q, i)), i).otherwise(0)))

    def out(ok: bool, how: str, confirmed: Column, unconfirmed: Column) -> Column:
        return F.struct(F.lit(ok).alias("ok"), F.lit(how).alias("how"), confirmed.alias("confirmed"), unconfirmed.alias("unconfirmed"))

    none = F.lit("")
    return (
        F.when(q == "", out(False, "empty", none, none))
        .when(F.length(q) < MIN_QUOTE, out(False, "short", none, none))
        .when(d.contains(q), out(True, "exact", q, none))
        .when(d.contains(F.left(q, half)), out(True, "partial", F.left(q, longest), F.substr(q, longest + 1)))
        .otherwise(out(False, "absent", none, none))
    )


def verify_structured(quote: Column, document: Column) -> Column:
    """exact, exact but punctuation, restated (two numbers or more, all in the document, and 60 % of its words), short, absent, empty."""
    q, d = fold(quote), fold(document)
    mine, theirs = numbers(quote), numbers(document)
    words = F.regexp_extract_all(q, F.lit("[a-z]{4,}"), F.lit(0))
    share = F.try_divide(F.size(F.filter(words, lambda w: d.contains(w))), F.size(words))
    return (
        F.when(q == "", "empty")
        .when(F.length(q) < MIN_STRUCTURED, "short")
        .when(d.contains(q), "exact")
        .when((alnum(q) != "") & alnum(d).contains(alnum(q)), "punctuation")
        .when((F.size(mine) >= 2) & (F.size(F.array_except(mine, theirs)) == 0) & (F.coalesce(share, F.lit(1.0)) >= 0.6), "restated")
        .otherwise("absent")
    )


def hash_bucket(c: Column, modulus: int = 1000) -> Column:
    """The development split: the first 32 bits of the folded name's SHA-256, modulo ``modulus``."""
    return F.pmod(F.conv(F.substring(F.sha2(fold(c), 256), 1, 8), 16, 10).cast("long"), F.lit(modulus))


def subject_key(c: Column) -> Column:
    """A drug's key: no parentheses, no salts, digits or dose words; the whole name if nothing is left."""
    # Salts and forms of a compound.
    salts = [
        "hydrochloride", "hcl", "hydrobromide", "sodium", "disodium", "potassium", "calcium", "magnesium", "sulfate", "sulphate", "phosphate", "diphosphate", "acetate", "citrate", "tartrate",
        "bitartrate", "maleate", "mesylate", "mesilate", "besylate", "besilate", "fumarate", "hemifumarate", "succinate", "tosylate", "bromide", "chloride", "nitrate", "oxalate", "malate",
        "lactate", "gluconate", "carbonate", "pamoate", "palmitate", "propionate", "valerate", "dipropionate", "furoate", "xinafoate", "trihydrate", "dihydrate", "monohydrate", "hydrate",
        "anhydrous", "salt", "base", "free",
    ]
    words = F.regexp_extract_all(F.lower(F.regexp_replace(c, r"\([^)]*\)", " ")), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*salts) & ~w.rlike(r"^\d+(mg|mcg|g|ml)?$") & ~w.isin("mg", "mcg", "g", "ml"))
    return F.when(F.size(kept) > 0, F.array_join(kept, "")).otherwise(F.array_join(words, ""))


# The mark before the results of the primary outcome, and the names of study types.
OUTCOME_MARK = "[1차 평가변수 결과]"
STUDY_NAMES = {"meta": "메타분석", "rct": "RCT", "trial": "임상시험", "observational": "관찰연구", "review": "고찰", "in_vitro": "시험관", "case": "증례"}


def in_outcome(quote: Column, document: Column) -> Column:
    """Whether a quote stands, but for case and spaces, in the part of a document after the outcome mark."""
    at = F.instr(document, OUTCOME_MARK)
    body = F.substring(document, at + F.lit(len(OUTCOME_MARK)), F.length(document))
    return F.coalesce((fold(quote) != "") & (at > 0) & F.contains(fold(body), fold(quote)), F.lit(False))


def source_tag(journal: Column, year: Column, pmid: Column, kind: Column, direction: Column) -> Column:
    """What a record is shown as: journal and year, else its id, then the study's name and the side."""
    head = F.concat_ws(" ", F.when(journal != "", journal), F.when(year > 0, year.cast("string")))
    name = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in STUDY_NAMES.items()], F.lit("기타"))
    return F.concat(F.when(head != "", head).otherwise(F.concat(F.lit("PMID "), pmid.cast("string"))), F.lit(" "), name, F.when(direction == "support", "(지지)").otherwise("(반박)"))


def query_terms(c: Column) -> Column:
    """A search term: no parentheses, no category after a dash, no punctuation."""
    out = F.regexp_replace(c, r"\([^)]*\)", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\s-\s.*$", " "), r"[(),;:\[\]]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def product_name(c: Column) -> Column:
    """A report's product: what stands in parentheses if that is four letters or more, up to the first comma, without dose or salt at the end."""
    inner = F.regexp_extract(c, r"\(([^)]{4,})\)", 1)
    name = F.split(F.when(inner != "", inner).otherwise(c), ",")[0]
    name = F.trim(F.regexp_replace(name, r"(?i)\s+(\d+(\.\d+)?\s*(mg|mcg|g|ml|%)|hydrochloride|hcl|sodium|acetate|sulfate|tablets?|capsules?|injection).*$", ""))
    return F.when(name == F.upper(name), F.initcap(name)).otherwise(name)
