"""Text of a fact memory: intents, triples, templates, guards. Expressions only, built to run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Patterns (fixed values of this engine).
HEDGE = r"(?i)(^|[^a-z])(maybe|perhaps|might|possibly|not|never|no longer|used to|think|guess)([^a-z]|$)"
FORGET = r"(?i)^\s*(forget|delete|remove|drop)([^a-z]|$)"
QUESTION = r"(?i)^\s*(who|what|where|when|which|how|is|are|does|do|did)([^a-z]|$)"
CORRECTION = r"(?i)^\s*(actually|correction|no,|wait)([^a-z]|$)"
BANNED = r"(?i)(^|[^a-z])(because|remember|stored|recorded|fact|memory|since)([^a-z]|$)"
LEADIN_WORDS = 8
#: A line "(s | r | o)"; fields may hold parentheses, as in "Tom (brother)".
TRIPLE_LINE = r"^\s*\(\s*([^|]*[^|\s])\s*\|\s*([^|]*[^|\s])\s*\|\s*([^|]*[^|\s])\s*\)\s*$"
#: Words that give away a fact in a remainder (fixed values).
KEYWORDS = r"(?i)\d|works?|lives?|born|manag|report|marri|sibling|stud(y|ied)|employ|schedul|resid|mov(e|ed|ing)|job|trip|visit|school|office|city|wedding|party|vacation|holiday|meeting|dinner|birthday"
#: Sentence templates by relation (fixed values of this engine).
TEMPLATES = (
    ("in nation", "{s} is from {o}."),
    ("in segment", "{s} buys for {o}."),
    ("in region", "{s} lies in {o}."),
    ("has brand", "{s} is of brand {o}."),
)


def intent(text: Column) -> Column:
    """forget, question or statement, in this order."""
    return F.when(text.rlike(FORGET), "forget").when(text.rlike(QUESTION) | text.rlike(r"\?\s*$"), "question").otherwise("statement")


def is_correction(text: Column) -> Column:
    return text.rlike(CORRECTION)


def strip_now(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+now([.!?]?)$", "$1")


def hedged(*fields: Column) -> Column:
    out = F.lit(False)
    for f in fields:
        out = out | F.coalesce(f.rlike(HEDGE), F.lit(False))
    return out


def parse_triples(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, subj, rel, obj) of each well-formed line "(s | r | o)"; relations in lower case, hedged ones dropped, one of equals."""
    pattern = TRIPLE_LINE
    lines = df.select(*keep, F.explode(F.split(text, "\n")).alias("line")).where(F.col("line").rlike(pattern))
    part = lambda k: F.regexp_extract("line", pattern, k)
    out = lines.select(*keep, part(1).alias("subj"), F.lower(part(2)).alias("rel"), part(3).alias("obj"))
    return out.where(~hedged(F.col("subj"), F.col("rel"), F.col("obj"))).distinct()


def parse_question(text: Column) -> Column:
    """STRUCT(subj, rel) of the first line "s | r", in parentheses or not; null fields otherwise."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.instr(x, "|") > 0)
    first = F.regexp_replace(F.trim(F.try_element_at(lines, F.lit(1))), r"^\((.*)\)$", "$1")
    parts = F.transform(F.split(first, r"\|"), lambda x: F.trim(x))
    fine = (F.size(parts) == 2) & ~F.exists(parts, lambda x: x == "")
    return F.struct(F.when(fine, parts[0]).alias("subj"), F.when(fine, parts[1]).alias("rel"))


def qualified(text: Column) -> Column:
    """"my doctor Ann Lee" as "Ann Lee (doctor)"; a bare "my doctor" stays itself."""
    pattern = r"(?:^|[^A-Za-z])my ([a-z]+) ([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)?)"
    name, role = F.regexp_extract(text, pattern, 2), F.regexp_extract(text, pattern, 1)
    return F.when(name != "", F.concat(name, F.lit(" ("), role, F.lit(")"))).otherwise(F.nullif(F.regexp_extract(text, r"(?:^|[^A-Za-z])(my [a-z]+)", 1), F.lit("")))


def render(subj: Column, rel: Column, obj: Column, provenance: Column | None = None) -> Column:
    out = None
    for name, form in TEMPLATES:
        own = F.replace(F.replace(F.lit(form), F.lit("{s}"), subj), F.lit("{o}"), obj)
        out = F.when(rel == name, own) if out is None else out.when(rel == name, own)
    text = out.otherwise(F.concat(subj, F.lit(" "), rel, F.lit(" "), obj, F.lit(".")))
    return text if provenance is None else F.when(provenance == "assistant-inferred", F.concat(F.lit("I believe "), text)).otherwise(text)


def speak(action: Column, body: Column, tag: Column, names: Column) -> Column:
    """The reply of each action; names: what a deliberation lists."""
    ask = F.when(tag == "referential", F.concat(F.lit("Which one do you mean: "), F.array_join(names, " or "), F.lit("?"))).otherwise(
        F.concat(F.lit("Two facts are on file: "), F.array_join(names, "; "), F.lit("."))
    )
    return F.when(action == "answer", body).when(action == "deliberate", ask).when(action == "recollect", F.coalesce(body, F.lit("Nothing is on file for this."))).otherwise(F.lit("I do not know."))


def leadin_ok(text: Column) -> Column:
    """A lead-in of at most eight words, without banned words and without capitals after its first word but I."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    later = F.slice(words, 2, 2 * LEADIN_WORDS)
    capital = F.exists(later, lambda w: w.rlike("^[A-Z]") & ~w.rlike("^I([^A-Za-z]|$)"))
    return (F.size(words) > 0) & (F.size(words) <= LEADIN_WORDS) & ~text.rlike(BANNED) & ~capital


def strip_think(text: Column) -> Column:
    done = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.trim(F.substring_index(F.regexp_replace(done, r"(?s)<think>.*$", ""), "</think>", -1))


def parse_confidence(text: Column) -> Column:
    """The first number of up to three digits as a share of 100, clamped; 0.5 if there is none."""
    n = F.regexp_extract(text, r"([0-9]{1,3})", 1)
    return F.when(n == "", 0.5).otherwise(F.least(n.try_cast("int"), F.lit(100)) / 100.0)


def json_object(text: Column, schema: str) -> Column:
    """The outermost object of a text, code fences around it or not; null if it does not parse."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def remainder(text: Column, bodies: Column) -> Column:
    """The text with each allowed body blanked."""
    return F.aggregate(bodies, text, lambda out, b: F.replace(out, b, F.lit(" ")))


def slot(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"^(the|a|an) ", "")


def bullets(facts: Column) -> Column:
    """An array of (subj, rel, obj) as lines "- (s | r | o)", in order of the array."""
    return F.array_join(F.transform(facts, lambda x: F.concat(F.lit("- ("), x.subj, F.lit(" | "), x.rel, F.lit(" | "), x.obj, F.lit(")"))), "\n")


def variant(name: Column, style: Column) -> Column:
    """A near-duplicate of a name: possessive, without its middle character, or with a suffix, by style modulo 3."""
    half = F.floor(F.length(name) / 2).cast("int")
    short = F.concat(F.substring(name, F.lit(1), half), F.substring(name, half + 2, F.length(name)))
    return F.when(style % 3 == 0, F.concat(name, F.lit("'s"))).when(style % 3 == 1, short).otherwise(F.concat(name, F.lit(" Jr")))


def clause(action: Column, subj: Column, rel: Column, obj: Column) -> Column:
    """What a reply has settled, as one sentence by its action."""
    fact = F.concat(subj, F.lit(" "), rel, F.lit(" "), obj)
    return (
        F.when(action == "answer", F.concat(F.lit("On file: "), fact, F.lit(".")))
        .when(action == "deliberate", F.concat(F.lit("More than one entry fits "), subj, F.lit(" "), rel, F.lit(".")))
        .otherwise(F.concat(F.lit("Nothing settled for "), subj, F.lit(" "), rel, F.lit(".")))
    )


def entity_class(name: Column, endings: tuple[str, ...]) -> Column:
    """org by its last word, else city for one word or a qualified place, else qualified or person."""
    org = F.element_at(F.split(name, " "), -1).isin(*endings)
    return F.when(org, "org").when(name.rlike(r"^[^ ]+ \([A-Z]+\)$") | ~name.contains(" "), "city").when(name.contains("("), "qualified").otherwise("person")


class TripleLines:
    """parse_triples as a table function: one row for each well-formed line that is not hedged."""

    def eval(self, text: str) -> Iterator[tuple[str, str, str]]:
        for line in (text or "").split("\n"):
            m = re.match(TRIPLE_LINE, line)
            if m and not any(re.search(HEDGE, x) for x in m.groups()):
                yield m[1], m[2].lower(), m[3]


def register_udtf(spark: SparkSession, name: str = "triple_lines") -> None:
    """triple_lines(text) for SQL users."""
    spark.udtf.register(name, F.udtf(TripleLines, returnType="subj string, rel string, obj string"))
