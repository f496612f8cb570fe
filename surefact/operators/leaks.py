"""Does a text say more than it was allowed to? Surface words and claims in what remains of an output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .encoding import resolve_names

SUPPORT = 0.90  # a claimed term counts as a name at this cosine (fixed value)


def remainders(outputs: DataFrame) -> DataFrame:
    """(id, rem) of outputs (id, output, bodies array): what is left when each allowed body is taken out; a null output leaves nothing."""
    return outputs.select("id", F.trim(text.remainder(F.coalesce("output", F.lit("")), F.coalesce("bodies", F.array().cast("array<string>")))).alias("rem"))


def vocabulary_hits(rem: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, word): words or phrases of vocab (word) that stand in a remainder as whole words.

    Both sides meet by a phrase's first token, then the phrase is looked for."""
    split = lambda c: F.split(c, r"[^A-Za-z0-9_]+")
    tokens = rem.select("id", "rem", F.explode(F.array_distinct(split(F.col("rem")))).alias("t")).where("t <> ''")
    first = vocab.select("word").distinct().withColumn("t", F.element_at(F.filter(split(F.col("word")), lambda x: x != ""), 1))
    whole = F.concat(F.lit(r"(^|[^A-Za-z0-9_])\Q"), "word", F.lit(r"\E($|[^A-Za-z0-9_])"))
    return tokens.join(first, "t").where(F.rlike(F.col("rem"), whole)).select("id", "word")


def supported(claims: DataFrame, facts: DataFrame, entities: DataFrame, threshold: float = SUPPORT) -> DataFrame:
    """The claims (..., subj, rel, obj) with `supported`: each field is, or resolves to, that of one active fact."""
    names = entities.select("name").unionByName(facts.select(F.col("rel").alias("name"))).distinct()
    fields = claims.select(F.explode(F.array("subj", "rel", "obj")).alias("term")).distinct()
    unknown = fields.join(names.withColumnRenamed("name", "term"), "term", "left_anti")
    near = resolve_names(unknown, names).where(F.col("c1") >= threshold).select("term", "name")
    out = claims
    for c in ("subj", "rel", "obj"):
        out = out.join(near.select(F.col("term").alias(c), F.col("name").alias(f"_{c}")), c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))
    known = facts.select(*(F.col(c).alias(f"_{c}") for c in ("subj", "rel", "obj"))).distinct().withColumn("supported", F.lit(True))
    return out.join(known, ["_subj", "_rel", "_obj"], "left").withColumn("supported", F.coalesce("supported", F.lit(False))).drop("_subj", "_rel", "_obj")


def check(outputs: DataFrame, vocab: DataFrame, facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, words, keyword, claims, unsupported, leak) of outputs (id, output, bodies)."""
    rem = remainders(outputs)
    words = vocabulary_hits(rem, vocab).groupBy("id").agg(F.count(F.lit(1)).alias("words"))
    said = supported(text.parse_triples(rem, "rem", "id"), facts, entities)
    claims = said.groupBy("id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(~F.col("supported")).alias("unsupported"))
    out = rem.select("id", F.col("rem").rlike(text.KEYWORDS).alias("keyword")).join(words, "id", "left").join(claims, "id", "left").fillna(0, ["words", "claims", "unsupported"])
    return out.withColumn("leak", F.col("keyword") | (F.col("words") > 0) | (F.col("unsupported") > 0))


def relevant(outputs: DataFrame, facts: DataFrame, cap: int = 150) -> DataFrame:
    """(id, subj, rel, obj): facts that hold a token of at least four letters or digits of an output or of its allowed bodies, at
    most `cap` by name for each output; a row ("__TRUNCATED__", "dropped", n) says how many more there were.

    A token may stand inside a fact's word, so both sides meet by runs of four characters before the whole token is looked for."""
    whole = F.lower(F.concat_ws(" ", "output", F.array_join("bodies", " ")))
    tokens = outputs.select("id", F.explode(F.array_distinct(F.regexp_extract_all(whole, F.lit("([a-z0-9]{4,})"), F.lit(1)))).alias("token"))
    blob = F.lower(F.concat_ws(" ", "subj", "rel", "obj"))
    runs = F.transform(F.sequence(F.lit(1), F.length("blob") - 3), lambda i: F.substring(F.col("blob"), i, F.lit(4)))
    grams = facts.select("subj", "rel", "obj").distinct().withColumn("blob", blob).where(F.length("blob") >= 4)
    grams = grams.select("*", F.explode(F.array_distinct(runs)).alias("gram")).where(F.col("gram").rlike("^[a-z0-9]{4}$"))
    met = tokens.select("token").distinct().withColumn("gram", F.substring("token", 1, 4)).join(grams, "gram").where(F.contains("blob", "token"))
    hits = tokens.join(met.select("token", "subj", "rel", "obj"), "token").select("id", "subj", "rel", "obj").distinct()
    from .metrics import prefix

    kept = prefix(hits, ["id"], [F.col("subj"), F.col("rel"), F.col("obj")], cap).select("id", "subj", "rel", "obj")
    more = hits.groupBy("id").agg((F.count(F.lit(1)) - cap).alias("n")).where("n > 0")
    return kept.unionByName(more.select("id", F.lit("__TRUNCATED__").alias("subj"), F.lit("dropped").alias("rel"), F.concat(F.col("n").cast("string"), F.lit(" more relevant facts")).alias("obj")))
