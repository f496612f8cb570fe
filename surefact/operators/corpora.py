"""Seeded generators: entity names from pools, and families of evaluation items over them. Order and choice go by md5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .metrics import digest, draw, hash_rank

#: Pools of this engine (fixed values).
FIRST = "Ada Ben Cleo Dan Eva Finn Gus Hana Ivo Jana Kurt Lena Milo Nora Otto Pia Ralf Sina Tom Uta".split()
LAST = "Adler Bauer Cohen Dietz Ebert Falk Graf Hahn Iske Jung Kern Lang Moser Noll Ortiz Pohl Rau Sauer Thoma Urban Voss Wulf Yates Zorn Brandt".split()
TWINS = {"Adler": "Adlers", "Bauer": "Bauers", "Cohen": "Cohens", "Dietz": "Dietze", "Ebert": "Eberts"}
ROLES = ("brother", "dentist", "neighbour", "accountant", "old classmate", "cousin")
ORG_A = "Argo Borealis Corvus Draco Elara Fornax Gemini Hydra".split()
ORG_B = ("Works", "Optics", "Freight", "Textiles", "Press", "Mills")
CITIES = "Aldergate Brookhaven Cawdor Dunmore Elmsford Fernley Glenrock Hartwell Inverley Junction Kilburn Langdale Marlow Newry Oxbow Pendle Quarley Redfern Stanmore Thornby".split()
PLACES = ("Springvale (NT)", "Springvale (SW)", "Portmore (NT)", "Portmore (SW)")
SYNONYMS = (("works at", "is employed by"), ("lives in", "resides in"))
RELATIONS = ("works at", "is employed by", "lives in", "resides in", "was born in", "manages", "reports to", "is married to")
ORG_RELATIONS, PERSON_RELATIONS = ("works at", "is employed by"), ("manages", "reports to", "is married to")
MIX = (0.55, 0.2, 0.15, 0.1)


def pools(spark: SparkSession) -> DataFrame:
    """(kind, name): the cross products of the pools; their sizes are those of the lists above."""
    one = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    first = one(FIRST, "a")
    both = lambda kind, left, right, form: left.crossJoin(right).select(F.lit(kind).alias("kind"), F.format_string(form, "a", "b").alias("name"))
    out = both("person", first, one(LAST, "b"), "%s %s").unionByName(both("qualified", first, one(ROLES, "b"), "%s (%s)")).unionByName(both("org", one(ORG_A, "a"), one(ORG_B, "b"), "%s %s"))
    return out.unionByName(one([*CITIES, *PLACES], "name").select(F.lit("city").alias("kind"), "name"))


def quotas(n: int) -> dict[str, int]:
    """How many names of each kind: by MIX, cut to the pools, the rest from the persons."""
    sizes = {"person": len(FIRST) * len(LAST), "qualified": len(FIRST) * len(ROLES), "org": len(ORG_A) * len(ORG_B), "city": len(CITIES) + len(PLACES)}
    out = {k: min(round(n * share), m) for (k, m), share in zip(sizes.items(), MIX, strict=True)}
    out["person"] += n - sum(out.values())
    if out["person"] > sizes["person"]:
        raise ValueError(f"the pools hold no {n} names")
    return out


def entities(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """n distinct (kind, name), the first of each kind by hash."""
    wanted = F.create_map(*(F.lit(x) for kv in quotas(n).items() for x in kv))
    ranked = hash_rank(pools(spark), digest(seed, F.col("name")), "place", ["kind"])
    return ranked.where(F.col("place") < wanted[F.col("kind")]).select("kind", "name")


def sibling_orgs(names: DataFrame) -> DataFrame:
    """(prefix, a, b): of the organisations that share a first word, the first two."""
    orgs = names.where(text.entity_class(F.col("name"), ORG_B) == "org")
    own = orgs.groupBy(F.element_at(F.split("name", " "), 1).alias("prefix")).agg(F.slice(F.array_sort(F.collect_set("name")), 1, 2).alias("two"))
    return own.where(F.size("two") == 2).select("prefix", F.col("two")[0].alias("a"), F.col("two")[1].alias("b"))


def _pick(xs: tuple[str, ...] | list[str], k: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in xs)), (k % len(xs)).cast("int") + 1)


#: Persons of each family, in the order in which they are dealt.
FAMILIES = (("f_syn", 40), ("f_nearkey", 40), ("f_para", 40), ("f_distract", 40), ("f_id", 80), ("f_ood", 80))


def families(spark: SparkSession, seed: int) -> DataFrame:
    """(family, kind, subj, rel, gold, other, written array<struct<subj,rel,obj>>): items and the facts that they stand on.

    f_syn: two objects under synonymous relations; f_nearkey: under a name and its variant; f_confusable: a fact of a
    person, asked of a namesake; f_para: written under one relation, asked under its synonym; f_distract: an object that has a
    sibling organisation; f_id: asked as written; f_ood: never written; f_ref: a first name that two members share."""
    persons = hash_rank(pools(spark).where("kind = 'person'"), digest(seed, F.col("name")), "i").select("name", "i")
    ends, at = [], 0
    for _, n in FAMILIES:
        at += n
        ends.append(at)
    family = F.when(F.lit(False), "")
    for (name, _), end in zip(FAMILIES, ends, strict=True):
        family = family.when(F.col("i") < end, name)
    k = draw(F.lit(f"r{seed}"), F.col("name"))
    pair = (k % 2).cast("int")
    rel_a = F.element_at(F.array(*(F.lit(a) for a, _ in SYNONYMS)), pair + 1)
    rel_b = F.element_at(F.array(*(F.lit(b) for _, b in SYNONYMS)), pair + 1)
    base = persons.withColumn("family", family).where("family is not null").withColumn("k", k)
    base = base.withColumn("rel", F.when(F.col("family").isin("f_syn", "f_para"), rel_a).when(F.col("family") == "f_distract", F.lit("works at")).otherwise(_pick(RELATIONS, k)))
    thing = lambda rel, j: (
        F.when(rel.isin(*ORG_RELATIONS), F.concat(_pick(ORG_A, j), F.lit(" "), _pick(ORG_B, j))).when(rel.isin(*PERSON_RELATIONS), F.concat(_pick(FIRST, j), F.lit(" "), _pick(LAST, j))).otherwise(_pick(CITIES, j))
    )
    base = base.withColumn("o1", thing(F.col("rel"), k)).withColumn("o2", thing(F.col("rel"), k + 1)).withColumn("other_rel", rel_b).withColumn("variant", text.variant(F.col("name"), F.col("i")))
    fact = lambda s, r, o: F.struct(s.alias("subj"), r.alias("rel"), o.alias("obj"))
    null, c = F.lit(None).cast("string"), F.col
    item = lambda kind, s, r, gold, other, *facts: F.struct(
        F.lit(kind).alias("kind"), s.alias("subj"), r.alias("rel"), gold.alias("gold"), other.alias("other"), F.array(*facts).cast("array<struct<subj:string,rel:string,obj:string>>").alias("written")
    )
    name, rel, o1, o2 = c("name"), c("rel"), c("o1"), c("o2")
    syn, near = (fact(name, rel, o1), fact(name, c("other_rel"), o2)), (fact(name, rel, o1), fact(c("variant"), rel, o2))
    made = (
        F.when(c("family") == "f_syn", F.array(item("syn_true", name, rel, o1, o2, *syn), item("syn_stale", name, c("other_rel"), o1, o2, *syn)))
        .when(c("family") == "f_nearkey", F.array(item("nearkey_true", name, rel, o1, o2, *near), item("nearkey_var", c("variant"), rel, o1, o2, *near)))
        .when(c("family") == "f_para", F.array(item("para", name, c("other_rel"), o1, null, fact(name, rel, o1))))
        .when(c("family") == "f_distract", F.array(item("distract", name, rel, o1, F.concat(F.element_at(F.split("o1", " "), 1), F.lit(" "), _pick(ORG_B, k + 1)), fact(name, rel, o1))))
        .when(c("family") == "f_id", F.array(item("id", name, rel, o1, null, fact(name, rel, o1))))
        .otherwise(F.array(item("ood", name, rel, null, null)))
    )
    out = base.select("family", F.explode(made).alias("x")).select("family", "x.*")
    twins = spark.createDataFrame([(f, a, b) for f in FIRST for a, b in TWINS.items()], "f string, a string, b string")
    twins = twins.select(F.concat_ws(" ", "f", "a").alias("name"), F.concat_ws(" ", "f", "b").alias("twin")).withColumn("k", draw(F.lit(f"t{seed}"), F.col("name")))
    twins = twins.withColumn("rel", _pick(RELATIONS, c("k"))).withColumn("o1", thing(c("rel"), c("k")))
    out = out.unionByName(twins.select(F.lit("f_confusable").alias("family"), item("confusable", c("twin"), rel, null, null, fact(name, rel, o1)).alias("x")).select("family", "x.*"))
    ref = spark.createDataFrame([(f,) for f in FIRST], "name string").withColumn("k", draw(F.lit(f"f{seed}"), F.col("name"))).withColumn("rel", _pick(RELATIONS, c("k")))
    ref = ref.withColumn("o1", thing(rel, c("k"))).withColumn("o2", thing(rel, c("k") + 1))
    own = [fact(F.concat(name, F.lit(f" ({ROLES[j]})")), rel, o) for j, o in enumerate((o1, o2))]
    return out.unionByName(ref.select(F.lit("f_ref").alias("family"), item("ref", name, rel, null, null, *own).alias("x")).select("family", "x.*"))


def observer(items: DataFrame, item: str, d: float, noise: float, seed: int) -> DataFrame:
    """(item, correct, conf): an observer of sensitivity d whose confidence sees its own evidence through more noise.

    Normal numbers come from md5 by the inverse normal distribution."""
    from ..functions.gate import norm_quantile, sigmoid

    normal = lambda name: norm_quantile((draw(F.lit(f"{name}{seed}"), F.col(item)) + 0.5) / float(1 << 28))
    out = items.select(item, (F.lit(d / 2) + normal("x")).alias("x"), normal("y").alias("y"))
    return out.select(item, (F.col("x") > 0).alias("correct"), sigmoid(F.abs(F.col("x")) + noise * F.col("y")).alias("conf"))
