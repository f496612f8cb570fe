"""All queries of the library with their oracle SQL (DuckDB), each over whole tables.

The fact store is drawn from the star schema: customers, suppliers, nations and parts give single-valued keys, events
give keys with many objects and an order of operations. Confidences come from labels and documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import gate, text, vec
from .operators import facts as store
from .operators import leaks, metrics, models, recall, registry
from .plans import memory_query
from .sources.io import scratch, table
from .streaming import facts as live

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    from . import extended  # noqa: F401  registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import extended  # noqa: F401

    return dict(_SQL)


def r6(c: F.Column | str) -> F.Column:  # type: ignore[name-defined]
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# -- the fact store -------------------------------------------------------------------------------


def triples(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    nation, customer = t("nation"), t("customer")
    parts = [
        customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("subj"), F.lit("in nation").alias("rel"), F.col("n_name").alias("obj")),
        customer.select(F.col("c_name").alias("subj"), F.lit("in segment").alias("rel"), F.col("c_mktsegment").alias("obj")),
        nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("subj"), F.lit("in region").alias("rel"), F.col("r_name").alias("obj")),
        t("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("subj"), F.lit("in nation").alias("rel"), F.col("n_name").alias("obj")),
        t("part").select(F.col("p_partkey").cast("string").alias("subj"), F.lit("has brand").alias("rel"), F.col("p_brand").alias("obj")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


TRIPLES = """triples as (
  select c_name as subj, 'in nation' as rel, n_name as obj from customer join nation on c_nationkey = n_nationkey
  union all select c_name, 'in segment', c_mktsegment from customer
  union all select n_name, 'in region', r_name from nation join region on n_regionkey = r_regionkey
  union all select s_name, 'in nation', n_name from supplier join nation on s_nationkey = n_nationkey
  union all select cast(p_partkey as varchar), 'has brand', p_brand from part)"""


def log(spark: SparkSession, d: str) -> DataFrame:
    """Events as operations: an error forgets, anything else writes."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "forget").otherwise("write").alias("op"), F.col("user_id").cast("string").alias("subj"),
        F.lit("did").alias("rel"), F.get_json_object("props", "$.k").alias("obj"), F.when(F.col("event_type") == "view", "tool-derived").otherwise("user-stated").alias("provenance"),
    )


LOG = """log as (
  select event_id as seq, case when event_type = 'error' then 'forget' else 'write' end as op, cast(user_id as varchar) as subj, 'did' as rel,
         json_extract_string(props, '$.k') as obj, case when event_type = 'view' then 'tool-derived' else 'user-stated' end as provenance from events)"""


@query(f"with {TRIPLES} select subj, rel, obj, count(*) as n from triples group by all")
def fact_table(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d).groupBy("subj", "rel", "obj").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {TRIPLES}, asked as (select c_name as subj, r.rel from customer, (values ('in nation'), ('has brand')) r(rel))
select a.subj, a.rel, exists (select 1 from triples t where t.subj = a.subj and t.rel = a.rel) as stored from asked a""")
def key_membership(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "customer").select(F.col("c_name").alias("subj"), F.explode(F.array(F.lit("in nation"), F.lit("has brand"))).alias("rel"))
    return store.membership(asked, triples(spark, d))


@query(f"with {LOG}, s as (select subj, rel, obj, arg_max(op, seq) as op from log group by all) select subj, rel, count(distinct obj) as objects from s where op = 'write' group by all having count(distinct obj) > 1")
def stored_collisions(spark: SparkSession, d: str) -> DataFrame:
    return store.collisions(store.state(log(spark, d)))


@query(f"""with {TRIPLES}, asked as (select s_name as subj, r.rel from supplier, (values ('in nation'), ('in segment')) r(rel))
select subj, rel from asked where (subj, rel) not in (select subj, rel from triples) and not (rel = 'in segment' and subj in (select subj from triples where rel = 'in region'))""")
def unwritten_keys(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "supplier").select(F.col("s_name").alias("subj"), F.explode(F.array(F.lit("in nation"), F.lit("in segment"))).alias("rel"))
    synonyms = spark.createDataFrame([("in region", "in segment")], "rel string, other string")
    return store.unwritten(asked, triples(spark, d), synonyms)


@query(f"with {LOG} select subj, rel, obj, arg_max(provenance, seq) as provenance, max(seq) as seq from log group by subj, rel, obj having arg_max(op, seq) = 'write'")
def active_facts_last_op(spark: SparkSession, d: str) -> DataFrame:
    return store.state(log(spark, d))


@query(f"""with {LOG}, w as (select *, row_number() over (partition by subj, rel order by seq desc) as k from log where op = 'write')
select subj, rel, obj, provenance, seq from w where k = 1 and not exists (select 1 from log f where f.op = 'forget' and f.subj = w.subj and f.rel = w.rel and f.obj is not distinct from w.obj and f.seq > w.seq)""")
def supersede_latest(spark: SparkSession, d: str) -> DataFrame:
    return store.supersede(log(spark, d))


@query(f"""with {LOG}, s as (select subj, rel, obj, arg_max(provenance, seq) as provenance from log group by subj, rel, obj having arg_max(op, seq) = 'write'),
asked as (select distinct subj, rel, obj from log) select a.subj, a.rel, a.obj, s.provenance, s.provenance is not null as supported from asked a left join s using (subj, rel, obj)""")
def provenance_lookup(spark: SparkSession, d: str) -> DataFrame:
    ops = log(spark, d)
    return store.provenance(ops.select("subj", "rel", "obj").distinct(), store.state(ops))


@query(f"""with {LOG}, s as (select subj, rel, obj from log group by all having arg_max(op, seq) = 'write'),
r as (select *, row_number() over (partition by subj, rel order by obj) as place from s) select subj, rel, obj, place from r where place <= 2""")
def deliberation_candidates(spark: SparkSession, d: str) -> DataFrame:
    s = store.state(log(spark, d)).select("subj", "rel", "obj")
    return store.candidates(s.select("subj", "rel").distinct(), s).select("subj", "rel", "obj", F.col("place").cast("long").alias("place"))


@query("""with f as (select distinct cast(user_id as varchar) as subj, event_type as rel, json_extract_string(props, '$.k') as obj from events)
select a.subj, a.rel, b.rel as other, count(*) filter (where a.obj <> b.obj) > 0 as differs from f a join f b on a.subj = b.subj and a.rel = 'click' and b.rel = 'view' group by a.subj, a.rel, b.rel""")
def both_ways_rate(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "events").select(F.col("user_id").cast("string").alias("subj"), F.col("event_type").alias("rel"), F.get_json_object("props", "$.k").alias("obj")).distinct()
    return store.both_ways(f, spark.createDataFrame([("click", "view")], "rel string, other string"))


@query(f"with {LOG} select count(*) filter (where provenance in ('user-stated', 'assistant-inferred', 'tool-derived') and obj is not null) as valid, count(*) as n from log")
def write_validation(spark: SparkSession, d: str) -> DataFrame:
    ops = log(spark, d)
    return store.valid_writes(ops).agg(F.count(F.lit(1)).alias("valid")).join(F.broadcast(ops.agg(F.count(F.lit(1)).alias("n"))))


# -- lossy recall ---------------------------------------------------------------------------------

PAGE = 32


def paged(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.floor(F.col("c_custkey") / PAGE).alias("page"), F.col("c_name").alias("subj"), F.lit("in nation").alias("rel"), F.col("n_name").alias("obj"))


def asked_keys(spark: SparkSession, d: str) -> DataFrame:
    """Every written key, and for each as many that nobody wrote."""
    f = paged(spark, d).select("page", "subj", "rel")
    return f.unionByName(f.withColumn("subj", F.concat(F.lit("no "), "subj")))


#: 32 facts a page lie below half of what 1024 dimensions hold for 25 names.
DIM = 1024
_BIT = "case when (instr('0123456789abcdef', substr(md5({n} || '#' || (p // 128)), p % 128 // 4 + 1, 1)) - 1) & (8 >> (p % 4)) > 0 then 1 else -1 end"
RECALL = f"""pos as (select unnest(range({DIM})) as p),
f as (select c_custkey // {PAGE} as page, c_name as subj, 'in nation' as rel, n_name as obj from customer join nation on c_nationkey = n_nationkey),
asked as (select page, subj, rel from f union all select page, 'no ' || subj, rel from f),
names as (select distinct subj as name from asked union select distinct rel from f union select distinct obj from f),
atoms as materialized (select name, p, {_BIT.format(n="name")} as x from names, pos),
bundle as (select page, s.p, case when sum(s.x * r.x * o.x) >= 0 then 1 else -1 end as b from f
  join atoms s on s.name = subj join atoms r on r.name = rel and r.p = (s.p + {DIM} - 1) % {DIM} join atoms o on o.name = obj and o.p = (s.p + {DIM} - 2) % {DIM} group by page, s.p),
got as (select a.page, a.subj, a.rel, (bundle.p + {DIM} - 2) % {DIM} as p, b * s.x * r.x as x from asked a join bundle on bundle.page = a.page
  join atoms s on s.name = a.subj and s.p = bundle.p join atoms r on r.name = a.rel and r.p = (bundle.p + {DIM} - 1) % {DIM}),
dots as (select g.page, g.subj, g.rel, c.name, sum(g.x * c.x) as dot from got g join atoms c on c.p = g.p where c.name in (select distinct obj from f) group by all),
ranked as (select *, row_number() over (partition by page, subj, rel order by dot desc, name) as k from dots),
told as (select page, subj, rel, max(name) filter (where k = 1) as top1, cast(max(dot) filter (where k = 1) as bigint) as dot1, cast(max(dot) filter (where k = 2) as bigint) as dot2 from ranked where k <= 2 group by all),
sizes as (select page, count(*) as n from f group by page)"""


@query(f"with {RECALL} select told.*, n from told join sizes using (page)")
def recall_top1_margin(spark: SparkSession, d: str) -> DataFrame:
    f = paged(spark, d)
    return recall.recall(f, asked_keys(spark, d), f.select(F.col("obj").alias("name")), DIM)


@query(f"with {RECALL} select f.page, f.subj, f.rel, f.obj, top1 = f.obj and dot1 > 0 as accepted from f join told using (page, subj, rel)")
def echo_check(spark: SparkSession, d: str) -> DataFrame:
    f = paged(spark, d)
    return recall.echo_check(f, f.select(F.col("obj").alias("name")), DIM).select("page", "subj", "rel", "obj", "accepted")


@query(f"with {RECALL}, x as (select told.*, f.obj from told left join f using (page, subj, rel)) select obj is not null as written, count(*) as n, count(*) filter (where top1 = obj) as right_, round(avg(dot1) / {DIM}, 6) as mean_a from x group by 1")
def recall_accuracy(spark: SparkSession, d: str) -> DataFrame:
    x = recall_top1_margin(spark, d).drop("n").join(paged(spark, d), ["page", "subj", "rel"], "left")
    return x.groupBy(F.col("obj").isNotNull().alias("written")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("top1") == F.col("obj")).alias("right_"), r6(F.avg("dot1") / DIM).alias("mean_a"))


@query(f"""with pos as (select unnest(range(128)) as p), names as (select n_name as name from nation),
atoms as (select name, p, {_BIT.format(n="name")} as x from names, pos) select p as pos, cast(sum(x) as bigint) as s from atoms group by p""")
def bundle_sum(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select(F.lit(1).alias("g"), vec.atom(F.col("n_name"), 128).alias("v"))
    return vec.superpose(rows, ["g"], "v").select(F.posexplode("bundle").alias("pos", "s")).select(F.col("pos").cast("long").alias("pos"), F.col("s").cast("long").alias("s"))


@query("""with pos as (select unnest(range(128)) as p), n as (select n_name, r_name from nation join region on n_regionkey = r_regionkey),
x as (select n_name, p, """ + _BIT.format(n="n_name") + " as a, " + _BIT.format(n="r_name") + """ as b from n, pos)
select x.n_name, cast(sum(x.a * x.b) as bigint) as overlap, cast(sum(x.a * x.b * y.b * y.a) as bigint) as back, cast(sum(x.a * y.a) as bigint) as shifted from x join x y on x.n_name = y.n_name and y.p = (x.p + 1) % 128 group by 1""")
def bind_permute_algebra(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    t = t.select("n_name", vec.atom(F.col("n_name"), 128).alias("a"), vec.atom(F.col("r_name"), 128).alias("b"))
    ab = vec.bind(F.col("a"), F.col("b"))
    left = lambda c: vec.permute(c, -1, 128)
    dot = lambda x, y: vec.dot(x, y).cast("long")
    return t.select("n_name", dot(F.col("a"), F.col("b")).alias("overlap"), dot(ab, left(ab)).alias("back"), dot(F.col("a"), left(F.col("a"))).alias("shifted"))


_SD = (1024 / DIM * 8) ** 0.5  # from 8192 dimensions, where sds were measured
_ROUTES = f"""{RECALL}, exact as (select page, subj, rel, count(distinct obj) as objects, min(obj) as obj from f group by all),
x as (select t.page, t.subj, t.rel, e.objects, e.obj, e.objects is not null as hit, dot1 / {DIM}.0 as a, (dot1 - dot2) / {DIM}.0 as m_l1, sqrt(2 / (pi() * greatest(n, 1))) as mh, sqrt(2 * ln(25.0) / {DIM}) as mn from told t join sizes using (page) left join exact e using (page, subj, rel)),
y as (select *, (a - (mh * {0.004 * _SD} + mn * {0.011 * _SD}) / {0.015 * _SD}) / {0.0075 * _SD} as z, case when objects > 1 then 0.0 else 1.0 end as m_l2 from x),
o as (select *, 1 / (1 + exp(-z)) as known, 1 - 1 / (1 + exp(-((1.0 - 0.19) / 0.08))) as ref, case when hit then 1 - 1 / (1 + exp(-((m_l2 - 0.4528) / 0.0342))) end as sto from y),
w as (select *, known * (1 - greatest(ref, coalesce(sto, ref))) as b, known * greatest(ref, coalesce(sto, ref)) as d, 1 - known as u, case when sto is null or ref >= sto then 'referential' else 'stored' end as tag from o),
r as (select *, case when mh <= mn + {0.004 * _SD} then 'recollect' when u >= 0.85 then 'abstain' when u >= 0.35 then 'recollect' when d > b then 'deliberate' else 'answer' end as action from w)
select page, subj, rel, hit, objects, round(a, 6) as a, round(m_l1, 6) as m_l1, round(b, 6) as b, round(d, 6) as d, round(u, 6) as u, action, case when action = 'deliberate' then tag end as tag,
case when action in ('answer', 'recollect') and objects = 1 then obj end as answer from r"""


@query(f"with {_ROUTES}")
def memory_routes(spark: SparkSession, d: str) -> DataFrame:
    f = paged(spark, d)
    out = memory_query.query(f, asked_keys(spark, d), f.select(F.col("obj").alias("name")), DIM)
    return out.select("page", "subj", "rel", "hit", "objects", *(r6(c).alias(c) for c in ("a", "m_l1", "b", "d", "u")), "action", "tag", "answer")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_routes(spark, sf_dir)


# -- the gate -------------------------------------------------------------------------------------


@query("""select o_orderkey as k, round(sqrt(2 / (pi() * k)), 6) as mu_hit, round(sqrt(2 * ln(k + 1.0) / 8192), 6) as mu_null, round(8192 / (pi() * ln(k + 1.0)), 6) as k_max,
round(0.5 * (8192 / (pi() * ln(k + 1.0))), 6) as paging, round(2 * 0.9 * 0.9 / (pi() * pow(sqrt(2 * ln(k + 1.0) / 8192) + 0.004, 2)), 6) as k_sat, sqrt(2 / (pi() * k)) <= sqrt(2 * ln(k + 1.0) / 8192) + 0.004 as saturated
from (select o_orderkey, o_orderkey as k from orders where o_orderkey > 0)""")
def capacity_law(spark: SparkSession, d: str) -> DataFrame:
    k, n, dim = F.col("o_orderkey"), F.col("o_orderkey") + F.lit(1.0), F.lit(8192)
    mu_n, sd = gate.mu_null(n, dim), F.lit(0.004)
    return table(spark, d, "orders").where(k > 0).select(
        k.alias("k"), r6(gate.mu_hit(k)).alias("mu_hit"), r6(mu_n).alias("mu_null"), r6(gate.k_max(n, dim)).alias("k_max"), r6(gate.paging_threshold(n, dim)).alias("paging"),
        r6(gate.k_sat(F.lit(0.9), mu_n, sd)).alias("k_sat"), gate.saturated(gate.mu_hit(k), mu_n, sd).alias("saturated"),
    )


_Z = "(l_discount * 40 - 2) as z, (l_tax * 20 - 0.5) as m_z, l_quantity / 50.0 as m_ref, l_extendedprice / 100000.0 as m_l2"
_OPINION = f"""x as (select l_orderkey, l_linenumber, {_Z} from lineitem),
p as (select *, 1 / (1 + exp(-z)) as known, 1 / (1 + exp(-m_z)) as s, 1 - 1 / (1 + exp(-((m_ref - 0.19) / 0.08))) as ref, 1 - 1 / (1 + exp(-((m_l2 - 0.4528) / 0.0342))) as sto from x),
o as (select *, 1 - known as u, known * (1 - greatest(ref, sto)) as b, known * greatest(ref, sto) as d, case when ref >= sto then 'referential' else 'stored' end as tag from p)"""


def signals(spark: SparkSession, d: str) -> DataFrame:
    c = lambda n: F.col(n).cast("double")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (c("l_discount") * 40 - 2).alias("z"), (c("l_tax") * 20 - 0.5).alias("m_z"), (c("l_quantity") / 50.0).alias("m_ref"), (c("l_extendedprice") / 100000.0).alias("m_l2")
    )


@query(f"with {_OPINION} select l_orderkey, l_linenumber, round(known * s, 6) as b, round(known * (1 - s), 6) as d, round(u, 6) as u from o")
def opinion_bdu(spark: SparkSession, d: str) -> DataFrame:
    o = signals(spark, d).withColumn("o", gate.opinion(F.col("z"), F.col("m_z")))
    return o.select("l_orderkey", "l_linenumber", *(r6(f"o.{k}").alias(k) for k in "bdu"))


@query(f"with {_OPINION} select l_orderkey, l_linenumber, round(b, 6) as b, round(d, 6) as d, round(u, 6) as u, tag from o")
def opinion_two_source(spark: SparkSession, d: str) -> DataFrame:
    return two_source(spark, d).select("l_orderkey", "l_linenumber", *(r6(f"o.{k}").alias(k) for k in "bdu"), "o.tag")


def two_source(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).withColumn("o", gate.opinion_two_source(F.col("z"), F.col("m_ref"), F.col("m_l2"), F.col("m_z")))


_ROUTE = "case when m_z > 0.9 then 'recollect' when u >= 0.85 then 'abstain' when u >= 0.35 then 'recollect' when d > b then 'deliberate' else 'answer' end"


@query(f"with {_OPINION}, r as (select *, {_ROUTE} as action from o) select l_orderkey, l_linenumber, action, case when action = 'deliberate' then tag end as tag from r")
def route_actions(spark: SparkSession, d: str) -> DataFrame:
    return routed(spark, d).select("l_orderkey", "l_linenumber", "action", gate.route_tag(F.col("action"), F.col("o.tag")).alias("tag"))


def routed(spark: SparkSession, d: str) -> DataFrame:
    return two_source(spark, d).withColumn("action", gate.route(F.col("o.b"), F.col("o.d"), F.col("o.u"), F.col("m_z") > 0.9, F.lit(True)))


@query(f"with {_OPINION}, r as (select *, {_ROUTE} as action from o) select action, case when action = 'deliberate' then tag end as tag, count(*) as n, round(avg(u), 6) as mean_u from r group by 1, 2")
def route_by_kind(spark: SparkSession, d: str) -> DataFrame:
    r = routed(spark, d).select("action", gate.route_tag(F.col("action"), F.col("o.tag")).alias("tag"), F.col("o.u").alias("u"))
    return r.groupBy("action", "tag").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("u")).alias("mean_u"))


@query(f"with {_OPINION} select l_orderkey, l_linenumber, round(b, 6) as belief, round(case when b + d <= 1e-12 then 0.5 else b / (b + d) end, 6) as share, round(1 - u, 6) as certainty from o")
def gate_scalars(spark: SparkSession, d: str) -> DataFrame:
    s = two_source(spark, d).withColumn("s", gate.scalars(F.col("o.b"), F.col("o.d"), F.col("o.u")))
    return s.select("l_orderkey", "l_linenumber", *(r6(f"s.{k}").alias(k) for k in ("belief", "share", "certainty")))


@query(f"""with x as (select l_orderkey, l_linenumber, {_Z} from lineitem) select l_orderkey, l_linenumber, round((m_ref - (0.12 * 0.004 + 0.03 * 0.011) / 0.015) / 0.0075, 6) as z, round((m_l2 - 0.5 * (0.12 - 0.03)) / 0.014, 6) as m_z,
round(case when m_ref <= 0.1 then 1.0 when m_ref <= 0.5 then 1.0 + (m_ref - 0.1) * ((3.0 - 1.0) / (0.5 - 0.1)) when m_ref <= 0.9 then 3.0 + (m_ref - 0.5) * ((2.0 - 3.0) / (0.9 - 0.5)) else 2.0 end, 6) as level from x""")
def normalised_scores(spark: SparkSession, d: str) -> DataFrame:
    h, sh, n, sn = F.lit(0.12), F.lit(0.011), F.lit(0.03), F.lit(0.004)
    return signals(spark, d).select(
        "l_orderkey", "l_linenumber", r6(gate.z_resolution(F.col("m_ref"), h, sh, n, sn)).alias("z"), r6(gate.z_margin(F.col("m_l2"), h, n, F.lit(0.014))).alias("m_z"),
        r6(gate.interpolate(F.col("m_ref"), [(0.1, 1.0), (0.5, 3.0), (0.9, 2.0)])).alias("level"),
    )


# -- the registry ---------------------------------------------------------------------------------


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("name"), F.col("embedding").alias("e"), "label")


_Q = "q as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1048576 + 0.5) as double)) as v from embeddings)"
_TOP = f"""{_Q}, d as (select a.vec_id as term, b.vec_id as name, list_dot_product(a.v, b.v) as dot from q a, q b where a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by term order by dot desc, name) as place from d), top as (select * from r where place <= 2)"""


def others(spark: SparkSession, d: str) -> DataFrame:
    """Each name's two nearest other names."""
    v = vectors(spark, d)
    found = registry.resolve(v.select(F.col("name").alias("term"), "e"), v.select("name", "e"), top=3).where("term <> name")
    w = Window.partitionBy("term").orderBy(F.desc("dot"), "name")
    return found.withColumn("place", F.row_number().over(w)).where("place <= 2")


@query(f"with {_TOP} select term, cast(place as bigint) as place, name, round(dot / 1099511627776, 6) as cos from top")
def resolve_top2(spark: SparkSession, d: str) -> DataFrame:
    return others(spark, d).select("term", F.col("place").cast("long").alias("place"), "name", r6(F.col("dot") / float(1 << 40)).alias("cos"))


@query(f"with {_TOP} select term, max(name) filter (where place = 1) as name, round((max(dot) filter (where place = 1) - max(dot) filter (where place = 2)) / 1099511627776, 6) as m_ref from top group by term")
def referential_margin(spark: SparkSession, d: str) -> DataFrame:
    return registry.margin(others(spark, d)).select("term", "name", r6("m_ref").alias("m_ref"))


@query(f"with {_TOP} select term, case when dot / 1099511627776 >= 0.5 then cast(name as varchar) else cast(term as varchar) end as canonical, dot / 1099511627776 >= 0.5 as matched from top where place = 1")
def canonicalise_threshold(spark: SparkSession, d: str) -> DataFrame:
    return registry.canonicalise(others(spark, d), 0.5)


@query(f"with {_TOP} select count(*) as n, round(avg(dot) / 1099511627776, 6) as mean_best, round(max(dot) / 1099511627776, 6) as max_best from top where place = 1")
def loo_max_floor(spark: SparkSession, d: str) -> DataFrame:
    best = registry.leave_one_out(vectors(spark, d).select("name", "e"))
    return best.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("best") / float(1 << 40)).alias("mean_best"), r6(F.max("best") / float(1 << 40)).alias("max_best"))


_PROJ = 16
_PBIT = "case when (instr('0123456789abcdef', substr(md5('proj' || r || '#0'), p // 4 + 1, 1)) - 1) & (8 >> (p % 4)) > 0 then 1 else -1 end"


@query(f"""with {_Q}, e as (select vec_id, unnest(v) as x, unnest(range(len(v))) as p from q), m as (select r, p, {_PBIT} as s from (select unnest(range({_PROJ})) as r), (select unnest(range(64)) as p)),
b as (select vec_id, r, case when sum(x * s) >= 0 then 1 else 0 end as bit from e join m using (p) group by all)
select vec_id as name, string_agg(cast(bit as varchar), '' order by r) as bits from b group by vec_id""")
def sign_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = vec.atoms([f"proj{r}" for r in range(_PROJ)], 128)[:, :64].astype(np.float64)
    out = registry.sign_projection(vectors(spark, d), rows)
    return out.select("name", F.array_join(F.transform("bits", lambda b: F.when(b > 0, "1").otherwise("0")), "").alias("bits"))


@query(f"""with {_Q}, g as (select label, list_dot_product(v, v) as n2, v from q) select label, count(*) as n, round(avg(n2) / 1099511627776, 6) as mean_norm2 from g group by label""")
def norm_by_label(spark: SparkSession, d: str) -> DataFrame:
    q = vec.quantised(F.col("e"))
    return vectors(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(vec.dot(q, q)) / float(1 << 40)).alias("mean_norm2"))


@query(f"""with {_TOP}, h as (select t.term, a.label, max(case when place = 1 and b.label = a.label then 1 else 0 end) as top1, max(case when b.label = a.label then 1 else 0 end) as top2 from top t join q a on a.vec_id = t.term join q b on b.vec_id = t.name group by all)
select label, count(*) as n, round(avg(top1), 6) as top1, round(avg(top2), 6) as top2 from h group by rollup (label)""")
def generalization_rollup(spark: SparkSession, d: str) -> DataFrame:
    labels = vectors(spark, d).select("name", "label")
    t = others(spark, d).join(labels, "name").withColumnRenamed("label", "found").join(labels.select(F.col("name").alias("term"), "label"), "term")
    h = t.groupBy("term", "label").agg(F.max(((F.col("place") == 1) & (F.col("found") == F.col("label"))).cast("int")).alias("top1"), F.max((F.col("found") == F.col("label")).cast("int")).alias("top2"))
    return h.rollup("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("top1")).alias("top1"), r6(F.avg("top2")).alias("top2"))


# -- statistics -----------------------------------------------------------------------------------

_SCORED = """scored as (select d.doc_id, d.lang, l.quality = 1 as correct, (d.doc_id * 7919 % 1000 + length(d.text) % 97) / 1100.0 as conf, (length(d.text) % 1009) / 1009.0 as other from documents d join labels l using (doc_id) where l.quality is not null)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").where("quality is not null").select(
        "doc_id", "lang", (F.col("quality") == 1).alias("correct"), ((F.col("doc_id") * 7919 % 1000 + n % 97) / 1100.0).alias("conf"), (n % 1009 / 1009.0).alias("other")
    )


_RANKED = """r as (select *, rank() over (partition by lang order by conf) + (count(*) over (partition by lang, conf) - 1) / 2.0 as k from scored)"""


@query(f"with {_SCORED}, {_RANKED} select lang, round((sum(k) filter (where correct) - count(*) filter (where correct) * (count(*) filter (where correct) + 1) / 2.0) / nullif(count(*) filter (where correct) * count(*) filter (where not correct), 0), 6) as auroc from r group by lang")
def auroc_by_group(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auroc(scored(spark, d), ["lang"], "conf", "correct").select("lang", r6("auroc").alias("auroc"))


@query(f"with {_SCORED} select lang, round(0.5 * (avg(case when correct then cast(conf < 0.5 as int) end) + avg(case when not correct then cast(conf >= 0.5 as int) end)), 6) as balanced_accuracy from scored group by lang")
def balanced_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.balanced_accuracy(scored(spark, d), ["lang"], "conf", "correct", 0.5).select("lang", r6("balanced_accuracy").alias("balanced_accuracy"))


@query(f"""with {_SCORED}, t as (select distinct lang, conf as threshold from scored),
a as (select t.lang, threshold, 0.5 * (avg(case when correct then cast(conf < threshold as int) end) + avg(case when not correct then cast(conf >= threshold as int) end)) as acc from t join scored s on s.lang = t.lang group by all)
select lang, round(max(acc), 6) as balanced_accuracy from a group by lang""")
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return metrics.best_threshold(scored(spark, d), ["lang"], "conf", "correct").select("lang", r6("balanced_accuracy").alias("balanced_accuracy"))


@query(f"""with {_SCORED}, b as (select lang, least(9, cast(floor(conf * 10 + 1e-12) as int)) as bin, correct, conf from scored) select lang, bin, count(*) as n, round(avg(cast(correct as int)), 6) as accuracy, round(avg(conf), 6) as confidence from b group by lang, bin""")
def ece_bins(spark: SparkSession, d: str) -> DataFrame:
    b = metrics.ece_bins(scored(spark, d), ["lang"], "conf", "correct")
    return b.select("lang", "bin", "n", r6("accuracy").alias("accuracy"), r6("confidence").alias("confidence"))


@query(f"""with {_SCORED}, b as (select lang, least(9, cast(floor(conf * 10 + 1e-12) as int)) as bin, count(*) as n, avg(cast(correct as int)) as a, avg(conf) as c from scored group by all) select lang, round(sum(n * abs(a - c)) / sum(n), 6) as ece from b group by lang""")
def expected_calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ece(scored(spark, d), ["lang"], "conf", "correct").select("lang", r6("ece").alias("ece"))


@query(f"""with {_SCORED}, e as (select lang, quantile_cont(conf, [0.25, 0.5, 0.75]) as q from scored group by lang) select lang, correct, cast(len(list_filter(q, lambda x: x <= conf + 1e-12)) as int) as rating, count(*) as n from scored join e using (lang) group by all""")
def rating_table(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rating_table(scored(spark, d), ["lang"], "conf", "correct")


@query(f"with {_SCORED} select lang, round((avg(case when correct then conf end) - avg(case when not correct then conf end)) / nullif(sqrt(0.5 * (var_samp(case when correct then conf end) + var_samp(case when not correct then conf end))), 0), 6) as d from scored group by lang")
def cohens_d(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cohens_d(scored(spark, d), ["lang"], "conf", "correct").select("lang", r6("d").alias("d"))


@query(f"""with {_SCORED}, c as (select lang, count(*) filter (where conf >= 0.5 and correct) as tp, count(*) filter (where conf >= 0.5 and not correct) as fp, count(*) filter (where conf < 0.5 and correct) as fn, count(*) filter (where conf < 0.5 and not correct) as tn from scored group by lang)
select *, round(coalesce(tp / nullif(tp + fp, 0), 1.0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 1.0), 6) as recall from c""")
def confusion_pr(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.confusion(scored(spark, d).withColumn("said", F.col("conf") >= 0.5), ["lang"], "said", "correct")
    return c.withColumn("precision", r6("precision")).withColumn("recall", r6("recall"))


@query(f"with {_SCORED} select lang, cast(ceil(pow((1.959964 + 0.841621) * stddev_samp(conf - other) / 0.02, 2)) as bigint) as n_needed from scored group by lang")
def power_n(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("lang").agg(metrics.power_n(F.stddev_samp(F.col("conf") - F.col("other")), F.lit(0.02)).cast("long").alias("n_needed"))


_REPS, _PERMS = 2000, 1000
_BOOT = f"""{_SCORED}, i as (select *, row_number() over (order by md5(cast(doc_id as varchar))) - 1 as k from scored), n as (select count(*) as n from scored),
c as (select rep, ('0x' || substr(md5(rep || ':' || k), 1, 7))::bigint % n as k from i, n, (select unnest(range(1, {_REPS + 1})) as rep)),
s as (select rep, correct, 'conf' as source, conf as x from c join i using (k) union all select rep, correct, 'other', other from c join i using (k)),
r as (select *, rank() over (partition by rep, source order by x) + (count(*) over (partition by rep, source, x) - 1) / 2.0 as k from s),
a as (select rep, source, (sum(k) filter (where correct) - count(*) filter (where correct) * (count(*) filter (where correct) + 1) / 2.0) / nullif(count(*) filter (where correct) * count(*) filter (where not correct), 0) as auroc from r group by rep, source)"""


@query(f"with {_BOOT} select source, round(quantile_cont(auroc, 0.025), 6) as low, round(quantile_cont(auroc, 0.975), 6) as high, round(stddev_samp(auroc), 6) as sd, count(auroc) as replicates from a group by source")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    a = metrics.bootstrap(scored(spark, d), "doc_id", ["conf", "other"], "correct", _REPS)
    return a.groupBy("source").agg(r6(F.percentile("auroc", F.lit(0.025))).alias("low"), r6(F.percentile("auroc", F.lit(0.975))).alias("high"), r6(F.stddev_samp("auroc")).alias("sd"), F.count("auroc").alias("replicates"))


@query(f"with {_BOOT} select round(quantile_cont(x.auroc - y.auroc, 0.025), 6) as low, round(quantile_cont(x.auroc - y.auroc, 0.975), 6) as high from a x join a y using (rep) where x.source = 'conf' and y.source = 'other'")
def bootstrap_difference(spark: SparkSession, d: str) -> DataFrame:
    wide = metrics.bootstrap(scored(spark, d), "doc_id", ["conf", "other"], "correct", _REPS).groupBy("rep").pivot("source", ["conf", "other"]).agg(F.first("auroc"))
    gap = F.col("conf") - F.col("other")
    return wide.agg(r6(F.percentile(gap, F.lit(0.025))).alias("low"), r6(F.percentile(gap, F.lit(0.975))).alias("high"))


def _perm(within: str) -> str:
    part = f"rep{', ' + within if within else ''}"
    return f"""{_SCORED}, x as (select scored.*, rep from scored, (select unnest(range(1, {_PERMS + 1})) as rep)),
l as (select rep, lang, correct, row_number() over (partition by {part} order by md5(cast(doc_id as varchar))) as k from x), m as (select rep, correct, conf, row_number() over (partition by {part} order by md5(rep || ':' || doc_id)) as k from x),
p as (select l.rep, l.correct, m.conf from l join m on l.rep = m.rep and l.k = m.k {"and l.correct = m.correct" if within else ""}),
r as (select *, rank() over (partition by rep order by conf) + (count(*) over (partition by rep, conf) - 1) / 2.0 as k from p),
a as (select rep, (sum(k) filter (where correct) - count(*) filter (where correct) * (count(*) filter (where correct) + 1) / 2.0) / nullif(count(*) filter (where correct) * count(*) filter (where not correct), 0) as auroc from r group by rep)"""


@query(f"""with {_perm('')}, w as (select correct, rank() over (order by conf) + (count(*) over (partition by conf) - 1) / 2.0 as k from scored),
obs as (select (sum(k) filter (where correct) - count(*) filter (where correct) * (count(*) filter (where correct) + 1) / 2.0) / nullif(count(*) filter (where correct) * count(*) filter (where not correct), 0) as o from w)
select round(any_value(o), 6) as observed, round(avg(auroc), 6) as mean, round(stddev_samp(auroc), 6) as sd, count(*) as replicates, round(avg(case when auroc >= o - 1e-12 then 1.0 else 0.0 end), 6) as p from a, obs""")
def permutation_null(spark: SparkSession, d: str) -> DataFrame:
    """The observed AUROC against confidences dealt anew: mean and sd of the null, and the share of it that is as high."""
    x = scored(spark, d)
    a = metrics.permuted_aurocs(x, "doc_id", "conf", "correct", _PERMS)
    # Null is the highest confidence, as in the SQL and the null distribution.
    seen = metrics.auroc(x.withColumn("conf", F.coalesce(F.col("conf").cast("double"), F.lit(math.nan))), [], "conf", "correct").withColumnRenamed("auroc", "observed")
    high = (F.col("auroc") >= F.col("observed") - 1e-12).cast("double")
    return a.join(F.broadcast(seen)).agg(r6(F.first("observed")).alias("observed"), r6(F.avg("auroc")).alias("mean"), r6(F.stddev_samp("auroc")).alias("sd"), F.count(F.lit(1)).alias("replicates"), r6(F.avg(high)).alias("p"))


@query(f"with {_perm('correct')} select rep, round(auroc, 6) as auroc from a")
def stratified_null_invariance(spark: SparkSession, d: str) -> DataFrame:
    a = metrics.permuted_aurocs(scored(spark, d), "doc_id", "conf", "correct", _PERMS, ["correct"])
    return a.select(F.col("rep").cast("long").alias("rep"), r6("auroc").alias("auroc"))


@query(f"""with {_SCORED}, s as (select lang, avg(cast(correct as int)) as acc, avg(conf) as c, count(*) as n from scored group by lang) select lang, n, round(acc, 6) as acc, acc between 0.55 and 0.95 as eligible, case when acc < 0.55 then 'too low' when acc > 0.95 then 'too high' end as reason from s""")
def eligibility_window(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("a"))
    return s.select("lang", "n", r6("a").alias("acc"), F.col("a").between(0.55, 0.95).alias("eligible"), F.when(F.col("a") < 0.55, "too low").when(F.col("a") > 0.95, "too high").alias("reason"))


# -- text -----------------------------------------------------------------------------------------

_INTENT = r"""case when regexp_matches(text, '(?i)^\s*(forget|delete|remove|drop)([^a-z]|$)') then 'forget' when regexp_matches(text, '(?i)^\s*(who|what|where|when|which|how|is|are|does|do|did)([^a-z]|$)') or regexp_matches(text, '\?\s*$') then 'question' else 'statement' end"""


@query(f"select conv_id, turn, {_INTENT} as intent from conversations")
def intent_routing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.intent(F.col("text")).alias("intent"))


@query(f"""with {TRIPLES}, t as (select distinct subj, rel, obj from triples) select subj, rel, obj, case rel when 'in nation' then subj || ' is from ' || obj || '.' when 'in segment' then subj || ' buys for ' || obj || '.' when 'in region' then subj || ' lies in ' || obj || '.' when 'has brand' then subj || ' is of brand ' || obj || '.' end as body from t""")
def render_templates(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d).distinct().withColumn("body", text.render(F.col("subj"), F.col("rel"), F.col("obj")))


@query("select c_name || ' (client)' as subj, 'in nation' as rel, n_name as obj from customer join nation on c_nationkey = n_nationkey where c_custkey % 3 <> 0")
def triple_parse(spark: SparkSession, d: str) -> DataFrame:
    """Triples written out as lines, some hedged, some broken, and read back."""
    f = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    line = F.concat(F.lit("("), "c_name", F.lit(" (client) |  IN Nation | "), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("maybe "), "n_name")).otherwise(F.col("n_name")), F.lit(")\nno triple | here\n"))
    return text.parse_triples(f.select(F.concat(line, line).alias("text")), "text")


@query(r"select c_custkey, regexp_matches(c_mktsegment || ' ' || c_name, '(?i)(^|[^a-z])(maybe|perhaps|might|possibly|not|never|no longer|used to|think|guess|household)([^a-z]|$)') as hedged from customer")
def hedge_filter(spark: SparkSession, d: str) -> DataFrame:
    own = text.HEDGE.replace("guess", "guess|household")
    return table(spark, d, "customer").select("c_custkey", F.concat_ws(" ", "c_mktsegment", "c_name").rlike(own).alias("hedged"))


@query(r"""with w as (select conv_id, turn, text, regexp_split_to_array(trim(split_part(text, '.', 1)), '\s+') as w from conversations)
select conv_id, turn, len(list_filter(w, lambda x: x <> '')) between 1 and 8 and not regexp_matches(split_part(text, '.', 1), '(?i)(^|[^a-z])(because|remember|stored|recorded|fact|memory|since)([^a-z]|$)')
  and len(list_filter(w[2:], lambda x: regexp_matches(x, '^[A-Z]') and not regexp_matches(x, '^I([^A-Za-z]|$)'))) = 0 as ok from w""")
def leadin_verify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.leadin_ok(F.split_part("text", F.lit("."), F.lit(1))).alias("ok"))


@query("select p_partkey, case when regexp_extract(p_name || p_type, '([0-9]{1,3})', 1) = '' then 0.5 else least(cast(regexp_extract(p_name || p_type, '([0-9]{1,3})', 1) as int), 100) / 100.0 end as conf from part")
def parse_int_confidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.parse_confidence(F.concat("p_name", "p_type")).alias("conf"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_verdict_parse(spark: SparkSession, d: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n``` done"))
    return table(spark, d, "events").select("event_id", text.json_object(fenced, "k long")["k"].alias("k"))


@query("""with b as (select item_id, text from benchmark where length(text) > 0), d as (select doc_id, text from documents) select d.doc_id, count(*) as bodies, min(b.item_id) as first_item from d join b on contains(d.text, b.text) group by d.doc_id""")
def surface_leak_hits(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a benchmark passage word for word: candidates by a shared rare word, then containment."""
    bench = table(spark, d, "benchmark").where(F.length("text") > 0)
    # Inner words of a passage stand in its holder as they are; the rarest decides who is looked at.
    cut_words = lambda c: F.array_distinct(F.split(c, r"[ \n]"))
    last = F.element_at(F.split("text", r"[ \n]"), -1)
    inner = F.filter(F.slice(cut_words(F.col("text")), 2, 1_000_000), lambda w: (w != "") & (w != last))
    words = bench.select("item_id", "text", F.explode(inner).alias("w"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    seen = docs.select("doc_id", F.explode(cut_words(F.col("text"))).alias("w")).join(words.select("w").distinct(), "w").cache()
    df = seen.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    rarest = words.join(df, "w").groupBy("item_id", "text").agg(F.min_by("w", F.struct("df", "w")).alias("w"))
    hits = seen.join(rarest, "w").select("doc_id", "item_id", F.col("text").alias("body")).join(docs, "doc_id").where(F.contains("text", "body"))
    # Passages without an inner word are looked for in every document.
    short = bench.where(F.size(inner) == 0).select("item_id", F.col("text").alias("body"))
    hits = hits.select("doc_id", "item_id").unionAll(docs.join(F.broadcast(short), F.contains("text", "body")).select("doc_id", "item_id"))
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("bodies"), F.min("item_id").alias("first_item"))


_SAID = "said as (select n_nationkey as id, n_name || ' trades with ' || r_name as output from nation join region on n_regionkey = r_regionkey)"


@query(f"""with {TRIPLES}, f as (select distinct subj, rel, obj, lower(subj || ' ' || rel || ' ' || obj) as blob from triples where rel in ('in region', 'in nation')), {_SAID},
w as (select distinct id, unnest(regexp_extract_all(lower(output), '[a-z0-9]{{4,}}')) as w from said),
m as (select distinct w.w, subj, rel, obj from (select distinct w from w) w join f on contains(blob, w.w)),
h as (select distinct id, subj, rel, obj from w join m using (w)), k as (select *, row_number() over (partition by id order by subj, rel, obj) as place, count(*) over (partition by id) as n from h)
select id, subj, rel, obj from k where place <= 150 union all select distinct id, '__TRUNCATED__', 'dropped', (n - 150) || ' more relevant facts' from k where n > 150""")
def relevant_facts(spark: SparkSession, d: str) -> DataFrame:
    """For each nation's sentence, the facts on nations and regions that share a token with it."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    said = n.select(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(" trades with "), "r_name").alias("output"), F.array().cast("array<string>").alias("bodies"))
    return leaks.relevant(said, triples(spark, d).where(F.col("rel").isin("in region", "in nation")))


@query("select s_suppkey, lower(s_name) as slot_, case s_suppkey % 3 when 0 then 'Ann Lee (doctor)' when 1 then 'my neighbour' end as bound from supplier")
def qualifier_binding(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    said = F.when(k == 0, F.concat(F.lit("I met my doctor Ann Lee near "), "s_name")).when(k == 1, F.lit("so my neighbour said")).otherwise(F.col("s_name"))
    return table(spark, d, "supplier").select("s_suppkey", text.slot(F.concat(F.lit("The "), "s_name", F.lit(" "))).alias("slot_"), text.qualified(said).alias("bound"))


# -- generators, models, streams ------------------------------------------------------------------


@query("""with i as (select 'id' as kind, c_name as subj, 'in nation' as rel, n_name as gold from customer join nation on c_nationkey = n_nationkey
union all select 'ood', s_name, 'in segment', null from supplier union all select 'ref', split_part(c_name, '#', 1), 'in nation', null from customer where c_custkey = 1)
select kind, subj, rel, gold, md5('7:' || subj || rel) as place from i""")
def corpus_items(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items: written keys, keys that nobody wrote, a name that fits many; ordered by hash."""
    f = paged(spark, d).select(F.lit("id").alias("kind"), "subj", "rel", F.col("obj").alias("gold"))
    none = F.lit(None).cast("string").alias("gold")
    ood = table(spark, d, "supplier").select(F.lit("ood").alias("kind"), F.col("s_name").alias("subj"), F.lit("in segment").alias("rel"), none)
    ref = table(spark, d, "customer").where("c_custkey = 1").select(F.lit("ref").alias("kind"), F.split_part("c_name", F.lit("#"), F.lit(1)).alias("subj"), F.lit("in nation").alias("rel"), none)
    return f.unionByName(ood).unionByName(ref).withColumn("place", F.md5(F.concat(F.lit("7:"), "subj", "rel")))


@query(f"with {RECALL}, x as (select told.*, f.obj from told left join f using (page, subj, rel)) select subj, coalesce(top1 = obj, false) as strict, coalesce(top1 = obj or regexp_matches(top1, '^U'), false) as either from x")
def strict_vs_either(spark: SparkSession, d: str) -> DataFrame:
    x = recall_top1_margin(spark, d).join(paged(spark, d), ["page", "subj", "rel"], "left")
    hit = F.coalesce(F.col("top1") == F.col("obj"), F.lit(False))
    return x.select("subj", hit.alias("strict"), (hit | F.col("top1").startswith("U")).alias("either"))


@query(f"with x as (select l_orderkey, l_linenumber, {_Z} from lineitem) select l_orderkey, l_linenumber, round(1 / (1 + exp(-(1.7755 + 2.6321 * (m_ref - 0.5) / 0.3 + 0.825 * (m_l2 - 0.4) / 0.2))), 6) as p from x")
def foil_predict(spark: SparkSession, d: str) -> DataFrame:
    # Weights, means and scales of a fitted head (fixed values).
    p = models.linear_readout([F.col("m_ref"), F.col("m_l2"), F.col("z")], [2.6321, 0.825, 0.0], [0.5, 0.4, 0.0], [0.3, 0.2, 0.0], 1.7755)
    return signals(spark, d).select("l_orderkey", "l_linenumber", r6(p).alias("p"))


@query()
def logistic_crossfit(spark: SparkSession, d: str) -> DataFrame:
    x = scored(spark, d).withColumn("y", F.col("correct").cast("int"))
    return models.cross_fit(x, "doc_id", ["conf", "other"], "y")


@query()
def meta_d(spark: SparkSession, d: str) -> DataFrame:
    """meta-d' per language: at most 8 counts a language come to the driver."""
    tables: dict[str, np.ndarray] = {}
    for r in metrics.rating_table(scored(spark, d), ["lang"], "conf", "correct").collect():
        tables.setdefault(r.lang, np.zeros((2, 4)))[int(r.correct), r.rating] = r.n
    return spark.createDataFrame([{"lang": k} | models.meta_d(v) for k, v in tables.items()], "lang string, eligible boolean, reason string, accuracy double, d double, meta_d double, m_ratio double")


@query()
def zca_whiten(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    mean, cov, _ = models.moments(v, "e")
    return models.whiten(v.select("name", "e"), "e", mean, models.zca(mean, cov))


@query(f"with {LOG} select subj, rel, obj, cast(sum(case when op = 'write' then 1 else -1 end) as bigint) as weight from log group by all")
def stream_accumulator(spark: SparkSession, d: str) -> DataFrame:
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    return live.drain(live.signed_sums(ops_of(source), ["subj", "rel", "obj"]), scratch(spark))


@query(f"with {LOG} select subj, rel, obj, arg_max(op, seq) as op, max(seq) as seq from log group by subj, rel, obj")
def stream_fact_state(spark: SparkSession, d: str) -> DataFrame:
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    return live.drain(live.last_state(ops_of(source)), scratch(spark), ["subj", "rel", "obj"])


def ops_of(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "forget").otherwise("write").alias("op"), F.col("user_id").cast("string").alias("subj"), F.lit("did").alias("rel"), F.get_json_object("props", "$.k").alias("obj"))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts from a stream in update mode."""
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    w = live.windowed(source.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
    return live.drain(w, scratch(spark), ["start", "event_type"])


@query(f"""with x as (select c_custkey // {PAGE} as page, n_name from customer join nation on c_nationkey = n_nationkey), s as (select page, count(*) as k, count(distinct n_name) as names from x group by page)
select page, k, names, k > 0.5 * {DIM} / (pi() * ln(25.0)) as over_half from s""")
def page_load(spark: SparkSession, d: str) -> DataFrame:
    s = paged(spark, d).groupBy("page").agg(F.count(F.lit(1)).alias("k"), F.count_distinct("obj").alias("names"))
    return s.withColumn("over_half", F.col("k") > gate.paging_threshold(F.lit(25.0), F.lit(DIM)))
