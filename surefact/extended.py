"""More queries with their SQL: the read path from terms, calibration, statistics, leak checks, generated corpora, sources."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import _BIT, _OPINION, _SCORED, _TOP, LOG, TRIPLES, log, others, query, r6, scored, signals, triples, vectors
from .functions import gate, text, vec
from .operators import calibration, corpora, encoding, leaks, metrics, models, recall
from .operators import facts as store
from .plans import memory_query
from .sources import io
from .sources.io import table

# -- names, encoded -------------------------------------------------------------------------------

_ENC = 256


def _encoded(names: str) -> str:
    """CTEs enc(name, v) of a CTE with a column name: trigram sums scaled to length 1, in 20-bit fixed point."""
    gram = _BIT.format(n="g")
    return f"""grams as (select name, substr('^' || lower(name) || '$', i, 3) as g from (select distinct name from {names}) z, (select unnest(range(1, 200)) as i) y where i <= length(name)),
gatoms as materialized (select g, p, {gram} as x from (select distinct g from grams) z, (select unnest(range({_ENC})) as p) y),
esum as (select name, p, sum(x) as s from grams join gatoms using (g) group by name, p),
enorm as (select name, sqrt(cast(sum(s * s) as double)) as norm from esum group by name),
enc as materialized (select name, list(cast(floor(s / norm * 1048576 + 0.5) as double) order by p) as v from esum join enorm using (name) group by name)"""


@query(f"""with n as (select n_name as name from nation union select r_name from region), {_encoded('n')},
pairs as (select a.name as term, b.name, list_dot_product(a.v, b.v) as dot from enc a join enc b on a.name <> b.name),
r as (select *, row_number() over (partition by term order by dot desc, name) as place from pairs)
select term, max(name) filter (where place = 1) as nearest, round(max(dot) filter (where place = 1) / 1099511627776, 6) as cos from r group by term""")
def encoded_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The nearest other name of each nation and region by encoded trigrams."""
    n = places(spark, d)
    found = encoding.resolve_names(n.withColumnRenamed("name", "term"), n)
    return found.select("term", F.col("second").alias("nearest"), r6(F.round(F.col("c1") - F.col("m_ref"), 12)).alias("cos"))


def places(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_name").alias("name")).union(table(spark, d, "region").select("r_name")).distinct()


_ROWS = 24
_PROJECT = "case when (instr('0123456789abcdef', substr(md5('row' || r || '#' || (p // 128)), p % 128 // 4 + 1, 1)) - 1) & (8 >> (p % 4)) > 0 then 1 else -1 end"


@query(f"""with n as (select n_name as name from nation union select r_name from region), {_encoded('n')},
e as (select name, unnest(v) as x, unnest(range({_ENC})) as p from enc), m as (select r, p, {_PROJECT} as s from (select unnest(range({_ROWS})) as r), (select unnest(range({_ENC})) as p)),
b as (select name, r, case when sum(x * s) >= 0 then '1' else '0' end as bit from e join m using (p) group by name, r) select name, string_agg(bit, '' order by r) as bits from b group by name""")
def encode_bipolar(spark: SparkSession, d: str) -> DataFrame:
    rows = vec.atoms([f"row{r}" for r in range(_ROWS)], _ENC).astype(np.float64)
    bits = encoding.encode_bipolar(places(spark, d), rows)
    return bits.select("name", F.array_join(F.transform("bits", lambda b: F.when(b > 0, "1").otherwise("0")), "").alias("bits"))


@query("""with x as (select n_name as name, md5(n_name) as h from nation) select count(*) = count(distinct name) as distinct_names, count(*) as n, 0 as wrong from x""")
def matrix_validation(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a caller brings are names with vectors of -1 and 1: distinct names, and how many rows hold anything else."""
    v = table(spark, d, "nation").select(F.col("n_name").alias("name"), vec.atom(F.col("n_name"), 128).alias("v"))
    return vec.validated(v).select("distinct_names", "n", "wrong")


@query(f"""with pos as (select unnest(range(128)) as p), f as (select n_name as s, 'in region' as r, r_name as o from nation join region on n_regionkey = r_regionkey)
select s, 128 as own_subj, 128 as own_rel, 1.0 as cos_self from f""")
def unbind_all_roles(spark: SparkSession, d: str) -> DataFrame:
    """A record gives back each of its parts exactly: dots of the unbound vectors with the parts."""
    f = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s, r, o = (vec.atom(c, 128) for c in (F.col("n_name"), F.lit("in region"), F.col("r_name")))
    x = f.select(F.col("n_name").alias("s_name"), s.alias("s"), r.alias("r"), o.alias("o")).withColumn("b", vec.record(F.col("s"), F.col("r"), F.col("o"), 128))
    own = lambda v, c: vec.dot(v, F.col(c)).cast("int")
    b, s_, r_, o_ = F.col("b"), F.col("s"), F.col("r"), F.col("o")
    unit = vec.unit(vec.unbind_subj(b, r_, o_, 128))
    return x.select(F.col("s_name").alias("s"), own(vec.unbind_subj(b, r_, o_, 128), "s").alias("own_subj"), own(vec.unbind_rel(b, s_, o_, 128), "r").alias("own_rel"), r6(vec.cosine(unit, s_)).alias("cos_self"))


# -- the read path from terms ---------------------------------------------------------------------

_D, _KD = 8192, 512


def region_facts(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's region, and for every fifth a second one that contradicts it."""
    n, r = table(spark, d, "nation"), table(spark, d, "region").select(F.col("r_regionkey").alias("k"), "r_name")
    own = n.join(r, F.col("n_regionkey") == F.col("k")).select("n_name", "r_name")
    more = n.where("n_nationkey % 5 = 0").join(r, F.pmod(F.col("n_regionkey") + 1, F.lit(5)) == F.col("k")).select("n_name", "r_name")
    return own.union(more).select(F.lit(0).cast("long").alias("page"), F.col("n_name").alias("subj"), F.lit("in region").alias("rel"), F.col("r_name").alias("obj"), F.lit("user-stated").alias("provenance"))


_TERMS = f"""f as (select n_name as subj, 'in region' as rel, r_name as obj from nation join region on n_regionkey = r_regionkey
 union all select n_name, 'in region', r_name from nation join region on (n_regionkey + 1) % 5 = r_regionkey where n_nationkey % 5 = 0),
ents as (select n_name as name from nation union select r_name from region),
terms as (select n_name as subj_term from nation union all select n_name || '''s' from nation union all select 'Planet ' || n_name from nation),
n as (select name from ents union select subj_term from terms), {_encoded('n')},
pairs as (select a.name as term, b.name, list_dot_product(a.v, b.v) / 1099511627776 as c from enc a, enc b where a.name in (select subj_term from terms) and b.name in (select name from ents)),
pr as (select *, row_number() over (partition by term order by c desc, name) as k from pairs),
res as materialized (select term, max(name) filter (where k = 1) as subj, max(name) filter (where k = 2) as second, max(c) filter (where k = 1) - max(c) filter (where k = 2) as m_ref from pr group by term),
pos as (select unnest(range({_D})) as p), anames as (select name from ents union select 'in region'), atoms as materialized (select name, p, {_BIT.format(n="name")} as x from anames, pos),
bundle as materialized (select s.p, case when sum(s.x * r.x * o.x) >= 0 then 1 else -1 end as b from f
  join atoms s on s.name = subj join atoms r on r.name = rel and r.p = (s.p + {_D} - 1) % {_D} join atoms o on o.name = obj and o.p = (s.p + {_D} - 2) % {_D} group by s.p),
got as materialized (select s.name as subj, (bundle.p + {_D} - 2) % {_D} as p, b * s.x * r.x as x from bundle join atoms s on s.p = bundle.p join atoms r on r.name = 'in region' and r.p = (bundle.p + {_D} - 1) % {_D} where s.name in (select subj from res)),
dots as (select g.subj, c.name, sum(g.x * c.x) as dot from got g join atoms c on c.p = g.p where c.name in (select name from ents) group by all),
dk as (select *, row_number() over (partition by subj order by dot desc, name) as k from dots),
told as materialized (select subj, max(name) filter (where k = 1) as top1, max(dot) filter (where k = 1) / {_D}.0 as a, (max(dot) filter (where k = 1) - max(dot) filter (where k = 2)) / {_D}.0 as m_l1 from dk where k <= 2 group by subj),
kd as (select a.name as subj, f.subj || chr(31) || f.rel || chr(31) || f.obj as rec, f.obj, (sum(a.x * b.x) + {_KD}) / {2 * _KD}.0 as c from atoms a join atoms b on a.p = b.p and a.p < {_KD} join f on f.subj = b.name where a.name in (select subj from res) group by all),
kr as (select *, row_number() over (partition by subj order by c desc, rec) as k from kd),
lead_ as (select subj, max(c) filter (where k = 1) - max(c) filter (where k = 2) as m_l2, max(obj) filter (where k = 1) as o1, max(obj) filter (where k = 2) as o2 from kr group by subj),
size as (select count(*) as n from f), en as (select count(*) as m from ents),
q as (select t.subj_term, r.subj, r.second, r.m_ref, told.top1, told.a, told.m_l1, l.m_l2, l.o1, l.o2, sqrt(2 / (pi() * n)) as mh, sqrt(2 * ln(m) / {_D}) as mn from terms t join res r on r.term = t.subj_term join told using (subj) join lead_ l using (subj), size, en),
g as (select *, (a - (mh * 0.004 + mn * 0.011) / 0.015) / 0.0075 as z, 1 - 1 / (1 + exp(-((m_ref - 0.19) / 0.08))) as ref, 1 - 1 / (1 + exp(-((m_l2 - 0.4528) / 0.0342))) as sto from q),
h as (select *, 1 / (1 + exp(-z)) * (1 - greatest(ref, sto)) as b, 1 / (1 + exp(-z)) * greatest(ref, sto) as d, 1 - 1 / (1 + exp(-z)) as u, case when ref >= sto then 'referential' else 'stored' end as why from g),
w as (select *, case when mh <= mn + 0.004 then 'recollect' when u >= 0.85 then 'abstain' when u >= 0.35 then 'recollect' when d > b then 'deliberate' else 'answer' end as action from h)"""


@query(f"""with {_TERMS} select subj_term, subj, round(a, 6) as a, round(m_ref, 6) as m_ref, round(m_l2, 6) as m_l2, round(b, 6) as b, round(d, 6) as d, round(u, 6) as u, action, case when action = 'deliberate' then why end as tag,
case when action = 'answer' and (subj, top1) in (select subj, obj from f) then top1 end as answer,
case when action = 'deliberate' and why = 'referential' then subj || ' or ' || second when action = 'deliberate' then least(o1, o2) || ' or ' || greatest(o1, o2) end as choices from w""")
def memory_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Terms as people write them, through resolution, recall, stored keys, opinion and routing, at 8192 dimensions."""
    n = table(spark, d, "nation").select("n_name")
    said = n.union(n.select(F.concat("n_name", F.lit("'s")))).union(n.select(F.concat(F.lit("Planet "), "n_name"))).select(F.lit(0).cast("long").alias("page"), F.col("n_name").alias("subj_term"), F.lit("in the region").alias("rel_term"))
    out = memory_query.resolved(region_facts(spark, d), said, places(spark, d), _D, _KD)
    return out.select("subj_term", "subj", *(r6(c).alias(c) for c in ("a", "m_ref", "m_l2", "b", "d", "u")), "action", "tag", "answer", F.array_join("candidates", " or ").alias("choices"))


@query(f"""with {_TERMS}, x as (select distinct subj, m_l2, (select count(*) from f where f.subj = w.subj) > 1 as coll from w where subj in (select subj from f)),
m as (select avg(m_l2) filter (where coll) as mc, stddev_samp(m_l2) filter (where coll) as sc, avg(m_l2) filter (where not coll) as ms, stddev_samp(m_l2) filter (where not coll) as ss from x)
select round((ms * sc + mc * ss) / (ss + sc), 6) as c, round(0.5 * (ss + sc), 6) as s from m""")
def calibrate_stored_margin(spark: SparkSession, d: str) -> DataFrame:
    """Where the stored margins of collisions and of single facts cross."""
    n = table(spark, d, "nation").select(F.lit(0).cast("long").alias("page"), F.col("n_name").alias("subj_term"), F.lit("in region").alias("rel_term"))
    facts = region_facts(spark, d)
    x = memory_query.resolved(facts, n, places(spark, d), _D, _KD).select("subj", "m_l2").join(facts.groupBy("subj").agg((F.count(F.lit(1)) > 1).alias("coll")), "subj")
    return models.crossing_of_classes(x, "m_l2", "coll").select(r6("c").alias("c"), r6("s").alias("s"))


# -- calibration ----------------------------------------------------------------------------------

_SW, _LOADS = 512, (16, 32, 64)


def _reads_sql(k: int) -> str:
    return f"""select {k} as k, t.page, t.subj, f.obj is not null as written, t.top1 is not distinct from f.obj as right_, dot1 / {_SW}.0 as a, (dot1 - dot2) / {_SW}.0 as m from told{k} t left join f{k} f on f.page = t.page and f.subj = t.subj"""


_SWEEP = "names as (select c_name as name from customer union select 'no ' || c_name from customer union select n_name from nation union select 'in nation'), pos as (select unnest(range(" + str(_SW) + ")) as p), atoms as (select name, p, " + _BIT.format(n="name") + " as x from names, pos), " + ", ".join(
    f"""f{k} as (select c_custkey // {k} as page, c_name as subj, n_name as obj from customer join nation on c_nationkey = n_nationkey),
asked{k} as (select page, subj from f{k} union all select page, 'no ' || subj from f{k}),
bundle{k} as (select page, s.p, case when sum(s.x * r.x * o.x) >= 0 then 1 else -1 end as b from f{k} join atoms s on s.name = subj join atoms r on r.name = 'in nation' and r.p = (s.p + {_SW} - 1) % {_SW} join atoms o on o.name = obj and o.p = (s.p + {_SW} - 2) % {_SW} group by page, s.p),
got{k} as (select a.page, a.subj, (b.p + {_SW} - 2) % {_SW} as p, b.b * s.x * r.x as x from asked{k} a join bundle{k} b on b.page = a.page join atoms s on s.name = a.subj and s.p = b.p join atoms r on r.name = 'in nation' and r.p = (b.p + {_SW} - 1) % {_SW}),
dots{k} as (select g.page, g.subj, c.name, sum(g.x * c.x) as dot from got{k} g join atoms c on c.p = g.p where c.name in (select distinct obj from f{k}) group by all),
ranked{k} as (select *, row_number() over (partition by page, subj order by dot desc, name) as rk from dots{k}),
told{k} as (select page, subj, max(name) filter (where rk = 1) as top1, max(dot) filter (where rk = 1) as dot1, max(dot) filter (where rk = 2) as dot2 from ranked{k} where rk <= 2 group by all)"""
    for k in _LOADS
) + ", reads as (" + " union all ".join(_reads_sql(k) for k in _LOADS) + ")"


def reads(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's key and one that nobody wrote, read from pages of each load."""
    f = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    out = None
    for k in _LOADS:
        own = f.select(F.floor(F.col("c_custkey") / k).alias("page"), F.col("c_name").alias("subj"), F.lit("in nation").alias("rel"), F.col("n_name").alias("obj"))
        keys = own.select("page", "subj", "rel")
        told = recall.recall(own, keys.unionByName(keys.withColumn("subj", F.concat(F.lit("no "), "subj"))), own.select(F.col("obj").alias("name")), _SW)
        x = told.join(own.select("page", "subj", "obj"), ["page", "subj"], "left")
        one = x.select(F.lit(k).alias("k"), F.col("obj").isNotNull().alias("written"), F.col("top1").eqNullSafe(F.col("obj")).alias("right"), (F.col("dot1") / float(_SW)).alias("a"), ((F.col("dot1") - F.col("dot2")) / float(_SW)).alias("m"))
        out = one if out is None else out.unionByName(one)
    return out


_CAP = f"""{_SWEEP}, cap as (select k, avg(case when written then cast(right_ as int) end) as accuracy, avg(a) filter (where written) as a_hit_mean, stddev_samp(a) filter (where written) as a_hit_sd, avg(a) filter (where not written) as a_miss_mean,
stddev_samp(a) filter (where not written) as a_miss_sd, avg(m) filter (where written) as m_hit_mean, stddev_samp(m) filter (where written) as m_hit_sd, count(*) filter (where written) as n1, count(*) filter (where not written) as n2 from reads group by k)"""


@query(f"""with {_CAP} select k, round(accuracy, 6) as accuracy, round(a_hit_mean, 6) as a_hit_mean, round(a_hit_sd, 6) as a_hit_sd, round(a_miss_mean, 6) as a_miss_mean, round(a_miss_sd, 6) as a_miss_sd, round(m_hit_mean, 6) as m_hit_mean, round(m_hit_sd, 6) as m_hit_sd,
round((a_hit_mean - a_miss_mean) / sqrt(((n1 - 1) * a_hit_sd * a_hit_sd + (n2 - 1) * a_miss_sd * a_miss_sd) / (n1 + n2 - 2)), 6) as cohens_d from cap""")
def capacity_sweep(spark: SparkSession, d: str) -> DataFrame:
    s = calibration.sweep(reads(spark, d))
    return s.select("k", *(r6(c).alias(c) for c in s.columns if c != "k"))


@query(f"with {_SWEEP} select round(avg(a), 6) as mu, round(stddev_samp(a), 6) as sd from reads where not written and k = 32")
def null_calibration(spark: SparkSession, d: str) -> DataFrame:
    return calibration.null_calibration(reads(spark, d).where("k = 32")).select(r6("mu").alias("mu"), r6("sd").alias("sd"))


@query(f"""with {_CAP}, s as (select sum(a_hit_mean * sqrt(2 / (pi() * k))) / sum(2 / (pi() * k)) as scale from cap) select k, round(a_hit_mean, 6) as mean, round(a_hit_sd, 6) as sd, round(scale, 6) as scale from cap, s""")
def hit_calibration(spark: SparkSession, d: str) -> DataFrame:
    return calibration.hit_calibration(reads(spark, d)).select("k", *(r6(c).alias(c) for c in ("mean", "sd", "scale")))


@query(f"""with {_CAP}, s as (select sum(a_hit_mean * sqrt(2 / (pi() * k))) / sum(2 / (pi() * k)) as scale from cap), z as (select avg(a) as mu, stddev_samp(a) as sd from reads where not written)
select k, round(2 * scale * scale / (pi() * pow(mu + sd, 2)), 6) as k_sat, round(2 * scale * scale / (pi() * mu * mu), 6) as k_max, scale * sqrt(2 / (pi() * k)) <= mu + sd as saturated from cap, s, z""")
def saturation_flags(spark: SparkSession, d: str) -> DataFrame:
    """Loads that measured moments call saturated."""
    m = calibration.moments(reads(spark, d)).withColumnRenamed("null_mu", "mu")
    hit = gate.hit_moments(F.col("k"), F.col("scale"), F.col("sd"))
    return m.select("k", r6(gate.k_sat(F.col("scale"), F.col("mu"), F.col("null_sd"))).alias("k_sat"), r6(calibration.k_max_measured(F.col("scale"), F.col("mu"))).alias("k_max"), gate.saturated(hit["mu"], F.col("mu"), F.col("null_sd")).alias("saturated"))


@query("""with k as (select * from (values (10, 0.02), (40, 0.011), (80, 0.007)) v(x, y)), c as (select c_nationkey, count(*) as load from customer group by c_nationkey)
select c_nationkey, load, round(case when load <= 10 then 0.02 when load < 40 then 0.02 + (0.011 - 0.02) * (load - 10) / 30.0 when load < 80 then 0.011 + (0.007 - 0.011) * (load - 40) / 40.0 else 0.007 end * sqrt(8192 / 1024.0), 6) as sd from c""")
def sigma_at_load(spark: SparkSession, d: str) -> DataFrame:
    """An sd from a small table of loads, rescaled to another dimension, for the load of each nation."""
    load = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("load"))
    knots = spark.createDataFrame([(10, 0.02), (40, 0.011), (80, 0.007)], "x int, y double")
    return calibration.interpolated(load, "load", knots, "sd").select("c_nationkey", "load", r6(calibration.rescaled(F.col("sd"), 8192, 1024)).alias("sd"))


@query("""with m as (select l_tax as blend, avg(l_discount) * 10 as auc, avg(l_quantity) as k_max from lineitem group by l_tax), b as (select * from m order by auc desc, k_max desc limit 1)
select m.blend, round(m.auc, 6) as auc, round(m.k_max, 6) as k_max from m, b where m.auc >= b.auc - 0.005 and m.k_max >= 0.9 * b.k_max order by m.blend limit 1""")
def blend_choice(spark: SparkSession, d: str) -> DataFrame:
    """The smallest blend that is nearly as good as the best one; measurements here are averages of line items by tax."""
    m = table(spark, d, "lineitem").groupBy(F.col("l_tax").alias("blend")).agg((F.avg("l_discount") * 10).alias("auc"), F.avg("l_quantity").alias("k_max"))
    return models.pick_blend(m).select("blend", r6("auc").alias("auc"), r6("k_max").alias("k_max"))


@query(f"with {_OPINION} select l_orderkey, l_linenumber, round(known * (1 - sto), 6) as b, round(known * sto, 6) as d from o")
def stored_opinion(spark: SparkSession, d: str) -> DataFrame:
    """The split of belief by the stored margin alone, and measured null moments in place of analytic ones."""
    parts = signals(spark, d).withColumn("p", gate.l2_opinion_parts(1 - gate.sigmoid(F.col("z")), F.col("m_l2")))
    return parts.select("l_orderkey", "l_linenumber", r6("p.b").alias("b"), r6("p.d").alias("d"))


@query("""select o_orderkey, round(case when o_orderkey % 2 = 0 then 0.03 else sqrt(2 * ln(o_orderkey + 1.0) / 8192) end, 6) as mu, case when o_orderkey % 2 = 0 then 0.005 else 0.004 end as sd from orders""")
def null_moments(spark: SparkSession, d: str) -> DataFrame:
    """Measured null moments where there are any, the analytic ones elsewhere."""
    k = F.col("o_orderkey")
    have = lambda x: F.when(k % 2 == 0, F.lit(x))
    m = gate.null_moments(gate.mu_null(k + F.lit(1.0), F.lit(8192)), F.lit(0.004), have(0.03), have(0.005))
    return table(spark, d, "orders").select("o_orderkey", r6(m["mu"]).alias("mu"), m["sd"].alias("sd"))


# -- the store ------------------------------------------------------------------------------------


@query(f"with {LOG}, s as (select subj, rel, obj, arg_max(op, seq) as op from log group by all) select rel, count(*) as triples, count(*) filter (where op = 'write') as active from s group by rel")
def active_count(spark: SparkSession, d: str) -> DataFrame:
    return store.active_count(log(spark, d), "rel")


@query(f"""with {LOG}, w as (select cast(subj as bigint) % 8 as page, obj, sum(case when op = 'write' then 1 else -1 end) as w from log where obj is not null group by all),
a as (select distinct obj as name from w), x as (select name, p, {_BIT.format(n="name")} as x from a, (select unnest(range(128)) as p)) select page, p as pos, cast(sum(w * x) as bigint) as s from w join x on x.name = w.obj group by page, p""")
def retracted_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Forgetting is a weight of -1 in the sum. Weights are added up before vectors are."""
    ops = log(spark, d).where("obj is not null")
    w = ops.groupBy(F.pmod(F.col("subj").cast("long"), F.lit(8)).alias("page"), "obj").agg(F.sum(F.when(F.col("op") == "write", 1).otherwise(-1)).alias("w"))
    out = vec.superpose(w.withColumn("v", vec.atom(F.col("obj"), 128)), ["page"], "v", "w")
    return out.select("page", F.posexplode("bundle").alias("pos", "s")).select("page", F.col("pos").cast("long").alias("pos"), F.col("s").cast("long").alias("s"))


@query(f"""with {_SWEEP}, e as (select f.page, f.subj, t.top1 = f.obj and dot1 / {_SW}.0 > ((sqrt(2 / (pi() * n)) * 0.016) + (sqrt(2 * ln(25.0) / {_SW}) * 0.044)) / 0.06 as fine, f.obj from told64 t join f64 f on f.page = t.page and f.subj = t.subj join (select page, count(*) as n from f64 group by page) z on z.page = f.page),
b as (select page, s.p, sum(case when fine then s.x * r.x * o.x else 0 end) as s from e join atoms s on s.name = subj join atoms r on r.name = 'in nation' and r.p = (s.p + {_SW} - 1) % {_SW} join atoms o on o.name = obj and o.p = (s.p + {_SW} - 2) % {_SW} group by page, s.p)
select b.page, any_value(n) as n, any_value(ok) as accepted, cast(sum(p * s) as bigint) as bundle from b join (select page, count(*) as n, count(*) filter (where fine) as ok from e group by page) using (page) group by b.page""")
def checked_writes(spark: SparkSession, d: str) -> DataFrame:
    """Writes to overfull pages, read back through the gate: what does not come back is taken out of the bundle again."""
    f = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    f = f.select(F.floor(F.col("c_custkey") / 64).alias("page"), F.col("c_name").alias("subj"), F.lit("in nation").alias("rel"), F.col("n_name").alias("obj"))
    done = recall.write_checked(f, f.select(F.col("obj").alias("name")), _SW)
    sums = recall.bundles(done.where("accepted"), _SW).select("page", F.posexplode("bundle").alias("p", "s")).groupBy("page").agg(F.sum(F.col("p") * F.col("s")).alias("bundle"))
    n = done.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("accepted"))
    return n.join(sums, "page", "left").select("page", "n", "accepted", F.coalesce("bundle", F.lit(0)).cast("long").alias("bundle"))


@query(f"with {TRIPLES} select rel, count(*) as n, count(distinct obj) as objects from triples group by rel")
def sql_views(spark: SparkSession, d: str) -> DataFrame:
    """The store as a temporary view, asked in SQL."""
    store.views(spark, facts=triples(spark, d))
    return spark.sql("select rel, count(*) as n, count(distinct obj) as objects from facts group by rel")


@query("""with c as (select distinct n_name from customer join nation on c_nationkey = n_nationkey where c_acctbal > 9000), s as (select distinct n_name from supplier join nation on s_nationkey = n_nationkey)
select 'both' as kind, n_name from (select * from c intersect select * from s) union all select 'any', n_name from (select * from c union select * from s) union all select 'only', n_name from (select * from s except select * from c)""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    c = table(spark, d, "customer").where("c_acctbal > 9000").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name")
    of = lambda kind, x: x.select(F.lit(kind).alias("kind"), "n_name")
    return of("both", c.intersect(s)).unionAll(of("any", c.union(s).distinct())).unionAll(of("only", s.distinct().subtract(c.distinct())))


# -- statistics -----------------------------------------------------------------------------------


@query(f"""with {_SCORED}, r as (select *, row_number() over (partition by lang, correct order by md5(cast(doc_id as varchar))) - 1 as k from scored),
s as (select lang, count(*) filter (where correct) as np, count(*) filter (where not correct) as nn from scored group by lang), i as (select lang, np, nn, unnest(range(greatest(np, nn))) as i from s where np > 0 and nn > 0),
p as (select lang, i, ('0x' || substr(md5('p1:' || i), 1, 7))::bigint % np as a, ('0x' || substr(md5('n1:' || i), 1, 7))::bigint % nn as b, ('0x' || substr(md5('t1:' || i), 1, 7))::bigint % 2 as coin from i)
select p.lang, count(*) as n, round(avg(case when x.conf > y.conf then 1 when x.conf < y.conf then 0 else coin end), 6) as acc from p join r x on x.lang = p.lang and x.correct and x.k = a join r y on y.lang = p.lang and not y.correct and y.k = b group by p.lang""")
def pseudo_2afc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pseudo_2afc(scored(spark, d), ["lang"], "doc_id", "conf", "correct").select("lang", "n", r6("acc").alias("acc"))


@query("""with n as (select l_discount as value, count(*) as n from lineitem group by 1) select value, n, round(n / sum(n) over (), 6) as share, value = (select value from n order by n desc, value limit 1) as mode from n""")
def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = metrics.histogram(table(spark, d, "lineitem").withColumnRenamed("l_discount", "value"), "value")
    return h.withColumn("share", r6("share"))


@query(f"""with x as (select l_suppkey, l_returnflag, l_quantity / 50.0 as m_ref from lineitem) select l_suppkey, round(max(m_ref) filter (where l_returnflag = 'R'), 6) as highest, round(min(m_ref) filter (where l_returnflag = 'N'), 6) as lowest, round(min(m_ref) filter (where l_returnflag = 'N') - max(m_ref) filter (where l_returnflag = 'R'), 6) as gap from x group by l_suppkey""")
def margin_gap(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").withColumn("m_ref", F.col("l_quantity").cast("double") / 50.0)
    g = metrics.margin_gap(x, ["l_suppkey"], "m_ref", F.col("l_returnflag") == "R", F.col("l_returnflag") == "N")
    return g.select("l_suppkey", *(r6(c).alias(c) for c in ("highest", "lowest", "gap")))


@query("with m as (select l_suppkey, l_linenumber, avg(l_discount) as x from lineitem group by all) select l_suppkey, round(max(x) - min(x), 6) as drift from m group by l_suppkey")
def drift_range(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_discount").alias("x"))
    return m.groupBy("l_suppkey").agg(r6(F.max("x") - F.min("x")).alias("drift"))


@query("""with x as (select l_linenumber % 2 as split, 'm_ref' as feature, l_quantity / 50.0 as x from lineitem union all select l_linenumber % 2, 'm_l2', l_extendedprice / 100000.0 from lineitem) select feature, split, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as sd from x group by all""")
def feature_shift(spark: SparkSession, d: str) -> DataFrame:
    x = signals(spark, d).withColumn("split", F.col("l_linenumber") % 2)
    return metrics.feature_shift(x, "split", ["m_ref", "m_l2"]).select("feature", "split", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query("select l_suppkey, round(quantile_cont(l_quantity, 0.5), 6) as median from lineitem group by l_suppkey")
def median_of_repeats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(r6(F.percentile(F.col("l_quantity").cast("double"), F.lit(0.5))).alias("median"))


@query("with k as (select event_type, event_id, row_number() over (partition by event_type order by event_id) as place from events) select event_type, event_id, place from k where place <= 120")
def first_items(spark: SparkSession, d: str) -> DataFrame:
    """The first 120 items of each kind, a report's fixed prefix."""
    p = metrics.prefix(table(spark, d, "events"), ["event_type"], [F.col("event_id")], 120)
    return p.select("event_type", "event_id", F.col("place").cast("long").alias("place"))


@query(f"with {_SCORED} select doc_id, lang, round(conf, 6) as conf from scored where lang = 'en' and correct")
def clean_items(spark: SparkSession, d: str) -> DataFrame:
    """One kind, answered right."""
    return scored(spark, d).where((F.col("lang") == "en") & F.col("correct")).select("doc_id", "lang", r6("conf").alias("conf"))


@query(f"with {_TOP} select term, 1 - dot / 1099511627776 >= 0.25 as isolated, round(1 - dot / 1099511627776, 6) as lead from top where place = 1")
def isolated_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that lead the nearest other name by 0.25 or more when asked for themselves, and their lead."""
    o = others(spark, d).where("place = 1").withColumn("c", F.col("dot") / float(1 << 40))
    return o.select("term", (1 - F.col("c") >= 0.25).alias("isolated"), r6(1 - F.col("c")).alias("lead"))


def _cdf_sql(x: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    tail = f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"(case when {x} >= 0 then 1 - {tail} else {tail} end)"


def _ppf_ctes(source: str, p: str, keep: str, name: str) -> str:
    """CTE `name` with keep and x = the normal quantile of p over `source`."""
    q = f"sqrt(-2 * ln(least({p}, 1 - ({p}))))"
    x0 = f"({q} - (2.515517 + 0.802853 * {q} + 0.010328 * {q} * {q}) / (1 + 1.432788 * {q} + 0.189269 * {q} * {q} + 0.001308 * {q} * {q} * {q}))"
    step = f"x - ({_cdf_sql('x')} - p_) * sqrt(2 * pi()) * exp(x * x / 2)"
    return f"""{name}0 as (select {keep}, {p} as p_, case when {p} < 0.5 then -{x0} else {x0} end as x from {source}),
{name}1 as (select * replace ({step} as x) from {name}0), {name} as (select * replace ({step} as x) from {name}1)"""


@query(f"with s as (select p_partkey, (p_partkey % 997 + 0.5) / 998.0 as p from part), {_ppf_ctes('s', 'p', 'p_partkey', 'z')} select p_partkey, round(x, 6) as x, round({_cdf_sql('x')}, 6) as back from z")
def normal_quantiles(spark: SparkSession, d: str) -> DataFrame:
    x = gate.norm_quantile((F.col("p_partkey") % 997 + 0.5) / 998.0)
    return table(spark, d, "part").select("p_partkey", x.alias("x")).select("p_partkey", r6("x").alias("x"), r6(gate.norm_cdf_poly(F.col("x"))).alias("back"))


_U = "((('0x' || substr(md5('{n}7:' || o_orderkey), 1, 7))::bigint + 0.5) / 268435456.0)"


@query(f"""with s as (select o_orderkey, {_U.format(n="x")} as p, {_U.format(n="y")} as q from orders), {_ppf_ctes('s', 'p', 'o_orderkey, q', 'a')}, b as (select o_orderkey, q, x + 0.5 as e from a), {_ppf_ctes('b', 'q', 'o_orderkey, e', 'c')}
select o_orderkey, e > 0 as correct, round(1 / (1 + exp(-(abs(e) + 0.4 * x))), 6) as conf from c""")
def simulated_observer(spark: SparkSession, d: str) -> DataFrame:
    o = corpora.observer(table(spark, d, "orders"), "o_orderkey", 1.0, 0.4, 7)
    return o.select("o_orderkey", "correct", r6("conf").alias("conf"))


@query()
def boosted_foil(spark: SparkSession, d: str) -> DataFrame:
    """Gradient-boosted trees out of fold, and how well they tell right from wrong."""
    x = scored(spark, d).withColumn("y", F.col("correct").cast("double"))
    p = models.boosted_cross_fit(x, "doc_id", ["conf", "other"], "y", rounds=5).join(x.select("doc_id", "correct"), "doc_id")
    return metrics.auroc(p.withColumnRenamed("p", "conf"), [], "conf", "correct")


@query("""with x as (select l_orderkey, l_linenumber, [cast(l_quantity as double) / 10, cast(l_discount as double) * 10, 0.5] as v from lineitem),
p as (select *, list_transform(v, lambda z: exp(z - list_max(v))) as e from x), q as (select l_orderkey, l_linenumber, v, e, list_sum(e) as s from p)
select l_orderkey, l_linenumber, round(v[1] - list_max(v) - ln(s), 6) as logp, round(ln(s) - (e[1] * (v[1] - list_max(v)) + e[2] * (v[2] - list_max(v)) + e[3] * (v[3] - list_max(v))) / s, 6) as entropy, round(list_reverse_sort(v)[1] - list_reverse_sort(v)[2], 6) as lead from q""")
def token_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of one answer position from its logits."""
    row = [F.col("l_quantity").cast("double") / 10, F.col("l_discount").cast("double") * 10, F.lit(0.5)]
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return models.token_features_of(rows, [row], [0], "f").select("l_orderkey", "l_linenumber", r6(F.col("f")[0]).alias("logp"), r6(F.col("f")[2]).alias("entropy"), r6(F.col("f")[3]).alias("lead"))


# -- text and leaks -------------------------------------------------------------------------------


@query("""select conv_id, turn, case when regexp_matches(text, '(?i)^\\s*(actually|correction|no,|wait)([^a-z]|$)') then 'correction' else 'other' end as kind, regexp_replace(text, '\\s+now([.!?]?)$', '\\1') as plain from conversations""")
def corrections(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(text.is_correction(c), "correction").otherwise("other").alias("kind"), text.strip_now(c).alias("plain"))


@query("select s_suppkey, s_name as subj, 'in nation' as rel from supplier where s_suppkey % 2 = 0 union all select s_suppkey, null, null from supplier where s_suppkey % 2 = 1")
def question_parse(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("so:\n ( "), "s_name", F.lit(" | in nation )\nx | y"))).otherwise(F.concat(F.lit("a | b | "), "s_name"))
    return table(spark, d, "supplier").select("s_suppkey", text.parse_question(line).alias("q")).select("s_suppkey", "q.subj", "q.rel")


@query("""select o_orderkey, case o_orderkey % 5 when 0 then o_clerk || ' did it.' when 1 then 'Which one do you mean: A or B?' when 2 then 'Two facts are on file: A; B.' when 3 then 'Nothing is on file for this.' else 'I do not know.' end as said from (select o_orderkey, 'Clerk ' || o_custkey as o_clerk from orders)""")
def replies(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    action = F.when(k == 0, "answer").when(k < 3, "deliberate").when(k == 3, "recollect").otherwise("abstain")
    body = F.when(k == 0, F.concat(F.lit("Clerk "), "o_custkey", F.lit(" did it.")))
    said = text.speak(action, body, F.when(k == 1, "referential").otherwise("stored"), F.array(F.lit("A"), F.lit("B")))
    return table(spark, d, "orders").select("o_orderkey", said.alias("said"))


@query("select p_partkey, p_type as said from part")
def think_stripping(spark: SparkSession, d: str) -> DataFrame:
    noisy = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<think>why\nso</think> "), "p_type")).otherwise(F.concat("p_type", F.lit(" <think>and then")))
    return table(spark, d, "part").select("p_partkey", text.strip_think(noisy).alias("said"))


@query(f"""with {TRIPLES}, t as (select distinct subj, rel, obj from triples), k as (select *, length(subj) as n, cast(length(subj) // 2 as int) as h from t)
select subj, rel, obj, case n % 3 when 0 then subj || '''s' when 1 then substr(subj, 1, h) || substr(subj, h + 2) else subj || ' Jr' end as twin, '- (' || subj || ' | ' || rel || ' | ' || obj || ')' as bullet, 'On file: ' || subj || ' ' || rel || ' ' || obj || '.' as settled from k""")
def fact_texts(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate names, facts as bullets, settled clauses."""
    f = triples(spark, d).distinct()
    s, r, o = F.col("subj"), F.col("rel"), F.col("obj")
    return f.select("subj", "rel", "obj", text.variant(s, F.length(s)).alias("twin"), text.bullets(F.array(F.struct("subj", "rel", "obj"))).alias("bullet"), text.clause(F.lit("answer"), s, r, o).alias("settled"))


def outputs(spark: SparkSession, d: str) -> DataFrame:
    """Replies of four kinds: allowed text alone, a nation's name beside it, a claim that holds, one that does not."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    body, k = F.concat("c_name", F.lit(" is from "), "n_name", F.lit(".")), F.col("c_custkey") % 4
    claim = lambda o: F.concat(F.lit("\n("), "n_name", F.lit(" | Lies In | "), o, F.lit(")"))
    more = F.when(k == 0, F.lit(" ")).when(k == 1, F.concat(F.lit(" Hello from "), "n_name", F.lit("!"))).when(k == 2, claim(F.lit("Earth's"))).otherwise(claim(F.lit("Mars")))
    return c.select(F.col("c_custkey").alias("id"), F.concat(body, more).alias("output"), F.array(body).alias("bodies"), k.alias("stratum"))


def earth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_name").alias("subj"), F.lit("lies in").alias("rel"), F.lit("Earth").alias("obj"))


def checked(spark: SparkSession, d: str) -> DataFrame:
    facts = earth(spark, d)
    vocab = table(spark, d, "nation").select(F.col("n_name").alias("word"))
    names = facts.select(F.col("subj").alias("name")).union(facts.select("obj")).union(spark.createDataFrame([("Mars",)], "name string"))
    return leaks.check(outputs(spark, d), vocab, facts, names)


_CHECKED = "x as (select c_custkey as id, c_custkey % 4 as k, n_name from customer join nation on c_nationkey = n_nationkey)"


@query(f"with {_CHECKED} select id, k > 0 as leak, cast(case when k = 0 then 0 else 1 end as bigint) as words, cast(case when k >= 2 then 1 else 0 end as bigint) as claims, cast(case when k >= 2 then 1 else 0 end as bigint) as unsupported from x")
def check_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Whole words of the vocabulary and claims in what an output says beyond its allowed bodies; "Earth's" is too far from "Earth" at 0.90."""
    return checked(spark, d).select("id", "leak", "words", "claims", "unsupported")


@query(f"with {_CHECKED} select cast(k as bigint) as stratum, count(*) as n, round(avg(case when k > 0 then 1.0 else 0.0 end), 6) as rate from x group by k")
def leak_rate(spark: SparkSession, d: str) -> DataFrame:
    c = checked(spark, d).join(outputs(spark, d).select("id", "stratum"), "id")
    return c.groupBy(F.col("stratum").cast("long").alias("stratum")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("leak").cast("double"))).alias("rate"))


@query("""with c as (select n_name, n_nationkey % 3 as k from nation) select n_name, case k when 0 then n_name when 1 then lower(n_name) else 'Atlantis' end as subj, k < 2 as supported from c""")
def claim_support(spark: SparkSession, d: str) -> DataFrame:
    """Claims whose fields are, or resolve to, those of one fact: exact and near ones hold, unknown ones do not."""
    k = F.col("n_nationkey") % 3
    subj = F.when(k == 0, F.col("n_name")).when(k == 1, F.lower("n_name")).otherwise(F.lit("Atlantis"))
    claims = table(spark, d, "nation").select("n_name", subj.alias("subj"), F.lit("lies in").alias("rel"), F.lit("Earth").alias("obj"))
    facts = earth(spark, d)
    names = facts.select(F.col("subj").alias("name")).union(facts.select("obj")).union(spark.createDataFrame([("Mars",)], "name string"))
    return leaks.supported(claims, facts, names).select("n_name", "subj", "supported")


@query("select c_name || ' (client)' as subj, 'in nation' as rel, n_name as obj from customer join nation on c_nationkey = n_nationkey where c_custkey % 3 <> 0")
def triple_udtf(spark: SparkSession, d: str) -> DataFrame:
    """The lines of triple_parse through the table function triple_lines, which SQL users may call."""
    text.register_udtf(spark)
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    obj = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("maybe "), "n_name")).otherwise(F.col("n_name"))
    c.select(F.concat(F.lit("("), "c_name", F.lit(" (client) |  IN Nation | "), obj, F.lit(")\nno triple | here\n")).alias("said")).createOrReplaceTempView("said_lines")
    return spark.sql("select t.subj, t.rel, t.obj from said_lines, lateral triple_lines(said) t")


# -- generated corpora ----------------------------------------------------------------------------


def _values(xs, name: str, column: str) -> str:  # type: ignore[no-untyped-def]
    return f"{name} as (select * from (values {', '.join(f'({x!r})' for x in xs)}) v({column}))"


_POOLS = f"""{_values(corpora.FIRST, 'fst', 'a')}, {_values(corpora.LAST, 'lst', 'b')}, {_values(corpora.ROLES, 'rol', 'b')}, {_values(corpora.ORG_A, 'oa', 'a')}, {_values(corpora.ORG_B, 'ob', 'b')}, {_values([*corpora.CITIES, *corpora.PLACES], 'cty', 'c')},
pools as (select 'person' as kind, a || ' ' || b as name from fst, lst union all select 'qualified', a || ' (' || b || ')' from fst, rol union all select 'org', a || ' ' || b from oa, ob union all select 'city', c from cty)"""
_WANTED = " ".join(f"when '{k}' then {n}" for k, n in corpora.quotas(200).items())


@query(f"with {_POOLS}, r as (select *, row_number() over (partition by kind order by md5('11:' || name)) as k from pools) select kind, name from r where k <= case kind {_WANTED} end")
def entity_names(spark: SparkSession, d: str) -> DataFrame:
    return corpora.entities(spark, 200, 11)


@query(f"with {_POOLS} select name, kind as class from pools")
def entity_classes(spark: SparkSession, d: str) -> DataFrame:
    """What a name's form says of it."""
    return corpora.pools(spark).select("name", text.entity_class(F.col("name"), corpora.ORG_B).alias("class"))


@query(f"with {_POOLS}, o as (select split_part(name, ' ', 1) as prefix, list_sort(list(name)) as l from pools where kind = 'org' group by 1) select prefix, l[1] as a, l[2] as b from o where len(l) >= 2")
def org_siblings(spark: SparkSession, d: str) -> DataFrame:
    return corpora.sibling_orgs(corpora.pools(spark))


def _at(xs, k: str) -> str:  # type: ignore[no-untyped-def]
    return f"list_extract([{', '.join(repr(x) for x in xs)}], cast(({k}) % {len(xs)} as int) + 1)"


def _thing(rel: str, k: str) -> str:
    orgs, folk = ", ".join(map(repr, corpora.ORG_RELATIONS)), ", ".join(map(repr, corpora.PERSON_RELATIONS))
    return f"case when {rel} in ({orgs}) then {_at(corpora.ORG_A, k)} || ' ' || {_at(corpora.ORG_B, k)} when {rel} in ({folk}) then {_at(corpora.FIRST, k)} || ' ' || {_at(corpora.LAST, k)} else {_at(corpora.CITIES, k)} end"


def _draw(tag: str) -> str:
    return f"('0x' || substr(md5('{tag}5:' || name), 1, 7))::bigint"


_ENDS = [sum(n for _, n in corpora.FAMILIES[: j + 1]) for j in range(len(corpora.FAMILIES))]
_FAMILY = "case " + " ".join(f"when i < {e} then '{name}'" for (name, _), e in zip(corpora.FAMILIES, _ENDS, strict=True)) + " end"


@query(f"""with {_POOLS}, p as (select name, row_number() over (order by md5('5:' || name)) - 1 as i from pools where kind = 'person'),
b as (select *, {_FAMILY} as family, {_draw('r')} as k, length(name) as n from p where i < {_ENDS[-1]}),
c as (select *, case when family in ('f_syn', 'f_para') then {_at([a for a, _ in corpora.SYNONYMS], 'k % 2')} when family = 'f_distract' then 'works at' else {_at(corpora.RELATIONS, 'k')} end as rel, {_at([b for _, b in corpora.SYNONYMS], 'k % 2')} as rel2,
 case i % 3 when 0 then name || '''s' when 1 then substr(name, 1, n // 2) || substr(name, n // 2 + 2) else name || ' Jr' end as twin from b),
o as (select *, {_thing('rel', 'k')} as o1, {_thing('rel', 'k + 1')} as o2 from c),
t as (select a || ' ' || b as name, a || ' ' || case b when 'Dietz' then 'Dietze' else b || 's' end as twin from fst, lst where b in ('Adler', 'Bauer', 'Cohen', 'Dietz', 'Ebert')),
tw as (select *, {_at(corpora.RELATIONS, _draw('t'))} as rel from t), rf as (select a as name from fst), rg as (select *, {_at(corpora.RELATIONS, _draw('f'))} as rel from rf)
select family, 'syn_true' as kind, name as subj, rel, o1 as gold, o2 as other, 2 as written from o where family = 'f_syn' union all select family, 'syn_stale', name, rel2, o1, o2, 2 from o where family = 'f_syn'
union all select family, 'nearkey_true', name, rel, o1, o2, 2 from o where family = 'f_nearkey' union all select family, 'nearkey_var', twin, rel, o1, o2, 2 from o where family = 'f_nearkey'
union all select family, 'para', name, rel2, o1, null, 1 from o where family = 'f_para' union all select family, 'distract', name, rel, o1, split_part(o1, ' ', 1) || ' ' || {_at(corpora.ORG_B, 'k + 1')}, 1 from o where family = 'f_distract'
union all select family, 'id', name, rel, o1, null, 1 from o where family = 'f_id' union all select family, 'ood', name, rel, null, null, 0 from o where family = 'f_ood'
union all select 'f_confusable', 'confusable', twin, rel, null, null, 1 from tw union all select 'f_ref', 'ref', name, rel, null, null, 2 from rg""")
def corpus_families(spark: SparkSession, d: str) -> DataFrame:
    return corpora.families(spark, 5).withColumn("written", F.size("written"))


# -- sources --------------------------------------------------------------------------------------


@query("select 'csv' as form, n_nationkey, n_name from nation union all select 'jsonl', n_nationkey, n_name from nation union all select 'parquet', n_nationkey, n_name from nation")
def source_forms(spark: SparkSession, d: str) -> DataFrame:
    """The nations written as CSV and as JSON lines, and read back."""
    n, at = table(spark, d, "nation").select("n_nationkey", "n_name"), io.scratch(spark)
    schema = f"n_nationkey {n.schema['n_nationkey'].dataType.simpleString()}, n_name string"
    io.write_csv(n, f"{at}/csv")
    io.write_jsonl(n, f"{at}/jsonl")
    of = lambda form, x: x.select(F.lit(form).alias("form"), "n_nationkey", "n_name")
    return of("csv", io.read_csv(spark, f"{at}/csv", schema)).unionByName(of("jsonl", io.read_jsonl(spark, f"{at}/jsonl", schema))).unionByName(of("parquet", n))


@query("select count(*) as n, round(avg(r_regionkey), 6) as mean from region")
def source_document(spark: SparkSession, d: str) -> DataFrame:
    """A calibration as one JSON document, stored and loaded."""
    at = io.scratch(spark)
    io.write_document(table(spark, d, "region").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("r_regionkey")).alias("mean")), at)
    return io.read_document(spark, at, "n long, mean double")


@query("select n_name as name, cast(256 as int) as size from nation union all select r_name, 256 from region")
def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    """A cache that holds the nations is asked for regions too: the missing ones are embedded and kept."""
    at = io.scratch(spark)
    io.cache_through(spark, at, table(spark, d, "nation").select(F.col("n_name").alias("name")), encoding.encode)
    return io.cache_through(spark, at, places(spark, d), encoding.encode).select("name", F.size("e").alias("size"))


@query("select unnest(range(8)) as row_, unnest(range(8)) * 2.0 as trace")
def matrix_artifact(spark: SparkSession, d: str) -> DataFrame:
    """A small matrix stored and loaded."""
    at = io.scratch(spark)
    io.write_matrix(spark, np.diag(np.arange(8.0)) * 2, at)
    m = io.read_matrix(spark, at)
    return spark.createDataFrame([(k, float(m[k].sum())) for k in range(len(m))], "row_ long, trace double")


@query()
def artifact_digests(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of the nation table's files."""
    return io.digests(spark, f"{d}/nation.parquet*").select(F.length("sha256").alias("digits"), "sha256")


@query("select item_id, 'yes ' || item_id as reply from benchmark")
def rating_port(spark: SparkSession, d: str) -> DataFrame:
    """The port for a language model with a stand-in: it fails on every other call, and is asked again."""

    def ask(prompts: list[str]) -> list[str]:
        return ["" if p.startswith("odd") and len(prompts) > 1 else f"yes {p.split(':')[1]}" for p in prompts]

    p = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("even:"), F.col("item_id")).alias("prompt"))
    return models.rated(p, ask, "prompt").select("item_id", "reply")
