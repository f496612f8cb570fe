import numpy as np
from pyspark.sql import functions as F

from surefact.functions import gate, text, vec
from surefact.operators import metrics, models


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_binding_is_its_own_inverse_and_rotation_undoes(spark):
    a, b = vec.atom(F.lit("ann"), 128), vec.atom(F.lit("bob"), 128)
    r = one(spark, a, vec.bind(vec.bind(a, b), b), vec.permute(vec.permute(a, 5, 128), -5, 128))
    assert r[0] == r[1] == r[2]
    assert r[0] == vec.atoms(["ann"], 128)[0].tolist()


def test_one_record_gives_back_each_role(spark):
    s, r, o = (vec.atom(F.lit(x), 128) for x in ("s", "r", "o"))
    rec = vec.record(s, r, o, 128)
    got = one(spark, vec.unbind_obj(rec, s, r, 128), vec.unbind_subj(rec, r, o, 128), vec.unbind_rel(rec, s, o, 128))
    assert [list(x) for x in got] == vec.atoms(["o", "s", "r"], 128).tolist()


def test_zero_vectors(spark):
    zero, x = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    r = one(spark, vec.cosine(zero, x), vec.unit(zero), vec.unit(x))
    assert r[0] == 0 and list(r[1]) == [0, 0] and list(r[2]) == [0.6, 0.8]


def test_routing_table(spark):
    route = lambda b, d, u, sat=False, store=True: one(spark, gate.route(F.lit(b), F.lit(d), F.lit(u), F.lit(sat), F.lit(store)))[0]
    assert route(0.8, 0.1, 0.1) == "answer"
    assert route(0.1, 0.8, 0.1) == "deliberate"
    assert route(0.1, 0.05, 0.85) == "abstain"
    assert route(0.4, 0.2, 0.4) == "recollect"
    assert route(0.4, 0.2, 0.4, store=False) == "abstain"
    assert route(0.9, 0.0, 0.1, sat=True) == "recollect"


def test_opinion_sums_to_one_and_needs_a_stored_key(spark):
    z, ref, l2, m = F.lit(1.3), F.lit(0.9), F.lit(0.0), F.lit(0.2)
    o = one(spark, gate.opinion_two_source(z, ref, l2, m).alias("o")).o
    assert abs(o.b + o.d + o.u - 1) < 1e-12 and o.tag == "stored"
    o = one(spark, gate.opinion_two_source(z, ref, l2, m, F.lit(False)).alias("o")).o
    assert o.tag == "referential"


def test_text_guards(spark):
    r = one(spark, text.strip_think(F.lit("<think>a</think> hi <think>b")), text.parse_confidence(F.lit("about 250")), text.parse_confidence(F.lit("none")), text.slot(F.lit(" The Cat")), text.qualified(F.lit("call my doctor")))
    assert list(r) == ["hi", 1.0, 0.5, "cat", "my doctor"]
    q = one(spark, text.parse_question(F.lit("x\n(ann | in nation)")).alias("q")).q
    assert (q.subj, q.rel) == ("ann", "in nation")
    assert one(spark, text.remainder(F.lit("abc def"), F.array(F.lit("abc"))))[0] == "  def"


def test_auroc_with_ties_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    conf, right = rng.integers(0, 8, 200) / 8, rng.random(200) < 0.4
    df = spark.createDataFrame([("a", float(c), bool(r)) for c, r in zip(conf, right, strict=True)], "g string, conf double, correct boolean")
    p, n = conf[right], conf[~right]
    want = ((p[:, None] > n[None, :]) + 0.5 * (p[:, None] == n[None, :])).mean()
    assert abs(metrics.auroc(df, ["g"], "conf", "correct").first().auroc - want) < 1e-12
    assert metrics.auroc(df.where("correct"), ["g"], "conf", "correct").first().auroc is None
