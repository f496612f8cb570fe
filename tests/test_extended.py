"""Cases that the queries' tables do not hold."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from surefact.functions import text
from surefact.operators import calibration, facts, leaks, metrics, models, recall
from surefact.sources import io


def test_a_forgotten_latest_write_is_not_reported(spark):
    rows = [(1, "write", "a", "r", "x", "user-stated"), (2, "write", "a", "r", "y", "tool-derived"), (3, "write", "b", "r", "x", None), (4, "write", "b", "r", "y", None), (5, "forget", "b", "r", "y", None), (6, "write", "c", "r", "x", None), (7, "forget", "c", "r", "z", None)]
    log = spark.createDataFrame(rows, "seq long, op string, subj string, rel string, obj string, provenance string")
    assert {(r.subj, r.obj, r.seq) for r in facts.supersede(log).collect()} == {("a", "y", 2), ("c", "x", 6)}
    assert facts.supersede(log.limit(0)).count() == 0


def test_fields_of_triples_may_hold_parentheses(spark):
    said = "(Tom (brother) | In Nation | France)\n( a | b )\n(x | y | z | q)\n(Ann | is | never here)\nplain"
    df = spark.createDataFrame([(1, said), (2, None), (3, "")], "id long, t string")
    assert [tuple(r) for r in text.parse_triples(df, "t", "id").collect()] == [(1, "Tom (brother)", "in nation", "France")]
    assert [(s, r, o) for s, r, o in text.TripleLines().eval(said)] == [("Tom (brother)", "in nation", "France")]


def test_meta_d_is_the_best_of_a_grid():
    counts = np.array([[30.0, 15, 8, 5], [25, 40, 60, 75]])
    got = models.meta_d(counts)
    assert got["eligible"] and abs(got["d"] - 2 * models.quantile(200 / 258)) < 1e-9

    def loss(m, limits):
        edges, out = [0.0, *limits, math.inf], 0.0
        for right, at in ((1, m / 2), (0, -m / 2)):
            mass = np.diff([models.cdf(x - at) if x < math.inf else 1.0 for x in edges])
            out -= float((counts[right] * np.log(mass / mass.sum())).sum())
        return out

    grid = min((loss(m, (a, a + b, a + b + c)), m) for m in np.arange(0, 4, 0.1) for a in np.arange(0.1, 1.5, 0.2) for b in np.arange(0.1, 1.5, 0.2) for c in np.arange(0.1, 1.5, 0.2))
    assert abs(got["meta_d"] - grid[1]) < 0.2
    assert models.meta_d(np.array([[0.0, 0], [1, 2]]))["reason"] == "one class"
    assert models.meta_d(np.array([[1.0, 1], [50, 48]]))["reason"] == "accuracy"


def test_whitening_blends_without_another_normalisation(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [1.0, 1.0])], "name long, e array<double>")
    rows = {r.name: r.e for r in models.whiten(df, "e", np.array([1.0, 1.0]), np.eye(2), 0.75).collect()}
    shifted = np.array([2.0, 3.0]) / math.sqrt(13)
    assert np.allclose(rows[1], 0.25 * np.array([0.6, 0.8]) + 0.75 * shifted) and rows[2] is None and np.allclose(rows[3], 0.25 / math.sqrt(2))
    assert models.whiten(df, "e", np.zeros(2), np.eye(2), 0) is df


def test_logistic_fit_has_no_slope_left(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1])))).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), 1.0, int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "i long, a double, b double, flat double, y int")
    m = models.logistic(df, ["a", "b", "flat"], "y")
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.zeros(300), np.ones(300)])
    w = np.array(m["w"])
    slope = z.T @ (1 / (1 + np.exp(-z @ w)) - y) / 300 + models.RIDGE * w
    assert np.abs(slope).max() < 1e-8 and m["sd"][2] == 0
    p = models.cross_fit(df, "i", ["a", "b"], "y").collect()
    assert len(p) == 300 and np.corrcoef([r.p for r in sorted(p, key=lambda r: r.i)], y)[0, 1] > 0.3


@pytest.mark.parametrize("buckets", [16, 64, 256])
def test_hash_ranks_are_the_ranks_of_a_sort(spark, buckets):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("g"))
    got = {r.id: r.k for r in metrics.hash_rank(df, metrics.digest(F.col("id")), "k", ["g"], buckets).collect()}
    import hashlib

    for g in range(3):
        own = sorted((i for i in range(500) if i % 3 == g), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        assert [got[i] for i in own] == list(range(len(own)))


def test_interpolation_clamps(spark):
    knots = spark.createDataFrame([(10, 1.0), (20, 3.0)], "x int, y double")
    df = spark.createDataFrame([(5.0,), (10.0,), (15.0,), (20.0,), (99.0,), (None,)], "k double")
    assert [r.out for r in calibration.interpolated(df, "k", knots, "out").orderBy(F.asc_nulls_last("k")).collect()] == [1.0, 1.0, 2.0, 3.0, 3.0, None]
    with pytest.raises(ValueError):
        calibration.interpolated(df, "k", knots.limit(0), "out")


def test_leaks_of_nothing_and_of_null(spark):
    outputs = spark.createDataFrame([(1, None, ["x"]), (2, "x", ["x"]), (3, "Bob is here", None), (4, "(Ann Lee | likes | Bob)", [])], "id long, output string, bodies array<string>")
    f = spark.createDataFrame([("Ann Lee", "likes", "Bob")], "subj string, rel string, obj string")
    names = spark.createDataFrame([("Ann Lee",), ("Bob",)], "name string")
    got = {r.id: (r.words, r.unsupported, r.leak) for r in leaks.check(outputs, names.withColumnRenamed("name", "word"), f, names).collect()}
    assert got == {1: (0, 0, False), 2: (0, 0, False), 3: (1, 0, True), 4: (2, 0, True)}


def test_rejected_writes_leave_the_bundle(spark):
    f = spark.createDataFrame([(0, f"s{i}", "r", f"o{i % 7}") for i in range(200)], "page long, subj string, rel string, obj string")
    done = recall.write_checked(f, f.select(F.col("obj").alias("name")), 128)
    kept = done.where("accepted")
    assert 0 < kept.count() < 200
    a, b = recall.bundles(kept, 128).first().bundle, recall.bundles(f, 128).first().bundle
    out = recall.bundles(done.where("not accepted"), 128).first().bundle
    assert [x + y for x, y in zip(a, out, strict=True)] == b


def test_reports_say_what_they_leave_out(spark):
    assert io.markdown(spark.range(5), 3).split("\n")[-1] == "2 more rows"
    assert io.markdown(spark.range(3), 3).count("\n") == 4
