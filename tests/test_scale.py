"""Steps that grew faster than their input: their results by brute force, and what their plans send."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import functions as F

from surefact import catalogue
from surefact.functions.digests import Texts
from surefact.operators import calibration, metrics, models, registry

ITEMS = "id string, right boolean, a double, b double"


def exchanges(df) -> int:
    """Shuffles of the plan as first made."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def items(spark):
    rng = np.random.default_rng(3)
    rows = [(f"id{i}" if i % 9 else "é" * (i % 5), bool(rng.random() < 0.4), float(rng.integers(6)), None if i % 11 == 3 else float(rng.random())) for i in range(80)]
    own = {r[0]: r for r in [*rows, ("x" * 70, True, 2.0, 0.5)]}
    return spark.createDataFrame(list(own.values()), ITEMS)


def auroc(pairs):
    """By pairs; null is the highest confidence, as in the SQL."""
    up = [float("inf") if c is None else c for c, r in pairs if r]
    down = [float("inf") if c is None else c for c, r in pairs if not r]
    return sum((x > y) + 0.5 * (x == y) for x in up for y in down) / (len(up) * len(down)) if up and down else None


def md5(s: str) -> str:
    return hashlib.md5(s.encode()).hexdigest()


def test_md5_of_many_texts_is_md5():
    texts = ["", "ü" * 20, "z" * 70, *("q" * k for k in range(48, 60)), *map(str, range(20_000))]
    for laid in (pa.array(texts), pa.array(["cut", *texts])[1:]):
        t = Texts(laid)
        for prefix in (b"", b"7:", b"1999:", b"12345:"):
            want = [hashlib.md5(prefix + s.encode()).digest() for s in texts]
            got = t.md5(prefix)
            assert got[0].tolist() == [int.from_bytes(w[:8], "big") for w in want] and got[1].tolist() == [int.from_bytes(w[8:], "big") for w in want]
            assert t.md5(prefix, first=True).tolist() == [int.from_bytes(w[:4], "big") for w in want]
    assert Texts(pa.array([], pa.string())).md5(b"1:").shape == (2, 0)


def test_a_bootstrap_sends_items_and_no_draws(spark):
    df = items(spark)
    out = metrics.bootstrap(df, "id", ["a", "b"], "right", 60)
    assert exchanges(out) - exchanges(df) == 1
    rows = sorted(df.collect(), key=lambda r: md5(r.id))
    got = {(r.rep, r.source): r.auroc for r in out.collect()}
    assert len(got) == 120
    for rep in range(1, 61):
        drawn = [rows[int(md5(f"{rep}:{k}")[:7], 16) % len(rows)] for k in range(len(rows))]
        for s in ("a", "b"):
            assert got[rep, s] == pytest.approx(auroc([(r[s], r.right) for r in drawn]), abs=1e-12)
    one = metrics.bootstrap(df.where("right"), "id", ["a"], "right", 3).collect()
    assert [(r.rep, r.auroc) for r in sorted(one)] == [(1, None), (2, None), (3, None)]
    assert metrics.bootstrap(df.limit(0), "id", ["a"], "right", 3).count() == 0


def test_differences_of_bootstraps_come_from_one_pass(spark, sf):
    out = catalogue.queries()["bootstrap_difference"](spark, sf)
    assert exchanges(out) - exchanges(catalogue.scored(spark, sf)) <= 4  # the items, two of the pivot, the one row
    x = sorted(catalogue.scored(spark, sf).collect(), key=lambda r: md5(str(r.doc_id)))
    gaps = []
    for rep in range(1, 2001):
        drawn = [x[int(md5(f"{rep}:{k}")[:7], 16) % len(x)] for k in range(len(x))]
        flag = np.array([r.correct for r in drawn])
        a, b = (np.array([float(r[s]) for r in drawn]) for s in ("conf", "other"))
        if 0 < flag.sum() < len(flag):
            wins = [(v[flag][:, None] > v[~flag]).mean() + 0.5 * (v[flag][:, None] == v[~flag]).mean() for v in (a, b)]
            gaps.append(wins[0] - wins[1])
    row = out.first()
    assert row.low == pytest.approx(np.quantile(gaps, 0.025), abs=1e-6) and row.high == pytest.approx(np.quantile(gaps, 0.975), abs=1e-6)


@pytest.mark.parametrize("tiles", [(7, 2), (16, 64), (512, 4096)])
def test_nearest_rows_are_exact_with_ties_and_any_size(monkeypatch, tiles):
    monkeypatch.setattr(registry, "TILE_TERMS", tiles[0])
    monkeypatch.setattr(registry, "TILE_NAMES", tiles[1])
    rng = np.random.default_rng(5)
    a, b = registry.quantise(rng.normal(size=(90, 8))), registry.quantise(rng.normal(size=(150, 8)))
    close = b.copy()
    close[1:] = close[0]
    close[77, 3] += 1  # one part in a million, which single precision may not see
    for x, y in ((a, b), (a, b[:1]), (a, b[:2]), (a, b[rng.integers(0, 9, 150)]), (a * 0, b), (a, close), (a * 2.0**60, b * 2.0**60), (a[:0], b)):
        d = x @ y.T
        want = np.lexsort((np.broadcast_to(np.arange(len(y)), d.shape), -d), axis=1)[:, :3]
        places, dots = registry.nearest(x, y, 3)
        assert (places == want).all() and (dots == np.take_along_axis(d, want, axis=1)).all()


def test_resolving_in_many_blocks_gives_the_nearest_names(spark, monkeypatch):
    for k, v in (("NAMES", 40), ("LEAST_TERMS", 25), ("TERMS", 60)):
        monkeypatch.setattr(registry, k, v)
    rng = np.random.default_rng(6)
    e = np.repeat(rng.normal(size=(60, 4)), 2, axis=0)
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(e)], "name long, e array<double>")
    q = registry.quantise(e)
    d = q @ q.T
    want = {(i, k + 1, int(n), d[i, n]) for i in range(120) for k, n in enumerate(np.lexsort((np.arange(120), -d[i]))[:3])}
    assert {(r.term, r.place, r.name, r.dot) for r in registry.resolve(v.withColumnRenamed("name", "term"), v, top=3).collect()} == want
    best = {r.name: r.best for r in registry.leave_one_out(v).collect()}
    assert best == {i: max(d[i, n] for n in range(120) if n != i) for i in range(120)}


def test_permutations_send_items_and_no_dealt_rows(spark):
    df = items(spark)
    rows = sorted(df.collect(), key=lambda r: md5(r.id))
    for within in (None, ["a"], ["right"]):
        out = metrics.permuted_aurocs(df, "id", "b", "right", 30, within)
        assert exchanges(out) - exchanges(df) == 1
        got = {r.rep: r.auroc for r in out.collect()}
        key = lambda r: r[within[0]] if within else 0  # noqa: E731, B023
        for rep in range(1, 31):
            dealt = []
            for k in {key(r) for r in rows}:
                own = [r for r in rows if key(r) == k]
                dealt += zip([r.b for r in sorted(own, key=lambda r: md5(f"{rep}:{r.id}"))], [r.right for r in own], strict=True)
            assert got[rep] == pytest.approx(auroc(dealt), abs=1e-12)
    assert metrics.permuted_aurocs(df.limit(0), "id", "b", "right", 3).count() == 0


def test_token_features_are_worked_out_once(spark):
    rows = [([[1.0, 3.0, 0.5], [0.0, 0.0, 2.0]], [0, 2]), ([[2.0, 2.0]], [1]), ([], []), (None, None), ([[800.0, 0.0]], [1])]
    f = models.token_features(F.col("logits"), F.col("chosen"))
    out = spark.createDataFrame(rows, "logits array<array<double>>, chosen array<int>").select(f.alias("f"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("EXP(") == 2  # the mass, the entropy
    for (logits, chosen), got in zip(rows, out.collect(), strict=True):
        each = []
        for x, i in zip(logits or [], chosen or [], strict=True):
            p = np.array(x) - max(x) - np.log(np.exp(np.array(x) - max(x)).sum())
            each.append((max(p[i], np.log(1e-12)), -(np.exp(p) * p).sum(), sorted(x)[-1] - sorted(x)[-2]))
        e = np.array(each)
        want = [e[:, 0].mean(), e[:, 0].min(), e[:, 1].mean(), e[:, 2].mean(), len(e)] if each else [0.0] * 5
        assert got.f == pytest.approx(want, abs=1e-9)


def test_token_features_of_columns_are_those_of_arrays(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([tuple(float(x) for x in r) for r in rng.normal(size=(40, 6)) * 9], "a double, b double, c double, d double, e double, g double")
    cells = [[F.col(c) for c in "abc"], [F.col(c) for c in "deg"]]
    want = models.token_features(F.array(*(F.array(*r) for r in cells)), F.array(F.lit(2), F.lit(0)))
    out = models.token_features_of(df.withColumn("want", want), cells, [2, 0], "f")
    plan = models.token_features_of(df, cells, [2, 0], "f")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and out.columns == [*df.columns, "want", "f"]
    for r in out.collect():
        assert r.f == pytest.approx(r.want, abs=1e-12)


def test_moments_come_from_one_pass(spark):
    rng = np.random.default_rng(9)
    rows = [(k, bool(i % 3), True, float(x), 0.0) for k in (16, 32) for i, x in enumerate(rng.normal(size=30))] + [(64, False, False, 0.5, 0.0)]
    df = spark.createDataFrame(rows, "k int, written boolean, right boolean, a double, m double")
    out = calibration.moments(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    miss = [r[3] for r in rows if not r[1]]
    hits = {k: [r[3] for r in rows if r[1] and r[0] == k] for k in (16, 32)}
    mu = {k: np.sqrt(2 / (np.pi * k)) for k in hits}
    scale = sum(np.mean(hits[k]) * mu[k] for k in hits) / sum(mu[k] ** 2 for k in hits)
    got = {r.k: r for r in out.collect()}
    assert set(got) == {16, 32}
    for k, r in got.items():
        assert [r.mean, r.sd, r.scale, r.null_mu, r.null_sd] == pytest.approx([np.mean(hits[k]), np.std(hits[k], ddof=1), scale, np.mean(miss), np.std(miss, ddof=1)])
