"""Intervals of metrics against resampling of indices in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import harness, resampling

N, BOOT = 150, 60


def macro(g, p):
    scores = []
    for x in set(g) | set(p):
        tp = sum(a == x == b for a, b in zip(g, p, strict=True))
        scores.append(2 * tp / (sum(a == x for a in g) + sum(b == x for b in p)))
    return float(np.mean(scores))


def kappa(g, p):
    po, pe = np.mean(g == p), sum(np.mean(g == x) * np.mean(p == x) for x in set(g) | set(p))
    return (po - pe) / (1 - pe)


def bcubed(g, p):
    both = (g[:, None] == g) & (p[:, None] == p)
    precision, recall = (both.sum(1) / (p[:, None] == p).sum(1)).mean(), (both.sum(1) / (g[:, None] == g).sum(1)).mean()
    return 2 * precision * recall / (precision + recall)


def fold(scorer, n, seed=12345):
    random = np.random.default_rng(seed)
    drawn = [scorer(random.integers(0, n, size=n)) for _ in range(BOOT)]
    return scorer(np.arange(n)), *np.percentile(drawn, [2.5, 97.5])


def test_intervals_of_any_metric_draw_numpy_indices(spark, monkeypatch):
    monkeypatch.setattr(resampling, "HELD_ROWS", 40)
    monkeypatch.setattr(resampling, "EACH", 7)
    rng = np.random.RandomState(4)
    g = rng.choice(["a", "b", "c"], N)
    p = np.where(rng.random_sample(N) < 0.3, rng.choice(["a", "b", "d"], N), g)
    a, b, c = (rng.randint(0, 4, N).astype(float) for _ in range(3))
    conf = rng.random_sample(N)
    bins, right = np.minimum(np.floor(conf * 10), 9), (g == p).astype(float)
    gk, pk = ([f'["{x}","{y}"]' for x, y in zip(side, rng.randint(0, 20, N), strict=True)] for side in (g, p))
    rows = []
    for i in rng.permutation(N):
        key = f"{i:04}"
        rows += [("label", key, g[i], p[i], 0.0, 0.0, 0.0), ("sum", key, None, None, a[i], b[i], c[i]), ("sure", key, str(bins[i]), None, conf[i], right[i], 0.0), ("count", key, gk[i], pk[i], 0.0, 0.0, None)]
        if i < 90:  # a family of its own size and places
            rows.append(("less", key, g[i], p[i], 0.0, 0.0, 0.0))
    rows = [tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in rows]
    df = spark.createDataFrame(rows, "family string, id string, gold string, pred string, a double, b double, c double").repartition(5)
    cells = resampling.resampled(df, BOOT, law="index").cache()
    of = lambda f: cells.where(F.col("family") == f)
    scores = resampling.label_scores(of("label"), {}).union(resampling.label_scores(of("less"), {"less": ["a", "b"]})).union(resampling.sum_scores(of("sum"))).union(resampling.calibration_scores(of("sure"))).union(resampling.count_scores(of("count")))
    scores = scores.union(resampling.group_scores(of("label")).where("metric = 'f1'").withColumn("metric", F.lit("bcubed")))
    found = {(r.family, r.metric): (r.value, r.ci_lo, r.ci_hi) for r in resampling.intervals(scores).collect()}

    def two(i, x):
        tp = ((g[i] == x) & (p[i] == x)).sum()
        return 2 * tp / ((g[i] == x).sum() + (p[i] == x).sum())

    def ece(i):
        return sum(abs(conf[i][bins[i] == x].mean() - right[i][bins[i] == x].mean()) * (bins[i] == x).mean() for x in set(bins[i]))

    def count_error(i):
        groups = [{tuple(k.split(",")) for k in np.array(side)[i]} for side in (gk, pk)]
        keys = {k for s in groups for k, _ in s}
        of_key = lambda s, k: sum(x == k for x, _ in s)
        return sum(abs(of_key(groups[0], k) - of_key(groups[1], k)) for k in keys) / len(groups[0])

    expected = {
        ("label", "accuracy"): fold(lambda i: np.mean(g[i] == p[i]), N), ("label", "macro_f1"): fold(lambda i: macro(g[i], p[i]), N), ("label", "kappa"): fold(lambda i: kappa(g[i], p[i]), N),
        ("label", "bcubed"): fold(lambda i: bcubed(g[i], p[i]), N), ("less", "macro_f1"): fold(lambda i: np.mean([two(i, x) for x in "ab"]), 90), ("less", "accuracy"): fold(lambda i: np.mean(g[i] == p[i]), 90),
        ("sum", "mean"): fold(lambda i: a[i].mean(), N), ("sum", "f1"): fold(lambda i: 2 * a[i].sum() / (2 * a[i].sum() + b[i].sum() + c[i].sum()), N),
        ("sure", "ece"): fold(ece, N), ("count", "count_error"): fold(count_error, N),
    }
    for key, want in expected.items():
        assert found[key] == pytest.approx(tuple(map(float, want)), abs=1e-9), key


def test_laws(spark, monkeypatch):
    df = spark.createDataFrame([("f", str(k), "x", "x", 1.0, 0.0, 0.0) for k in range(30)], "family string, id string, gold string, pred string, a double, b double, c double")
    parts = [sorted(map(tuple, resampling.resampled(df.repartition(n), 20).collect())) for n in (1, 4)]
    assert parts[0] == parts[1] and len(parts[0]) == 21
    assert resampling.resampled(df.limit(0), 20, law="index").count() == 0
    monkeypatch.setattr(resampling, "INDEX_ROWS", 29)
    with pytest.raises(ValueError, match="poisson"):
        resampling.resampled(df, 20, law="index")
    with pytest.raises(ValueError, match="law"):
        resampling.resampled(df, 20, law="other")


def test_regressions():
    now = {"value": 0.5, "ci_lo": 0.4, "ci_hi": 0.6}
    assert harness.worse_than("a_f1", now, {"value": 0.8, "ci_lo": 0.7, "ci_hi": 0.9}) and not harness.worse_than("a_f1", now, {"value": 0.6, "ci_lo": 0.55, "ci_hi": 0.7})
    assert not harness.worse_than("a_f1", now, {"value": 0.2, "ci_lo": 0.1, "ci_hi": 0.3}) and harness.worse_than("a_count_error", now, {"value": 0.2, "ci_lo": 0.1, "ci_hi": 0.3})
    assert harness.worse_than("a_f1", now, {"value": 0.8}) and not harness.worse_than("a_f1", {"value": None}, {"value": 0.8})
