"""Corner cases of the relational operators."""

import hashlib
from collections import Counter
import math

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from siltstone.functions import columns as C
from siltstone.operators import analysis, evaluation, gold, matching, models, news, vector_join
from siltstone.operators.graph import component_labels
from siltstone.plans import catalog
from siltstone.plans.views import view

FACT = "geo string, year long, feature string, value double, unit string, source_system string, source_dataset string, source_column string"


def test_null_of_a_better_source_shadows_a_value(spark):
    rows = [("HU", 2020, "f", 1.0, "u", "worldbank", "d", "c"), ("HU", 2020, "f", None, "u", "eurostat", "d", "c"), ("AT", 2020, "f", 2.0, "u", "nobody", "d", "c"), ("AT", 2020, "f", 3.0, "u", "worldbank", "d", "c")]
    found = {r.geo: r.value for r in gold.resolve(spark.createDataFrame(rows, FACT)).collect()}
    assert found == {"HU": None, "AT": 3.0}
    assert [r.geo for r in gold.pivot_features(gold.resolve(spark.createDataFrame(rows, FACT)), ["f"]).collect()] == ["AT"]


def test_carry_forward_resets(spark):
    rows = [(1, 1, "AT", "AT"), (1, 2, "", None), (1, 3, "??", None), (1, 4, "", None), (1, 5, "HU", "HU"), (1, 6, None, None)]
    out = gold.carried_forward(spark.createDataFrame(rows, "t int, k int, code string, v string"), ["t"], ["k"], "code", "v", "geo")
    assert [r.geo for r in out.orderBy("k").collect()] == ["AT", "AT", None, None, "HU", "HU"]


def test_numbers_and_dates(spark):
    df = spark.createDataFrame([("14988 p",), (":",), ("1,234",), (None,)], "v string")
    assert [r[0] for r in df.select(C.sdmx_number(F.col("v"))).collect()] == [14988.0, None, 1234.0, None]
    df = spark.createDataFrame([("1.234.567",), ("19 635,0",), ("-",), ("..",), ("1.5",)], "v string")
    assert [r[0] for r in df.select(C.german_number(F.col("v"))).collect()] == [1234567.0, 19635.0, None, None, 1.5]
    df = spark.createDataFrame([("20240102T030405Z",), ("Tue, 02 Jan 2024 03:04:05 +0000",), ("2024-01-02",), ("soon",), ("20240102",)], "v string")
    assert [str(r[0]) for r in df.select(C.news_time(F.col("v")).cast("timestamp_ntz")).collect()] == ["2024-01-02 03:04:05"] * 2 + ["2024-01-02 00:00:00", "None", "2024-01-02 00:00:00"]


def test_geo_levels(spark):
    df = spark.createDataFrame([(g,) for g in ("AT", "AT11", "EU27_2020", "EU", "1A", "Z4")], "geo string")
    assert [r.geo_level for r in gold.with_levels(df).collect()] == ["country", "region", "aggregate", "aggregate", "aggregate", "aggregate"]


def test_components_and_groups(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101)], "a long, b long")
    found = {r.node: r.component for r in component_labels(edges).collect()}
    assert set(found.values()) == {1, 100} and len(found) == 42


def brute_links(path, threshold):
    rows = sorted(pq.read_table(path).to_pylist(), key=lambda r: r["vec_id"])
    v = np.array([r["embedding"] for r in rows], float)
    v /= np.sqrt((v * v).sum(1))[:, None]
    return {(rows[x]["vec_id"], rows[y]["vec_id"]) for x, y in zip(*np.nonzero(np.triu(v @ v.T >= threshold, 1)), strict=True)}


def test_links_cross_labels(spark, sf_dir):
    links = brute_links(f"{sf_dir}/embeddings.parquet", 0.3)
    found = [tuple(r) for r in catalog.QUERIES["dedup_similarity_edges"](spark, sf_dir).collect()]
    assert len(found) == len(set(found)) and set(found) == links
    degrees = Counter(x for link in links for x in link)
    rows = vector_join.linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 0.3).collect()
    assert len({r.vec_id for r in rows}) == len(rows) and {r.vec_id: r.n_links for r in rows if r.n_links} == degrees


def test_registered_edges_tell_both_ends_of_each_link(spark, tmp_path):
    v = [[1.0, 0.0], [2.0, 0.0], [0.0, 1.0], [1.0, 1.0], [-1.0, 0.0], [1.0, 0.0]]
    spark.createDataFrame([(10 * k, x, k % 2) for k, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = catalog.QUERIES["dedup_similarity_edges"](spark, str(tmp_path))
    assert found.columns == ["a", "b"]
    assert sorted(tuple(r) for r in found.collect()) == [(0, 10), (0, 30), (0, 50), (10, 30), (10, 50), (20, 30), (30, 50)]


def test_blocks_of_few_and_of_unlike_vectors(spark, monkeypatch):
    for name, value in {"BLOCK_ROWS": 64, "STRIP_ROWS": 10, "CELL_ROWS": 40}.items():
        monkeypatch.setattr(matching, name, value)
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(size=(150, 8)), np.repeat(rng.normal(size=(3, 8)), 30, axis=0) * 3.0, rng.normal(size=(40, 3)) @ np.eye(3, 8)])
    rows = [(k, x.tolist() if k < 240 else x[:3].tolist()) for k, x in enumerate(v)]
    df = spark.createDataFrame([*rows, (900, [0.0] * 8), (901, [float("inf")] + [1.0] * 7), (902, [float("nan")] * 8)], "id long, v array<double>")
    for threshold in (0.3, 1.0, -0.5):
        found = [(r.a, r.b, r.cos) for r in matching.similar_pairs(df, "id", "v", threshold).collect()]
        want = []
        for part in (range(240), range(240, len(v))):
            for x in part:
                r, _, cos = matching.close_cells(v[x + 1 : part.stop, : len(rows[x][1])], v[x : x + 1, : len(rows[x][1])], threshold)
                want += [(x, x + 1 + k, c) for k, c in zip(r.tolist(), cos.tolist(), strict=True)]
        assert sorted(f[:2] for f in found) == sorted(w[:2] for w in want) == sorted(tuple(r) for r in matching.similar_pairs(df, "id", "v", threshold, cosine=False).collect())
        assert np.allclose([f[2] for f in sorted(found)], [w[2] for w in sorted(want)], rtol=0, atol=1e-12)


def test_groups_cross_labels(spark, sf_dir):
    links = brute_links(f"{sf_dir}/embeddings.parquet", 0.3)
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    members = {}
    for x in sorted(parent, key=str):
        members.setdefault(find(x), []).append(str(x))
    ids = {k: "dedup_" + hashlib.sha256("|".join(m).encode()).hexdigest()[:16] for k, m in members.items()}
    found = catalog.QUERIES["dedup_components"](spark, sf_dir).collect()
    assert sorted((r.node, r.component, r.group_id, r.is_duplicate) for r in found) == sorted((x, find(x), ids[find(x)], find(x) != x) for x in parent)


def test_blocks_of_vectors_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_ROWS", 7)
    monkeypatch.setattr(matching, "STRIP_ROWS", 3)
    v = np.random.default_rng(5).normal(size=(60, 4))
    rows = [(f"k{k:02}", x.tolist()) for k, x in enumerate(v)] + [("none", None), ("zero", [0.0] * 4), ("short", [1.0]), (None, [1.0] * 4), ("hole", [1.0, None, 1.0, 1.0]), ("k00", v[0].tolist())]
    found = [(r.a, r.b) for r in matching.similar_pairs(spark.createDataFrame(rows, "id string, v array<double>"), "id", "v", 0.5).collect()]
    u = v / np.sqrt((v * v).sum(1))[:, None]
    once = [(f"k{x:02}", f"k{y:02}") for x, y in zip(*np.nonzero(np.triu(u @ u.T >= 0.5, 1)), strict=True)]
    assert sorted(found) == sorted(once + [p for p in once if p[0] == "k00"])


def test_only_significant_pairs_are_ranked(spark, sf_dir):
    z = [math.atanh(r) * math.sqrt(n - 3) for r, n in ((0.9, 4), (0.5, 40), (0.3, 44))] + [None]
    rows = [("t", "f", g, r, x) for g, r, x in zip("abcd", (0.9, 0.5, 0.3, 1.0), z, strict=True)]
    found = analysis.strongest(analysis.significant(spark.createDataFrame(rows, "target string, feature string, geo string, pearson_r double, fisher_z double")))
    p = {g: x is not None and math.erfc(abs(x) / math.sqrt(2)) < 0.05 for g, x in zip("abcd", z, strict=True)}
    assert [(r.geo, r["rank"]) for r in found.orderBy("rank").collect()] == [("b", 1), ("c", 2)] and [g for g in p if p[g]] == ["b", "c"]
    every = {(r.target, r.feature, r.geo): r.fisher_z for r in catalog.QUERIES["corr_by_geo"](spark, sf_dir).collect()}
    top = [(r.target, r.feature, r.geo) for r in catalog.QUERIES["corr_topk"](spark, sf_dir).collect()]
    likely = {k for k, x in every.items() if x is not None and math.erfc(abs(x) / math.sqrt(2)) < 0.05}
    assert len(top) == min(15, len(likely)) and set(top) <= likely


def test_each_order_is_looked_up(spark, sf_dir):
    orders = pq.read_table(f"{sf_dir}/orders.parquet").to_pylist()
    hits, misses = ([r.k for r in catalog.QUERIES[q](spark, sf_dir).collect()] for q in ("cache_hits", "cache_misses"))
    assert sorted(hits + misses) == sorted(r["o_orderkey"] for r in orders)
    assert set(hits) == {r["o_orderkey"] for r in orders if r["o_orderstatus"] == "F"}


def test_metrics(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "gold int, pred int")
    row = evaluation.binary(pairs).first()
    assert (row.precision, row.recall, row.f1) == (0.5, 0.5, 0.5)
    assert evaluation.kappa(pairs).first().kappa == 0.0
    ci = evaluation.bootstrap(spark.createDataFrame([(k, float(k % 2)) for k in range(200)], "id long, v double"), "v", 200).first()
    assert 0.35 < ci.ci_lo < 0.5 < ci.ci_hi < 0.65


def test_registered_bootstrap_takes_all_resamples(spark, sf_dir):
    scores = view(spark, sf_dir, "eval_pair").withColumn("v", (F.col("gold") == F.col("pred")).cast("double"))
    row = catalog.QUERIES["eval_bootstrap_ci"](spark, sf_dir).first()
    want, few = (evaluation.bootstrap(scores, "v", n).first() for n in (2000, 200))
    six = lambda r: (round(r.ci_lo, 6), round(r.ci_hi, 6))
    assert six(row) == six(want) != six(few)


def test_model_failures_are_rows(spark):
    def model(text):
        if "bad" in text:
            raise ValueError("no answer")
        return {"event_type": "strike", "sentiment": "negative", "confidence": 2}

    rows = spark.createDataFrame([("1", "fine"), ("2", "bad")], "article_id string, body string")
    found = {r.article_id: r for r in models.extract(rows, model).collect()}
    assert found["2"].reason == "ValueError: no answer" and found["1"].event_type == "strike"
    for given, country in (("HU", "HU"), ("hu", None), ("other", "other")):  # countries are taken exactly
        good = news.validated(models.extract(rows, model).where("reason is null").withColumn("country", F.lit(given))).first()
        assert (good.country, good.confidence) == (country, 1.0)
