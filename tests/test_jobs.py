"""Jobs over the wide matrix, the evaluation harness and validation, on small tables."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import columns as C
from siltstone.operators import analysis, evaluation, harness, jobs, news

GOLD = "article_id string, partition string, is_rail_related boolean, event_type string, sentiment string, country string, language string, operators array<string>, rail_lines array<string>, monetary_amount_eur double, cross_lingual_dedup_id string"


def test_p_values(spark):
    rows = [(0.5, 30), (-0.9, 4), (1.0, 10), (0.3, 3), (0.99, 500), (0.0, 10), (None, 9)]
    found = spark.createDataFrame(rows, "r double, n long").select(C.fisher_p(F.col("r"), F.col("n")).alias("p")).collect()
    for (r, n), row in zip(rows, found, strict=True):
        if r is None or n < 4 or abs(r) >= 1:
            assert row.p is None
        else:
            assert row.p == pytest.approx(math.erfc(abs(math.atanh(r) * math.sqrt(n - 3)) / math.sqrt(2)), rel=1e-6, abs=1e-300)


def test_jobs(spark, tmp_path):
    rng = np.random.RandomState(3)
    rows = []
    for geo in ("HU", "AT", "DE", "HU11", "HU12", "HU21"):
        for year in range(2000, 2020):
            x = float(rng.normal())
            rows.append((geo, "country" if len(geo) == 2 else "region", year, 10 + x, 20 + 2 * x + float(rng.normal()) * 0.1, float(rng.random_sample()), 100.0 + len(rows), 50.0))
    matrix = spark.createDataFrame(rows, "geo string, geo_level string, year long, rail_investment double, follows double, noise double, rail_network_length_km double, rail_electrified_km double")
    assert jobs.numeric_columns(matrix) == ["rail_investment", "follows", "noise", "rail_network_length_km", "rail_electrified_km"]
    out = str(tmp_path / "out")
    found = jobs.run_correlations(matrix, ["rail_investment", "absent"], out, country_only=True)
    best = found["top_by_target"]["rail_investment"][0]
    assert best["feature"] == "follows" and best["kind"] == "level" and best["pearson_r"] > 0.9 and best["p_pearson"] == 0.0
    assert json.loads(spark.read.text(f"{out}/manifest_correlations_pooled_levels").first().value)["status"] == "passed"
    assert os.path.isdir(f"{out}/correlations_pooled_levels_csv")
    panel = jobs.run_correlations(matrix, ["rail_investment"], out, by_country=True, panel=True, least=10)
    assert {r["kind"] for r in panel["top_by_target"]["rail_investment"]} == {"delta"} and all(r["p_pearson"] < 0.05 for r in panel["top_by_target"]["rail_investment"])
    assert jobs.run_coverage(matrix, out)["n_rows"] == len(rows)
    assert jobs.run_regional(matrix, out, "rail_investment")["n_pairs"] == 20
    for broken in (lambda: jobs.run_coverage(matrix.limit(0), out), lambda: jobs.run_correlations(matrix, ["absent"], out), lambda: jobs.run_regional(matrix.drop("rail_electrified_km"), out)):
        with pytest.raises(ValueError, match="no column|no rows|none of the targets"):
            broken()


def test_correlation_job_in_detail(spark, tmp_path):
    """Investment is no feature, aggregates are no countries, intensities become targets, and the CSV is one file in order."""
    rng = np.random.RandomState(5)
    rows = [(geo, level, year, *(float(x) for x in rng.random_sample(6) + 1)) for geo, level in (("HU", "country"), ("AT", "country"), ("EU", "aggregate"), ("DE", "country"), ("HU11", "region")) for year in range(2000, 2015)]
    names = ["rail_investment", "rail_investment_pps", "population_total", "gdp_current_meur", "rail_network_length_km", "other"]
    matrix = spark.createDataFrame(rows, "geo string, geo_level string, year long, " + ", ".join(f"{n} double" for n in names))
    found = jobs.run_correlations(matrix, ["rail_investment_pps", "rail_investment"], str(tmp_path), country_only=True, least=10)
    assert found["targets"] == ["rail_investment_pps", "rail_investment", "rail_investment_per_capita", "rail_investment_pct_gdp", "rail_investment_per_network_km"] and found["n_features"] == 4
    table = spark.read.parquet(f"{tmp_path}/correlations_pooled_levels").collect()
    assert {r.feature for r in table} == set(names[2:]) and len(table) == 5 * 8 == found["n_rows_reported"]
    x = {(r[0], r[2]): r for r in rows if r[1] == "country"}
    both = [(r[4] / r[5] * 1e6, r[8]) for r in x.values()]
    mine = next(r for r in table if (r.target, r.feature, r.kind) == ("rail_investment_per_capita", "other", "level"))
    assert mine.n == 45 and mine.pearson_r == pytest.approx(np.corrcoef(*zip(*both, strict=True))[0, 1])
    (csv,) = [f for f in os.listdir(f"{tmp_path}/correlations_pooled_levels_csv") if f.endswith(".csv")]
    lines = [line.split(",") for line in open(f"{tmp_path}/correlations_pooled_levels_csv/{csv}").read().split()]
    assert len(lines) == 41 and [(r[0], -abs(float(r[3]))) for r in lines[1:]] == sorted((r[0], -abs(float(r[3]))) for r in lines[1:])
    bare = matrix.drop("geo_level")
    assert jobs.run_correlations(bare, ["rail_investment"], str(tmp_path), country_only=True, least=10)["top_by_target"]["rail_investment"][0]["n"] in (42, 45)
    with pytest.raises(ValueError, match="feature"):
        jobs.run_correlations(matrix.select("geo", "year", "rail_investment"), ["rail_investment"], str(tmp_path))


def test_regional_job_in_detail(spark, tmp_path):
    rows = [(f"{c}{k}{j}", "region", year, 100.0 * (k + 1) * (1 + (year - 2000) * (c == "HU")), 50.0 if k else 0.0, None) for c in ("HU", "AT") for k in range(3) for j in (0, "1") for year in range(2000, 2006)]
    rows += [("HU1", "region", 2000, 5.0, 1.0, None), ("AT90", "region", 2000, 0.0, 1.0, None)] + [(c, "country", year, 9.0, 9.0, float(year)) for c in ("HU", "AT") for year in range(2000, 2006)]
    matrix = spark.createDataFrame(rows, "geo string, geo_level string, year long, rail_network_length_km double, rail_electrified_km double, rail_investment double")
    found = jobs.run_regional(matrix, str(tmp_path))
    assert found["n_described"] == 74 and found["n_regions"] == 13 and found["n_country_years"] == 12 and found["investment_vs_disparity"]["n"] == 12
    assert [r["geo"] for r in found["top_nuts2_by_network"]][:2] == ["HU20", "HU21"] and len(found["least_unequal_countries"]) == 2
    unequal = {(r.country_code, r.year): r for r in spark.read.parquet(f"{tmp_path}/inequality").collect()}
    electrified = [0.0, 0.0, 50.0, 50.0, 50.0, 50.0]
    assert unequal["HU", 2003].cv_electrified == pytest.approx(np.std(electrified, ddof=1) / np.mean(electrified))
    with pytest.raises(ValueError, match="usable pairs"):
        jobs.run_regional(matrix.where("year < 2001"), str(tmp_path))


@pytest.mark.parametrize("buckets", [2, 128])
def test_percent_ranks(spark, buckets):
    rng = np.random.RandomState(6)
    rows = [(f"k{k % 3}", float(v)) for k, v in enumerate(rng.normal(size=500).round(1))] + [("k0", 0.0)] * 300 + [("k1", float("nan"))] * 3 + [("k1", float("inf")), ("k1", -0.0), ("alone", 1.0)]
    df = spark.createDataFrame(rows, "name string, v double")
    got = analysis.percent_ranked(df, ["name"], "v", "r", buckets)
    expected = df.selectExpr("name", "v", "percent_rank() OVER (PARTITION BY name ORDER BY v) AS r")
    assert sorted(map(repr, got.select("name", "v", "r").collect())) == sorted(map(repr, expected.collect()))


def test_significance_is_by_p(spark):
    found = spark.createDataFrame([("t", "a", 0.9, 0.14), ("t", "b", 0.6, 0.01), ("t", "c", 1.0, None)], "target string, feature string, pearson_r double, p_pearson double")
    assert [r.feature for r in analysis.strongest(analysis.significant(found)).collect()] == ["b"]


def test_harness(spark, tmp_path):
    g = [(str(k), "TEST", True, "strike", "negative", "HU", "hu", ["MÁV"], ["L1"], 100.0, None) for k in range(40)] + [("x", "TUNE", True, "delay", None, "AT", "de", [], [], None, None)]
    p = [(str(k), "TEST", True, "delay" if k < 10 else "strike", "negative", "HU", "hu", ["MÁV"], [], 100.5, None, 0.8, 1) for k in range(39)] + [("0", "TEST", False, "strike", None, "HU", "hu", [], ["L1"], None, None, 0.8, 2), ("new", "TEST", True, "other", None, None, None, None, None, None, None, 0.1, 1)]
    gold, pred = spark.createDataFrame(g, GOLD), spark.createDataFrame(p, GOLD + ", confidence double, at long")
    assert harness.alignment_counts(gold, pred).first().asDict() == {"matched": 39, "gold_only": 1, "pred_only": 1}
    scores = {r.article_id: r for r in harness.article_scores(harness.aligned(gold, pred, "at")).collect()}
    assert len(scores) == 39
    first = scores["0"]  # the later of two predictions
    assert (first.event_10way_match, first.is_rail_related_match, first.operators_f1, first.rail_lines_recall, first.monetary_match, first.sentiment_match) == (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    assert (scores["5"].event_10way_match, scores["5"].event_superclass_match, scores["5"].rail_lines_recall) == (0.0, 1.0, 0.0)
    assert scores["20"].overall_score == pytest.approx(0.9)
    limits = {"event_type_accuracy": 0.7, "language_accuracy": 0.9, "monetary_match_rate": 0.99}
    found = harness.evaluate(gold, pred, "at", str(tmp_path / "eval"), limits)
    assert found["metrics"]["event_type_accuracy"]["value"] == pytest.approx(30 / 39) and found["threshold_violations"] == ["monetary_match_rate"] and found["status"] == "failed"
    assert harness.of_partition(gold, "tune").count() == 1 and harness.of_partition(gold, "ALL").count() == 41
    less = harness.evaluate(gold, pred, "at", str(tmp_path / "eval"), limits, least_support=100)
    assert less["status"] == "passed" and less["metrics"]["event_type_accuracy"]["demotion_reason"] == "support"


def test_validation(spark):
    raw = spark.createDataFrame([("1", "xx", "flying", "maybe", "2.5", "zz", "-7", "MÁV", "yes"), ("2", "HU", "strike", "negative", "nan", "HU ", "0.5", None, None)], "article_id string, country string, event_type string, sentiment string, confidence string, language string, sentiment_score string, operators string, is_rail_related string")
    a, b = news.validated(raw).orderBy("article_id").collect()
    assert (a.country, a.event_type, a.sentiment, a.confidence, a.language, a.sentiment_score, a.operators, a.is_rail_related) == (None, "other", None, 1.0, None, -1.0, ["MÁV"], True)
    assert (b.country, b.event_type, b.confidence, b.language, b.operators, b.rail_lines, b.is_rail_related, b.confidence_schema_version) == ("HU", "strike", None, "hu", [], [], False, "1.0")


def test_scalars(spark):
    row = spark.range(1).select(C.string_list(F.lit(" a; ;b ")).alias("a"), C.string_list(F.lit('["x", " "]')).alias("b"), C.string_list(F.lit(None).cast("string")).alias("c"), C.digits_date(F.lit("2024-02-03T10")).alias("d"), C.digits_date(F.lit("soon")).alias("e"), C.month_window(F.to_date(F.lit("2024-02-03"))).alias("m"), C.fold(F.lit("ČŠŽŁąț")).alias("f")).first()
    assert (row.a, row.b, row.c, str(row.d), row.e, str(row.m["last"]), row.f) == (["a", "b"], ["x"], [], "2024-02-03", None, "2024-02-29", "cszlat")


def test_bootstrap(spark):
    rng = np.random.RandomState(2)
    values = rng.random_sample(900)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)] + [(5000, None)], "id long, v double")
    keys = np.array([r.k for r in df.where("v is not null").orderBy("id").select(evaluation.row_key(F.col("id")).alias("k")).collect()])
    w = evaluation.poisson_weights(keys, 2000, 12345)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    means = values @ w / w.sum(axis=0)
    for parts in (1, 5):
        row = evaluation.bootstrap(df.repartition(parts), "v").first()
        assert (row.ci_lo, row.ci_hi) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=1e-9)
    spread = 1.96 * values.std() / 30
    assert row.ci_lo == pytest.approx(values.mean() - spread, abs=0.004) and row.ci_hi == pytest.approx(values.mean() + spread, abs=0.004)
    assert evaluation.bootstrap(df.limit(0), "v").first().ci_lo is None
