"""Extraction runs with cache, routes and failures."""

import hashlib
import json

from pyspark.sql import functions as F

from siltstone.operators import runner

ARTICLES = "article_id string, source string, url string, title string, published_date string, body string"
RECORDS = "gkg_id string, gkg_date string, document_identifier string, source_common_name string, gkg_themes string, gkg_tone double, gkg_persons string, gkg_organizations string, gkg_locations string, gkg_emotions string"


def model_of(log):
    def model(article):
        with open(log, "a") as out:
            out.write(article["article_id"] + "\n")
        if article["article_id"] == "bad":
            raise ValueError("no answer")
        if article["article_id"] == "list":
            return ["no object"]
        return {"language": "de", "country": "AT", "event_type": "strike", "is_rail_related": "y", "operators": "ÖBB", "confidence": 1.7, "monetary_amount_eur": "12.5", "unknown": {"a": 1}, "article_id": "stolen"}

    return model


def test_runs(spark, tmp_path):
    rows = [("a", "feed", "http://a", "T", "2024-01-01", "text"), ("a", "feed", "http://a", "T", "2024-01-01", "text"), ("b", "feed", None, None, None, None), ("bad", "feed", None, "T", None, "x"), ("list", "feed", None, "T", None, "x")]
    rows += [("g", "GDELT", "http://g/1", "der Zug und die Bahn", "2024-01-05", None), ("h", "gdelt", "http://h", "T", None, "unmatched")]
    records = [("r1", "20240105", "http://x;http://g/1/", None, "RAIL;LABOR_STRIKE", -3.0, "Somebody", "Osterreich; ÖBB Holding", "1#Paris#FR; 4#Wien, Austria#AU", "1,2"), ("r0", "20240105", "http://other", None, "DELAY", 1.0, None, None, None, None)]
    articles, gkg, log = spark.createDataFrame(rows, ARTICLES), spark.createDataFrame(records, RECORDS), tmp_path / "calls"
    first = runner.run_extraction(articles, model_of(str(log)), str(tmp_path / "cache"), "m1", gkg, attempts=2)
    calls = sorted(log.read_text().split())
    assert calls == ["a", "b", "bad", "bad", "h", "list", "list"]  # repeated rows ask once, failures as often as allowed
    found = {r.article_id: r for r in first.features.collect()}
    assert first.features.count() == 5 and set(found) == {"a", "b", "g", "h"}
    a, g = found["a"], found["g"]
    assert (a.language, a.country, a.event_type, a.is_rail_related, a.operators, a.confidence, a.monetary_amount_eur, a.url, a.source) == ("de", "AT", "strike", True, ["ÖBB"], 1.0, 12.5, "http://a", "feed")
    assert (g.country, g.event_type, g.operators, g.sentiment, g.gkg_tone, g.is_rail_related, g.language, g.gkg_tone_source, g.confidence) == ("AT", "strike", ["ÖBB"], "negative", -3.0, True, "de", "gdelt_gkg", None)
    assert {(r.article_id, r.reason) for r in first.failures.collect()} == {("bad", "ValueError: no answer"), ("list", "ValueError: the model's answer is no object")}
    assert first.manifest["counts"] == {"processed": 7, "succeeded": 5, "failed": 2, "cache_hits": 0, "gdelt_passthrough": 1, "llm_attempted": 5, "llm_attempts": 7, "retry_attempts": 2}
    assert first.manifest["status"] == "completed_with_failures" and json.loads(spark.read.text(f"{tmp_path}/cache/runs/{first.manifest['run_id']}/manifest").first().value)["counts"] == first.manifest["counts"]

    log.write_text("")
    good = articles.where("article_id NOT IN ('bad', 'list')")
    second = runner.run_extraction(good, model_of(str(log)), str(tmp_path / "cache"), "m1", gkg)
    assert log.read_text() == "" and second.manifest["counts"]["cache_hits"] == 5 and second.manifest["counts"]["llm_attempted"] == 0 and second.manifest["status"] == "passed"
    assert sorted(map(str, second.features.collect())) == sorted(map(str, first.features.collect()))
    changed = runner.run_extraction(good.withColumn("body", F.concat(F.coalesce("body", F.lit("")), F.lit("!"))), model_of(str(log)), str(tmp_path / "cache"), "m1")
    assert sorted(log.read_text().split()) == ["a", "b", "g", "h"] and changed.manifest["counts"]["cache_hits"] == 0
    manifest = {r.model_digest: r for r in runner.Cache(spark, str(tmp_path / "cache")).manifest().collect()}
    assert (manifest["m1"].hits, manifest["m1"].misses, manifest["m1"].cached) == (4, 11, 7) and (manifest["gdelt-passthrough"].hits, manifest["gdelt-passthrough"].misses, manifest["gdelt-passthrough"].cached) == (1, 1, 1)
    assert [e.event for e in manifest["gdelt-passthrough"].events] == ["hit", "miss"]
    none = runner.run_extraction(articles.limit(0), model_of(str(log)), str(tmp_path / "cache"), "m1", gkg.limit(0))
    assert none.features.collect() == [] and none.manifest["counts"]["processed"] == 0


def test_keys(spark):
    row = spark.createDataFrame([("a", 'q"\\ü/', None, "T", "2024", "u")], "article_id string, body string, extra string, title string, published_date string, url string")
    payload = {"article_id": "a", "title": "T", "body": 'q"\\ü/', "url": "u", "published_date": "2024"}
    assert row.select(runner.content_key(row, runner.ARTICLE_KEY)).first()[0] == hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_places(spark):
    rows = [("1#Budapest#HU", "HU"), ("1#Paris#FR;2#Graz#au", "AT"), ("1#Hungarian plain", "HU"), ("", None), (None, None), (" ; 1#x#AUS; 4#Vienna, Austria", "AT"), ("4#Vienna#AT;1#Pecs#HU", "AT")]
    df = spark.createDataFrame(rows, "l string, c string")
    assert df.where(~runner.country_of_places(F.col("l")).eqNullSafe(F.col("c"))).collect() == []


def test_last_events(spark):
    df = spark.range(0, 5000, 1, 8).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 40)) AS digest", "if(id % 100 = 1, NULL, id div 2) AS ts")
    got = runner.last_events(df, "digest", ["ts", "id"], 100)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    rows, by = df.collect(), {}
    for r in sorted(rows, key=lambda r: (r.ts is not None, r.ts or 0, r.id), reverse=True):
        by.setdefault(r.digest, []).append(r.id)
    assert {(r.digest, r.recency, r.id) for r in got.collect()} == {(d, k, i) for d, ids in by.items() for k, i in enumerate(ids[:100], 1)}
