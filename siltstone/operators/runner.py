"""Extraction runs: articles go by route through cache, records or model; failures are written once, counts come from the writes.

The cache is a table of features by content key and model digest that only grows, with a log of hits and misses beside it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.functions.columns import fold, operators_in, theme_event, tone_sentiment
from siltstone.operators.matching import match_first
from siltstone.operators.models import language
from siltstone.operators.news import validated
from siltstone.sources.sinks import exists, write_manifest
from siltstone.tables import forget, settle, small_batches

#: The digest under which features of records stand in the cache, and how many events of a digest are shown.
PASSTHROUGH, LAST_EVENTS = "gdelt-passthrough", 100
ARTICLE_KEY = ["article_id", "body", "published_date", "title", "url"]
RECORD_KEY = ["article_id", "body", "gkg_emotions", "gkg_locations", "gkg_organizations", "gkg_persons", "gkg_themes", "gkg_tone", "published_date", "title", "url"]
GKG = ["gkg_themes", "gkg_tone", "gkg_persons", "gkg_organizations", "gkg_locations", "gkg_emotions"]
LISTS = ["operators", "rail_lines"]
EVENT = "cache_key string, event string, ts timestamp, run_id string, model_digest string"
#: Codes and words by which a place is one of the home countries.
PLACES = [("HU", ["HU", "HUN"], ["hungary", "hungarian"]), ("AT", ["AT", "AUT", "AU"], ["austria", "austrian"])]


def content_key(rows: DataFrame, fields: list[str], nullable: list[str] | None = None) -> Column:
    """SHA-256 of the fields as one compact JSON object in order of names: whatever changes in a field is new work. Nulls count as empty, but for `nullable` ones."""
    value = lambda c: F.col(c) if c in (nullable or []) else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.sha2(F.to_json(F.struct(*(value(c).alias(c) for c in sorted(fields) if c in rows.columns)), {"ignoreNullFields": "false"}), 256)


def country_of_places(locations: Column) -> Column:
    """The home country of the first place in a list of places that is in one, by its code or name; null without any."""
    parts = lambda s: F.split(s, "#")

    def one(segment: Column) -> Column:
        code, text = F.upper(F.coalesce(F.get(parts(segment), F.lit(2)), F.lit(""))), F.lower(F.replace(segment, F.lit("#"), F.lit(" ")))
        out = F.lit(None).cast("string")
        for country, codes, words in reversed(PLACES):
            hit = code.isin(codes)
            for word in words:
                hit = hit | text.contains(word)
            out = F.when(hit, country).otherwise(out)
        return out

    segments = F.filter(F.transform(F.split(locations, ";"), F.trim), lambda s: s != "")
    return F.get(F.array_compact(F.transform(segments, one)), F.lit(0))


def from_records(rows: DataFrame) -> DataFrame:
    """News features of articles with knowledge-graph fields, by schemas.NEWS_FEATURE's names: no model is asked."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    sentiment = tone_sentiment(F.col("gkg_tone"))
    return rows.select(
        "*", language(text).alias("language"), language(text).alias("language_detected_code"), F.lit(True).alias("is_rail_related"), country_of_places(F.col("gkg_locations")).alias("country"),
        theme_event(fold(F.coalesce("gkg_themes", F.lit("")))).alias("event_type"), operators_in(F.concat_ws(" ", "gkg_organizations", "gkg_persons")).alias("operators"), F.array().cast("array<string>").alias("rail_lines"),
        sentiment.alias("sentiment"), sentiment.alias("sentiment_label"), F.lit("gdelt_gkg").alias("gkg_tone_source"), F.lit(PASSTHROUGH).alias("extraction_model_digest"),
    )


def asked(rows: DataFrame, model: Callable[[dict], dict], attempts: int, backoff: float) -> DataFrame:
    """(cache_key, raw, reason, attempts): the model's answer to each article as JSON, or why it gave none after all attempts."""
    small_batches(rows.sparkSession)
    names = ["cache_key", "article_id", "source", "url", "title", "published_date", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key, raw, reason = row.pop("cache_key"), None, None
                for k in range(1, attempts + 1):
                    try:
                        found = model(row)
                        if not isinstance(found, dict):
                            raise ValueError("the model's answer is no object")
                        raw, reason = json.dumps({f: [v] if f in LISTS and isinstance(v, str) else v for f, v in found.items()}, default=str), None
                        break
                    except Exception as error:  # noqa: BLE001 - a model may fail in any way; the row then says how
                        reason = f"{type(error).__name__}: {error}"
                        time.sleep(backoff if k < attempts else 0)
                out.append({"cache_key": key, "raw": raw, "reason": reason, "attempts": k})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("cache_key", pa.string()), ("raw", pa.string()), ("reason", pa.string()), ("attempts", pa.int64())]))

    return rows.select(*names).mapInArrow(run, "cache_key string, raw string, reason string, attempts long")


def answers(raw: DataFrame, articles: DataFrame, digest: str) -> DataFrame:
    """The features in the model's answers, with the fields that stand for the article itself taken from it."""
    own = ["article_id", "source", "url", "published_date", "extraction_model_digest", "extraction_timestamp_utc"]
    fields = [f.split(" ", 1) for f in schemas.NEWS_FEATURE.split(", ")]
    shape = ", ".join(f"{c}: {kind if kind.startswith('array') else 'string'}" for c, kind in fields if c not in own)
    parsed = raw.select("cache_key", F.from_json("raw", f"struct<{shape}>").alias("found")).select("cache_key", "found.*")
    return parsed.join(articles.select("cache_key", "article_id", "source", "url", "published_date"), "cache_key").withColumn("extraction_model_digest", F.lit(digest))


def last_events(events: DataFrame, group: str, order: list[str], many: int = LAST_EVENTS) -> DataFrame:
    """Each group's last `many` events by `order`, numbered from 1, the last. Partitions keep their own last ones before anything is shuffled, so a group's size doesn't matter."""
    latest = Window.partitionBy(group).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return events.withColumn("recency", F.row_number().over(latest)).where(F.col("recency") <= many)


class Cache:
    """Features by (cache_key, model_digest) under a folder, and the log of lookups."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def features(self) -> DataFrame:
        """One row for each key and digest; a run that was written twice counts once."""
        rows = self._read("features", f"cache_key string, {schemas.NEWS_FEATURE}, model_digest string")
        return rows.dropDuplicates(["cache_key", "model_digest"])

    def events(self) -> DataFrame:
        return self._read("events", EVENT)

    def add(self, features: DataFrame) -> None:
        features.write.mode("append").partitionBy("model_digest").parquet(f"{self.folder}/features")

    def log(self, events: DataFrame) -> None:
        events.write.mode("append").partitionBy("model_digest").parquet(f"{self.folder}/events")

    def manifest(self) -> DataFrame:
        """(model_digest, hits, misses, cached, events): counts of all time and the last LAST_EVENTS events, the last first."""
        counts = self.events().groupBy("model_digest").agg(F.count_if(F.col("event") == "hit").alias("hits"), F.count_if(F.col("event") == "miss").alias("misses"))
        shown = last_events(self.events(), "model_digest", ["ts", "cache_key"]).groupBy("model_digest").agg(F.sort_array(F.collect_list(F.struct("recency", "ts", "event", "cache_key"))).alias("events"))
        cached = self.features().groupBy("model_digest").agg(F.count("*").alias("cached"))
        return counts.join(cached, "model_digest", "full").join(shown, "model_digest", "left").fillna(0, ["hits", "misses", "cached"])


def enriched(articles: DataFrame, records: DataFrame | None) -> DataFrame:
    """Articles of the source gdelt with the fields of their first matching record; all get the knowledge-graph columns."""
    have = [c for c in GKG if c in articles.columns]
    rows = articles.select(*(c for c in articles.columns if c not in GKG), *(F.col(c) if c in have else F.lit(None).cast("double" if c == "gkg_tone" else "string").alias(c) for c in GKG))
    if records is None:
        return rows
    mine = rows.where(F.lower("source") == "gdelt").select("article_id", "url").distinct()
    found = match_first(mine, records.select(F.col("gkg_id").alias("record_id"), F.col("document_identifier").alias("urls"), F.col("gkg_id").alias("ordinal")))
    fields = records.groupBy(F.col("gkg_id").alias("ordinal")).agg(F.first(F.struct(*GKG)).alias("r"))
    met = rows.join(found.join(fields, "ordinal").drop("ordinal"), "article_id", "left")
    take = (F.lower("source") == "gdelt") & F.col("r").isNotNull()
    return met.select(*(c for c in rows.columns if c not in GKG), *(F.when(take, F.coalesce(F.col(f"r.{c}"), F.col(c))).otherwise(F.col(c)).alias(c) for c in GKG))


@dataclass
class Run:
    features: DataFrame
    failures: DataFrame
    manifest: dict


def run_extraction(articles: DataFrame, model: Callable[[dict], dict], folder: str, digest: str, records: DataFrame | None = None, attempts: int = 3, backoff: float = 0.0, run_id: str | None = None) -> Run:
    """Features of articles (article_id, source, url, title, published_date, body and perhaps knowledge-graph fields), by cache, record or model.

    Articles of gdelt with knowledge-graph fields pass through; others ask the model, once for each content key, unless the cache under `folder` has the key for `digest`.
    The run's features and failures are written under folder/runs/<run_id>, and a manifest whose counts are those of the rows written. What failed isn't cached:
    the next run asks again. Null texts count as empty; rows that repeat get a feature each; no articles give empty tables.
    """
    spark, cache, run_id = articles.sparkSession, Cache(articles.sparkSession, folder), run_id or uuid.uuid4().hex
    began, started = datetime.now(UTC), time.perf_counter()
    rows = enriched(articles, records)
    passing = F.coalesce((F.lower("source") == "gdelt") & F.greatest(*(F.col(c).isNotNull() for c in GKG)), F.lit(False))
    key = F.when(passing, content_key(rows, RECORD_KEY, GKG)).otherwise(content_key(rows, ARTICLE_KEY))
    work = settle(rows.select("*", passing.alias("passing"), key.alias("cache_key"), F.when(passing, PASSTHROUGH).otherwise(digest).alias("model_digest")))
    known = settle(cache.features().join(work.select("cache_key", "model_digest").distinct(), ["cache_key", "model_digest"], "left_semi"))
    missing = work.join(known.select("cache_key", "model_digest"), ["cache_key", "model_digest"], "left_anti")
    once = settle(missing.dropDuplicates(["cache_key", "model_digest"]))
    tried = settle(asked(once.where("NOT passing"), model, attempts, backoff))
    stamp = F.lit(began.strftime("%Y-%m-%dT%H:%M:%SZ"))
    told = validated(answers(tried.where("reason IS NULL"), once, digest).withColumn("extraction_timestamp_utc", stamp), ["cache_key"]).withColumn("model_digest", F.lit(digest))
    lifted = validated(from_records(once.where("passing")).withColumn("extraction_timestamp_utc", stamp), ["cache_key"]).withColumn("model_digest", F.lit(PASSTHROUGH))
    fresh_features = settle(told.unionByName(lifted))
    cache.add(fresh_features)
    looked = work.select("cache_key", "model_digest").join(known.select("cache_key", "model_digest", F.lit("hit").alias("event")), ["cache_key", "model_digest"], "left")
    cache.log(looked.select("cache_key", F.coalesce("event", F.lit("miss")).alias("event"), F.lit(began).alias("ts"), F.lit(run_id).alias("run_id"), "model_digest"))

    out, seen = f"{folder}/runs/{run_id}", {n: Observation(n) for n in ("features", "failures")}
    names = [f.split(" ", 1)[0] for f in schemas.NEWS_FEATURE.split(", ")]
    own = [c for c in ("article_id", "source", "url", "published_date") if c in work.columns]
    ready = known.withColumn("hit", F.lit(True)).unionByName(fresh_features.withColumn("hit", F.lit(False)))
    features = work.select("cache_key", "model_digest", "passing", *(F.col(c).alias(f"own_{c}") for c in own)).join(ready, ["cache_key", "model_digest"])
    counts = [F.count("*").alias("rows"), F.count_if("hit").alias("hits"), F.count_if("passing").alias("passed")]
    features.observe(seen["features"], *counts).select(*(F.coalesce(f"own_{c}", c).alias(c) if c in own else F.col(c) for c in names)).write.mode("overwrite").parquet(f"{out}/features")
    broken = work.where("NOT passing").join(tried.where("reason IS NOT NULL").select("cache_key", "reason"), "cache_key")
    failures = broken.select("article_id", "source", "url", "title", "published_date", "reason", stamp.alias("timestamp_utc"), F.lit(digest).alias("model_digest"), F.lit(None).cast("string").alias("raw"))
    failures.observe(seen["failures"], F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{out}/failures")
    asks = tried.agg(F.count("*").alias("n"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("all")).first()
    good, bad = seen["features"].get, seen["failures"].get
    manifest = {
        "run_id": run_id, "model_digest": digest, "run_started_utc": began.isoformat(), "duration_seconds": round(time.perf_counter() - started, 3), "settings": {"max_attempts": attempts},
        "counts": {"processed": good["rows"] + bad["rows"], "succeeded": good["rows"], "failed": bad["rows"], "cache_hits": good["hits"], "gdelt_passthrough": good["passed"], "llm_attempted": asks["n"], "llm_attempts": asks["all"], "retry_attempts": asks["all"] - asks["n"]},
        "failure_rate": round(bad["rows"] / max(1, good["rows"] + bad["rows"]), 6), "status": "completed_with_failures" if bad["rows"] else "passed",
    }
    write_manifest(spark, manifest, f"{out}/manifest")
    for used in (work, known, once, tried, fresh_features):
        forget(used)
    return Run(spark.read.schema(schemas.NEWS_FEATURE).parquet(f"{out}/features"), spark.read.schema(schemas.FAILURE).parquet(f"{out}/failures"), manifest)
