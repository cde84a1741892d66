"""Operators around models: the model is a function that the caller passes; scoring is by Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from siltstone import vocab
from siltstone.functions.columns import theme_event, tone_sentiment
from siltstone.tables import fresh

# Frequent words that tell the languages apart.
STOP_WORDS = {"en": ["the", "and", "of", "with"], "de": ["und", "der", "die", "nicht"], "hu": ["és", "az", "hogy", "nem"]}

# Labels of a sentiment model, by name and by number.
SENTIMENT_LABELS = {"negative": "negative", "neutral": "neutral", "positive": "positive", "label_0": "negative", "label_1": "neutral", "label_2": "positive"}


def extract(articles: DataFrame, model: Callable[[str], dict], retries: int = 2) -> DataFrame:
    """(article_id, language, event_type, sentiment, confidence, reason): the model's fields, or why it gave none after all tries."""
    fields = ["language", "event_type", "sentiment", "confidence"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                reason = None
                for _ in range(retries + 1):
                    try:
                        found = model(row["body"] or "")
                        out.append({"article_id": row["article_id"], **{f: None if found.get(f) is None else str(found[f]) for f in fields}, "reason": None})
                        break
                    except Exception as error:  # noqa: BLE001 - a model may fail in any way; the row then says how
                        reason = f"{type(error).__name__}: {error}"
                else:
                    out.append({"article_id": row["article_id"], **dict.fromkeys(fields), "reason": reason})
            yield pa.RecordBatch.from_pylist(out, pa.schema([(c, pa.string()) for c in ("article_id", *fields, "reason")]))

    return articles.select("article_id", "body").mapInArrow(run, "article_id string, language string, event_type string, sentiment string, confidence string, reason string")


def embed(articles: DataFrame, model: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(article_id, text_embedding): unit vectors of the first field with text of body, title and id."""
    text = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in ("body", "title", "article_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in model(["passage: " + (t or "") for t in batch.column(1).to_pylist()]):
                size = sum(x * x for x in v) ** 0.5
                out.append([x / size for x in v] if size else v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float32()))], ["article_id", "text_embedding"])

    return articles.select("article_id", text.alias("t")).mapInArrow(run, "article_id string, text_embedding array<float>")


def language(text: Column) -> Column:
    """The language most of whose frequent words stand in the text; null without any."""
    words = F.split(F.lower(text), r"[^\p{L}]+")
    among = lambda known: F.size(F.filter(words, lambda w: w.isin(known)))
    scores = [F.struct(among(s).alias("n"), F.lit(k).alias("lang")) for k, s in STOP_WORDS.items()]
    best = F.sort_array(F.array(*scores), asc=False)[0]
    return F.when(best["n"] > 0, best["lang"])


def passthrough(records: DataFrame) -> DataFrame:
    """News features of knowledge-graph records, without a model."""
    return records.select(F.col("gkg_id").alias("article_id"), F.col("document_identifier").alias("url"), theme_event(F.col("gkg_themes")).alias("event_type"), tone_sentiment(F.col("gkg_tone")).alias("sentiment"), "gkg_tone")


def one_answer(found: object) -> tuple[str | None, float]:
    """(label, score) of a model's answer for one text: an object, a list with it first, or a list of candidates of which the likeliest counts. (None, NaN) where it says nothing usable."""
    score = lambda item: _number(item.get("score")) if isinstance(item, dict) else math.nan
    if isinstance(found, list) and found and isinstance(found[0], list):
        candidates = [c for c in found[0] if isinstance(c, dict)]
        found = max(candidates, key=lambda c: -1.0 if math.isnan(score(c)) else score(c)) if candidates else None
    elif isinstance(found, list):
        found = found[0] if found else None
    if not isinstance(found, dict):
        return None, math.nan
    label = SENTIMENT_LABELS.get(str(found.get("label") or "").strip().lower())
    return (label, score(found)) if label and not math.isnan(score(found)) else (None, math.nan)


def _number(value: object) -> float:
    """A score from 0 to 1, else NaN."""
    try:
        found = float(value)
    except (TypeError, ValueError):
        return math.nan
    return found if 0 <= found <= 1 else math.nan


def with_sentiment(articles: DataFrame, make_model: Callable[[], Callable[[str], object]], batch: int = 64) -> DataFrame:
    """articles with the sentiment that a model gives title and body: sentiment, sentiment_label, confidence, sentiment_confidence, and sentiment_score, the confidence with the label's sign.

    `make_model` is called once for each Python worker, not for each batch. Where it fails, and for blank texts and answers that fail or
    say nothing usable, earlier values of these columns stay, or nulls where there are none; the row is never lost.
    """

    def make() -> Callable[[np.ndarray], dict[str, np.ndarray]]:
        try:
            model = make_model()
        except Exception:  # noqa: BLE001 - without a model every text is without an answer
            model = None

        def predict(texts: np.ndarray) -> dict[str, np.ndarray]:
            answers = []
            for text in texts:
                try:
                    answers.append(one_answer(model(text)) if model is not None and text and text.strip() else (None, math.nan))
                except Exception:  # noqa: BLE001 - one text that the model can't take doesn't end the batch
                    answers.append((None, math.nan))
            return {"label": np.array([a for a, _ in answers], object), "score": np.array([b for _, b in answers], float)}

        return predict

    answer = predict_batch_udf(make, return_type=StructType([StructField("label", StringType()), StructField("score", DoubleType())]), batch_size=batch)
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    held = fresh("answer", articles.columns)
    rows = articles.withColumn(held, answer(text))
    label, score = F.col(f"{held}.label"), F.col(f"{held}.score")
    signed = F.coalesce(*(F.when(label == k, score * v) for k, v in vocab.SENTIMENT_SCORE.items()))
    new = {"sentiment": label, "sentiment_label": label, "confidence": score, "sentiment_confidence": score, "sentiment_score": signed}
    kept = {c: F.coalesce(F.when(label.isNotNull(), v), F.col(c).cast("string" if c in ("sentiment", "sentiment_label") else "double")) if c in articles.columns else F.when(label.isNotNull(), v) for c, v in new.items()}
    return rows.withColumns(kept).drop(held)
