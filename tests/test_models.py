"""Sentiment by a model that is made once for each worker."""

import math

import pytest

from siltstone.operators import models


def test_answers():
    two = [[{"label": "LABEL_0", "score": 0.2}, {"label": "LABEL_2", "score": "0.7"}]]
    given = [{"label": "Positive", "score": 0.9}, [{"label": "label_1", "score": 0.5}], two]
    assert [models.one_answer(x) for x in given] == [("positive", 0.9), ("neutral", 0.5), ("positive", 0.7)]
    for useless in (None, [], [[]], {}, {"label": "joy", "score": 1}, {"label": "neutral", "score": "much"}, {"label": "neutral", "score": 1.5}, "text", [1]):
        label, score = models.one_answer(useless)
        assert label is None and math.isnan(score)


def test_sentiment_of_articles(spark, tmp_path):
    made = str(tmp_path / "made")

    def make():
        with open(made, "a") as f:
            f.write("x")

        def model(text):
            if "bad" in text:
                raise ValueError("no")
            return {"label": "negative" if "late" in text else "positive", "score": 0.75}

        return model

    rows = [("1", "Train late", None, None, 0.1), ("2", None, "New line", None, None), ("3", "bad", "", "neutral", 0.4), ("4", None, " ", None, None)] + [(f"{k}", "x", "y", None, None) for k in range(10, 200)]
    df = spark.createDataFrame(rows, "id string, title string, body string, sentiment string, confidence double").coalesce(1)
    found = {r.id: (r.sentiment, r.confidence, r.sentiment_score, r.sentiment_label) for r in models.with_sentiment(df, make, batch=8).collect()}
    assert found["1"] == ("negative", 0.75, -0.75, "negative") and found["2"] == ("positive", 0.75, 0.75, "positive")
    assert found["3"] == ("neutral", 0.4, None, None) and found["4"] == (None, None, None, None) and len(found) == 194
    with open(made) as f:
        assert len(f.read()) == 1

    def broken():
        raise RuntimeError("no weights")

    assert {r.sentiment for r in models.with_sentiment(df, broken).collect()} == {None, "neutral"}


@pytest.mark.parametrize("columns", ["id string, title string, body string, answer string"])
def test_columns_of_the_same_name_stay(spark, columns):
    df = spark.createDataFrame([("1", "a", "b", "mine")], columns)
    row = models.with_sentiment(df, lambda: lambda t: {"label": "neutral", "score": 1}).first()
    assert (row.answer, row.sentiment_score, row.sentiment) == ("mine", 0.0, "neutral") and models.with_sentiment(df.limit(0), lambda: None).count() == 0
