"""A quality classifier with hierarchical empirical Bayes.

A logistic regression over counts of bytes, words and repeats gives each document's evidence. Hosts and, inside them, paths get
posterior means of it: sums by group are shrunk towards the level above, the more the sparser the group, with a strength that the
method of moments takes from the spread between groups. A document's odds are then those of its own evidence times the odds of its
path over the global odds; the path's posterior leaves the document itself out, so that its evidence counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from siltstone.llm.common import Block, settle, small_batches, table, text_parts
from siltstone.llm.logistic import fit_dense
from siltstone.llm.toxicity import labelled_sample
from siltstone.llm.window_dedup import word_hashes

#: Bound of the labelled sample.
SAMPLE_ROWS = 12_000
LOGIT = "_siltstone_logit"
CUT = 0.5
#: Bounds of the strength of a prior, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 5.0, 1000.0
CLASSES = np.zeros(256, np.uint8)
for _k, _bytes in enumerate((range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), b"#$%&*|", b"!?", b".,;:'\"-()", b"\n"), 1):
    CLASSES[list(_bytes)] = _k
N_FEATURES = 14
#: Columns of groups that leaving a document out takes.
LEAVING = ["n", "s", "hn", "hs", "m_host", "m_path"]


def features(batch: pa.Array) -> np.ndarray:
    """Numbers that tell running text from junk: shares of byte classes, length of words, repeats."""
    raw, bounds = text_parts(batch)
    n = len(batch)
    words, cuts = word_hashes(Block(np.zeros(n), raw, bounds))
    out = np.zeros((n, N_FEATURES))
    kinds = CLASSES[raw]
    for k in range(n):
        size, own = int(bounds[k + 1] - bounds[k]), words[cuts[k] : cuts[k + 1]]
        if not size:
            continue
        counts = np.bincount(kinds[bounds[k] : bounds[k + 1]], minlength=8)
        out[k, :7] = counts[1:8] / size
        out[k, 7] = np.log1p(len(own))
        if len(own):
            repeats = np.unique(own, return_counts=True)[1]
            out[k, 8] = size / len(own)
            out[k, 9] = len(repeats) / len(own) ** 0.8
            out[k, 10] = repeats.max() / len(own)
            out[k, 11] = (own[1:] == own[:-1]).mean() if len(own) > 1 else 0
        out[k, 12] = np.sqrt(out[k, 3])
        out[k, 13] = np.sqrt(out[k, 0])
    return out


class Model:
    """Means and spreads of the features, and the weights of these and their squares."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray) -> None:
        self.mean, self.spread, self.weights = mean, spread, weights

    def logits(self, batch: pa.Array) -> np.ndarray:
        return np.hstack([expanded((features(batch) - self.mean) / self.spread), np.ones((len(batch), 1))]) @ self.weights


def expanded(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -8, 8)
    return np.hstack([z, z**2 / 4])


def fit(labelled: DataFrame) -> Model:
    """A model from (text string, label int), label 1 for good; the caller bounds the rows. Without both labels all odds are even."""
    small_batches(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(features(batch.column(0).fill_null(""))), pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    rows = labelled.mapInArrow(run, "x array<double>, label int").collect()
    y = np.array([r.label for r in rows], float)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(2 * N_FEATURES + 1))
    x = np.array([r.x for r in rows])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    return Model(mean, spread, fit_dense(expanded((x - mean) / spread), y))


def evidence(docs: DataFrame, model: Model, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """Settled (doc_id, host, path, same, logit) of each row; same is a hash of the text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = np.clip(model.logits(batch.column("text").fill_null("")), -12, 12)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "host", "path", "same")), pa.array(logits)], ["doc_id", "host", "path", "same", "logit"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.xxhash64(text).alias("same"), text.alias("text"))
    return settle(rows.mapInArrow(run, "doc_id long, host string, path string, same long, logit double"))


def strength(mean: float, between: float) -> float:
    """Documents that a prior is worth: beta-distributed group means with this mean and variance."""
    whole = mean * (1 - mean) / max(between, 1e-9) - 1
    return float(min(MOST_STRENGTH, max(LEAST_STRENGTH, whole)))


def judged(docs: DataFrame, model: Model, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """(doc_id, same, doc_score, host_mean, path_mean, score, kept) of each row; path is a level inside its host.

    Null hosts and paths count as empty names; empty and null texts have the features of nothing. Rows are scored each by its own
    text and group, so repeated rows get equal results; other columns aren't read.
    """
    rows = evidence(docs, model, id_col, text_col, host_col, path_col)
    groups, mean = posteriors(rows)
    out = rows.join(groups, ["host", "path"]).withColumn("final", final(mean))
    p = 1 / (1 + F.exp(-F.col("logit")))
    return out.select("doc_id", "same", p.alias("doc_score"), "host_mean", "path_mean", F.col("final").alias("score"), (F.col("final") >= cut).alias("kept"))


def posteriors(rows: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, host_mean, path_mean) for each path, and the global mean, from the evidence of all documents.

    With them go what leaving one document out takes: n, s, hn, hs (documents and summed evidence of path and host), m_host, m_path.
    """
    p = 1 / (1 + F.exp(-F.col("logit")))
    paths = settle(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = paths.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"), F.coalesce(F.sum("q"), F.lit(0.0)).alias("q")).first()
    mean = min(1 - 1e-6, max(1e-6, total.s / total.n)) if total.n else 0.5
    within = max(0.0, total.q / total.n - mean**2) if total.n else 0.0
    # spread between group means beyond what their sampling explains, by the method of moments
    beyond = lambda n, s: F.coalesce(F.sum(F.col(n) * ((F.col(s) / F.col(n) - mean) ** 2 - within / F.col(n))) / F.sum(n), F.lit(0.0))
    m_host = strength(mean, hosts.agg(beyond("hn", "hs").alias("v")).first().v)
    m_path = strength(mean, paths.agg(beyond("n", "s").alias("v")).first().v)
    host_mean = (m_host * F.lit(mean) + F.col("hs")) / (m_host + F.col("hn"))
    groups = paths.join(hosts, "host").select("host", "path", host_mean.alias("host_mean"), ((m_path * host_mean + F.col("s")) / (m_path + F.col("n"))).alias("path_mean"), *LEAVING[:4], F.lit(m_host).alias("m_host"), F.lit(m_path).alias("m_path"))
    return settle(groups), mean


def final(mean: float) -> Column:
    """A document's score from its logit and the evidence of the other documents of its path and host."""
    odds = lambda c: F.log(c / (1 - c))
    c, p = F.col, 1 / (1 + F.exp(-F.col("logit")))
    host = (c("m_host") * mean + c("hs") - p) / (c("m_host") + c("hn") - 1)
    path = (c("m_path") * host + c("s") - p) / (c("m_path") + c("n") - 1)
    path = F.greatest(F.least(path, F.lit(1 - 1e-6)), F.lit(1e-6))
    return 1 / (1 + F.exp(-(F.col("logit") + odds(path) - odds(F.lit(mean)))))


def keep_good(docs: DataFrame, model: Model, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least `cut`; the texts are scored where they lie and not dealt out.

    The table of groups is broadcast only if Spark finds it below its limit for that, and dealt out by group otherwise.
    """
    groups, mean = posteriors(evidence(docs, model, id_col, text_col, host_col, path_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col)
            logits = np.clip(model.logits(texts.cast(pa.string()).fill_null("")), -12, 12)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logits)], [*batch.schema.names, LOGIT])

    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    scored = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(LOGIT, DoubleType())]))
    own = groups.select(F.col("host").alias("_siltstone_host"), F.col("path").alias("_siltstone_path"), *LEAVING)
    score = final(mean)
    held = scored.select(F.struct(*docs.columns).alias("row"), F.col(LOGIT).alias("logit"), name(host_col).alias("_siltstone_host"), name(path_col).alias("_siltstone_path"))
    return held.join(own, ["_siltstone_host", "_siltstone_path"]).where(score >= cut).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", SAMPLE_ROWS))
    return judged(docs, model).drop("same")
