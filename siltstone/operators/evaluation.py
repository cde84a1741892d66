"""Metrics over aligned (gold, pred) rows, each a single aggregate."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")]


def binary(pairs: DataFrame, positive: object = 1) -> DataFrame:
    g, p = F.col("gold") == positive, F.col("pred") == positive
    n = pairs.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    return n.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def macro_f1(pairs: DataFrame) -> DataFrame:
    """Mean F1 over the labels that gold or pred has."""
    each = pairs.select(F.explode(F.array_distinct(F.array("gold", "pred"))).alias("label"), "gold", "pred")
    g, p = F.col("gold") == F.col("label"), F.col("pred") == F.col("label")
    n = each.groupBy("label").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    return n.select(*prf(F.col("tp"), F.col("fp"), F.col("fn"))).agg(F.avg("f1").alias("macro_f1"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("gold", "pred").agg(F.count("*").alias("n"))


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg(F.col("gold").eqNullSafe(F.col("pred")).cast("double")).alias("accuracy"))


def kappa(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa from the confusion counts; where chance alone would agree always (one label on both sides), 1 if all agree."""
    n = confusion(pairs)
    gold, pred = (n.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(c)) for c in ("gold", "pred"))
    chance = gold.join(pred, "label").agg(F.coalesce(F.sum(F.col("gold").cast("double") * F.col("pred")), F.lit(0.0)).alias("c"))
    whole = n.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.col("c") / F.col("n") / F.col("n")
    one_label = F.col("c") == F.col("n").cast("double") * F.col("n")
    return whole.join(F.broadcast(chance)).select(F.when(one_label, (F.col("same") == F.col("n")).cast("double")).otherwise(ratio(po - pe, 1 - pe)).alias("kappa"))


def bcubed(pairs: DataFrame) -> DataFrame:
    """B-cubed of two clusterings from counts by (gold, pred): every member of a cell scores alike."""
    cells = confusion(pairs)
    size = lambda c: F.sum("n").over(Window.partitionBy(c))
    cells = cells.withColumns({"ng": size("gold"), "np": size("pred")})
    n = F.sum("n")
    out = cells.agg((F.sum(F.col("n") * F.col("n") / F.col("np")) / n).alias("precision"), (F.sum(F.col("n") * F.col("n") / F.col("ng")) / n).alias("recall"))
    return out.select("precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def set_prf(pairs: DataFrame) -> DataFrame:
    """Micro scores of array columns taken as sets."""
    g, p = F.array_distinct("gold"), F.array_distinct("pred")
    size = lambda c: F.sum(F.size(c)).cast("long")
    n = pairs.agg(size(F.array_intersect(g, p)).alias("tp"), size(F.array_except(p, g)).alias("fp"), size(F.array_except(g, p)).alias("fn"))
    return n.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def money_match(pairs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    near = F.coalesce(F.abs(F.col("gold") - F.col("pred")) <= F.abs("gold") * tolerance, F.lit(False))
    return pairs.where(F.col("gold").isNotNull()).agg(F.avg(near.cast("double")).alias("match_rate"))


def calibration_error(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins of the confidence, the last one closed; pairs: confidence, correct."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    each = pairs.where(F.col("confidence").between(0, 1)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(F.col("correct").cast("double")).alias("a"))
    return each.agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"))


def cell_count_error(gold: DataFrame, pred: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Summed absolute error of distinct groups by key, over the gold total."""
    g, p = (df.groupBy(*keys).agg(F.countDistinct(group).alias(n)) for df, n in ((gold, "g"), (pred, "p")))
    both = g.join(p, keys, "full_outer").fillna(0, ["g", "p"])
    return both.agg(ratio(F.sum(F.abs(F.col("p") - F.col("g"))), F.sum("g")).alias("count_error"))


def alignment(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Keys in both, in gold alone and in pred alone."""
    g, p = (df.select(key).distinct().withColumn(n, F.lit(1)) for df, n in ((gold, "g"), (pred, "p")))
    both = g.join(p, key, "full_outer")
    return both.agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("matched"), F.count_if(F.col("p").isNull()).alias("gold_only"), F.count_if(F.col("g").isNull()).alias("pred_only"))


def row_key(row_id: Column) -> Column:
    """A number of 60 bits for an id, by a hash that other engines have too."""
    return F.conv(F.substring(F.md5(row_id.cast("string")), 1, 15), 16, 10).cast("long")


#: Poisson(1) numbers are told by where 53 random bits lie among these: the cumulated probabilities of 0 to 17.
STEPS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def poisson_weights(keys: np.ndarray, resamples: int, seed: int, first: int = 1) -> np.ndarray:
    """A Poisson(1) number for each key and resample, the first one given; it depends on key, resample and seed alone."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64)[:, None] + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.arange(first, first + resamples, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return np.searchsorted(STEPS, (h >> np.uint64(11)).astype(float) * 2.0**-53, "right")


def bootstrap(scores: DataFrame, value: str, resamples: int = 2000, seed: int = 12345) -> DataFrame:
    """Percentile interval (ci_lo, ci_hi) of a mean: every row takes a Poisson(1) weight in each resample, so no index table is dealt out.

    Weights come from a hash of (row id, resample, seed) and don't depend on how rows are dealt; scores: id, value. A partition adds
    up its weights and weighted values in place, so what is shuffled is one row for each partition and resample. Null values count nowhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo in range(0, len(keys), 512):
                w = poisson_weights(keys[lo : lo + 512], resamples, seed)
                weight += w.sum(axis=0)
                total += values[lo : lo + 512] @ w
        if weight.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(resamples), pa.int32()), pa.array(weight), pa.array(total)], ["k", "w", "s"])

    rows = scores.select(row_key(F.col("id")).alias("key"), F.col(value).cast("double").alias("v")).where("v is not null")
    means = rows.mapInArrow(run, "k int, w double, s double").groupBy("k").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("ci_lo"), F.percentile("m", F.lit(0.975)).alias("ci_hi"))
