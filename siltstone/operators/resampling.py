"""Bootstrap intervals of any metric: numbers of draws by resample, applied to sufficient statistics.

Rows are (family, id, gold, pred, a, b, c): a family is what one metric or several are worked out from, gold and pred name the cell of
its statistics that a row counts in, and a, b and c are summed there. Drawing rows with replacement only changes how often each row
counts, so a resample is the cells with other counts; every metric here is an aggregate of cells, by resample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.evaluation import poisson_weights, ratio, row_key
from siltstone.tables import settle

#: Rows that a task holds at a time, resamples that it hands on at a time, and rows of the largest family whose indices are drawn.
HELD_ROWS, EACH, INDEX_ROWS = 16_384, 64, 1_000_000
CELLS = "family string, k int, gold string, pred string, n double, a double, b double, c double"


def positions(rows: DataFrame) -> DataFrame:
    """rows with `at`, the place among those of their family by id, from 0, and `size`, the family's rows. Ranges of ids are sorted apart and shifted by the sizes of earlier ones."""
    order = ["family", "id", "gold", "pred", "a", "b", "c"]
    ranged = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("own", F.monotonically_increasing_id()))
    part, within = F.shiftright("own", 33), F.col("own").bitwiseAND((1 << 33) - 1)
    # one row for each range and family: the number of shuffle partitions bounds them
    sizes = ranged.groupBy("family", part.alias("part")).agg(F.count("*").alias("here"), F.min(within).alias("first"))
    earlier = Window.partitionBy("family").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("family", "part", "first", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("start"), F.sum("here").over(Window.partitionBy("family")).alias("size"))
    placed = ranged.withColumn("part", part).join(starts, ["family", "part"])
    return placed.select(*rows.columns, (F.col("start") + within - F.col("first")).alias("at"), "size")


def draws(law: str, at: np.ndarray, size: int, resamples: int, seed: int) -> Iterator[np.ndarray]:
    """Blocks of EACH resamples at most: how often each row is drawn, a resample in each row of the block.

    `index` draws whole index arrays from numpy's default_rng(seed), as one loop over the resamples would; each task draws them all and
    counts its own rows. `poisson` takes a hash of row and resample, so rows need no order and a family may be of any size.
    """
    random = np.random.default_rng(seed)
    for first in range(1, resamples + 1, EACH):
        last = min(first + EACH, resamples + 1)
        if law == "index":
            yield np.stack([np.bincount(random.integers(0, size, size=size), minlength=size)[at] for _ in range(first, last)])
        else:
            yield poisson_weights(at, last - first, seed, first).T


def resampled(rows: DataFrame, resamples: int = 2000, seed: int = 12345, law: str = "poisson") -> DataFrame:
    """Cells (family, k, gold, pred, n, a, b, c): k = 0 counts every row once, k from 1 is a resample. Tasks add up the cells of their rows before the shuffle.

    Null a, b and c add nothing, null gold and pred are cells of their own. Under `index` ids should differ; equal ones go by their other columns.
    """
    if law not in ("index", "poisson"):
        raise ValueError(f"no law of drawing: {law}")
    rows = rows.select("family", "id", "gold", "pred", *(F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x) for x in "abc"))
    if law == "index":
        rows = positions(rows)
        largest = rows.agg(F.max("size")).first()[0] or 0
        if largest > INDEX_ROWS:
            raise ValueError(f"a family of {largest} rows: indices are drawn for up to {INDEX_ROWS}; take law 'poisson'")
    else:
        rows = rows.withColumns({"at": row_key(F.col("id")), "size": F.lit(0).cast("long")})

    def of_family(held: pd.DataFrame) -> Iterator[pd.DataFrame]:
        codes = held.groupby(["gold", "pred"], dropna=False, sort=False).ngroup().to_numpy()
        cells = held[["family", "gold", "pred"]].iloc[np.unique(codes, return_index=True)[1]].reset_index(drop=True)
        one_hot = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.diff(codes[one_hot], prepend=-1))
        sums = np.stack([np.ones(len(held)), *(held[x].to_numpy() for x in "abc")])[:, one_hot]

        def counted(first: int, times: np.ndarray) -> pd.DataFrame:
            weighed = np.stack([np.add.reduceat(times[:, one_hot] * s, starts, axis=1) for s in sums])
            k, cell = np.nonzero(weighed[0])
            out = cells.take(cell).reset_index(drop=True).assign(k=(k + first).astype(np.int32))
            for x, of in zip("nabc", weighed[:, k, cell], strict=True):
                out[x] = of
            return out[["family", "k", "gold", "pred", *"nabc"]]

        yield counted(0, np.ones((1, len(held))))
        first = 1
        for times in draws(law, held["at"].to_numpy(), int(held["size"].iloc[0]), resamples, seed):
            yield counted(first, times.astype(float))
            first += len(times)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for frame in frames:
            for start in range(0, len(frame), HELD_ROWS):
                held.append(frame.iloc[start : start + HELD_ROWS])
                count += len(held[-1])
                if count >= HELD_ROWS:
                    for _, one in pd.concat(held).groupby("family", sort=False):
                        yield from of_family(one)
                    held, count = [], 0
        if held:
            for _, one in pd.concat(held).groupby("family", sort=False):
                yield from of_family(one)

    parts = rows.mapInPandas(run, CELLS)
    return parts.groupBy("family", "k", "gold", "pred").agg(*(F.sum(x).alias(x) for x in "nabc"))


def long(scores: DataFrame, names: list[str]) -> DataFrame:
    return scores.select("family", "k", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names))).alias("m")).select("family", "k", "m.*")


def label_scores(cells: DataFrame, known: dict[str, list[str]], positive: str = "true") -> DataFrame:
    """accuracy, macro_f1, kappa, and precision, recall and f1 of `positive`, by family and resample. A family in `known` has its macro F1 over those labels."""
    each = cells.select("family", "k", "n", "gold", "pred", F.explode(F.array_distinct(F.array("gold", "pred"))).alias("label"))
    g, p = F.col("gold").eqNullSafe(F.col("label")), F.col("pred").eqNullSafe(F.col("label"))
    some = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0.0))
    per = each.groupBy("family", "k", "label").agg(some(g & p).alias("tp"), some(g).alias("g"), some(p).alias("p"))
    counts = F.lit(True)
    for family, labels in known.items():
        counts = counts & ((F.col("family") != family) | F.col("label").isin(labels))
    f1, own = ratio(2 * F.col("tp"), F.col("g") + F.col("p")), F.col("label") == positive
    of = lambda value: F.coalesce(F.max(F.when(own, value)), F.lit(0.0))
    out = per.groupBy("family", "k").agg(
        F.coalesce(F.avg(F.when(counts, f1)), F.lit(0.0)).alias("macro_f1"), F.sum("tp").alias("same"), F.sum("g").alias("n"), F.sum(F.col("g") * F.col("p")).alias("chance"),
        of(ratio(F.col("tp"), F.col("p"))).alias("precision"), of(ratio(F.col("tp"), F.col("g"))).alias("recall"), of(f1).alias("f1"))
    po, pe = F.col("same") / F.col("n"), F.col("chance") / F.col("n") / F.col("n")
    kappa = F.when(F.col("chance") == F.col("n") * F.col("n"), F.when(F.col("same") == F.col("n"), 1.0).otherwise(0.0)).otherwise(ratio(po - pe, 1 - pe))
    return long(out.withColumns({"accuracy": po, "kappa": kappa}), ["accuracy", "macro_f1", "kappa", "precision", "recall", "f1"])


def sum_scores(cells: DataFrame) -> DataFrame:
    """mean of a; precision, recall and f1 of a hits, b false and c missed ones, by family and resample."""
    out = cells.groupBy("family", "k").agg(*(F.sum(x).alias(x) for x in "nabc"))
    a, b, c = (F.col(x) for x in "abc")
    return long(out.select("family", "k", (a / F.col("n")).alias("mean"), ratio(a, a + b).alias("precision"), ratio(a, a + c).alias("recall"), ratio(2 * a, 2 * a + b + c).alias("f1")), ["mean", "precision", "recall", "f1"])


def group_scores(cells: DataFrame) -> DataFrame:
    """B-cubed precision, recall and f1 of groups gold and pred."""
    size = lambda c: F.sum("n").over(Window.partitionBy("family", "k", c))
    n = F.col("n")
    sized = cells.withColumns({"ng": size("gold"), "np": size("pred")})
    out = sized.groupBy("family", "k").agg((F.sum(n * n / F.col("np")) / F.sum(n)).alias("precision"), (F.sum(n * n / F.col("ng")) / F.sum(n)).alias("recall"))
    return long(out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))), ["precision", "recall", "f1"])


def calibration_scores(cells: DataFrame) -> DataFrame:
    """Expected calibration error: gold is the bin, a adds up confidences and b what was right."""
    bins = cells.groupBy("family", "k", "gold").agg(*(F.sum(x).alias(x) for x in "nab"))
    return long(bins.groupBy("family", "k").agg((F.sum(F.abs(F.col("b") - F.col("a"))) / F.sum("n")).alias("ece")), ["ece"])


def count_scores(cells: DataFrame) -> DataFrame:
    """Summed error of the number of groups by key over their gold number; gold and pred are JSON lists of key and group."""
    side = lambda c, name: cells.select("family", "k", F.get_json_object(c, "$[0]").alias("key"), F.get_json_object(c, "$[1]").alias("group"), F.lit(name).alias("side")).where("key IS NOT NULL")
    groups = side("gold", "g").union(side("pred", "p")).distinct()
    keys = groups.groupBy("family", "k", "key").agg(F.count_if(F.col("side") == "g").alias("g"), F.count_if(F.col("side") == "p").alias("p"))
    out = keys.groupBy("family", "k").agg(F.sum(F.abs(F.col("g") - F.col("p"))).alias("off"), F.sum("g").alias("g"))
    error = F.when(F.col("g") > 0, F.col("off") / F.col("g")).otherwise(F.when(F.col("off") > 0, 1.0).otherwise(0.0))
    return long(out.withColumn("count_error", error), ["count_error"])


def intervals(scores: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(family, metric, value, ci_lo, ci_hi): the value over the rows themselves and the percentiles over resamples."""
    drawn = F.when(F.col("k") > 0, F.col("value"))
    ends = [F.percentile(drawn, F.lit(q)).alias(c) for q, c in ((alpha / 2, "ci_lo"), (1 - alpha / 2, "ci_hi"))]
    return scores.groupBy("family", "metric").agg(F.max(F.when(F.col("k") == 0, F.col("value"))).alias("value"), *ends)


def of_labels(family: str, row_id: Column, gold: Column, pred: Column) -> Column:
    """One row of a family of labels, for an array of such rows."""
    return of_sums(family, row_id, F.lit(0.0), gold=gold, pred=pred)


def of_sums(family: str, row_id: Column, a: Column, b: Column | None = None, c: Column | None = None, gold: Column | None = None, pred: Column | None = None) -> Column:
    """One row of a family of sums, for an array of such rows."""
    text, number = (lambda x: F.lit(None).cast("string") if x is None else x.cast("string")), (lambda x: F.lit(0.0) if x is None else x.cast("double"))
    columns = {"family": F.lit(family), "id": row_id.cast("string"), "gold": text(gold), "pred": text(pred), "a": number(a), "b": number(b), "c": number(c)}
    return F.struct(*(v.alias(k) for k, v in columns.items()))
