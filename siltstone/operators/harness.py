"""The evaluation harness: aligned rows, scores by article, metrics with intervals and gates, all in one manifest."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone import vocab
from siltstone.operators import resampling
from siltstone.sources.sinks import write_manifest
from siltstone.tables import forget, settle

FIELDS = ["is_rail_related", "event_type", "sentiment", "country", "language"]


def of_partition(rows: DataFrame, partition: str | None) -> DataFrame:
    """Rows of a partition (TUNE, TEST), by any case; ALL or None keeps every row."""
    return rows if partition is None or partition.upper() == "ALL" else rows.where(F.upper("partition") == partition.upper())


def last_of_each(rows: DataFrame, order: str) -> DataFrame:
    """Of rows with one article id the last by `order`; rows without an id go. An aggregate, so a hot id combines before the shuffle."""
    kept = rows.where("article_id is not null")
    return kept.groupBy(F.col("article_id").cast("string").alias("id")).agg(F.max_by(F.struct(*kept.columns), order).alias("row")).select("row.*")


def aligned(gold: DataFrame, pred: DataFrame, order: str, partition: str = "TEST") -> DataFrame:
    """(article_id, partition, gold struct, pred struct) of articles that both have; of repeated predictions the last counts."""
    g = of_partition(gold, partition).where("article_id is not null").select(F.col("article_id").cast("string").alias("article_id"), "partition", F.struct(*gold.columns).alias("gold"))
    last = last_of_each(pred, order)
    return g.join(last.select(F.col("article_id").cast("string").alias("article_id"), F.struct(*last.columns).alias("pred")), "article_id")


def alignment_counts(gold: DataFrame, pred: DataFrame, partition: str = "TEST") -> DataFrame:
    """One row: ids of the partition that predictions have, those that they lack, and predicted ids that no gold row has."""
    ids = lambda df, name: df.where("article_id is not null").select(F.col("article_id").cast("string").alias("id")).distinct().withColumn(name, F.lit(True))
    both = ids(gold, "any").join(ids(of_partition(gold, partition), "own"), "id", "left").join(ids(pred, "p"), "id", "full_outer")
    return both.agg(F.count_if(F.col("own") & F.col("p")).alias("matched"), F.count_if(F.col("own") & F.col("p").isNull()).alias("gold_only"), F.count_if(F.col("any").isNull()).alias("pred_only"))


def superclass(event: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in vocab.SUPERCLASS.items() for x in pair))[event], F.lit("other"))


def _set(c: str) -> Column:
    return F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))


def article_scores(pairs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """How well each article was read: matches by field, F1 of operators, recall of lines, and their mean; two nulls match."""
    same = lambda f: F.col(f"gold.{f}").eqNullSafe(F.col(f"pred.{f}")).cast("double")
    go, po, gl, pl = _set("gold.operators"), _set("pred.operators"), _set("gold.rail_lines"), _set("pred.rail_lines")
    both = F.size(F.array_intersect(go, po))
    f1 = F.when(F.size(go) + F.size(po) == 0, 1.0).otherwise(2.0 * both / (F.size(go) + F.size(po)))
    recall = F.when(F.size(gl) == 0, 1.0).otherwise(F.size(F.array_intersect(gl, pl)) / F.size(gl))
    money = F.when(F.col("gold.monetary_amount_eur").isNull(), F.col("pred.monetary_amount_eur").isNull()).otherwise(
        F.coalesce(F.abs(F.col("gold.monetary_amount_eur") - F.col("pred.monetary_amount_eur")) <= F.abs("gold.monetary_amount_eur") * tolerance, F.lit(False)))
    scores = {
        "is_rail_related_match": same("is_rail_related"), "event_superclass_match": superclass(F.col("gold.event_type")).eqNullSafe(superclass(F.col("pred.event_type"))).cast("double"), "event_10way_match": same("event_type"),
        "sentiment_match": same("sentiment"), "country_match": same("country"), "language_match": same("language"), "monetary_match": money.cast("double"), "operators_f1": f1.cast("double"), "rail_lines_recall": recall.cast("double"),
        "dup_group_match": same("cross_lingual_dedup_id"),
    }
    out = pairs.select("article_id", "partition", F.col("gold.language").alias("language_gold"), *(v.alias(k) for k, v in scores.items()))
    mean = F.aggregate(F.array(*scores), F.lit(0.0), lambda s, v: s + v) / len(scores)
    return out.withColumn("overall_score", mean)


#: Metrics that are gated by default, with their least values (the largest one of an error).
THRESHOLDS = {"is_rail_related_recall": 0.9, "event_superclass_macro_f1": 0.5, "country_macro_f1": 0.8, "sentiment_macro_f1_de": 0.6, "language_accuracy": 0.95, "dedup_geoyear_count_error": 0.1}
#: Labels of macro F1 where only these count; others in the data are no labels.
KNOWN = {"event_superclass": ["development", "disruption", "other", "policy"], "event_type": vocab.EVENT_TYPES, "country": ["AT", "HU", "other"], **{f"sentiment_{x}": ["negative", "neutral", "positive"] for x in ("de", "hu", "en")}}
#: Families all of whose known labels need enough support for a gate.
EACH_LABEL = ["event_superclass", "country"]
#: What an absent prediction, or an empty label of gold, counts as.
ABSENT = {"is_rail_related": "false", "event_type": "other", "country": "other", "sentiment": "neutral", "language": ""}
LABEL_METRICS, SUM_METRICS = ["accuracy", "macro_f1", "kappa", "precision", "recall", "f1"], ["precision", "recall", "f1"]


def families(pairs: DataFrame) -> DataFrame:
    """Rows (family, id, gold, pred, a, b, c) of all metrics, from one pass over aligned pairs with `overall_score`.

    gold rows without a label count in none of its metrics; counts by place and year need a column `published_year` and a country on both sides.
    """
    i, gold, pred = F.col("article_id"), (lambda f: F.col(f"gold.{f}").cast("string")), (lambda f: F.col(f"pred.{f}").cast("string"))
    filled = lambda x, f: F.when(F.coalesce(x, F.lit("")) == "", F.lit(ABSENT[f])).otherwise(x)
    g, p = ({f: filled(side(f), f) for f in FIELDS} for side in (gold, pred))
    has = lambda f: gold(f).isNotNull()
    rows = [(has(f), resampling.of_labels(f, i, g[f], p[f])) for f in FIELDS]
    rows.append((has("event_type"), resampling.of_labels("event_superclass", i, superclass(g["event_type"]), superclass(p["event_type"]))))
    rows += [(has("sentiment") & (F.lower(gold("language")) == x), resampling.of_labels(f"sentiment_{x}", i, g["sentiment"], p["sentiment"])) for x in ("de", "hu", "en")]
    for f in ("operators", "rail_lines"):
        a, b = _set(f"gold.{f}"), _set(f"pred.{f}")
        rows.append((F.lit(True), resampling.of_sums(f, i, F.size(F.array_intersect(a, b)), F.size(F.array_except(b, a)), F.size(F.array_except(a, b)))))
    owed, said = F.col("gold.monetary_amount_eur"), F.col("pred.monetary_amount_eur")
    rows.append((owed.isNotNull(), resampling.of_sums("monetary", i, F.coalesce(F.abs(owed - said) <= F.abs(owed) * 0.01, F.lit(False)).cast("double"))))
    rows.append((F.lit(True), resampling.of_sums("overall", i, F.col("overall_score"))))
    groups = [F.coalesce(side("cross_lingual_dedup_id"), i.cast("string")) for side in (gold, pred)]
    rows.append((F.lit(True), resampling.of_labels("dedup", i, *groups)))
    sure = F.col("pred.confidence")
    rows.append((sure.between(0, 1), resampling.of_sums("confidence", i, sure, gold("event_type").eqNullSafe(pred("event_type")).cast("double"), gold=F.least(F.floor(sure * 10), F.lit(9)))))
    if all("published_year" in pairs.schema[side].dataType.names for side in ("gold", "pred")):
        keyed = [F.when(side("country").isNotNull() & side("published_year").isNotNull(), F.to_json(F.array(F.concat_ws("|", side("country"), side("published_year")), group))) for side, group in zip((gold, pred), groups, strict=True)]
        rows.append((keyed[0].isNotNull(), resampling.of_labels("geoyear", i, *keyed)))
    array = F.filter(F.array(*(F.when(cond, row) for cond, row in rows)), lambda r: r.isNotNull())
    return pairs.select(F.explode(array).alias("row")).select("row.*")


def metrics(pairs: DataFrame, resamples: int = 2000, seed: int = 12345, law: str = "index") -> dict[str, dict]:
    """value, ci_lo, ci_hi and support of each metric over aligned pairs with `overall_score`; a metric without rows is absent.

    All intervals come from one table of resampled cells. A few numbers for each metric reach the driver.
    """
    cells = settle(resampling.resampled(families(pairs), resamples, seed, law))
    of = lambda *names: cells.where(F.col("family").isin(*names))
    labels = [*FIELDS, *KNOWN]
    scores = resampling.label_scores(of(*labels), KNOWN).union(resampling.sum_scores(of("operators", "rail_lines", "monetary", "overall")))
    scores = scores.union(resampling.group_scores(of("dedup"))).union(resampling.calibration_scores(of("confidence"))).union(resampling.count_scores(of("geoyear")))
    once = cells.where("k = 0")
    support = {r.family: int(r.n) for r in once.groupBy("family").agg(F.sum("n").alias("n")).collect()}
    each = {(r.family, r.gold): int(r.n) for r in once.where(F.col("family").isin(*EACH_LABEL, "is_rail_related") & (F.col("gold").isin(*sum((KNOWN[f] for f in EACH_LABEL), [])) | (F.col("gold") == "true"))).groupBy("family", "gold").agg(F.sum("n").alias("n")).collect()}
    names = {("operators", "f1"): "operators_f1", ("rail_lines", "f1"): "rail_lines_f1", ("rail_lines", "recall"): "rail_lines_recall", ("monetary", "mean"): "monetary_match_rate", ("overall", "mean"): "overall_score"}
    names |= {("dedup", m): f"dedup_bcubed_{m}" for m in SUM_METRICS} | {("confidence", "ece"): "llm_confidence_ece", ("geoyear", "count_error"): "dedup_geoyear_count_error"}
    names |= {(f, m): f"{f}_{m}" for f in labels for m in LABEL_METRICS[:3]} | {("is_rail_related", m): f"is_rail_related_{m}" for m in SUM_METRICS}
    names |= {(f"sentiment_{x}", "macro_f1"): f"sentiment_macro_f1_{x}" for x in ("de", "hu", "en")}
    out = {}
    for r in resampling.intervals(scores).collect():
        name = names.get((r.family, r.metric))
        if name is not None:
            n = each.get((r.family, "true"), 0) if name == "is_rail_related_recall" else support[r.family]
            thinnest = min(each.get((r.family, x), 0) for x in KNOWN[r.family]) if r.family in EACH_LABEL else n
            out[name] = {"value": r.value, "ci_lo": r.ci_lo, "ci_hi": r.ci_hi, "support": n, "support_for_gate": min(n, thinnest) if name.endswith("macro_f1") else n}
    forget(cells)
    return out


def worse_than(name: str, now: dict, before: dict) -> bool:
    """Whether a metric's interval lies apart from the baseline's and its value on the wrong side; without an interval on both sides the values alone decide."""
    ends = [x.get(c) for x in (now, before) for c in ("ci_lo", "ci_hi")]
    if None not in ends and max(ends[0], ends[2]) <= min(ends[1], ends[3]):
        return False
    if now.get("value") is None or before.get("value") is None:
        return False
    return now["value"] > before["value"] if name.endswith(("ece", "error")) else now["value"] < before["value"]


def evaluate(
    gold: DataFrame, pred: DataFrame, order: str, folder: str, thresholds: dict[str, float] | None = None, baseline: dict[str, dict] | None = None, partition: str = "TEST", least_support: int = 30,
    resamples: int = 2000, seed: int = 12345, law: str = "index",
) -> dict:
    """Score predictions, write scores by article, a summary and a manifest, and return it.

    A metric is gated if it has a threshold and enough support; it fails below its threshold (an error, above it), or where its value is
    worse than the baseline's and their intervals don't meet. `baseline` is an earlier manifest or its metrics. Every metric has an interval.
    """
    began = time.time()
    thresholds = THRESHOLDS if thresholds is None else thresholds
    pairs = aligned(gold, pred, order, partition).persist()
    scores = article_scores(pairs)
    scores.orderBy("article_id").write.mode("overwrite").option("header", True).csv(f"{folder}/per_article_scores")
    scored = pairs.join(scores.select("article_id", "overall_score"), "article_id")
    found, low, worse, summary = {}, [], [], {}
    earlier = (baseline or {}).get("metrics", baseline or {})
    for name, m in sorted(metrics(scored, resamples, seed, law).items()):
        enough = m.pop("support_for_gate") >= least_support
        gated = name in thresholds and enough
        passed = None if not gated else m["value"] is not None and (m["value"] <= thresholds[name] if name.endswith(("ece", "error")) else m["value"] >= thresholds[name])
        regression = bool(gated and name in earlier and worse_than(name, m, earlier[name]))
        found[name] = {**m, "gated": gated, "gate_threshold": thresholds.get(name), "absolute_pass": passed, "regression": regression, "demotion_reason": None if gated else "support" if name in thresholds else "report_only"}
        low += [name] if gated and not passed else []
        worse += [name] if regression else []
        summary[name] = {**m, "threshold": thresholds.get(name), "gated": gated, "status": "report_only" if not gated else "pass" if passed and not regression else "fail"}
    out = {
        "status": "failed" if low or worse else "passed", "partition": partition, "min_support": least_support, "n_boot": resamples, "boot_seed": seed, "resampling": law, "alignment": alignment_counts(gold, pred, partition).first().asDict(), "metrics": found,
        "threshold_violations": low, "regression_violations": worse, "regression_checked": baseline is not None, "duration_seconds": round(time.time() - began, 3),
    }
    pairs.unpersist()
    write_manifest(gold.sparkSession, summary, f"{folder}/metric_summary")
    write_manifest(gold.sparkSession, out, f"{folder}/manifest")
    return out
