"""Jobs from the wide matrix to files: a table, a CSV and a manifest each, all written by Spark."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.columns import fisher_p, geo_level
from siltstone.operators import analysis, gold
from siltstone.sources.sinks import write_manifest

NUMBERS = {"double", "float", "int", "bigint", "smallint", "tinyint"}
#: Columns that identify a row and are no feature.
IDENTITY = {"geo", "geo_level", "year", "month"}
#: What correlations explain and so don't count among what explains.
INVESTMENT = {"rail_investment", "rail_investment_pps", "rail_investment_per_capita", "rail_investment_pct_gdp", "rail_investment_per_network_km"}


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns that may be features, by their type: numbers that identify nothing."""
    return [c for c, t in df.dtypes if c not in IDENTITY and (t in NUMBERS or t.startswith("decimal"))]


def check_payload(df: DataFrame, needed: list[str]) -> None:
    """Raise unless df has the columns and at least one row."""
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    if df.isEmpty():
        raise ValueError("the table has no rows")


def _written(found: DataFrame, folder: str, name: str, csv: bool = True, order: list | None = None) -> int:
    """Rows written as Parquet, and from there as one CSV file, in the order given: one task sorts and streams it, as a result is small beside its input."""
    spark, seen = found.sparkSession, Observation(name)
    found.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{folder}/{name}")
    if csv:
        one = spark.read.parquet(f"{folder}/{name}").repartition(1)
        (one.sortWithinPartitions(*order) if order else one).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}_csv")
    return seen.get["rows"]


def _manifest(spark: SparkSession, folder: str, name: str, began: float, **values: object) -> dict:
    now = datetime.now(timezone.utc).isoformat()
    out = {"command": name, "status": "passed", "spark_version": spark.version, "finished_at_utc": now, "duration_seconds": round(time.time() - began, 3)} | values
    write_manifest(spark, out, f"{folder}/manifest_{name}")
    return out


def run_gold(facts: DataFrame, news_features: DataFrame, features: list[str], folder: str, monthly: bool = False) -> dict:
    """Build the wide matrix and write it with its counts."""
    began, spark = time.time(), facts.sparkSession
    rows = _written(gold.build(facts, news_features, features, monthly=monthly), folder, "gold_monthly" if monthly else "gold", csv=False)
    counts = gold.counts(spark.read.parquet(f"{folder}/{'gold_monthly' if monthly else 'gold'}")).first().asDict()
    return _manifest(spark, folder, "gold", began, n_written=rows, **counts)


def run_coverage(matrix: DataFrame, folder: str) -> dict:
    """Counts of each feature by (geo, year)."""
    check_payload(matrix, ["geo", "year"])
    began = time.time()
    rows = _written(analysis.coverage(matrix, numeric_columns(matrix)), folder, "coverage", order=["geo", "year"])
    return _manifest(matrix.sparkSession, folder, "coverage", began, n_rows=rows, n_features=len(numeric_columns(matrix)))


def with_intensities(matrix: DataFrame) -> tuple[DataFrame, list[str]]:
    """The matrix with investment per head, per cent of GDP and per km of network, as far as it has their columns, and their names."""
    ratios = {
        "rail_investment_per_capita": ("rail_investment_pps", "population_total", 1_000_000.0), "rail_investment_pct_gdp": ("rail_investment", "gdp_current_meur", 100.0),
        "rail_investment_per_network_km": ("rail_investment_pps", "rail_network_length_km", 1.0),
    }
    made = {n: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")) * k for n, (a, b, k) in ratios.items() if {a, b} <= set(matrix.columns) and n not in matrix.columns}
    return matrix.withColumns(made), list(made)


def run_correlations(matrix: DataFrame, targets: list[str], folder: str, by_country: bool = False, panel: bool = False, country_only: bool = False, least: int = 30, top: int = 15) -> dict:
    """Correlations of targets with all features: levels against levels and deltas, or as panel deltas against deltas.

    Investment and what is derived from it are targets only, never features; the derived intensities join the targets given. The strongest pairs of each
    target are listed in the manifest; by country only significant ones.
    """
    check_payload(matrix, ["geo", "year"])
    began = time.time()
    if country_only:
        matrix = matrix.where((F.col("geo_level") if "geo_level" in matrix.columns else geo_level(F.col("geo"))) == "country")
        check_payload(matrix, ["geo"])
    features = [c for c in numeric_columns(matrix) if c not in INVESTMENT]
    matrix, derived = with_intensities(matrix)
    targets = [t for t in dict.fromkeys([*targets, *derived]) if t in matrix.columns]
    if not targets:
        raise ValueError("the table has none of the targets")
    if not features:
        raise ValueError("the table has no column that may be a feature")
    moved = analysis.deltas(matrix, list(dict.fromkeys([*features, *targets])), "__delta")
    if panel:
        left, right = [f"{t}__delta" for t in targets], [f"{f}__delta" for f in features]
    else:
        left, right = targets, [*features, *(f"{f}__delta" for f in features)]
    found = analysis.correlations(moved, left, right, by_country, least)
    bare = lambda c: F.regexp_replace(c, "__delta$", "")
    found = found.withColumns({"kind": F.when(F.col("feature").endswith("__delta"), "delta").otherwise("level"), "target": bare("target"), "feature": bare("feature")}).where("target <> feature or kind = 'delta'")
    name = f"correlations_{'by_country' if by_country else 'pooled'}_{'panel' if panel else 'levels'}"
    columns = [*(["geo"] if by_country else []), "target", "feature", "kind", "pearson_r", "p_pearson", F.col("rank_r").alias("spearman_r"), "p_spearman", "n"]
    rows = _written(found.select(*columns), folder, name, order=["target", F.abs("pearson_r").desc(), "feature", "kind", *(["geo"] if by_country else [])])
    if not rows:
        raise ValueError(f"no pair has {least} observations")
    written = matrix.sparkSession.read.parquet(f"{folder}/{name}")
    best = analysis.strongest(analysis.significant(written) if by_country else written, top).orderBy("target", "rank")
    listed: dict[str, list] = {}
    for r in best.drop("rank").collect():  # at most `top` for each target
        listed.setdefault(r.target, []).append({k: round(v, 4) if isinstance(v, float) else v for k, v in r.asDict().items() if k != "target"})
    return _manifest(matrix.sparkSession, folder, name, began, n_features=len(features), n_rows_reported=rows, targets=targets, top_by_target=listed)


def run_regional(matrix: DataFrame, folder: str, money: str | None = None, least: int = 3) -> dict:
    """Regions' networks and electrification, their inequality inside countries, and its correlation with the country's money.

    `money` is the investment at purchasing power if there is such a column, or else the plain one. Fewer than max(4, least) usable pairs are an error.
    """
    money = money or next((c for c in ("rail_investment_pps", "rail_investment") if c in matrix.columns), "rail_investment")
    check_payload(matrix, ["geo", "year", "rail_network_length_km", "rail_electrified_km", money])
    began = time.time()
    level = F.col("geo_level") if "geo_level" in matrix.columns else geo_level(F.col("geo"))
    lengths = matrix.where(level == "region").select("geo", "year", F.col("rail_network_length_km").alias("network"), F.col("rail_electrified_km").alias("electrified"))
    share = F.when(F.col("network") > 0, F.col("electrified") / F.col("network"))
    described = lengths.select("geo", F.substring("geo", 1, 2).alias("country_code"), (F.length("geo") - 2).alias("nuts_level"), "year", "network", "electrified", share.alias("share"))
    regions = described.where("nuts_level = 2")
    means, unequal = analysis.region_means(regions), analysis.inequality(regions, least, True)
    paid = matrix.where(level == "country").select(F.col("geo").alias("country_code"), "year", F.col(money).cast("double").alias("money"))
    found = analysis.money_against_inequality(unequal, paid).first()
    if found.n_pairs < max(4, least) or found.r is None:
        raise ValueError(f"investment and inequality have {found.n_pairs} usable pairs, {max(4, least)} are needed")
    counts = {
        "n_described": _written(described, folder, "descriptives", order=["geo", "year"]), "n_regions": _written(means, folder, "regions", order=[F.desc_nulls_last("mean_network"), "geo"]),
        "n_country_years": _written(unequal, folder, "inequality", order=["country_code", "year"]),
    }
    shown = lambda df, by, k, digits: [{c: round(v, digits) if isinstance(v, float) else v for c, v in r.asDict().items()} for r in df.where(F.col(by).isNotNull()).orderBy(F.desc(by), df.columns[0]).limit(k).collect()]
    cv = analysis.mean_inequality(unequal).select("country_code", F.col("mean_cv").alias("avg_cv_network"))
    lists = {
        "top_nuts2_by_network": shown(means.select("geo", "country_code", "mean_network"), "mean_network", 10, 1), "top_nuts2_by_electrification": shown(means.select("geo", "country_code", "mean_share"), "mean_share", 10, 3),
        "most_unequal_countries": shown(cv, "avg_cv_network", 10, 3),
        "least_unequal_countries": [{"country_code": r[0], "avg_cv_network": round(r[1], 3)} for r in cv.where("avg_cv_network IS NOT NULL").orderBy("avg_cv_network", F.desc("country_code")).limit(5).collect()][::-1],
    }
    p = matrix.sparkSession.range(1).select(fisher_p(F.lit(found.r), F.lit(found.n_pairs)).alias("p")).first().p
    against = {"target": money, "metric": "cv_network", "pearson_r": round(found.r, 4), "p_value": None if p is None else round(p, 4), "n": found.n_pairs}
    return _manifest(matrix.sparkSession, folder, "regional", began, **counts, **lists, investment_vs_disparity=against, r=found.r, n_pairs=found.n_pairs)
