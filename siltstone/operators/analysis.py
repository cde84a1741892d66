"""Coverage, correlations and regional inequality over the wide matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.columns import fisher_p, fisher_z, two_sided_p
from siltstone.tables import settle


#: Ranges of values that a variable's ranks are worked out in.
RANK_BUCKETS = 128


def coverage(gold: DataFrame, features: list[str]) -> DataFrame:
    return gold.groupBy("geo", "year").agg(F.count("*").alias("n_rows"), *(F.count(c).alias(f"n_{c}") for c in features))


def deltas(gold: DataFrame, columns: list[str], suffix: str = "_delta") -> DataFrame:
    """Year-on-year differences; null over a gap. All in one projection over one window."""
    w = Window.partitionBy("geo").orderBy("year")
    step = F.col("year") - F.lag("year").over(w) == 1
    return gold.select("*", *(F.when(step, F.col(c) - F.lag(c).over(w)).alias(c + suffix) for c in columns))


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson's r, null where one side doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y)))


def percent_ranked(rows: DataFrame, keys: list[str], value: str, out: str, buckets: int = RANK_BUCKETS) -> DataFrame:
    """rows with the percent rank of their value among those of equal keys: (rank - 1) / (n - 1), ties at their smallest rank, 0 for a row alone.

    Equal values are counted first, so a hot value is one row. The others are cut into about `buckets` ranges of neighbouring values for each key, told by
    approximate quantiles; a rank is the count of earlier ranges and of smaller values in its own. So no task sorts a whole key, and the result is exact.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    cuts = counts.where(~F.isnan(value)).groupBy(*keys).agg(F.percentile_approx(value, [k / buckets for k in range(1, buckets)]).alias("_cuts"))
    within = counts.join(cuts, keys, "left").withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(value))), F.lit(0))).drop("_cuts")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = within.groupBy(*keys, "_range").agg(F.sum("_n").alias("_size"))
    starts = sizes.select(*keys, "_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"), F.sum("_size").over(Window.partitionBy(*keys)).alias("_all"))
    smaller = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = within.withColumn("_smaller", F.coalesce(F.sum("_n").over(smaller), F.lit(0))).join(starts, [*keys, "_range"])
    rank = F.when(F.col("_all") > 1, (F.col("_start") + F.col("_smaller")) / (F.col("_all") - 1)).otherwise(0.0)
    return rows.join(placed.select(*keys, value, rank.alias(out)), [*keys, value])


def correlations(gold: DataFrame, targets: list[str], features: list[str], by_geo: bool = False, least: int = 4) -> DataFrame:
    """Pearson and rank correlation of each target with each feature over common (geo, year), with n, Fisher's z and two-sided p.

    Ranks are percent ranks of each variable over all its own rows, taken before pairing. A skewed variable costs nothing extra:
    the long form has one row for each variable and observation, and pairing is an equi-join on (geo, year).
    """
    group, names = ["geo"] if by_geo else [], list(dict.fromkeys([*targets, *features]))
    # settled, as ranks and pairs read these several times and the matrix behind them is dear
    long = settle(gold.select("geo", "year", *(F.col(c).cast("double").alias(c) for c in names)).unpivot(["geo", "year"], names, "name", "value").where("value IS NOT NULL"))
    placed = settle(percent_ranked(long, [*group, "name"], "value", "value_rank"))

    def ranked(columns: list[str], name: str, value: str) -> DataFrame:
        return placed.where(F.col("name").isin(columns)).withColumnsRenamed({"name": name, "value": value, "value_rank": value + "_rank"})

    pairs = ranked(targets, "target", "t").join(ranked(features, "feature", "f"), ["geo", "year"]).where("target <> feature")
    out = pairs.groupBy("target", "feature", *group).agg(guarded_corr(F.col("t"), F.col("f")).alias("pearson_r"), guarded_corr(F.col("t_rank"), F.col("f_rank")).alias("rank_r"), F.count("*").alias("n"))
    return out.where((F.col("n") >= least) & F.col("pearson_r").isNotNull()).withColumns({"fisher_z": fisher_z(F.col("pearson_r"), F.col("n")), "p_pearson": fisher_p(F.col("pearson_r"), F.col("n")), "p_spearman": fisher_p(F.col("rank_r"), F.col("n"))})


def significant(found: DataFrame, level: float = 0.05) -> DataFrame:
    """Correlations whose two-sided p, that of `fisher_z` where there is no column p_pearson, is below the level; none without p."""
    return found.where((F.col("p_pearson") if "p_pearson" in found.columns else two_sided_p(F.col("fisher_z"))) < level)


def strongest(found: DataFrame, k: int = 15) -> DataFrame:
    """The k largest correlations of each target."""
    w = Window.partitionBy("target").orderBy(F.abs("pearson_r").desc(), *(c for c in ("feature", "geo") if c in found.columns))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def regional_share(regions: DataFrame) -> DataFrame:
    """Regions with country and electrified share of their network."""
    return regions.where(F.length("geo") == 4).withColumns({"country_code": F.substring("geo", 1, 2), "share": F.try_divide(F.col("electrified"), F.col("network"))})


def region_means(regions: DataFrame) -> DataFrame:
    return regions.groupBy("geo", "country_code").agg(F.avg("network").alias("mean_network"), F.avg("share").alias("mean_share"), F.count("*").alias("n_years"))


def inequality(regions: DataFrame, least: int = 3, electrified: bool = False) -> DataFrame:
    """Coefficient of variation of network length, and if asked for of electrified length, between the regions of each country and year."""
    also = [F.avg("electrified").alias("mean_electrified"), F.stddev_samp("electrified").alias("std_electrified")] if electrified else []
    out = regions.groupBy("country_code", "year").agg(F.count("*").alias("n_regions"), F.avg("network").alias("mean_length"), F.stddev_samp("network").alias("std_length"), *also)
    out = out.where(F.col("n_regions") >= least).withColumn("cv", F.when(F.col("mean_length") > 0, F.col("std_length") / F.col("mean_length")))
    return out.withColumn("cv_electrified", F.when(F.col("mean_electrified") > 0, F.col("std_electrified") / F.col("mean_electrified"))) if electrified else out


def mean_inequality(unequal: DataFrame) -> DataFrame:
    return unequal.groupBy("country_code").agg(F.avg("cv").alias("mean_cv"), F.count("*").alias("n_years"))


def money_against_inequality(unequal: DataFrame, money: DataFrame) -> DataFrame:
    """One row: correlation of a country's money with its inequality, and complete pairs."""
    both = unequal.join(money, ["country_code", "year"])
    return both.agg(guarded_corr(F.col("money"), F.col("cv")).alias("r"), F.count_if(F.col("money").isNotNull() & F.col("cv").isNotNull()).alias("n_pairs"))
