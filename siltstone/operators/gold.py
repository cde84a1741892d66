"""From long facts to the wide (geo, year) matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone import vocab
from siltstone.functions.columns import geo_level
from siltstone.operators import news

KEYS = ["geo", "year"]


def resolve(facts: DataFrame, priority: list[str] = vocab.SOURCE_PRIORITY) -> DataFrame:
    """One fact for each (geo, year, feature): that of the source that ranks first, even if its value is null.

    Unknown sources rank last; ties go by dataset, column, unit and value. The aggregate combines before its one shuffle.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col("source_system")), F.lit(0))
    order = F.struct(F.when(rank == 0, len(priority) + 1).otherwise(rank).alias("rank"), "source_dataset", "source_column", "unit", "value", "source_system")
    best = facts.groupBy("geo", "year", "feature").agg(F.min(order).alias("m"))
    return best.select("geo", "year", "feature", "m.value", "m.unit", "m.source_system", "m.source_dataset", "m.source_column")


def pivot_features(resolved: DataFrame, features: list[str]) -> DataFrame:
    """A column for each feature; null values, and so rows without any, drop out."""
    known = resolved.where("value is not null and geo is not null and year is not null")
    return known.groupBy(*KEYS).pivot("feature", features).agg(F.first("value", ignorenulls=True))


def with_levels(gold: DataFrame) -> DataFrame:
    return gold.withColumn("geo_level", geo_level(F.col("geo")))


def with_intensities(gold: DataFrame, money: str, population: str, gdp: str, network: str, price_level: str | None = None) -> DataFrame:
    """Money per head (times a million), as percentage of GDP and per kilometre; in purchasing power where a price level is given."""
    ratio = lambda a, b, k=1: F.try_divide(F.col(a), F.col(b)) * k
    new = {f"{money}_per_capita": ratio(money, population, 1_000_000), f"{money}_pct_gdp": ratio(money, gdp, 100), f"{money}_per_km": ratio(money, network)}
    if price_level:
        new[f"{money}_pps"] = ratio(money, price_level, 100)
    return gold.withColumns(new)


def join_news(stats: DataFrame, news: DataFrame, counts: list[str], texts: list[str]) -> DataFrame:
    """Full outer join on (geo, year); absent counts become 0 and absent texts empty, statistics stay null."""
    return stats.join(news, KEYS, "full_outer").fillna(0, counts).fillna("", texts)


def years_between(gold: DataFrame, first: int | None, last: int | None) -> DataFrame:
    out = gold if first is None else gold.where(F.col("year") >= first)
    return out if last is None else out.where(F.col("year") <= last)


def counts(gold: DataFrame) -> DataFrame:
    """One row: rows, geos, rows by level, first and last year, and whether home countries are there."""
    level = geo_level(F.col("geo"))
    return gold.agg(
        F.count("*").alias("n_rows"), F.countDistinct("geo").alias("n_geos"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        *(F.count_if(level == v).alias(f"n_{v}") for v in ("country", "region", "aggregate")),
        *(F.count_if(F.col("geo") == c).alias(f"n_{c.lower()}") for c in vocab.HOME_COUNTRIES),
    )


def crosswalk(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Facts with the canonical feature of their label; unmapped ones go. Spark broadcasts the mapping if it is below its limit."""
    return facts.drop("feature").join(mapping.where("feature <> 'unmapped'"), "source_column")


def latest_partition(rows: DataFrame, keys: list[str], date: str = "ingest_date") -> DataFrame:
    """The rows of each key's last date; an aggregate and a join, so one large key doesn't sort in one task."""
    last = rows.groupBy(*keys).agg(F.max(date).alias(date))
    return rows.join(last, [*keys, date], "left_semi")


def carried_forward(rows: DataFrame, partition: list[str], order: list[str], code: str, value: str, out: str) -> DataFrame:
    """`value` of the last row whose `code` isn't blank; a code without a value resets it to null."""
    seen = F.when(F.trim(F.coalesce(F.col(code), F.lit(""))) != "", F.struct(F.col(value).alias("v")))
    upto = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(seen, ignorenulls=True).over(upto)["v"])


def melted(wide: DataFrame, ids: list[str], columns: list[str], name: str = "year", value: str = "value") -> DataFrame:
    """Long rows of wide columns, nulls left out."""
    return wide.unpivot(ids, columns, name, value).where(F.col(value).isNotNull())


def build(facts: DataFrame, news_features: DataFrame, features: list[str], first: int | None = None, last: int | None = None, monthly: bool = False) -> DataFrame:
    """The wide matrix: resolved and pivoted facts, the news block, levels of geo and investment at purchasing power, by (geo, year[, month]).

    Features without a value in any row are left out; absent news counts are 0 and texts empty, statistics stay null. Rows are sorted.
    """
    resolved = resolve(facts)
    stats = pivot_features(resolved, features)
    seen = stats.agg(*(F.count(c).alias(c) for c in features)).first()
    stats = stats.select(*KEYS, *(c for c in features if seen[c]))
    keys = ["country", "year", "month"] if monthly else ["country", "year"]
    rows = news.block(news.relevant(news_features, monthly), keys).withColumnRenamed("country", "geo")
    both = stats.join(rows, KEYS, "full_outer")
    both = both.fillna(0, [c for c in rows.columns if news.is_count(c)]).fillna("", [c for c in rows.columns if news.is_text(c)])
    if {"rail_investment", "price_level_index"} <= set(both.columns):
        both = both.withColumn("rail_investment_pps", F.try_divide(F.col("rail_investment") * 100.0, F.col("price_level_index")))
    lead = ["geo", "geo_level", "year", *(["month"] if monthly else [])]
    wide = with_levels(years_between(both, first, last))
    return wide.select(*lead, *(c for c in wide.columns if c not in lead)).orderBy("geo", "year", *(["month"] if monthly else []))
