"""The registered queries over the driver's tables, and the same queries in DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import vocab
from siltstone.functions import columns as C
from siltstone.operators import analysis, evaluation, gold, matching, news, resampling, runner, vector_join
from siltstone.plans.views import duck, view
from siltstone.sources import discovery, rules
from siltstone.tables import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FEATURES = ["order_value", "ship_lines", "ship_qty"]
YM = ["country", "year", "month"]


def register(name: str, oracle: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = duck(oracle)
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a precision that doesn't depend on the order of summation."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def stats(spark: SparkSession, sf: str) -> DataFrame:
    return gold.pivot_features(gold.resolve(view(spark, sf, "stat_fact")), FEATURES)


def kept_news(spark: SparkSession, sf: str) -> DataFrame:
    return news.relevant(view(spark, sf, "news"), monthly=True)


RANK = "coalesce(list_position(['eurostat', 'uic', 'ksh', 'statistik_austria', 'worldbank'], source_system), 6)"
RESOLVED = f"(SELECT * FROM stat_fact QUALIFY row_number() OVER (PARTITION BY geo, year, feature ORDER BY {RANK}, source_dataset, source_column, unit, value) = 1)"
GOLD = "(SELECT geo, year, " + ", ".join(f"max(value) FILTER (feature = '{f}') AS {f}" for f in FEATURES) + f" FROM {RESOLVED} WHERE value IS NOT NULL GROUP BY geo, year)"
LEVEL = "CASE WHEN regexp_matches(geo, '^(EU|EA)') THEN 'aggregate' WHEN regexp_matches(geo, '^[A-Z]{2}$') THEN 'country' WHEN regexp_matches(geo, '^[A-Z]{2}[A-Z0-9]{1,3}$') THEN 'region' ELSE 'aggregate' END"
TYPES = ", ".join(f"'{e}'" for e in vocab.EVENT_TYPES)
KEPT = f"""(SELECT article_id, country, year, month, sentiment, sentiment_score, money, operators, tone, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END AS confidence,
  CASE WHEN event_type IN ({TYPES}) THEN event_type ELSE 'other' END AS event_type, CASE WHEN language = 'cz' THEN 'cs' ELSE language END AS language
  FROM news WHERE is_rail_related AND country IN ('HU', 'AT'))"""
CORR = "CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 0 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"
REGIONS = "(SELECT *, substr(geo, 1, 2) AS country_code, CASE WHEN network <> 0 THEN electrified / network END AS share FROM region_fact WHERE length(geo) = 4)"
UNEQUAL = f"(SELECT country_code, year, count(*) AS n_regions, avg(network) AS mean_length, stddev_samp(network) AS std_length, CASE WHEN avg(network) > 0 THEN stddev_samp(network) / avg(network) END AS cv FROM {REGIONS} GROUP BY ALL HAVING count(*) >= 3)"


@register("gold_resolve_conflicts", f"SELECT geo, year, feature, value, unit, source_system FROM {RESOLVED}")
def _(spark, sf):
    return gold.resolve(view(spark, sf, "stat_fact")).select("geo", "year", "feature", "value", "unit", "source_system")


@register("gold_pivot_stats", f"SELECT * FROM {GOLD}")
def flagship(spark, sf):
    return stats(spark, sf).select("geo", "year", *FEATURES)


FLAGSHIP = flagship


@register("gold_geo_level", f"SELECT geo, {LEVEL} AS geo_level FROM (SELECT geo FROM stat_fact UNION SELECT geo FROM region_fact UNION SELECT 'EU27_2020')")
def _(spark, sf):
    geos = view(spark, sf, "stat_fact").select("geo").union(view(spark, sf, "region_fact").select("geo")).union(spark.range(1).select(F.lit("EU27_2020"))).distinct()
    return gold.with_levels(geos)


@register("gold_investment_intensity", f"SELECT geo, year, round(order_value / nullif(ship_qty, 0) * 1000000, 2) AS order_value_per_capita, round(order_value / nullif(ship_lines, 0) * 100, 2) AS order_value_pct_gdp, round(order_value / nullif(ship_qty, 0), 2) AS order_value_per_km FROM {GOLD}")
def _(spark, sf):
    out = gold.with_intensities(stats(spark, sf), "order_value", "ship_qty", "ship_lines", "ship_qty")
    return rounded(out.select("geo", "year", "order_value_per_capita", "order_value_pct_gdp", "order_value_per_km"), 2)


NEWS_YEAR = f"(SELECT country AS geo, year, count(article_id) AS news_count, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM {KEPT} GROUP BY ALL)"


@register("gold_full_outer", f"SELECT coalesce(s.geo, n.geo) AS geo, coalesce(s.year, n.year) AS year, order_value, ship_lines, ship_qty, coalesce(news_count, 0) AS news_count, coalesce(languages, '') AS languages FROM {GOLD} s FULL JOIN {NEWS_YEAR} n ON s.geo = n.geo AND s.year = n.year")
def _(spark, sf):
    by_year = kept_news(spark, sf).groupBy(F.col("country").alias("geo"), "year").agg(F.count("article_id").alias("news_count"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
    return gold.join_news(stats(spark, sf).select("geo", "year", *FEATURES), by_year, ["news_count"], ["languages"])


@register("gold_year_month", f"SELECT coalesce(s.geo, n.geo) AS geo, coalesce(s.year, n.year) AS year, month, ship_qty, coalesce(news_count, 0) AS news_count FROM {GOLD} s FULL JOIN (SELECT country AS geo, year, month, count(article_id) AS news_count FROM {KEPT} GROUP BY ALL) n ON s.geo = n.geo AND s.year = n.year")
def _(spark, sf):
    monthly = kept_news(spark, sf).groupBy(F.col("country").alias("geo"), "year", "month").agg(F.count("article_id").alias("news_count"))
    return gold.join_news(stats(spark, sf).select("geo", "year", "ship_qty"), monthly, ["news_count"], [])


@register("gold_counts", f"SELECT count(*) AS n_rows, count(DISTINCT geo) AS n_geos, min(year) AS first_year, max(year) AS last_year, count(*) FILTER (({LEVEL}) = 'country') AS n_country, count(*) FILTER (({LEVEL}) = 'region') AS n_region, count(*) FILTER (({LEVEL}) = 'aggregate') AS n_aggregate, count(*) FILTER (geo = 'HU') AS n_hu, count(*) FILTER (geo = 'AT') AS n_at FROM {GOLD}")
def _(spark, sf):
    return gold.counts(stats(spark, sf))


@register("gold_year_range", f"SELECT geo, year, ship_qty FROM {GOLD} WHERE year BETWEEN 1996 AND 1998")
def _(spark, sf):
    return gold.years_between(stats(spark, sf).select("geo", "year", "ship_qty"), 1996, 1998)


@register("news_core", f"SELECT country, year, month, count(article_id) AS news_count, round(avg(coalesce(sentiment_score, CASE sentiment WHEN 'negative' THEN -1.0 WHEN 'neutral' THEN 0.0 ELSE 1.0 END)), 6) AS news_sentiment_mean, round(avg(CASE WHEN sentiment = 'negative' THEN 1.0 ELSE 0.0 END), 6) AS news_share_negative, coalesce(sum(money), 0) AS news_money_sum FROM {KEPT} GROUP BY ALL")
def _(spark, sf):
    return rounded(news.core(kept_news(spark, sf), YM))


def counted(column: str, names: list[str]) -> str:
    return "SELECT country, year, month, " + ", ".join(f"count(*) FILTER ({column} = '{n}') AS n_{k}" for k, n in enumerate(names))


@register("news_event_counts", counted("event_type", vocab.EVENT_TYPES) + f" FROM {KEPT} GROUP BY ALL")
def _(spark, sf):
    return news.category_counts(kept_news(spark, sf), YM, F.col("event_type"), vocab.EVENT_TYPES, "n_")


@register("news_language_counts", counted("language", vocab.LANGUAGES) + f" FROM {KEPT} GROUP BY ALL")
def _(spark, sf):
    return news.category_counts(kept_news(spark, sf), YM, F.col("language"), vocab.LANGUAGES, "n_")


@register("news_operator_counts", counted("op", vocab.OPERATORS) + f" FROM (SELECT country, year, month, unnest(string_split(operators, ';')) AS op FROM {KEPT}) GROUP BY ALL")
def _(spark, sf):
    each = kept_news(spark, sf).select(*YM, F.explode(F.split("operators", ";")).alias("op"))
    return news.category_counts(each, YM, F.col("op"), vocab.OPERATORS, "n_")


@register("news_superclass_counts", "SELECT CASE WHEN event_type IN ('accident', 'strike', 'service_change', 'delay', 'line_closure') THEN 'disruption' WHEN event_type IN ('investment', 'line_opening', 'financial') THEN 'development' WHEN event_type = 'policy' THEN 'policy' ELSE 'other' END AS superclass, count(*) AS n FROM " + KEPT + " GROUP BY ALL")
def _(spark, sf):
    classes = F.create_map(*(F.lit(x) for pair in vocab.SUPERCLASS.items() for x in pair))
    return kept_news(spark, sf).groupBy(classes[F.col("event_type")].alias("superclass")).agg(F.count("*").alias("n"))


@register("news_language_primary", f"SELECT country, year, month, language AS primary_language FROM (SELECT country, year, month, language, count(*) AS n FROM {KEPT} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY country, year, month ORDER BY n DESC, language) = 1")
def _(spark, sf):
    return news.primary(kept_news(spark, sf), YM, "language", "primary_language")


@register("news_language_entropy", f"SELECT country, year, month, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS language_entropy FROM (SELECT country, year, month, language, count(*)::DOUBLE AS n FROM {KEPT} GROUP BY ALL) GROUP BY ALL")
def _(spark, sf):
    return rounded(news.entropy(kept_news(spark, sf), YM, "language", "language_entropy"))


for _name, _column in (("confidence", "confidence"), ("tone", "tone")):

    @register(f"news_{_name}_stats", f"SELECT country, year, month, round(avg({_column}), 6) AS c_mean, round(stddev_samp({_column}), 6) AS c_std, min({_column}) AS c_min, max({_column}) AS c_max FROM {KEPT} GROUP BY ALL")
    def _(spark, sf, column=_column):
        return rounded(news.spread(kept_news(spark, sf), YM, column, "c"))


@register("news_confidence_bins", f"SELECT country, year, month, count(*) FILTER (confidence <= 0.33) AS news_confidence_bin_low, count(*) FILTER (confidence > 0.33 AND confidence <= 0.67) AS news_confidence_bin_medium, count(*) FILTER (confidence > 0.67) AS news_confidence_bin_high FROM {KEPT} GROUP BY ALL")
def _(spark, sf):
    return news.confidence_bins(kept_news(spark, sf), YM)


@register("news_token_rollup", f"SELECT country, year, month, count(DISTINCT t) AS operators_count, string_agg(DISTINCT t, ',' ORDER BY t) AS operators_list FROM (SELECT country, year, month, trim(unnest(string_split(operators, ';'))) AS t FROM {KEPT}) WHERE t <> '' GROUP BY ALL")
def _(spark, sf):
    return news.token_rollup(kept_news(spark, sf), YM, F.split("operators", ";"), "operators")


@register("news_date_parse", """SELECT event_id, coalesce(try_strptime(t, '%Y%m%dT%H%M%SZ'), try_strptime(t, '%Y%m%d%H%M%S'), try_strptime(t, '%Y-%m-%d %H:%M:%S'), try_strptime(t, '%d %b %Y %H:%M:%S +0000')) AS published
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y%m%dT%H%M%SZ') WHEN 1 THEN strftime(ts, '%Y%m%d%H%M%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 3 THEN strftime(ts, '%d %b %Y %H:%M:%S +0000') ELSE 'soon' END AS t FROM events)""")
def _(spark, sf):
    events, f = spark.read.parquet(f"{sf}/events.parquet"), lambda p: F.date_format("ts", p)
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, f("yyyyMMdd'T'HHmmss'Z'")).when(kind == 1, f("yyyyMMddHHmmss")).when(kind == 2, f("yyyy-MM-dd HH:mm:ss")).when(kind == 3, f("EEE, dd MMM yyyy HH:mm:ss '+0000'")).otherwise("soon")
    return events.select("event_id", C.news_time(text).cast("timestamp_ntz").alias("published"))


@register("sdmx_value_parse", "SELECT l_orderkey % 97 AS k, sum(CAST(nullif(replace(regexp_extract(v, '([-\\d.,]+)', 1), ',', ''), '') AS DECIMAL(18,0))) AS s, count(*) AS n FROM (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN ':' WHEN 1 THEN concat(CAST(CAST(l_quantity AS INT) AS VARCHAR), ' p') ELSE concat('1,', lpad(CAST(CAST(l_quantity AS INT) AS VARCHAR), 3, '0')) END AS v FROM lineitem) GROUP BY ALL")
def _(spark, sf):
    q = F.col("l_quantity").cast("int").cast("string")
    cell = F.when(F.col("l_linenumber") % 3 == 0, ":").when(F.col("l_linenumber") % 3 == 1, F.concat(q, F.lit(" p"))).otherwise(F.concat(F.lit("1,"), F.lpad(q, 3, "0")))
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_orderkey") % 97).alias("k"), C.sdmx_number(cell).cast("decimal(18,0)").alias("v"))
    return rows.groupBy("k").agg(F.sum("v").cast("decimal(38,0)").alias("s"), F.count("*").alias("n"))


@register("sdmx_unpivot", "SELECT o_custkey AS id, name AS measure, value FROM (UNPIVOT (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS total, CASE WHEN count(*) > 3 THEN count(*)::DOUBLE END AS busy FROM orders GROUP BY ALL) ON total, busy INTO NAME name VALUE value)")
def _(spark, sf):
    wide = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").alias("id")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.when(F.count("*") > 3, F.count("*").cast("double")).alias("busy"))
    return gold.melted(wide, ["id"], ["total", "busy"], "measure", "value")


@register("crosswalk_map", "SELECT geo, year, CASE source_column WHEN 'Price' THEN 'order_value' ELSE 'ship_qty' END AS feature, value FROM stat_fact WHERE source_column IN ('Price', 'Quantity')")
def _(spark, sf):
    mapping = spark.createDataFrame([("Price", "order_value"), ("Quantity", "ship_qty"), ("Lines", "unmapped")], "source_column string, feature string")
    return gold.crosswalk(view(spark, sf, "stat_fact"), mapping).select("geo", "year", "feature", "value")


@register("latest_partition", "SELECT user_id, count(*) AS n, max(CAST(ts AS DATE)) AS day FROM events e WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events x WHERE x.user_id = e.user_id) GROUP BY user_id")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("ingest_date", F.to_date("ts"))
    return gold.latest_partition(rows, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"), F.max("ingest_date").alias("day"))


@register("union_by_name", "SELECT geo, year, value, CAST(NULL AS DOUBLE) AS network FROM stat_fact UNION ALL SELECT geo, year, NULL, network FROM region_fact")
def _(spark, sf):
    return view(spark, sf, "stat_fact").select("geo", "year", "value").unionByName(view(spark, sf, "region_fact").select("geo", "year", "network"), allowMissingColumns=True)


@register("locf_sections", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 1 THEN NULL ELSE 0 END AS skip, last_value(CASE WHEN l_linenumber % 3 = 1 THEN coalesce(nullif(l_returnflag, 'R'), '-') END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS section FROM lineitem""")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").withColumns({"code": F.when(F.col("l_linenumber") % 3 == 1, "x").otherwise(""), "v": F.nullif("l_returnflag", F.lit("R"))})
    seen = F.when(F.col("code") != "", F.coalesce("v", F.lit("-")))
    out = gold.carried_forward(rows.withColumn("mark", seen), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "code", "mark", "section")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") != 1, 0).alias("skip"), "section")


@register("cov_by_geo_year", f"SELECT geo, year, count(*) AS n_rows, count(order_value) AS n_order_value, count(ship_lines) AS n_ship_lines, count(ship_qty) AS n_ship_qty FROM {GOLD} GROUP BY ALL")
def _(spark, sf):
    return analysis.coverage(stats(spark, sf), FEATURES)


DELTA = f"(SELECT geo, year, " + ", ".join(f"CASE WHEN year - lag(year) OVER w = 1 THEN {f} - lag({f}) OVER w END AS {f}_delta" for f in FEATURES) + f" FROM {GOLD} WINDOW w AS (PARTITION BY geo ORDER BY year))"


@register("corr_deltas", f"SELECT geo, year, round(order_value_delta, 4) AS order_value_delta, ship_lines_delta, ship_qty_delta FROM {DELTA}")
def _(spark, sf):
    return rounded(analysis.deltas(stats(spark, sf), FEATURES).select("geo", "year", *(f"{f}_delta" for f in FEATURES)), 4)


def corr_oracle(source: str, features: list[str], group: str, also: str = "") -> str:
    g, gs = (f", {group}", f"{group}, ") if group else ("", "")
    long = " UNION ALL ".join(f"SELECT geo, year, '{f}' AS name, {f} AS v FROM {source} WHERE {f} IS NOT NULL" for f in features)
    ranked = f"(SELECT *, percent_rank() OVER (PARTITION BY {gs}name ORDER BY v) AS r FROM ({long}))"
    pg = ", t.geo" if group else ""
    r, rr = CORR.format(x="t.v", y="f.v"), CORR.format(x="t.r", y="f.r")
    return f"SELECT target, feature{g}, round(p, 5) + 0.0 AS pearson_r, round(s, 5) + 0.0 AS rank_r, n, round(CASE WHEN abs(p) < 1 THEN atanh(p) * sqrt(n - 3) END, 4) + 0.0 AS fisher_z FROM (SELECT t.name AS target, f.name AS feature{pg}, {r} AS p, {rr} AS s, count(*) AS n FROM {ranked} t JOIN {ranked} f ON t.geo = f.geo AND t.year = f.year WHERE t.name = '{features[0]}' AND f.name <> '{features[0]}' GROUP BY t.name, f.name{pg} HAVING count(*) >= 4) WHERE p IS NOT NULL{also}"


#: A two-sided p below 0.05, said of z.
SIGNIFICANT = " AND abs(CASE WHEN abs(p) < 1 THEN atanh(p) * sqrt(n - 3) END) > 1.959963984540054"
HORNER = "0.17087277"
for _c in ("-0.82215223", "1.48851587", "-1.13520398", "0.27886807", "-0.18628806", "0.09678418", "0.37409196", "1.00002368", "-1.26551223"):
    HORNER = f"({HORNER}) * t + {_c}"


def p_oracle(r: str) -> str:
    """The two-sided p of a correlation r of n pairs, rounded."""
    z = f"abs(atanh(CASE WHEN abs({r}) < 1 THEN {r} END) * sqrt(n - 3)) / sqrt(2.0)"
    return f"(SELECT round(t * exp({HORNER} - x * x), 4) FROM (SELECT x, 1 / (1 + x / 2) AS t FROM (SELECT {z} AS x)))"


def corr_shape(df: DataFrame) -> DataFrame:
    return df.drop("p_pearson", "p_spearman").withColumns({"pearson_r": F.round("pearson_r", 5) + 0.0, "rank_r": F.round("rank_r", 5) + 0.0, "fisher_z": F.round("fisher_z", 4) + 0.0})


@register("corr_levels", corr_oracle(GOLD, FEATURES, ""))
def _(spark, sf):
    return corr_shape(analysis.correlations(stats(spark, sf), FEATURES[:1], FEATURES))


@register("corr_panel", corr_oracle(DELTA, [f"{f}_delta" for f in FEATURES], ""))
def _(spark, sf):
    names = [f"{f}_delta" for f in FEATURES]
    return corr_shape(analysis.correlations(analysis.deltas(stats(spark, sf), FEATURES), names[:1], names))


RAW = corr_oracle(GOLD, FEATURES, "geo").replace("round(p, 5) + 0.0 AS pearson_r, round(s, 5) + 0.0 AS rank_r", "p, s")


@register("fisher_p", f"SELECT target, feature, geo, n, {p_oracle('p')} AS p_pearson, {p_oracle('s')} AS p_spearman FROM ({RAW})")
def _(spark, sf):
    found = analysis.correlations(stats(spark, sf), FEATURES[:1], FEATURES, by_geo=True)
    return found.select("target", "feature", "geo", "n", F.round("p_pearson", 4).alias("p_pearson"), F.round("p_spearman", 4).alias("p_spearman"))


@register("corr_by_geo", corr_oracle(GOLD, FEATURES, "geo"))
def _(spark, sf):
    return corr_shape(analysis.correlations(stats(spark, sf), FEATURES[:1], FEATURES, by_geo=True)).select("target", "feature", "geo", "pearson_r", "rank_r", "n", "fisher_z")


@register("corr_topk", f"SELECT target, feature, geo, n, row_number() OVER (PARTITION BY target ORDER BY abs(pearson_r) DESC, feature, geo) AS rank FROM ({corr_oracle(GOLD, FEATURES, 'geo', SIGNIFICANT)}) QUALIFY rank <= 15")
def _(spark, sf):
    found = corr_shape(analysis.significant(analysis.correlations(stats(spark, sf), FEATURES[:1], FEATURES, by_geo=True)))
    return analysis.strongest(found).select("target", "feature", "geo", "n", F.col("rank").cast("long").alias("rank"))


@register("regional_descriptives", f"SELECT geo, country_code, round(avg(network), 6) AS mean_network, round(avg(share), 6) AS mean_share, count(*) AS n_years FROM {REGIONS} GROUP BY ALL")
def _(spark, sf):
    return rounded(analysis.region_means(analysis.regional_share(view(spark, sf, "region_fact"))))


@register("regional_rank", f"SELECT geo, round(avg(network), 6) AS mean_network FROM {REGIONS} GROUP BY geo ORDER BY avg(network) DESC, geo LIMIT 10")
def _(spark, sf):
    means = analysis.region_means(analysis.regional_share(view(spark, sf, "region_fact")))
    return rounded(means.select("geo", "mean_network").orderBy(F.desc("mean_network"), "geo").limit(10))


@register("regional_inequality", f"SELECT country_code, year, n_regions, round(mean_length, 6) AS mean_length, round(std_length, 6) AS std_length, round(cv, 6) AS cv FROM {UNEQUAL}")
def _(spark, sf):
    return rounded(analysis.inequality(analysis.regional_share(view(spark, sf, "region_fact"))))


@register("regional_mean_inequality", f"SELECT country_code, round(avg(cv), 6) AS mean_cv, count(*) AS n_years FROM {UNEQUAL} GROUP BY ALL")
def _(spark, sf):
    return rounded(analysis.mean_inequality(analysis.inequality(analysis.regional_share(view(spark, sf, "region_fact")))))


@register("invest_vs_disparity", f"SELECT round({CORR.format(x='order_value', y='cv')}, 6) AS r, count(*) FILTER (order_value IS NOT NULL AND cv IS NOT NULL) AS n_pairs FROM {UNEQUAL} u JOIN {GOLD} g ON u.country_code = g.geo AND u.year = g.year WHERE order_value IS NOT NULL")
def _(spark, sf):
    money = stats(spark, sf).select(F.col("geo").alias("country_code"), "year", F.col("order_value").alias("money"))
    return rounded(analysis.money_against_inequality(analysis.inequality(analysis.regional_share(view(spark, sf, "region_fact"))), money.where("money is not null")))


@register("article_ids", "SELECT doc_id, sha1(concat_ws('|', source, CAST(doc_id AS VARCHAR), text)) AS article_id, sha256(text) AS content_hash FROM documents")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha1(F.concat_ws("|", "source", F.col("doc_id").cast("string"), "text")).alias("article_id"), F.sha2("text", 256).alias("content_hash"))


@register("url_normalise", "SELECT article_id, lower(rtrim(trim(url), '/')) AS url_key FROM article")
def _(spark, sf):
    return view(spark, sf, "article").select("article_id", C.url_key(F.col("url")).alias("url_key"))


MATCH = "(SELECT article_id, min(ordinal) AS ordinal FROM (SELECT article_id, ordinal FROM article JOIN record ON article_id = record_id UNION ALL SELECT article_id, ordinal FROM article JOIN (SELECT ordinal, lower(rtrim(unnest(string_split(urls, ';')), '/')) AS k FROM record) ON lower(rtrim(trim(url), '/')) = k) GROUP BY article_id)"


@register("gkg_match_first", f"SELECT article_id, ordinal FROM {MATCH}")
def _(spark, sf):
    return matching.match_first(view(spark, sf, "article"), view(spark, sf, "record"))


@register("gkg_antijoin", f"SELECT min(ordinal) AS ordinal FROM record WHERE ordinal NOT IN (SELECT ordinal FROM {MATCH}) GROUP BY lower(urls)")
def _(spark, sf):
    articles, records = view(spark, sf, "article"), view(spark, sf, "record")
    return matching.unmatched(records, matching.match_first(articles, records)).select("ordinal")


@register("tone_sentiment", "SELECT article_id, CASE WHEN tone > 1 THEN 'positive' WHEN tone < -1 THEN 'negative' WHEN tone IS NOT NULL THEN 'neutral' END AS sentiment FROM news")
def _(spark, sf):
    return view(spark, sf, "news").select("article_id", C.tone_sentiment(F.col("tone")).alias("sentiment"))


THEMES = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(upper(props2), '{k}')" for k in keys) + f" THEN '{e}'" for e, keys in vocab.THEME_RULES) + " ELSE 'other' END"


@register("theme_event", f"SELECT event_id, {THEMES} AS event FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'tax_derail;x' WHEN 1 THEN 'PROTEST;DELAY' WHEN 2 THEN 'Infrastructure' WHEN 3 THEN 'cancelled' WHEN 4 THEN 'TRANSPORT' ELSE event_type END AS props2 FROM events)")
def _(spark, sf):
    k = F.col("event_id") % 6
    themes = F.when(k == 0, "tax_derail;x").when(k == 1, "PROTEST;DELAY").when(k == 2, "Infrastructure").when(k == 3, "cancelled").when(k == 4, "TRANSPORT").otherwise(F.col("event_type"))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", C.theme_event(themes).alias("event"))


@register("operator_gazetteer", "SELECT article_id, concat_ws(',', " + ", ".join("CASE WHEN " + " OR ".join(f"contains(strip_accents(lower(operators)), '{a}')" for a in al) + f" THEN '{n}' END" for n, al in vocab.OPERATOR_ALIASES.items()) + ") AS found FROM news")
def _(spark, sf):
    return view(spark, sf, "news").select("article_id", F.array_join(C.operators_in(F.col("operators")), ",").alias("found"))


@register("validate_feature", f"""SELECT article_id, CASE WHEN country IN ('HU', 'AT', 'other') THEN country END AS country, CASE WHEN event_type IN ({TYPES}) THEN event_type ELSE 'other' END AS event_type, sentiment,
  greatest(least(confidence, 1.0), 0.0)::DOUBLE AS confidence, CASE WHEN language <> 'cz' THEN language END AS language, is_rail_related, CASE WHEN sentiment_score IS NOT NULL THEN greatest(least(sentiment_score, 1.0), -1.0) END::DOUBLE AS sentiment_score,
  CASE WHEN operators = '' THEN '' WHEN operators IN ({", ".join(f"'{o}'" for o in vocab.OPERATORS)}) THEN operators ELSE 'other' END AS operators, '1.0' AS confidence_schema_version FROM news""")
def _(spark, sf):
    raw = view(spark, sf, "news").withColumns({c: F.col(c).cast("string") for c in ("confidence", "sentiment_score", "is_rail_related")})
    out = news.validated(raw).withColumn("operators", F.array_join("operators", ","))
    return out.select("article_id", "country", "event_type", "sentiment", "confidence", "language", "is_rail_related", "sentiment_score", "operators", "confidence_schema_version")


@register("cache_hits", "SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    return matching.cache_split(orders.select("k"), orders.where("o_orderstatus = 'F'").select("k").distinct(), ["k"])[0]


@register("cache_last_events", "SELECT event_type AS digest, event_id, ts, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS INTEGER) AS recency FROM events QUALIFY recency <= 100")
def _(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("digest"), "event_id", "ts")
    return runner.last_events(events, "digest", ["ts", "event_id"])


@register("cache_misses", "SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders WHERE o_orderstatus <> 'F'")
def _(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    return matching.cache_split(orders.select("k"), orders.where("o_orderstatus = 'F'").select("k"), ["k"])[1]


@register("dedup_exact", "SELECT sha256(text) AS digest, count(*) AS members, min(doc_id) AS first_id FROM documents GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return matching.exact_groups(spark.read.parquet(f"{sf}/documents.parquet"), "text", "doc_id")


EDGES = "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3"


@register("dedup_similarity_edges", EDGES)
def _(spark, sf):
    return matching.similar_pairs(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding", 0.3, cosine=False)


#: One row for each vector: its links and the smallest id that links reach.
CLASSES = f"""WITH RECURSIVE e AS MATERIALIZED ({EDGES}), l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT a, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON r.a = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) d ON vec_id = d.a LEFT JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON vec_id = m.a"""


@register("dedup_similarity_links", CLASSES.replace("0.3", "0.95"))
def _(spark, sf):
    return vector_join.linked(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding", 0.95)


@register("dedup_marks", f"""WITH RECURSIVE e AS MATERIALIZED ({EDGES.replace("0.3", "0.95")}), l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT a, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON r.a = l.a),
m AS (SELECT a AS node, min(CAST(c AS VARCHAR)) AS component FROM r GROUP BY a),
g AS (SELECT component, 'dedup_' || substr(sha256(string_agg(CAST(node AS VARCHAR), '|' ORDER BY CAST(node AS VARCHAR))), 1, 16) AS group_id FROM m GROUP BY component)
SELECT vec_id, group_id AS cross_lingual_dedup_id, coalesce(CAST(vec_id AS VARCHAR) <> m.component, false) AS is_duplicate FROM embeddings LEFT JOIN m ON vec_id = node LEFT JOIN g ON m.component = g.component""")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    return vector_join.marked(rows, "vec_id", "embedding").drop("embedding")


@register("paging_plan", """SELECT CAST(row_number() OVER (ORDER BY m) - 1 AS INTEGER) AS page, greatest(m, lo)::DATE AS first, least(m + INTERVAL 1 MONTH, hi)::DATE AS last, (SELECT count(*) FROM orders WHERE o_orderdate::DATE >= greatest(m, lo) AND o_orderdate::DATE < least(m + INTERVAL 1 MONTH, hi)) AS orders
FROM (SELECT lo, hi, unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi - INTERVAL 1 DAY), INTERVAL 1 MONTH)) AS m FROM (SELECT min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders))""")
def _(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("day"))
    pages = discovery.month_pages(orders.agg(F.min("day").alias("lo"), F.max("day").alias("hi")), "lo", "hi")
    by_month = orders.groupBy(F.trunc("day", "month").alias("month"), "day").agg(F.count("*").alias("n"))
    # a page lies in one month, so days meet pages by an equi-join
    met = pages.withColumn("month", F.trunc("first", "month")).join(by_month, "month", "left").groupBy("page", "first", "last")
    return met.agg(F.coalesce(F.sum(F.when((F.col("day") >= F.col("first")) & (F.col("day") < F.col("last")), F.col("n"))), F.lit(0)).alias("orders"))


@register("union_first", """SELECT key, source, a, b FROM (SELECT l_partkey AS key, 0 AS source, l_orderkey AS a, CAST(l_linenumber AS BIGINT) AS b FROM lineitem UNION ALL SELECT p_partkey, 1, p_partkey, 0 FROM part)
WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY source, a, b) = 1""")
def _(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("a"), F.col("l_linenumber").cast("long").alias("b"))
    parts = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("key"), F.col("p_partkey").alias("a"), F.lit(0).cast("long").alias("b"))
    return discovery.first_of_each([lines, parts], "key", ["a", "b"])


@register("eval_prf", "SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT count(*) FILTER (gold = 1 AND pred = 1) AS tp, count(*) FILTER (gold <> 1 AND pred = 1) AS fp, count(*) FILTER (gold = 1 AND pred <> 1) AS fn FROM eval_pair)")
def _(spark, sf):
    return evaluation.binary(view(spark, sf, "eval_pair")).withColumn("f1", F.round("f1", 6))


@register("eval_macro_f1", "SELECT round(avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1 FROM (SELECT label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold <> label AND pred = label) AS fp, count(*) FILTER (gold = label AND pred <> label) AS fn FROM eval_multi, (SELECT gold AS label FROM eval_multi UNION SELECT pred FROM eval_multi) GROUP BY label)")
def _(spark, sf):
    return rounded(evaluation.macro_f1(view(spark, sf, "eval_multi")))


@register("eval_confusion", "SELECT gold, pred, count(*) AS n FROM eval_multi GROUP BY ALL")
def _(spark, sf):
    return evaluation.confusion(view(spark, sf, "eval_multi"))


@register("eval_accuracy", "SELECT round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM eval_multi")
def _(spark, sf):
    return rounded(evaluation.accuracy(view(spark, sf, "eval_multi")))


@register("eval_kappa", "WITH n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (gold = pred) AS s FROM eval_multi), c AS (SELECT sum(g.n::DOUBLE * p.n) AS c FROM (SELECT gold AS l, count(*) AS n FROM eval_multi GROUP BY 1) g JOIN (SELECT pred AS l, count(*) AS n FROM eval_multi GROUP BY 1) p ON g.l = p.l) SELECT round((s / n - c / n / n) / (1 - c / n / n), 6) AS kappa FROM n, c".replace("WITH n AS", "SELECT * FROM (WITH n AS") + ")")
def _(spark, sf):
    return rounded(evaluation.kappa(view(spark, sf, "eval_multi")))


@register("eval_bcubed", "SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM (SELECT avg(ngp::DOUBLE / np) AS p, avg(ngp::DOUBLE / ng) AS r FROM (SELECT count(*) OVER (PARTITION BY gold, pred) AS ngp, count(*) OVER (PARTITION BY gold) AS ng, count(*) OVER (PARTITION BY pred) AS np FROM eval_multi))")
def _(spark, sf):
    return rounded(evaluation.bcubed(view(spark, sf, "eval_multi")))


@register("eval_ece", "SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM (SELECT least(floor(confidence * 10), 9) AS b, count(*) AS n, avg(confidence) AS c, avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END) AS a FROM eval_pair GROUP BY 1)")
def _(spark, sf):
    return rounded(evaluation.calibration_error(view(spark, sf, "eval_pair").withColumn("correct", F.col("gold") == F.col("pred"))))


@register("eval_money", "SELECT round(avg(CASE WHEN abs(money - p) <= abs(money) * 0.01 THEN 1.0 ELSE 0.0 END), 6) AS match_rate FROM (SELECT money, CASE WHEN month = 3 THEN NULL ELSE money * (1 + (year - 2020) * 0.006) END AS p FROM news) WHERE money IS NOT NULL")
def _(spark, sf):
    pairs = view(spark, sf, "news").select(F.col("money").alias("gold"), F.when(F.col("month") != 3, F.col("money") * (1 + (F.col("year") - 2020) * 0.006)).alias("pred"))
    return rounded(evaluation.money_match(pairs))


@register("eval_set_prf", "SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT CAST(sum(len(list_intersect(g, p))) AS BIGINT) AS tp, CAST(sum(len(list_filter(p, lambda x: NOT list_contains(g, x)))) AS BIGINT) AS fp, CAST(sum(len(list_filter(g, lambda x: NOT list_contains(p, x)))) AS BIGINT) AS fn FROM (SELECT list_distinct(string_split(operators, ';')) AS g, list_distinct(string_split(CASE WHEN month > 6 THEN 'MÁV;GYSEV' ELSE operators END, ';')) AS p FROM news))")
def _(spark, sf):
    n = view(spark, sf, "news")
    return rounded(evaluation.set_prf(n.select(F.split("operators", ";").alias("gold"), F.split(F.when(F.col("month") > 6, "MÁV;GYSEV").otherwise(F.col("operators")), ";").alias("pred"))))


@register("eval_geoyear_error", "SELECT round(sum(abs(coalesce(p, 0) - coalesce(g, 0)))::DOUBLE / sum(coalesce(g, 0)), 6) AS count_error FROM (SELECT country, year, count(DISTINCT event_type) AS g FROM news GROUP BY ALL) FULL JOIN (SELECT country, year, count(DISTINCT event_type) AS p FROM news WHERE is_rail_related AND month < 7 GROUP BY ALL) USING (country, year)")
def _(spark, sf):
    n = view(spark, sf, "news")
    return rounded(evaluation.cell_count_error(n, n.where("is_rail_related and month < 7"), ["country", "year"], "event_type"))


@register("eval_alignment", "SELECT count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS matched, count(*) FILTER (p IS NULL) AS gold_only, count(*) FILTER (g IS NULL) AS pred_only FROM (SELECT doc_id, 1 AS g FROM labels) FULL JOIN (SELECT doc_id, 1 AS p FROM documents WHERE lang <> 'de') USING (doc_id)")
def _(spark, sf):
    return evaluation.alignment(spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet").where("lang <> 'de'"), "doc_id")


def weights_oracle(rows: str, columns: str, resamples: int = 2000, seed: int = 12345) -> str:
    """CTEs up to w (k, columns, w): the hashed Poisson weight of each of rows (id, columns) in each resample, in integers of 128 bits modulo 2^64."""
    times = lambda h, by: f"(({h}) * {by}::UHUGEINT) % 18446744073709551616::UHUGEINT"
    mixed = lambda h, shift: f"xor({h}, {h} >> {shift})"
    start = f"(key::UHUGEINT + {seed * 0x9E3779B97F4A7C15 % 2**64}::UHUGEINT + {times('k::UHUGEINT', 0xD1B54A32D192ED03)}) % 18446744073709551616::UHUGEINT"
    weight = " + ".join(f"(u >= {math.ceil(step * 2**53)}::UHUGEINT)::INTEGER" for step in evaluation.STEPS)
    return f"""SELECT * FROM (WITH r AS (SELECT ('0x' || substr(md5(id::VARCHAR), 1, 15))::BIGINT AS key, {columns} FROM ({rows})),
h0 AS (SELECT k, {columns}, {start} AS h FROM r, range(1, {resamples + 1}) t(k)), h1 AS (SELECT k, {columns}, {times(mixed("h", 30), 0xBF58476D1CE4E5B9)} AS h FROM h0), h2 AS (SELECT k, {columns}, {times(mixed("h", 27), 0x94D049BB133111EB)} AS h FROM h1),
w AS (SELECT k, {columns}, {weight} AS w FROM (SELECT k, {columns}, {mixed("h", 31)} >> 11 AS u FROM h2))"""


@register("eval_bootstrap_ci", weights_oracle("SELECT id, CASE WHEN gold = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM eval_pair WHERE gold = pred IS NOT NULL", "v")
    + " SELECT round(quantile_cont(m, 0.025), 6) AS ci_lo, round(quantile_cont(m, 0.975), 6) AS ci_hi FROM (SELECT sum(w * v) / nullif(sum(w), 0) AS m FROM w GROUP BY k))")
def _(spark, sf):
    return rounded(evaluation.bootstrap(view(spark, sf, "eval_pair").withColumn("v", (F.col("gold") == F.col("pred")).cast("double")), "v"))


@register("eval_metric_intervals", weights_oracle("SELECT id, gold, pred FROM eval_multi", "gold, pred") + """, every AS (SELECT * FROM w UNION ALL SELECT 0, gold, pred, 1 FROM eval_multi),
c AS (SELECT k, gold, pred, sum(w)::DOUBLE AS n FROM every GROUP BY ALL HAVING sum(w) > 0), l AS (SELECT k, gold AS label, n AS g, 0 AS p, CASE WHEN gold = pred THEN n ELSE 0 END AS tp FROM c UNION ALL SELECT k, pred, 0, n, 0 FROM c),
p AS (SELECT k, sum(g) AS g, sum(p) AS p, sum(tp) AS tp FROM l GROUP BY k, label), s AS (SELECT k, avg(2 * tp / (g + p)) AS macro_f1, sum(tp) / sum(g) AS accuracy, (sum(tp) / sum(g) - sum(g * p) / sum(g) / sum(g)) / (1 - sum(g * p) / sum(g) / sum(g)) AS kappa FROM p GROUP BY k),
b AS (SELECT k, sum(n * n / np) / sum(n) AS bp, sum(n * n / ng) / sum(n) AS br FROM (SELECT k, n, sum(n) OVER (PARTITION BY k, gold) AS ng, sum(n) OVER (PARTITION BY k, pred) AS np FROM c) GROUP BY k),
v AS (SELECT k, unnest(['label_accuracy', 'label_macro_f1', 'label_kappa', 'group_f1']) AS metric, unnest([accuracy, macro_f1, kappa, 2 * bp * br / (bp + br)]) AS value FROM s JOIN b USING (k))
SELECT metric, round(max(value) FILTER (k = 0), 6) AS value, round(quantile_cont(value, 0.025) FILTER (k > 0), 6) AS ci_lo, round(quantile_cont(value, 0.975) FILTER (k > 0), 6) AS ci_hi FROM v GROUP BY metric)""")
def _(spark, sf):
    pairs = view(spark, sf, "eval_multi")
    rows = pairs.select(F.explode(F.array(*(resampling.of_labels(f, F.col("id"), F.col("gold"), F.col("pred")) for f in ("label", "group")))).alias("row")).select("row.*")
    cells = settle(resampling.resampled(rows))
    scores = resampling.label_scores(cells.where("family = 'label'"), {}).union(resampling.group_scores(cells.where("family = 'group'")))
    found = resampling.intervals(scores).select(F.concat_ws("_", "family", "metric").alias("metric"), "value", "ci_lo", "ci_hi")
    return rounded(found.where("metric IN ('label_accuracy', 'label_macro_f1', 'label_kappa', 'group_f1')"))


@register("volume_rollup", "SELECT coalesce(source, 'TOTAL') AS source, count(*) AS artifacts, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY ROLLUP (source)")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").rollup("source").agg(F.count("*").alias("artifacts"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))
    return rows.withColumn("source", F.coalesce("source", F.lit("TOTAL")))


@register("dedup_components", f"""WITH RECURSIVE e AS MATERIALIZED ({EDGES}), l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT a, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON r.a = l.a),
m AS (SELECT a AS node, min(c) AS component FROM r GROUP BY a),
g AS (SELECT component, 'dedup_' || substr(sha256(string_agg(CAST(node AS VARCHAR), '|' ORDER BY CAST(node AS VARCHAR))), 1, 16) AS group_id FROM m GROUP BY component)
SELECT node, m.component, group_id, node <> m.component AS is_duplicate FROM m JOIN g ON m.component = g.component""")
def _(spark, sf):
    from siltstone.operators.graph import component_labels

    edges = vector_join.joining_links(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding", 0.3)
    return matching.group_ids(component_labels(edges))


def wide_news(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "news_wide")
    return rows.withColumns({"operators": F.split("operators", ";"), "rail_lines": F.split("lines", ";")})


def block_oracle() -> str:
    kept = f"""(SELECT * REPLACE (CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END AS confidence, CASE WHEN event_type IN ({TYPES}) THEN event_type ELSE 'other' END AS event_type, CASE WHEN language = 'cz' THEN 'cs' ELSE language END AS language)
  FROM news_wide WHERE is_rail_related AND country IN ('HU', 'AT'))"""
    spread = lambda c, p: f"round(avg({c}), 6) AS {p}_mean, round(stddev_samp({c}), 6) AS {p}_std, min({c}) AS {p}_min, max({c}) AS {p}_max"
    columns = [
        "count(article_id) AS news_article_count", "round(avg(coalesce(sentiment_score, CASE sentiment WHEN 'negative' THEN -1.0 WHEN 'neutral' THEN 0.0 ELSE 1.0 END)), 6) AS news_sentiment_mean",
        "round(avg(CASE WHEN sentiment = 'negative' THEN 1.0 ELSE 0.0 END), 6) AS news_share_negative", "round(coalesce(sum(money), 0), 6) AS news_total_investment_eur",
        *(f"count(*) FILTER (language = '{n}') AS news_language_{n}" for n in vocab.LANGUAGES), spread("confidence", "news_confidence"),
        "count(*) FILTER (confidence <= 0.33) AS news_confidence_bin_low, count(*) FILTER (confidence > 0.33 AND confidence <= 0.67) AS news_confidence_bin_medium, count(*) FILTER (confidence > 0.67) AS news_confidence_bin_high",
        spread("gkg_tone", "news_gkg_tone"), *(f"count(*) FILTER (event_type = '{n}') AS news_n_{n}" for n in vocab.EVENT_TYPES),
        *(f"CAST(sum(len(list_filter(string_split(operators, ';'), lambda o: trim(o) = '{n}'))) AS BIGINT) AS \"news_op_{n}\"" for n in vocab.OPERATORS),
    ]
    each = lambda c: f"list_filter(list_transform(string_split(coalesce({c}, ''), ';'), lambda o: trim(o)), lambda o: o <> '')"
    for c, count, listed in [("lines", "news_n_rail_lines_unique", "news_rail_lines_list"), *((f"gkg_{f}", f"news_n_gkg_{f}_unique", f"news_gkg_{f}_list") for f in vocab.GKG_FIELDS)]:
        every = f"list_sort(list_distinct(flatten(list({each(c)}))))"
        columns += [f"CAST(len({every}) AS BIGINT) AS {count}", f"array_to_string({every}, ',') AS {listed}"]
    lang = f"(SELECT country, year, language, count(*)::DOUBLE AS n FROM {kept} WHERE language IS NOT NULL GROUP BY ALL)"
    main = f"(SELECT country, year, {', '.join(columns)} FROM {kept} GROUP BY ALL)"
    first = f"(SELECT country, year, language AS news_language_primary FROM {lang} QUALIFY row_number() OVER (PARTITION BY country, year ORDER BY n DESC, language) = 1)"
    spread_of_languages = f"(SELECT country, year, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS news_language_entropy FROM {lang} GROUP BY ALL)"
    return f"SELECT * FROM {main} LEFT JOIN {first} USING (country, year) LEFT JOIN {spread_of_languages} USING (country, year)"


@register("news_block", block_oracle())
def _(spark, sf):
    return rounded(news.block(news.relevant(wide_news(spark, sf)), ["country", "year"]))


@register("gold_build", f"SELECT coalesce(s.geo, n.country) AS geo, {LEVEL.replace('geo', 'coalesce(s.geo, n.country)')} AS geo_level, coalesce(s.year, n.year) AS year, s.* EXCLUDE (geo, year), n.* EXCLUDE (country, year) REPLACE ("
    + ", ".join(f'coalesce(n."{c}", 0) AS "{c}"' for c in ["news_article_count", "news_total_investment_eur", *(f"news_language_{x}" for x in vocab.LANGUAGES), *(f"news_confidence_bin_{x}" for x in ("low", "medium", "high")), *(f"news_n_{x}" for x in vocab.EVENT_TYPES), *(f"news_op_{x}" for x in vocab.OPERATORS), "news_n_rail_lines_unique", *(f"news_n_gkg_{f}_unique" for f in vocab.GKG_FIELDS)])
    + ", " + ", ".join(f"coalesce(n.{c}, '') AS {c}" for c in ["news_language_primary", "news_rail_lines_list", *(f"news_gkg_{f}_list" for f in vocab.GKG_FIELDS)])
    + f") FROM {GOLD} s FULL JOIN ({block_oracle()}) n ON s.geo = n.country AND s.year = n.year")
def _(spark, sf):
    return rounded(gold.build(view(spark, sf, "stat_fact"), wide_news(spark, sf), FEATURES))


LABELS = ["Passengers carried", "Transportleistung insgesamt", "Lokomotivbestand insgesamt", "Road network", "Total - electrified railway lines", "rail_investment", "Unknown"]


@register("crosswalk_rules", "SELECT s AS source_column, CASE s WHEN 'Passengers carried' THEN 'rail_passengers' WHEN 'Transportleistung insgesamt' THEN 'rail_freight_tonne_km' WHEN 'Lokomotivbestand insgesamt' THEN 'rail_locomotives' "
    "WHEN 'Total - electrified railway lines' THEN 'rail_electrified_km' WHEN 'rail_investment' THEN s ELSE 'unmapped' END AS feature, count(*) AS n FROM (SELECT CASE l_linenumber WHEN 1 THEN 'Passengers carried' WHEN 2 THEN 'Transportleistung insgesamt' "
    "WHEN 3 THEN 'Lokomotivbestand insgesamt' WHEN 4 THEN 'Road network' WHEN 5 THEN 'Total - electrified railway lines' WHEN 6 THEN 'rail_investment' ELSE 'Unknown' END AS s FROM lineitem) GROUP BY ALL")  # fmt: skip
def _(spark, sf):
    label = F.element_at(F.array(*map(F.lit, LABELS)), F.col("l_linenumber").cast("int"))
    facts = spark.read.parquet(f"{sf}/lineitem.parquet").select(label.alias("source_column"))
    return facts.join(rules.label_crosswalk(facts), "source_column").groupBy("source_column", "feature").agg(F.count("*").alias("n"))
