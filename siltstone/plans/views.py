"""Domain views over the driver's tables, in SQL that Spark and DuckDB both read, so that an oracle starts from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def geo(key: str) -> str:
    return f"CASE WHEN {key} = 0 THEN 'HU' WHEN {key} = 1 THEN 'AT' ELSE concat(chr(CAST(65 + {key} AS INT)), chr(CAST(65 + {key} AS INT))) END"


def pick(key: str, names: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {key} = {k} THEN '{n}'" for k, n in enumerate(names[:-1])) + f" ELSE '{names[-1]}' END"


EVENTS = ["investment", "accident", "strike", "service_change", "policy", "line_opening", "line_closure", "delay", "financial", "unheard_of"]

VIEWS = {
    "stat_fact": f"""
SELECT {geo("c_nationkey")} AS geo, CAST(year(o_orderdate) AS BIGINT) AS year, 'order_value' AS feature,
  CASE WHEN c_nationkey % 7 = 1 AND year(o_orderdate) = 1997 THEN NULL ELSE CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) END AS value,
  'EUR' AS unit, 'eurostat' AS source_system, 'orders' AS source_dataset, 'Order value' AS source_column
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 5 <> 0 GROUP BY c_nationkey, year(o_orderdate)
UNION ALL
SELECT {geo("s_nationkey")}, CAST(year(l_shipdate) AS BIGINT), 'order_value', CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 'USD', 'worldbank', 'lineitem', 'Price'
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, year(l_shipdate)
UNION ALL
SELECT {geo("s_nationkey")}, CAST(year(l_shipdate) AS BIGINT), 'ship_qty', CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 'NR', 'uic', 'lineitem', 'Quantity'
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, year(l_shipdate)
UNION ALL
SELECT {geo("s_nationkey")}, CAST(year(l_shipdate) AS BIGINT), 'ship_lines', CAST(count(*) AS DOUBLE), 'NR', 'other_source', 'lineitem', 'Lines'
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey % 3 <> 2 GROUP BY s_nationkey, year(l_shipdate)""",
    "region_fact": f"""
SELECT concat({geo("c_nationkey")}, '1', substr(c_mktsegment, 1, 1)) AS geo, CAST(year(o_orderdate) AS BIGINT) AS year,
  CAST(count(*) AS DOUBLE) AS network, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) AS electrified
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, substr(c_mktsegment, 1, 1), year(o_orderdate)""",
    "news": f"""
SELECT CAST(event_id AS STRING) AS article_id, CASE user_id % 3 WHEN 0 THEN 'HU' WHEN 1 THEN 'AT' ELSE 'other' END AS country,
  2020 + event_id % 4 AS year, 1 + event_id % 12 AS month, event_id % 7 <> 0 AS is_rail_related, {pick("event_id % 10", EVENTS)} AS event_type,
  CASE WHEN value < 30 THEN 'negative' WHEN value < 60 THEN 'neutral' ELSE 'positive' END AS sentiment,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 21 - 10 AS DOUBLE) / 10 END AS sentiment_score,
  CAST(event_id % 111 AS DOUBLE) / 100 AS confidence, {pick("user_id % 7", ["hu", "de", "en", "fr", "cz", "cs", "nl"])} AS language,
  CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 1000 AS DOUBLE) END AS money, {pick("event_id % 5", ["MÁV;ÖBB", "GYSEV; ", "ÖBB;MÁV;MÁV", "", "Westbahn"])} AS operators,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 13 - 6 AS DOUBLE) END AS tone
FROM events""",
    "article": """
SELECT CAST(page_id AS STRING) AS article_id, CASE WHEN page_id % 3 = 0 THEN concat(' ', url, '/') ELSE url END AS url FROM pages""",
    "record": """
SELECT page_id * 2 AS ordinal, concat('gkg-', CAST(page_id AS STRING)) AS record_id, concat(upper(url), ';', 'http://x.example/', CAST(page_id % 5 AS STRING)) AS urls FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id * 2 + 1, CAST(page_id AS STRING), concat('http://y.example/', CAST(page_id % 4 AS STRING)) FROM pages WHERE page_id % 5 = 0""",
    "eval_pair": """
SELECT l.doc_id AS id, l.quality AS gold, CASE WHEN d.n_chars < 600 OR d.lang = 'fr' THEN 0 ELSE 1 END AS pred, CAST(l.doc_id % 101 AS DOUBLE) / 100 AS confidence
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "eval_multi": """
SELECT doc_id AS id, lang AS gold, CASE WHEN doc_id % 9 = 0 THEN 'en' WHEN doc_id % 11 = 0 THEN 'it' ELSE lang END AS pred FROM documents""",
}
VIEWS["news_wide"] = f"""
SELECT *, CASE WHEN month % 4 = 0 THEN '' ELSE concat('line ', CAST(month % 3 AS STRING), '; line 7') END AS lines, tone AS gkg_tone,
  CASE WHEN month = 5 THEN NULL ELSE concat('RAIL;T', CAST(month AS STRING), ';RAIL') END AS gkg_themes, concat('P', CAST(year AS STRING), '; ') AS gkg_persons, operators AS gkg_organizations,
  concat('1#', country) AS gkg_locations, CASE WHEN month > 3 THEN '' ELSE 'c1,2' END AS gkg_emotions
FROM ({VIEWS["news"]})"""


def duck(sql: str) -> str:
    """The oracle's query with the views it names in front."""
    used = [v for v in VIEWS if v in sql]
    return "WITH " + ", ".join(f"{v} AS ({VIEWS[v].replace('AS STRING', 'AS VARCHAR')})" for v in used) + " " + sql if used else sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view; tables are read where they are named, without names in the session's catalogue."""
    sql = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in sql or f"JOIN {t}" in sql}
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **used)
