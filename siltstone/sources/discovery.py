"""Discovery: which datasets and indicators of a catalogue are collected, lists merged in order, and months as pages of a backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How codes and titles of the catalogue are judged.
RAIL_TITLES, RAIL_ONLY, NOT_RAIL = ["rail"], "rail_", ["trailer"]
NO_DATASETS = ["folder", "table"]
TRANSPORT, NO_TRANSPORT = ["rail_", "tran_"], ["tran_sf_mar", "tran_sf_road", "tran_sf_avia"]
THEMES = [
    "tran_", "rail_", "road_", "avia_", "iww_", "mar_", "mare_", "nama_", "nasa_", "gov_", "ei_", "sts_", "prc_", "irt_", "bop_", "demo_", "lfsi_", "lfsa_", "lfst_", "lfsq_", "lfso_", "une_", "earn_", "migr_",
    "ilc_", "hlth_", "educ_", "isoc_", "tour_", "crim_",
]
REGIONAL, REGIONAL_STARTS, SUBANNUAL = ["_r_", "10r", "_reg_"], ["met_", "urt_", "tgs"], ["_m", "_q", "_d"]
SAFE_ID = r"^[A-Za-z0-9_.-]+$"
RAIL_WORD = r"(?i)\brail\w*"
#: Indicators that are collected whatever the catalogue says.
RAIL_INDICATORS = ["IS.RRS.TOTL.KM", "IS.RRS.GOOD.MT.K6", "IS.RRS.PASG.KM"]


def some(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def bare(cell: Column) -> Column:
    """A cell without white space and quotes around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(cell), '^"+|"+$', ""), "^'+|'+$", "")


def datasets(lines: DataFrame) -> DataFrame:
    """(title, code, low): the datasets that a tab-separated catalogue of contents (column value) lists and that can be fetched.

    Lines of fewer than two cells, codes with other characters than letters, digits, `_`, `.` and `-`, aggregated tables (`t_`) and, where there is a column of
    types, folders and tables go.
    """
    cells = F.split(F.regexp_replace("value", r"\r$", ""), "\t")
    rows = lines.select(cells.alias("c")).where("size(c) >= 2").select(F.lower(bare(F.col("c")[0])).alias("title"), bare(F.col("c")[1]).alias("code"), F.lower(bare(F.get("c", F.lit(2)))).alias("type"))
    rows = rows.withColumn("low", F.lower("code"))
    return rows.where(F.col("code").rlike(SAFE_ID) & ~F.col("low").startswith("t_") & ~F.coalesce(F.col("type").isin(NO_DATASETS), F.lit(False))).select("title", "code", "low")


def rail_datasets(lines: DataFrame) -> DataFrame:
    """Distinct codes, in order, of datasets about rail: by their family or by a word of the title."""
    title, low = F.col("title"), F.col("low")
    rail = low.startswith(RAIL_ONLY) | some([title.contains(t) for t in RAIL_TITLES])
    return datasets(lines).where(rail & ~some([title.contains(t) for t in NOT_RAIL])).select("code").distinct().orderBy("code")


def transport_datasets(lines: DataFrame) -> DataFrame:
    """Distinct codes, in order, of the transport theme without its maritime, road and air safety series."""
    low = F.col("low")
    return datasets(lines).where(some([low.startswith(p) for p in TRANSPORT]) & ~some([low.startswith(p) for p in NO_TRANSPORT])).select("code").distinct().orderBy("code")


def national_datasets(lines: DataFrame) -> DataFrame:
    """Distinct codes, in order, of annual series by country over all themes."""
    low = F.col("low")
    left_out = some([low.contains(m) for m in REGIONAL] + [low.startswith(p) for p in REGIONAL_STARTS] + [low.endswith(s) for s in SUBANNUAL])
    return datasets(lines).where(some([low.startswith(p) for p in THEMES]) & ~left_out).select("code").distinct().orderBy("code")


def rail_indicators(catalogue: DataFrame) -> DataFrame:
    """Distinct ids, in order, of indicators (id, name, sourceNote) whose name or note has a word that begins with rail, and those that are always collected."""
    text = F.concat_ws(" ", "name", "sourceNote")
    found = catalogue.where(text.rlike(RAIL_WORD) & F.col("id").rlike(SAFE_ID)).select("id")
    always = catalogue.sparkSession.createDataFrame([(i,) for i in RAIL_INDICATORS], "id string")
    return found.union(always).distinct().orderBy("id")


def first_of_each(lists: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """One row (key, source, order columns) of each key in any of the lists: the first list that has it, there its first row by `order`.

    Sorting by (source, order) gives the union of the lists without repeats. An aggregate that combines before the shuffle; no row of
    any list waits for a place. The lists share the types of key and order. Null keys go.
    """
    place = F.struct("source", *order)
    rows = None
    for k, one in enumerate(lists):
        part = one.where(F.col(key).isNotNull()).select(key, F.lit(k).alias("source"), *order)
        rows = part if rows is None else rows.union(part)
    return rows.groupBy(key).agg(F.min(place).alias("first")).select(key, "first.*")


def month_pages(spans: DataFrame, start: str, end: str) -> DataFrame:
    """spans with one row for each month from `start` up to, not including, `end`: page (from 0), first and last, cut to the span.

    A page's last day is the next page's first one; a span that ends where it starts, or earlier, or has a null end, has no pages.
    """
    lo, hi = F.col(start).cast("date"), F.col(end).cast("date")
    months = F.when(lo < hi, F.sequence(F.trunc(lo, "month"), F.trunc(F.date_sub(hi, 1), "month"), F.expr("INTERVAL 1 MONTH")))
    paged = spans.select("*", F.posexplode(months).alias("page", "month"))
    nxt = F.add_months("month", 1)
    return paged.withColumns({"first": F.greatest(F.col("month"), lo), "last": F.least(nxt, hi)}).drop("month")


def within_reach(pages: DataFrame, spans: list[str], found: str, target: int, most: int | None = None, each: int = 250) -> DataFrame:
    """Pages that a backfill asks for: until earlier pages of the span brought `target` rows, or `most` pages; a page that found nothing counts as `each` rows.

    Pages of a span are months, so its window is short.
    """
    brought = F.when(F.coalesce(F.col(found), F.lit(0)) > 0, F.col(found)).otherwise(each)
    before = F.coalesce(F.sum(brought).over(Window.partitionBy(*spans).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = pages.withColumn("before", before).where(F.col("before") < target).drop("before")
    return reached if most is None else reached.where(F.col("page") < most)
