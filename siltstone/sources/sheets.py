"""Facts from cells of spreadsheets: the layout of each sheet is told from its own cells, whatever sheets a table of cells holds.

Cells are (file, sheet, row, col, value), from read_grid or alike, with `numeric` (a number cell, not text) and `position` (of the sheet
in its file) where known. Headers, labels, units and sections are small tables by sheet; every value cell meets the nearest header above
it, its row's label and its column's year by joins, so a million sheets are read like one. Only a file's first sheet is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.gold import carried_forward

KEY = ["file", "sheet"]
#: Rows in which titles, headers and a total column are looked for, and the words that mark them.
TITLE_ROWS, HEADER_ROWS, TOTAL_ROWS = 5, 40, 10
UNIT_HEADS = ["unit", "units"]
REGION_HEAD, COUNTRY_ROW = "territorial unit denomination", "country, total"
REPORT_YEAR, TOTAL, SOURCE_NOTE, UNIT_NOTE = "berichtsjahr", "insgesamt", "q:", "einheit"
OFFICE_GEO = {"ksh": "HU", "statistik_austria": "AT"}
NATIVE_UNIT, DEFAULT_TITLE = "ksh_native", "Statistik Austria rail statistics"


def stripped(raw: Column) -> Column:
    return F.regexp_replace(raw, r"^[\s  ]+|[\s  ]+$", "")


def year_cell(text: Column) -> Column:
    """A year from 1900 to 2100, with or without .0."""
    bare = F.regexp_replace(text, r"\.0$", "")
    return F.when(bare.rlike(r"^\d{4}$") & bare.try_cast("long").between(1900, 2100), bare.try_cast("long"))


def plain_number(text: Column) -> Column:
    return F.when(text.rlike(r"[0-9.]$"), text.try_cast("double"))


def austrian_number(text: Column, numeric: Column) -> Column:
    """Number cells as they are; texts with decimal comma or points that group thousands; '-', '.' and '..' give null."""
    tight = F.regexp_replace(text, r"[   ]", "")
    comma = F.replace(F.replace(tight, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    grouped = F.replace(tight, F.lit("."), F.lit(""))
    read = F.when(tight.contains(","), comma).when(tight.rlike(r"^[-+]?\d{1,3}(\.\d{3})+$"), grouped).otherwise(tight)
    return F.when(numeric, plain_number(text)).otherwise(plain_number(read))


def prepared(cells: DataFrame) -> DataFrame:
    """(file, sheet, row, col, text, low, numeric, year) of the first sheets' cells that aren't blank."""
    cells = cells.where("position = 0") if "position" in cells.columns else cells
    numeric = F.coalesce("numeric", F.lit(False)) if "numeric" in cells.columns else F.lit(False)
    text = cells.select(*KEY, "row", "col", stripped(F.col("value")).alias("text"), numeric.alias("numeric")).where("text <> ''")
    return text.select("*", F.lower("text").alias("low"), year_cell(F.col("text")).alias("year"))


def _first(cells: DataFrame, name: str, *found: str) -> DataFrame:
    """The cell of each sheet that stands first by row and column: its `found` as `name` or as they are."""
    first = cells.groupBy(*KEY).agg(F.min_by(F.struct(*found), F.struct("row", "col")).alias("at"))
    return first.select(*KEY, *(F.col(f"at.{c}").alias(name if len(found) == 1 else c) for c in found))


def _year_tables(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """One row for each cell under a year: (KEY, header, row, y, text, numeric, label, header_label, section, unit).

    headers: (KEY, header, until) rows of years, each with the row where its table ends. The label column is that with most texts below among those before the
    first year, the first of equal ones; unit columns don't count. A label whose row has no value is the section of those below.
    """
    years = cells.join(headers, KEY).where("row = header AND year IS NOT NULL").select(*KEY, "header", "col", F.col("year").alias("y"))
    firsts = years.groupBy(*KEY, "header").agg(F.min("col").alias("first_year"))
    tables = headers.join(firsts, [*KEY, "header"])
    before = cells.join(tables, KEY).where("col < first_year")
    heads = before.where("row = header").select(*KEY, "header", "col", F.col("text").alias("head"), F.col("low").isin(UNIT_HEADS).alias("is_unit"))
    body = before.where("row > header").join(heads, [*KEY, "header", "col"], "left")
    picked = body.where("NOT coalesce(is_unit, false)").groupBy(*KEY, "header", "col", "head").agg(F.count("*").alias("n"))
    label_col = picked.groupBy(*KEY, "header").agg(F.max_by(F.struct("col", "head"), F.struct("n", -F.col("col"))).alias("at")).select(*KEY, "header", F.col("at.col").alias("col"), F.col("at.head").alias("header_label"))
    unit_col = heads.where("is_unit").groupBy(*KEY, "header").agg(F.min("col").alias("col"))
    inside = body.where("row < until")
    units = inside.join(unit_col, [*KEY, "header", "col"]).select(*KEY, "header", "row", F.col("text").alias("unit"))
    values = cells.join(years, [*KEY, "col"]).join(headers, [*KEY, "header"]).where("row > header AND row < until").select(*KEY, "header", "row", "y", "text", "numeric")
    filled = values.select(*KEY, "header", "row").distinct().withColumn("filled", F.lit(True))
    labels = inside.join(label_col, [*KEY, "header", "col"]).select(*KEY, "header", "row", F.col("text").alias("label"), "header_label").join(filled, [*KEY, "header", "row"], "left")
    labels = labels.withColumns({"code": F.when(F.col("filled").isNull(), F.col("label")), "own": F.col("label")})
    labels = carried_forward(labels, [*KEY, "header"], ["row"], "code", "own", "section").drop("code", "own", "filled")
    return values.join(labels, [*KEY, "header", "row"]).join(units, [*KEY, "header", "row"], "left")


def hungarian(cells: DataFrame) -> DataFrame:
    """(file, label, year, value, unit) of sheets by period and year, of regional sheets (the country's total only) and of sheets under a row of years.

    The unit is the row's own, or else that in brackets in the title.
    """
    cells = prepared(cells)
    titles = cells.where(F.col("row") < TITLE_ROWS).groupBy(*KEY, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]), " ").alias("line"))
    titles = titles.select(*KEY, "row", F.trim(F.regexp_extract("line", r"\[([^\]]+)\]", 1)).alias("title_unit"), F.col("line").rlike(r"\[([^\]]+)\]").alias("has")).where("has")
    titles = titles.groupBy(*KEY).agg(F.min_by("title_unit", "row").alias("title_unit"))
    full = cells.groupBy(*KEY, "row").agg(F.count("*").alias("n")).where("n > 1").select(*KEY, "row")
    marks = cells.where((F.col("row") < HEADER_ROWS) & ((F.col("low").contains("period") & F.col("low").contains("year")) | (F.col("low") == "year"))).join(full, [*KEY, "row"])
    periods = _first(marks, "", "row", "col").select(*KEY, F.col("row").alias("header"), F.col("col").alias("year_col"))
    heads = cells.join(periods, KEY).where("row = header AND col <> year_col").select(*KEY, "col", F.col("text").alias("label"))
    rows = cells.join(periods, KEY).where("row > header AND col = year_col AND year IS NOT NULL").select(*KEY, "row", "year")
    by_period = cells.drop("year").join(heads, [*KEY, "col"]).join(rows, [*KEY, "row"]).select(*KEY, "label", "year", "text", F.lit(None).cast("string").alias("unit"))

    others = cells.where((F.col("row") < HEADER_ROWS) & F.col("year").isNotNull()).join(periods, KEY, "left_anti").groupBy(*KEY).agg(F.min("row").alias("header"))
    regional = cells.join(others, KEY).where((F.col("row") == F.col("header")) & (F.col("low") == REGION_HEAD)).select(*KEY, "header").distinct()
    below = cells.where("col = 0").join(regional, KEY).where("row > header")
    named, total = _first(below, "label", "text"), _first(below.where(F.col("low") == COUNTRY_ROW), "row", "row")
    years = cells.join(regional, KEY).where("row = header AND year IS NOT NULL").select(*KEY, "col", F.col("year").alias("y"))
    by_region = cells.join(total, [*KEY, "row"]).join(years, [*KEY, "col"]).join(named, KEY).select(*KEY, "label", F.col("y").alias("year"), "text", F.lit(None).cast("string").alias("unit"))

    plain = _year_tables(cells, others.join(regional, KEY, "left_anti").withColumn("until", F.lit(2**62)))
    by_year = plain.select(*KEY, F.concat_ws(" - ", "section", "label").alias("label"), F.col("y").alias("year"), "text", "unit")
    out = by_period.unionByName(by_region).unionByName(by_year).join(titles, KEY, "left")
    return out.select("file", "label", "year", plain_number(F.col("text")).alias("value"), F.coalesce("unit", "title_unit", F.lit(NATIVE_UNIT)).alias("unit"))


def austrian(cells: DataFrame) -> DataFrame:
    """(file, label, year, value, unit) of sheets in blocks of a report year, and of tables under rows of years, several in one sheet among them.

    A label is made of the sheet's title, the section before and inside a table, the head of its labels and the row's own, repeats in a row left out.
    """
    cells = prepared(cells)
    number = austrian_number(F.col("text"), F.col("numeric"))
    col0 = cells.where("col = 0")
    title = _first(col0.where((F.col("row") < TITLE_ROWS) & ~F.startswith("low", F.lit(UNIT_NOTE)) & ~F.startswith("low", F.lit(SOURCE_NOTE))), "title", "text")
    sheets = cells.select(*KEY).distinct().join(title, KEY, "left").select(*KEY, F.coalesce("title", F.lit(DEFAULT_TITLE)).alias("title"))

    total = _first(cells.where((F.col("row") < TOTAL_ROWS) & (F.col("low") == TOTAL)), "total_col", "col")
    report = F.when(F.startswith("low", F.lit(REPORT_YEAR)), F.nullif(F.regexp_extract("text", r"((?:19|20)\d{2})", 1), F.lit("")))
    lines = carried_forward(col0.join(total, KEY).withColumn("code", report).withColumn("own", F.col("code").cast("long")), KEY, ["row"], "code", "own", "report_year")
    lines = lines.where(F.col("code").isNull() & F.col("report_year").isNotNull() & ~F.startswith("low", F.lit(SOURCE_NOTE))).select(*KEY, "row", "report_year", "total_col", F.col("text").alias("metric"), F.col("low").alias("metric_low"))
    tkm = F.col("metric_low").contains("tkm") | F.col("metric_low").contains("tonnenkilometer")
    context = F.when(tkm, "Transportleistung").when(F.col("metric_low").contains("tonnen"), "Transportaufkommen").otherwise(F.col("metric"))
    totals = cells.join(lines, [*KEY, "row"]).where("col = total_col").join(sheets, KEY)
    by_report = totals.select("file", F.concat_ws(" - ", "title", context, "metric", F.lit("Insgesamt")).alias("label"), F.col("report_year").alias("year"), number.alias("value"), F.col("metric").alias("unit"))

    headers = cells.where((F.col("row") < HEADER_ROWS) & F.col("year").isNotNull()).groupBy(*KEY, "row").agg(F.count("*").alias("n")).where("n >= 2")
    ends = F.coalesce(F.lead("row").over(Window.partitionBy(*KEY).orderBy("row")), F.lit(2**62))
    headers = headers.select(*KEY, F.col("row").alias("header"), ends.alias("until"))
    notes = col_notes(cells, headers)
    cut = headers.join(notes, [*KEY, "header"], "left").select(*KEY, "header", F.least("until", F.coalesce("note", F.lit(2**62))).alias("until"))
    alone = cells.groupBy(*KEY, "row").agg(F.count("*").alias("n"), F.first("text").alias("before"), F.first("low").alias("low")).where(f"n = 1 AND NOT startswith(low, '{SOURCE_NOTE}')")
    before = headers.join(alone.withColumn("header", F.col("row") + 1), [*KEY, "header"]).select(*KEY, "header", "before")
    found = _year_tables(cells, cut).join(before, [*KEY, "header"], "left").join(sheets, KEY)
    bare = F.filter(F.transform(F.array(*(F.coalesce(c, F.lit("")) for c in ("title", "before", "section", "header_label", "label"))), lambda p: F.regexp_replace(p, r"^[ -]+|[ -]+$", "")), lambda p: p != "")
    label = F.array_join(F.filter(bare, lambda p, k: (k == 0) | (p != F.get(bare, k - 1))), " - ")
    low = F.lower(label)
    unit = F.when(low.contains("tkm") | low.contains("tonnenkilometer"), F.when(low.contains("1 000"), "1 000 tkm Inland").otherwise("tonne-km")).when(low.contains("tonnen") | low.contains("nutzlast"), "Tonnen").otherwise("count")
    by_year = found.select("file", label.alias("label"), F.col("y").alias("year"), number.alias("value"), unit.alias("unit"))
    return by_report.unionByName(by_year)


def col_notes(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(KEY, header, note): the first row of each table that is a source note; the table ends there."""
    years = cells.join(headers, KEY).where("row = header AND year IS NOT NULL").groupBy(*KEY, "header", "until").agg(F.min("col").alias("first_year"))
    notes = cells.where(F.startswith("low", F.lit(SOURCE_NOTE))).join(years, KEY).where("row > header AND row < until AND col < first_year")
    return notes.groupBy(*KEY, "header").agg(F.min("row").alias("note"))


def sheet_facts(cells: DataFrame, dataset: str | Column, system: str, geo: str | None = None) -> DataFrame:
    """Long facts of an office's sheets (`ksh` or `statistik_austria`); sheets of another layout and cells that aren't numbers give nothing.

    `dataset` may be a column of `file`, for files of many datasets at once.
    """
    found = (austrian if system == "statistik_austria" else hungarian)(cells).where("value IS NOT NULL AND NOT isnan(value)")
    name = F.lit(dataset) if isinstance(dataset, str) else dataset
    return found.select(F.lit(geo or OFFICE_GEO.get(system)).cast("string").alias("geo"), "year", "value", "unit", name.alias("source_dataset"), F.col("label").alias("source_column"), F.lit(system).alias("source_system"))
