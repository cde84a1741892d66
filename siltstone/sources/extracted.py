"""Tables and texts extracted from reports: facts by header specs, staged rows by state, text chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["dataset", "table_idx"]
#: Rows that may hold a header: of a wide table for its words, of a compact one for its columns.
WIDE_HEADER, COMPACT_HEADER, WIDE_CELLS = 14, 10, 20
#: Where a wide table names the country.
COUNTRY_CELL = 21
# Columns of the wide table, their labels and units.
WIDE_COLUMNS = [
    (2, "Average staff strength", "thousands"),
    (4, "Length of lines worked at end of year - Total", "kilometres"),
    (6, "Length of lines worked at end of year - electrified lines", "kilometres"),
    (7, "Locomotives including Light Rail Motor-tractors", "count"),
    (10, "Railway's wagons", "count"),
    (13, "Passengers carried", "millions"),
    (15, "Passenger.kilometres", "millions"),
    (17, "Tonnes carried", "millions"),
    (19, "Tonne.kilometres", "millions"),
]
# Words that a compact header has, any of the alternatives for each, in order of precedence; label and unit.
COMPACT_COLUMNS = [
    ([["length of lines worked"], ["total"]], "Length of lines worked at end of year - Total", "kilometres"),
    ([["electrified"], ["line"]], "Length of lines worked at end of year - electrified lines", "kilometres"),
    ([["passenger.kilometres", "passenger kilometres"]], "Passenger.kilometres", "millions"),
    ([["tonne.kilometres", "tonne kilometres"]], "Tonne.kilometres", "millions"),
    ([["passengers carried"]], "Passengers carried", "millions"),
    ([["tonnes carried"]], "Tonnes carried", "millions"),
    ([["average staff"]], "Average staff strength", "thousands"),
]
SPEC = "array<struct<col int, label string, unit string>>"
LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def cleaned(cell: Column) -> Column:
    """A cell with single spaces; null is ''."""
    return F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"[\s\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+", " "))


def report_number(cell: Column) -> Column:
    """The first number of a cleaned cell: spaces group, a comma is the decimal sign and points then group; n/a, marks and text are null."""
    token = F.replace(F.regexp_extract(cell, r"[-+]?\d[\d\s.,]*", 0), F.lit(" "), F.lit(""))
    plain = F.when(F.contains(token, F.lit(",")), F.replace(F.replace(token, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(token)
    return F.when(~F.lower(cell).isin("na", "n/a", "-", "none"), F.nullif(plain, F.lit("")).try_cast("double"))


def company_year(cell: Column) -> Column:
    """The year in brackets, else the first one that stands alone, from 1900 to 2099."""
    found = lambda p: F.nullif(F.regexp_extract(cell, p, 1), F.lit(""))
    return F.coalesce(found(r"\(((?:19|20)\d{2})\)"), found(r"\b((?:19|20)\d{2})\b")).cast("long")


def looked_up(values: dict[str, str], key: Column) -> Column:
    if not values:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)).cast("map<string,string>"), key)


def row_specs(lower: Column) -> Column:
    """The columns that a compact header row names."""

    def spec(cell: Column, at: Column) -> Column:
        out = F.lit(None).cast("struct<label string, unit string>")
        for words, label, unit in reversed(COMPACT_COLUMNS):
            has = F.lit(True)
            for either in words:
                one = F.lit(False)
                for word in either:
                    one = one | F.contains(cell, F.lit(word))
                has = has & one
            out = F.when(has, F.struct(F.lit(label).alias("label"), F.lit(unit).alias("unit"))).otherwise(out)
        return F.when(out.isNotNull(), F.struct(at.cast("int").alias("col"), out.getField("label").alias("label"), out.getField("unit").alias("unit")))

    return F.filter(F.transform(lower, spec), lambda s: s.isNotNull()).cast(SPEC)


def laid_out(tables: DataFrame, codes: dict[str, str], names: dict[str, str]) -> DataFrame:
    """tables (dataset, table_idx, row_idx, cells) with cleaned cells, the table's specs and first data row, the row's own code and geo.

    specs is null where no header is known. One aggregate over the rows gives each table's layout, which joins back.
    """
    rows = tables.select(*KEYS, "row_idx", F.coalesce(F.transform("cells", cleaned), F.array().cast("array<string>")).alias("cells"))
    code = F.coalesce(F.get("cells", F.lit(0)), F.lit(""))
    by_code = F.when((code != "") & (code == F.upper(code)), looked_up(codes, code))
    country = F.lower(F.coalesce(F.get("cells", F.lit(COUNTRY_CELL)), F.lit("")))
    rows = rows.withColumns({"code": code, "own": F.coalesce(by_code, looked_up(names, country)), "lower": F.transform("cells", F.lower)})
    rows = rows.withColumn("text", F.array_join("lower", " "))
    has = lambda text, *words: F.forall(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w))
    named = (F.col("row_idx") < COMPACT_HEADER) & has(F.col("text"), "country code", "railway company")
    rows = rows.withColumn("found", F.when(named, row_specs(F.col("lower"))))
    header = F.size("found") > 0
    heads = rows.groupBy(*KEYS).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("row_idx") < WIDE_HEADER, F.struct("row_idx", "text")))), lambda r: r.text), " ").alias("head"),
        F.max(F.size("cells")).alias("widest"),
        F.coalesce(F.min(F.when(F.col("own").isNotNull(), F.col("row_idx"))), F.lit(0)).alias("first"),
        F.min_by(F.when(header, F.struct("row_idx", "found")), F.when(header, F.col("row_idx"))).alias("compact"),
    )
    wide = (F.col("widest") >= WIDE_CELLS) & has(F.col("head"), "country code", "railway company", "revenue rail traffic")
    fixed = F.array(*(F.struct(F.lit(c).alias("col"), F.lit(a).alias("label"), F.lit(u).alias("unit")) for c, a, u in WIDE_COLUMNS)).cast(SPEC)
    specs, start = F.when(wide, fixed).otherwise(F.col("compact.found")), F.when(wide, F.col("first")).otherwise(F.col("compact.row_idx") + 1)
    return rows.drop("lower", "text", "found").join(heads.select(*KEYS, specs.alias("specs"), start.alias("start")), KEYS)


def carried(kept: Column) -> Column:
    """The geo of the last row with a code among the kept data rows, which may be none."""
    order = Window.partitionBy(*KEYS).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(kept & (F.col("row_idx") >= F.col("start")) & (F.col("code") != ""), F.struct("own")), ignorenulls=True).over(order).getField("own")


def report_facts(tables: DataFrame, codes: dict[str, str], names: dict[str, str]) -> DataFrame:
    """Facts of extracted tables (dataset, table_idx, row_idx from 0, cells): one for each row and column of its header with a geo, a year and a number.

    `codes` gives geos by upper-case code, `names` by lower-case country. A blank code takes the last row's geo, an unknown one resets it; rows of
    fewer than two cells are passed over. Tables without a known header, null and empty rows give nothing.
    """
    rows = laid_out(tables, codes, names).where("specs is not null")
    rows = rows.withColumns({"geo": carried(F.size("cells") >= 2), "year": company_year(F.get("cells", F.lit(1)))})
    rows = rows.where("row_idx >= start and size(cells) >= 2 and geo is not null and year is not null")
    each = rows.select("geo", "year", "dataset", "cells", F.explode("specs").alias("s"))
    facts = each.select("geo", "year", report_number(F.get("cells", F.col("s.col"))).alias("value"), F.col("s.unit").alias("unit"), F.col("dataset").alias("source_dataset"), F.col("s.label").alias("source_column"), F.lit("uic").alias("source_system"))
    return facts.where("value is not null")


def staged(rows: DataFrame, created_at: str | None) -> DataFrame:
    at = F.lit(created_at) if created_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    table_id = F.concat_ws("_", "dataset", F.col("table_idx").cast("string"), "row_type")
    return rows.select(
        F.lit("uic_staging").alias("table_name"), F.col("dataset").alias("dataset_id"), table_id.alias("table_id"), F.col("table_idx").cast("long").alias("table_idx"), "row_type", F.col("row_idx").cast("long").alias("row_idx"),
        "parse_status", "geo", "year", F.col("dataset").alias("source_dataset"), F.lit("uic").alias("source_system"), "raw_geo_cell", "raw_year_cell", "raw_value_cells", "text_chunk", at.alias("created_at"),
    )


def staged_rows(tables: DataFrame, codes: dict[str, str], names: dict[str, str], created_at: str | None = None) -> DataFrame:
    """Every row of extracted tables with its state: table_mismatch (no known header), geo_unmapped, year_missing, value_unparseable or success; header rows
    are a success without geo and year. A null or empty row has empty cells."""
    rows = laid_out(tables, codes, names)
    known, data = F.col("specs").isNotNull(), F.col("row_idx") >= F.col("start")
    rows = rows.withColumn("carried", carried(F.lit(True))).withColumn("raw_year_cell", F.coalesce(F.get("cells", F.lit(1)), F.lit("")))
    within = F.filter("specs", lambda s: s.getField("col") < F.size("cells"))
    rows = rows.withColumn("raw_value_cells", F.when(known, F.transform(within, lambda s: F.get("cells", s.getField("col")))).otherwise(F.col("cells")))
    rows = rows.withColumns({"geo": F.when(known & data, F.col("carried")), "year": F.when(known & data, company_year(F.col("raw_year_cell")))})
    some = F.exists("raw_value_cells", lambda c: report_number(c).isNotNull())
    state = F.when(~known, "table_mismatch").when(~data, "success").when(F.col("geo").isNull(), "geo_unmapped").when(F.col("year").isNull(), "year_missing").when(~some, "value_unparseable").otherwise("success")
    kind = F.when(F.when(known, ~data).otherwise(F.col("row_idx") == 0), "header").otherwise("data_row")
    return staged(rows.withColumns({"parse_status": state, "row_type": kind, "raw_geo_cell": F.col("code"), "text_chunk": F.lit("")}), created_at)


def staged_texts(texts: DataFrame, created_at: str | None = None) -> DataFrame:
    """The lines of extracted texts (dataset, text) that aren't blank, numbered from 0, as staged rows of state text_only; a null text has none."""
    lines = F.filter(F.transform(F.split("text", LINE_ENDS), cleaned), lambda c: c != "")
    rows = texts.select("dataset", F.posexplode(lines).alias("row_idx", "text_chunk"))
    none = {"table_idx": F.lit(-1), "row_type": F.lit("text_chunk"), "parse_status": F.lit("text_only"), "geo": F.lit(None).cast("string"), "year": F.lit(None).cast("long")}
    return staged(rows.withColumns({**none, "raw_geo_cell": F.lit(""), "raw_year_cell": F.lit(""), "raw_value_cells": F.array().cast("array<string>")}), created_at)


def landed_reports(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables, texts) of landed files (dataset, content): each a JSON object with the text and the tables of a report; other content is left out."""
    read = files.select("dataset", F.from_json(F.col("content").cast("string"), "text string, tables array<array<array<string>>>").alias("r"))
    each = read.select("dataset", F.posexplode("r.tables").alias("table_idx", "rows"))
    return each.select("dataset", "table_idx", F.posexplode("rows").alias("row_idx", "cells")), read.select("dataset", F.col("r.text").alias("text")).where("text is not null")
