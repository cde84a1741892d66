"""Layouts of sheets, by value."""

import zipfile

import pytest

from siltstone.sources import readers, sheets

CELLS = "file string, sheet string, row long, col long, value string, numeric boolean, position long"


def cells(spark, rows, file="f", position=0):
    found = [(file, f"s{position}", r, c, str(v), not isinstance(v, str), position) for r, line in enumerate(rows) for c, v in enumerate(line) if v is not None]
    return spark.createDataFrame(found, CELLS)


def facts(spark, rows, system, **kw):
    return {(r.source_column, r.year, r.value, r.unit, r.geo) for r in sheets.sheet_facts(cells(spark, rows, **kw), "d", system).collect()}


def test_period_and_year(spark):
    rows = [["24.1. Transport of goods [thousand tonnes]"], ["Period, year", "Rail", "Road", "Note"], [2020, 5.5, "1 000"], ["2021.0", "6", None, "x"], ["total", 9, 9], ["2022 I.", 1, 1], [2023, "..", 8]]
    assert facts(spark, rows, "ksh") == {("Rail", 2020, 5.5, "thousand tonnes", "HU"), ("Rail", 2021, 6.0, "thousand tonnes", "HU"), ("Road", 2023, 8.0, "thousand tonnes", "HU")}
    assert facts(spark, [["Year"], [2020], [2021]], "ksh") == set()  # no column beside the year's, and no label before it


def test_regional(spark):
    rows = [["Lines"], ["Territorial unit denomination", "Level", 2019, 2020], ["Length of lines, km"], ["Budapest", "capital", 1, 2], ["Country, total", "country", 70.5, "71"], ["Country, total", "again", 0, 0]]
    assert facts(spark, rows, "ksh") == {("Length of lines, km", 2019, 70.5, "ksh_native", "HU"), ("Length of lines, km", 2020, 71.0, "ksh_native", "HU")}
    assert facts(spark, rows[:4], "ksh") == set()


def test_years_in_a_row(spark):
    rows = [["T [km]"], [None, "Code", "Indicator", "Unit", 2019, "2020.0", 1899], [None, None, "Freight"], [None, "a", "Tonnes", "t", 5, 6, 7], [None, None, "Wagons", None, " 8 ", "-"], [None, None, "Passengers"], [None, None, None, None, 3, 3]]
    assert facts(spark, rows, "ksh") == {("Freight - Tonnes", 2019, 5.0, "t", "HU"), ("Freight - Tonnes", 2020, 6.0, "t", "HU"), ("Freight - Wagons", 2019, 8.0, "km", "HU")}
    assert facts(spark, [["x"]] * 40 + [["Label", 2020], ["a", 1]], "ksh") == set()  # headers are looked for in 40 rows
    assert facts(spark, rows, "ksh", position=1) == set()  # only a file's first sheet is read


def test_report_years(spark):
    title = "Schienengüterverkehr nach Verkehrsbereich"
    rows = [[title], ["Einheit", "Verkehrsbereich"], [None, "Inlandverkehr", "Transit", "Insgesamt"], ["Berichtsjahr 2025"], ["Tonnen", 28480747, 29984563, "96.161.650"], ["1 000 tkm Inland", 4459575, 8421301, 21535754]]
    rows += [["Berichtsjahr 20241"], ["Tonnen", 27512786, 29201352, "94 417 959,5"], ["Q: Statistik Austria", None, None, 7], ["Nutzlast", 1, 1, ".."]]
    label = lambda context, metric: f"{title} - {context} - {metric} - Insgesamt"
    assert facts(spark, rows, "statistik_austria") == {
        (label("Transportaufkommen", "Tonnen"), 2025, 96161650.0, "Tonnen", "AT"), (label("Transportleistung", "1 000 tkm Inland"), 2025, 21535754.0, "1 000 tkm Inland", "AT"),
        (label("Transportaufkommen", "Tonnen"), 2024, 94417959.5, "Tonnen", "AT"),
    }


def test_stacked_tables(spark):
    title = "Lokomotivbestände zum Stichtag 31. Dezember 2023 und 2024"
    rows = [[title], ["Lokomotiven"], ["Antriebsart", 2023, 2024], ["Diesel", 325, 328.5], ["Insgesamt", 1193, "1.275"], ["Spurweite", 2023, 2024], ["Regelspur", 1.157, "-"], ["Wagen -"], ["Nutzlast in t", "1,5", None], ["Q: x", 1, 1], ["Nie", 5, 5]]
    head = f"{title} - Lokomotiven - Antriebsart"
    assert facts(spark, rows, "statistik_austria") == {
        (f"{head} - Diesel", 2023, 325.0, "count", "AT"), (f"{head} - Diesel", 2024, 328.5, "count", "AT"), (f"{head} - Insgesamt", 2023, 1193.0, "count", "AT"), (f"{head} - Insgesamt", 2024, 1275.0, "count", "AT"),
        (f"{title} - Spurweite - Regelspur", 2023, 1.157, "count", "AT"), (f"{title} - Wagen - Spurweite - Nutzlast in t", 2023, 1.5, "Tonnen", "AT"),
    }


def test_many_files_at_once(spark):
    one, two = ([["T [km]"], ["Label", 2020], ["a", k]] for k in (1, 2))
    both = cells(spark, one, "/r/stats/ksh/d1/ingest_date=1/a.xlsx").union(cells(spark, two, "/r/stats/ksh/d2/ingest_date=1/a.xlsx"))
    from pyspark.sql import functions as F

    got = sheets.sheet_facts(both, F.regexp_extract("file", "/([^/]+)/ingest_date=", 1), "ksh").collect()
    assert {(r.source_dataset, r.value) for r in got} == {("d1", 1.0), ("d2", 2.0)}
    assert sheets.sheet_facts(both.limit(0), "d", "ksh").collect() == [] and sheets.sheet_facts(both.limit(0), "d", "statistik_austria").collect() == []


@pytest.mark.parametrize("told", [True, False])
def test_order_of_sheets(spark, tmp_path, told):
    sheet = lambda v: f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1"><v>{v}</v></c><c r="B1" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        for k in (2, 10, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", sheet(k))
        if told:
            z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="rel"><sheets><sheet name="B" r:id="r2"/><sheet name="A" r:id="r1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet10.xml"/></Relationships>')
    got = sorted((r.position, r.value, r.numeric) for r in readers.read_grid(spark, str(tmp_path / "a.xlsx")).collect() if r.col == 0)
    assert got == [(k, v, True) for k, v in enumerate(["10", "1", "2"] if told else ["1", "2", "10"])]
