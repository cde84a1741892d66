"""Facts, staged rows and text chunks of extracted reports."""

import json

import pytest

from siltstone.sources import extracted as X
from siltstone.sources.readers import bronze
from siltstone.sources.tree import stats_from_tree

CODES, NAMES = {"AT": "AT", "HU": "HU", "CZE": "CZ", "SK": "SK", "IT": "IT"}, {"austria": "AT"}
HEAD = ["Country Code", "Railway company", "Length of lines\nworked at end of year Total", "Passenger.kilometres", "Tonne.kilometres"]


def frame(spark, *tables):
    rows = [("d", t, k, r) for t, table in enumerate(tables) for k, r in enumerate(table)]
    return spark.createDataFrame(rows, "dataset string, table_idx int, row_idx int, cells array<string>")


def facts(spark, *tables):
    return sorted((r.geo, r.year, r.source_column, r.value, r.unit) for r in X.report_facts(frame(spark, *tables), CODES, NAMES).collect())


def test_compact_tables(spark):
    km, pkm, tkm = "Length of lines worked at end of year - Total", "Passenger.kilometres", "Tonne.kilometres"
    table = [HEAD, ["HU", "MAV (2024)", "6 876", "11 298", ""], ["AT", "OBB 1999 (2024)", "5 018", "n/a", "19.635,5"], ["", "OBB 2023", "1.5", None, "-"], ["XX", "X (2024)", "1", "2", "3"], ["", "X (2024)", "1"], ["at", "Narrative (2024)", "10"], ["IT"], ["", "FS (2024)", "7"], None, []]
    expected = [("HU", 2024, km, 6876.0, "kilometres"), ("HU", 2024, pkm, 11298.0, "millions"), ("AT", 2024, km, 5018.0, "kilometres"), ("AT", 2024, tkm, 19635.5, "millions"), ("AT", 2023, km, 1.5, "kilometres")]
    assert facts(spark, table, [["a", "b"], ["HU", "MAV (2024)"]]) == sorted(expected)  # the one-cell row gives no geo to the next
    assert facts(spark) == []


def test_wide_tables(spark):
    head = ["Country\nCode", "Railway\ncompany", *[None] * 11, "Revenue rail traffic (3)", *[None] * 7, "Country", *[None] * 3]
    row = lambda code, company, country, **v: [code, company, *(v.get(f"c{k}") for k in range(2, 21)), country]
    table = [head, [None] * 25, row("AT", "OBB (2021)", "Austria", c2="41,1", c4="4 876", c3="9", c19="12"), row("Osterreich", "X 2020", "AUSTRIA", c13="5"), row("?", "Y 2020", "Nowhere", c13="5")]
    got = facts(spark, table)
    assert [(g, y, c, v) for g, y, c, v, _ in got] == [("AT", 2020, "Passengers carried", 5.0), ("AT", 2021, "Average staff strength", 41.1), ("AT", 2021, "Length of lines worked at end of year - Total", 4876.0), ("AT", 2021, "Tonne.kilometres", 12.0)]


def test_states(spark):
    table = [HEAD, ["SK", "ZSSK (2024)", "pending", "N/A"], ["IT", "FS", "16 800", "53 000"], ["XX", "X (2024)", "1", "2"], ["CZE", "CD (2024)", "9 355", "8 912"], None]
    rows = X.staged_rows(frame(spark, table, [["a", "b"], ["HU"]]), CODES, NAMES, "2026-06-25T00:00:00Z").orderBy("table_idx", "row_idx").collect()
    assert [(r.row_type, r.parse_status, r.geo, r.year) for r in rows] == [
        ("header", "success", None, None), ("data_row", "value_unparseable", "SK", 2024), ("data_row", "year_missing", "IT", None), ("data_row", "geo_unmapped", None, 2024),
        ("data_row", "success", "CZ", 2024), ("data_row", "year_missing", "CZ", None), ("header", "table_mismatch", None, None), ("data_row", "table_mismatch", None, None),
    ]
    assert rows[1].raw_value_cells == ["pending", "N/A"] and rows[2].raw_year_cell == "FS" and rows[0].table_id == "d_0_header" and rows[6].raw_value_cells == ["a", "b"]
    texts = spark.createDataFrame([("d", "one  two\r\n\n three\x0bfour"), ("e", None), ("f", "")], "dataset string, text string")
    chunks = X.staged_texts(texts, "x").collect()
    assert [(r.dataset_id, r.row_idx, r.text_chunk, r.parse_status) for r in chunks] == [("d", 0, "one two", "text_only"), ("d", 1, "three", "text_only"), ("d", 2, "four", "text_only")]
    assert chunks[0].asDict().keys() == rows[0].asDict().keys()


@pytest.mark.parametrize("cell, value", [("1,5", 1.5), ("1 234,5", 1234.5), ("12 756", 12756.0), ("1.234.5", None), ("NA", None), ("none", None), ("about -3.", -3.0), ("", None), ("+7 (e)", 7.0)])
def test_numbers(spark, cell, value):
    df = spark.createDataFrame([(cell,)], "c string")
    assert df.select(X.report_number(X.cleaned(df.c))).first()[0] == value


def test_landed(spark, tmp_path):
    for name, content in [("a", json.dumps({"text": "x\ny", "tables": [[HEAD, ["HU", "MAV (2024)", "6 876"], ["??", "X (2024)", "1"]]]})), ("b", "%PDF-"), ("c", json.dumps({"text": "only"}))]:
        folder = tmp_path / "stats" / "uic" / name / "ingest_date=2024-01-01"
        folder.mkdir(parents=True)
        (folder / "r.json").write_text(content)
    tables, texts = X.landed_reports(bronze(spark, str(tmp_path), "stats", ".json"))
    assert [(r.geo, r.value, r.source_dataset) for r in X.report_facts(tables, CODES, NAMES).collect()] == [("HU", 6876.0, "a")]
    assert sorted((r.dataset_id, r.text_chunk) for r in X.staged_texts(texts).collect()) == [("a", "x"), ("a", "y"), ("c", "only")]
    assert [tuple(r) for r in stats_from_tree(spark, str(tmp_path)).collect()] == [("HU", 2024, 6876.0, "kilometres", "a", "Length of lines worked at end of year - Total", "uic")]
