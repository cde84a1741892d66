"""Readers, sinks and streams over files made here."""

import gzip
import hashlib
import json
import zipfile

from siltstone import cli, schemas
from siltstone.sources import readers, retry, sheets, sinks, tree
from siltstone.streaming import articles


def test_sdmx(spark, tmp_path):
    text = "freq,unit,tra_cov,geo\\TIME_PERIOD\t2019 \t2020\t2020-M01\nA,PAS,TOTAL,HU\t1,234 p\t:\t5\nA,PAS,NAT,HU\t7\t8\t9\nA,PAS,TOTAL,AT\t3\t4\t5\n"
    (tmp_path / "a.tsv").write_text(text)
    with gzip.open(tmp_path / "b.tsv.gz", "wt") as f:
        f.write(text)
    rules = [("rail_passengers", {"tra_cov": {"TOTAL"}, "unit": {"PAS"}}), ("absent", {"no_such": {"X"}})]
    for name in ("a.tsv", "b.tsv.gz"):
        got = {(r.geo, r.year, r.source_column, r.value) for r in readers.read_sdmx(spark, str(tmp_path / name), "d", rules).collect()}
        assert got == {("HU", 2019, "rail_passengers", 1234.0), ("HU", 2020, "rail_passengers", None), ("AT", 2019, "rail_passengers", 3.0), ("AT", 2020, "rail_passengers", 4.0)}
    assert readers.read_sdmx(spark, str(tmp_path / "a.tsv"), "d").count() == 0


def test_worldbank(spark, tmp_path):
    record = {"indicator": {"id": "IS.RRS", "value": "x"}, "country": {"id": "hu", "value": "Hungary"}, "countryiso3code": "HUN", "date": "2020", "value": 1.5, "unit": ""}
    (tmp_path / "a.json").write_text(json.dumps([{"page": 1}, [record, record | {"value": None}]]))
    (tmp_path / "b.json").write_text(json.dumps([{"message": [{"id": "120"}]}]))
    (tmp_path / "c.json").write_text(json.dumps([{"page": 1}, None]))
    got = readers.read_worldbank(spark, str(tmp_path / "*.json"), "d").collect()
    assert [(r.geo, r.year, r.value, r.source_column) for r in got] == [("HU", 2020, 1.5, "worldbank_unmapped:IS.RRS"), ("HU", 2020, None, "worldbank_unmapped:IS.RRS")]


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>T</title><link>http://a/1</link><description>body</description></item><item><title>U</title></item></channel></rss>")
    (tmp_path / "b.xml").write_text("<rss><channel><item><title>lost</title></item>")
    got = sorted((r.title, r.url, r.body) for r in readers.read_rss(spark, str(tmp_path / "*.xml"), "s").collect())
    assert [g[0] for g in got] == ["T", "U"] and got[0][1:] == ("http://a/1", "body")
    (tmp_path / "g.json").write_text(json.dumps({"articles": [{"url": "", "url_mobile": "http://m", "title": "A"}, {"title": "no url"}]}))
    found = readers.read_gdelt(spark, str(tmp_path / "g.json"), "x").collect()
    assert [(r.url, r.body, r.source) for r in found] == [("http://m", "A", "x"), ("", "no url", "x")]
    assert found[0].article_id == "http://m" and found[1].article_id == hashlib.sha1(b"x|no url||no url|1").hexdigest()


def test_gkg_zip(spark, tmp_path):
    new = ["id1", "20240101000000", "1", "src", "http://u"] + [""] * 22
    new[7], new[8], new[15] = "RAIL;", "RAIL_INCIDENT,12;RAIL_INCIDENT,40;TAX,3", "-2.5,1,2"
    with zipfile.ZipFile(tmp_path / "x.gkg.csv.zip", "w") as z:
        z.writestr("x.csv", "\t".join(new) + "\nshort\trow\n")
    (tmp_path / "bad.gkg.csv.zip").write_bytes(b"no archive")
    rows = readers.read_gkg(spark, str(tmp_path / "*.zip")).collect()
    assert [(r.gkg_id, r.gkg_themes, r.gkg_tone, r.document_identifier) for r in rows] == [("id1", "RAIL_INCIDENT;RAIL_INCIDENT;TAX", -2.5, "http://u")]
    assert (rows[0].gkg_emotions, rows[0].gkg_persons) == ("1,2", None)
    old = ["20240101"] + [""] * 20
    old[14], old[15], old[17], old[18] = "http://v", "1.0,,3", "T;;T", "1#Wien#AU,5"
    with zipfile.ZipFile(tmp_path / "old.zip", "w") as z:
        z.writestr("y.CSV", "\t".join(old) + "\n")
    record = readers.read_gkg(spark, str(tmp_path / "old.zip")).first()
    key = '{"date":"20240101","document_identifier":"http://v","locations":"1#Wien#AU,5","themes":"T;;T","tone":"1.0,,3"}'
    assert (record.gkg_id, record.gkg_themes, record.gkg_locations, record.gkg_emotions) == (hashlib.sha256(key.encode()).hexdigest(), "T;T", "1#Wien#AU,5", "3")
    whole = (tmp_path / "x.gkg.csv.zip").read_bytes()
    at = whole.index(b"x.csv") + 10
    (tmp_path / "x.gkg.csv.zip").write_bytes(whole[:at] + b"\xff" * 8 + whole[at + 8 :])
    assert readers.read_gkg(spark, str(tmp_path / "x.gkg.csv.zip")).count() == 0


def test_grid(spark, tmp_path):
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = "".join(f"<row>{''.join(cell(*c) for c in row)}</row>" for row in ([("A1", "Title")], [("A2", "Indicator"), ("B2", "Unit"), ("C2", "2020"), ("D2", "2021")], [("A3", "Length"), ("B3", "km"), ("C3", "1.234"), ("D3", "-")]))
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>')
    cells = readers.read_grid(spark, str(tmp_path / "a.xlsx"))
    assert cells.count() == 9
    got = sheets.sheet_facts(cells, "d", "ksh").collect()
    assert [(r.year, r.unit, r.source_column, r.geo, r.value) for r in got] == [(2020, "km", "Length", "HU", 1.234)]
    assert sheets.sheet_facts(cells, "d", "statistik_austria").first().value == 1234.0
    with zipfile.ZipFile(tmp_path / "bad.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet")
    assert readers.read_grid(spark, str(tmp_path / "*.xlsx")).count() == 9


def test_sections(spark):
    cells = [("f", "s", r, c, v) for r, line in enumerate([["", "2020"], ["Freight", ""], ["Tonnes", "5"], ["Wagons", "6"], ["Passengers", ""], ["Total", "7"]]) for c, v in enumerate(line) if v]
    got = sheets.sheet_facts(spark.createDataFrame(cells, "file string, sheet string, row long, col long, value string"), "d", "ksh").collect()
    assert {(r.source_column, r.value) for r in got} == {("Freight - Tonnes", 5.0), ("Freight - Wagons", 6.0), ("Passengers - Total", 7.0)}


def test_sdmx_rules_and_headers(spark, tmp_path):
    (tmp_path / "tran_r_net.tsv").write_text("freq,TRA_INFR,unit,geo\\TIME_PERIOD\t2019 \t2020 \nA,RL,KM,HU\t5\t6 b\nA,RL_ELC,KM,HU\t2\t:\nA,RD,KM,HU\t9\t9\nA,RL\t1\t1\n")
    got = {(r.geo, r.year, r.source_column, r.value) for r in readers.read_sdmx(spark, str(tmp_path / "tran_r_net.tsv"), "tran_r_net").collect()}
    assert got == {("HU", 2019, "rail_network_length_km", 5.0), ("HU", 2020, "rail_network_length_km", 6.0), ("HU", 2019, "rail_electrified_km", 2.0), ("HU", 2020, "rail_electrified_km", None)}
    (tmp_path / "demo_gind.tsv").write_text("freq,indic_de,geo\\TIME_PERIOD\t2019\nA,GROWRT,AT\t0.4\n")
    assert [(r.unit, r.source_column) for r in readers.read_sdmx(spark, str(tmp_path / "demo_gind.tsv"), "demo_gind").collect()] == [("", "pop_growth_rate")]
    (tmp_path / "old.tsv").write_text("Rail freight\t2019\nx,HU\t5\ny,hu\t6\n")
    assert {(r.geo, r.unit, r.source_column, r.value) for r in readers.read_sdmx(spark, str(tmp_path / "old.tsv"), "o").collect()} == {("HU", "eurostat_native", "Rail freight", 5.0), (None, "eurostat_native", "Rail freight", 6.0)}
    (tmp_path / "none.tsv").write_text("freq,unit,geo\\TIME_PERIOD\tnote\nA,KM,HU\tx\n")
    assert readers.read_sdmx(spark, str(tmp_path / "none.tsv"), "n").count() == 0


def test_trees_and_command_line(spark, tmp_path):
    for day, value in (("2024-01-01", 1), ("2024-01-02", 2)):
        folder = tmp_path / f"bronze/stats/eurostat/rail_pa_total/ingest_date={day}"
        folder.mkdir(parents=True)
        (folder / "a.tsv").write_text(f"freq,unit,geo\\TIME_PERIOD\t2019\nA,THS_PAS,HU\t{value}\n")
        (folder / "a.tsv.meta.json").write_text("{}")
    news = tmp_path / "bronze/news/feed/x/ingest_date=2024-01-01"
    news.mkdir(parents=True)
    (news / "a.xml").write_text("<rss><item><title>T</title><link>http://a</link></item><item><title>T</title><link>http://a</link></item></rss>")
    assert [(r.value, r.source_column) for r in tree.stats_from_tree(spark, str(tmp_path / "bronze")).collect()] == [(2.0, "rail_passengers")]
    assert tree.articles_from_tree(spark, str(tmp_path / "bronze")).count() == 1 and tree.gkg_from_tree(spark, str(tmp_path / "bronze")).count() == 0
    assert cli.main(["gold", "--bronze-root", str(tmp_path / "bronze"), "--out", str(tmp_path / "out")]) == 0
    row = spark.read.parquet(str(tmp_path / "out/gold")).first()
    assert (row.geo, row.geo_level, row.year, row.rail_passengers, row.news_article_count) == ("HU", "country", 2019, 2.0, 0)


def test_retries():
    class Answer:
        def __init__(self, status_code, headers=None):
            self.status_code, self.headers = status_code, headers or {}

    answers, waits = iter([Answer(429, {"Retry-After": "7"}), Answer(503), Answer(200)]), []
    assert retry.with_retries(lambda: next(answers), sleep=waits.append).status_code == 200 and waits == [7.0, 10.0]
    assert retry.is_error_payload([{"message": 1}]) and not retry.has_observations([{}, [{"value": 1}]]) and retry.has_observations([{}, [{"date": "2020", "value": None}]]) and not retry.has_observations([{"total": 0}, [{"date": "2020"}]]) and not retry.has_observations({})


def test_uic(spark):
    rows = [(0, 0, ["HU", "MAV (2024)", "6 876", "11 298"]), (0, 1, ["", "GYSEV (2023)", "19 635,0", "na"]), (0, 2, ["??", "X (2020)", "1"]), (0, 3, ["AT", "OBB", "1"])]
    got = readers.uic_rows(spark.createDataFrame(rows, "table_idx long, row_idx long, cells array<string>"), {"HU": "HU", "AT": "AT"}).orderBy("row_idx").collect()
    assert [r.parse_status for r in got] == ["success", "success", "geo_unmapped", "year_missing"]
    assert got[0]["values"] == [6876.0, 11298.0] and got[1].geo == "HU"


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "facts")
    assert sinks.load(spark, schemas.STAT_FACT, path).count() == 0
    one = spark.createDataFrame([("HU", 2020, "more")], "geo string, year int, extra string")
    for day in ("2024-01-01", "2024-01-02", "2024-01-02"):
        assert sinks.persist(one, schemas.STAT_FACT, path, day) == {"rows": 1}
    assert sinks.load(spark, schemas.STAT_FACT, path).count() == 1 and sinks.load(spark, schemas.STAT_FACT, path, "2024-01-01").first().value is None
    art = spark.createDataFrame([("stats", "s", "d", "2024-01-01", "f", bytearray(b"abc"), "u")], "domain string, source string, dataset_id string, ingest_date string, filename string, content binary, source_url string")
    sinks.land(art, str(tmp_path / "bronze"))
    assert spark.read.parquet(str(tmp_path / "bronze")).first().byte_size == 3


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"article_id":"1","source":"s"}\n{"article_id":"1","source":"s"}\n{"article_id":"2","source":"s"}\n')
    stream = articles.without_repeats(articles.article_stream(spark, str(tmp_path / "in"), "article_id string, source string"), ["article_id"])
    for _ in range(2):
        articles.drain(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_every_date_of_news(spark, tmp_path):
    root = tmp_path / "bronze"
    feed = lambda *items: "<rss>" + "".join(f"<item><title>{t}</title><link>http://x/{u}</link></item>" for t, u in items) + "</rss>"
    for path, text in {
        "news/feed/x/ingest_date=2024-01-02/a.xml": feed(("late", "1"), ("new", "9")), "news/feed/x/ingest_date=2024-01-01/b.xml": feed(("second", "2"), ("first", "1")),
        "news/gdelt/y/ingest_date=2024-01-01/a.json": '{"articles": [{"title": "listed", "url": "http://x/3"}, {"title": ""}]}', "news/gdelt/y/ingest_date=2024-01-01/a.json.meta.json": "{}",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    got = tree.articles_from_tree(spark, str(root))
    assert {(r.title, r.source, r.url[-1]) for r in got.collect()} == {("second", "feed", "2"), ("first", "feed", "1"), ("new", "feed", "9"), ("listed", "gdelt", "3")}
    assert {r.title for r in tree.articles_from_tree(spark, str(root), 2).collect()} == {"second", "first"}
    records = [("g1", "20240105010203", "http://x/1", None), ("g2", "20240106", "http://y/2;http://z/3", "name"), ("g3", "2024", "http://y/2", None), ("g4", None, None, None), ("g5", "20240106", "http://q; http://x/9/", None)]
    more = tree.with_unmatched_records(got, spark.createDataFrame(records, "gkg_id string, gkg_date string, document_identifier string, source_common_name string"))
    assert {(r.article_id, r.title, r.url, r.published_date, r.source) for r in more.where("gkg_id is not null").collect()} == {("g2", "name", "http://y/2", "2024-01-06", "gdelt"), ("g4", "g4", "", None, "gdelt")}
    assert more.count() == 6


def test_sheets_and_indicators_of_a_tree(spark, tmp_path):
    for k in (1, 2):
        folder = tmp_path / f"stats/worldbank/w{k}/ingest_date=2024-01-01"
        folder.mkdir(parents=True)
        (folder / "a.json").write_text('[{}, [{"indicator": {"id": "IS.RRS.TOTL.KM"}, "country": {"id": "HU"}, "countryiso3code": "HUN", "date": "2020", "value": %d, "unit": "x"}]]' % k)
        folder = tmp_path / f"stats/ksh/k{k}/ingest_date=2024-01-01"
        folder.mkdir(parents=True)
        cells = '<row><c r="A1" t="inlineStr"><is><t>Label</t></is></c><c r="B1"><v>2020</v></c></row><row><c r="A2" t="inlineStr"><is><t>Length</t></is></c><c r="B2"><v>%d.5</v></c></row>' % k
        with zipfile.ZipFile(folder / "a.xlsx", "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    got = tree.stats_from_tree(spark, str(tmp_path))
    assert {(r.source_dataset, r.geo, r.year, r.value, r.unit) for r in got.collect()} == {("w1", "HU", 2020, 1.0, "worldbank_native"), ("w2", "HU", 2020, 2.0, "worldbank_native"), ("k1", "HU", 2020, 1.5, "ksh_native"), ("k2", "HU", 2020, 2.5, "ksh_native")}
