"""Readers of raw files; each gives a DataFrame and leaves what can't be parsed out."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.columns import sdmx_number, url_key, year_of_text
from siltstone.sources.rules import FEATURE_RULES, INDICATORS

LONG = ["geo", "year", "value", "unit", "source_dataset", "source_column", "source_system"]
#: Unit codes of coded tables without rules of their own, and their labels.
UNIT_LABELS = {
    "MIO_TKM": "freight tonne-km", "THS_TKM": "freight tonne-km", "TKM": "freight tonne-km", "MIO_PKM": "passenger-km", "THS_PKM": "passenger-km", "PKM": "passenger-km",
    "PAS": "passengers", "THS_PAS": "passengers", "MIO_PAS": "passengers", "THS": "passengers", "KM": "rail network km", "T": "freight tonnes", "THS_T": "freight tonnes", "MIO_T": "freight tonnes",
}
#: Dimensions a table may have and still be read without rules: none of them breaks a total down.
PLAIN = {"freq", "unit", "geo"}


def read_sdmx(spark: SparkSession, path: str, dataset: str, rules: list[tuple[str, dict]] | None = None) -> DataFrame:
    """A coded TSV table, plain or gzipped: melted at once, rows chosen by rules (feature, {dimension: code or codes}) and summed.

    Rules are the dataset's own, unless given. Only headers of digits are years; a table without any gives nothing. Without rules, a
    table with further dimensions gives nothing, as its rows are breakdowns. Keys shorter than the header have null dimensions. A
    header that names no `geo` is a label: its cells keep it, and the geo is the two letters at the end of the key.
    """
    wide = spark.read.option("sep", "\t").option("header", True).csv(path)
    head, years = wide.columns[0], [c for c in wide.columns[1:] if re.fullmatch(r"\d+", c.strip())]
    if not years:
        return spark.createDataFrame([], "geo string, year long, value double, unit string, source_dataset string, source_column string, source_system string")
    names = [n.strip().lower() for n in head.split("\\")[0].split(",")]
    long = wide.unpivot([head], years, "y", "raw")
    key = F.col(f"`{head}`")
    cell = [F.trim("y").cast("long").alias("year"), sdmx_number(F.col("raw")).alias("value")]
    shaped = lambda df: df.select("geo", "year", "value", "unit", F.lit(dataset).alias("source_dataset"), "source_column", F.lit("eurostat").alias("source_system"))
    if "geo" not in names:
        geo = F.nullif(F.regexp_extract(key, r",([A-Z]{2})$", 1), F.lit(""))
        return shaped(long.select(geo.alias("geo"), *cell, F.lit("eurostat_native").alias("unit"), F.lit(head).alias("source_column")))
    part = F.split(key, ",")
    long = long.select(*(F.trim(F.get(part, F.lit(k))).alias(n) for k, n in enumerate(names)), *cell)
    long = long if "unit" in names else long.withColumn("unit", F.lit(""))
    rules = FEATURE_RULES.get(dataset) if rules is None else rules
    if rules is None:
        label = F.create_map(*(F.lit(x) for kv in UNIT_LABELS.items() for x in kv))[F.col("unit")]
        chosen = long.withColumn("source_column", label if set(names) <= PLAIN else F.lit(None).cast("string")).where("source_column is not null")
    else:
        usable = [(f, need) for f, need in rules if set(need) <= {*names, "unit"}]
        codes = lambda v: [v] if isinstance(v, str) else sorted(v)
        pick = lambda need: reduce(lambda a, b: a & b, (F.col(d).isin(codes(v)) for d, v in need.items()), F.lit(True))
        matches = F.array_compact(F.array(*(F.when(pick(need), f) for f, need in usable)))
        chosen = long.withColumn("source_column", F.explode(matches if usable else F.array().cast("array<string>")))
    return shaped(chosen.groupBy("geo", "year", "unit", "source_column").agg(F.sum("value").alias("value")))


def read_worldbank(spark: SparkSession, path: str | list[str], dataset: str | Column, iso3: dict[str, str] | None = None, indicators: dict[str, str] | None = None) -> DataFrame:
    """[meta, records] JSON documents; an error envelope or null records give no rows. `dataset` may be a column of `file`, for many files at once."""
    record = "array<struct<indicator:struct<id:string,value:string>,country:struct<id:string,value:string>,countryiso3code:string,date:string,value:double,unit:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.explode(F.from_json(F.get_json_object("value", "$[1]"), record)).alias("r")).select("file", "r.*")
    known = lambda table, c: F.coalesce(*([F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c]] if table else []), F.lit(None).cast("string"))
    geo = F.coalesce(known(iso3, F.col("countryiso3code")), F.nullif(F.upper("country.id"), F.lit("")), F.substring("countryiso3code", 1, 2))
    label = F.coalesce(known(INDICATORS if indicators is None else indicators, F.col("indicator.id")), F.concat(F.lit("worldbank_unmapped:"), F.col("indicator.id")))
    return rows.select(geo.alias("geo"), F.col("date").try_cast("long").alias("year"), "value", F.lit("worldbank_native").alias("unit"), as_column(dataset).alias("source_dataset"), label.alias("source_column"), F.lit("worldbank").alias("source_system"))


def as_column(value: str | Column) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def read_rss(spark: SparkSession, path: str | list[str], source: str | Column, places: bool = False) -> DataFrame:
    """Items of RSS feeds; a file with a malformed part gives none. A feed is parsed whole, by its own task.

    `source` may be a column of `file`. With `places`, each item has its `file` and its place `at` there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    items = ElementTree.fromstring(content).iter("item")
                except ElementTree.ParseError:
                    continue
                text = lambda item, tag: (item.findtext(tag) or "").strip() or None
                body = "{http://purl.org/rss/1.0/modules/content/}encoded"
                out += [{"file": file, "title": text(i, "title"), "url": text(i, "link"), "published_date": text(i, "pubDate"), "body": text(i, body) or text(i, "description"), "at": k} for k, i in enumerate(items)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([*((c, pa.string()) for c in ("file", "title", "url", "published_date", "body")), ("at", pa.int64())]))

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, title string, url string, published_date string, body string, at long")
    key = article_id(F.col("url"), as_column(source), F.col("title"), F.col("published_date"), F.col("body"), F.col("at"))
    return rows.select(key.alias("article_id"), as_column(source).alias("source"), "title", "url", "published_date", "body", *(["file", "at"] if places else []))


def article_id(url: Column, *others: Column) -> Column:
    """The URL, or a hash of the other fields where there is none: source, title, date, text and the item's place, nulls as empty."""
    return F.coalesce(F.nullif(F.trim(url), F.lit("")), F.sha1(F.concat_ws("|", *(F.coalesce(o.cast("string"), F.lit("")) for o in others))))


def read_gdelt(spark: SparkSession, path: str | list[str], source: str | Column = "gdelt", places: bool = False) -> DataFrame:
    """Article lists in JSON; items stay that have a title. Without a text of its own, an item's title is its text.

    `source` may be a column of `file`. With `places`, each item has its `file` and its place `at` there.
    """
    fields = ["url", "url_mobile", "title", "seendate", "publishedDate", "datetime", "snippet", "summary", "description"]
    shape = f"array<struct<{','.join(f'{f}:string' for f in fields)}>>"
    a = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.from_json(F.get_json_object("value", "$.articles"), shape)).alias("at", "a")).select("file", "at", "a.*")
    first = lambda *cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))
    out = a.where("title <> ''").select("file", F.col("at").cast("long").alias("at"), F.coalesce(first("url", "url_mobile"), F.lit("")).alias("url"), "title", first("seendate", "publishedDate", "datetime").alias("published_date"), first("snippet", "summary", "description", "title").alias("body"))
    key = article_id(F.col("url"), as_column(source), F.col("title"), F.col("published_date"), F.col("body"), F.col("at"))
    return out.select(key.alias("article_id"), as_column(source).alias("source"), "title", "url", "published_date", "body", *(["file", "at"] if places else []))


def read_gkg(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Zipped tab-delimited knowledge-graph files of either layout; archives with a damaged member and rows of neither layout give nothing.

    Lists keep repeats and lose empty entries; the enhanced ones of themes, persons and organisations lose their offsets too. Empty
    fields are null. A record without an id gets a hash of its date, document, locations, themes and tone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    member = next(n for n in archive.namelist() if n.lower().endswith(".csv"))
                    with archive.open(member) as whole:
                        while whole.read(1 << 20):
                            pass
                except (zipfile.BadZipFile, StopIteration, zlib.error, EOFError, NotImplementedError, RuntimeError):  # the last: an encrypted member
                    continue
                with archive.open(member) as lines:
                    held = []
                    for k, line in enumerate(io.TextIOWrapper(lines, "utf-8", "replace")):
                        held.append((name, k, line.rstrip("\n")))
                        if len(held) == 4096:
                            yield rows_of(held)
                            held = []
                    yield rows_of(held)

    def rows_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": a, "ordinal": b, "line": c} for a, b, c in held], pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("line", pa.string())]))

    lines = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, ordinal long, line string")
    f = F.split("line", "\t")
    at = lambda k: F.get(f, F.lit(k))
    new = (F.size(f) >= 16) & at(1).rlike(r"^\d{8,}$")
    old = (F.size(f) >= 21) & at(0).rlike(r"^\d{8}$")
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    entries = lambda c: F.filter(F.transform(F.split(c, ";"), lambda t: F.trim(t)), lambda t: t != "")
    bare = lambda c: F.filter(F.transform(entries(c), lambda t: F.trim(F.regexp_replace(t, r",\d+$", ""))), lambda t: t != "")
    joined = lambda a, by=";": F.when(F.size(a) > 0, F.array_join(a, by))
    enhanced = lambda k, plain, other: F.when(new, F.coalesce(joined(bare(at(k))), joined(entries(at(plain))))).otherwise(joined(entries(at(other))))
    tone = F.transform(F.split(at(15), ","), lambda t: F.trim(t))
    raw = lambda k, plain: F.coalesce(F.nullif(at(k), F.lit("")), at(plain))
    document = F.when(new, clean(at(4))).otherwise(joined(entries(at(14))))
    date = F.when(new, clean(at(1))).otherwise(clean(at(0)))
    hashed = F.struct(
        date.alias("date"), F.when(new, clean(at(4))).otherwise(clean(at(14))).alias("document_identifier"),
        F.when(new, clean(raw(10, 9))).otherwise(clean(at(18))).alias("locations"), F.when(new, clean(raw(8, 7))).otherwise(clean(at(17))).alias("themes"), clean(at(15)).alias("tone"),
    )
    own_id = F.coalesce(F.when(new, clean(at(0))), F.sha2(F.to_json(hashed, {"ignoreNullFields": "false"}), 256))
    return lines.where(new | old).select(
        "file", "ordinal", own_id.alias("gkg_id"), date.alias("gkg_date"), document.alias("document_identifier"),
        F.when(new, clean(at(3))).otherwise(joined(entries(at(13)))).alias("source_common_name"), enhanced(8, 7, 17).alias("gkg_themes"), F.get(tone, F.lit(0)).try_cast("double").alias("gkg_tone"),
        enhanced(12, 11, 19).alias("gkg_persons"), enhanced(14, 13, 20).alias("gkg_organizations"),
        F.when(new, F.coalesce(joined(entries(at(10))), joined(entries(at(9))))).otherwise(joined(entries(at(18)))).alias("gkg_locations"),
        joined(F.filter(tone, lambda t, k: (k > 0) & (t != "")), ",").alias("gkg_emotions"),
    )


def read_grid(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Cells of spreadsheets (XLSX, ODS) as (file, sheet, row, col, value, numeric, position): both are zipped XML and need no further library."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_cells, "file string, sheet string, row long, col long, value string, numeric boolean, position long")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("col", pa.int64()), ("value", pa.string()), ("numeric", pa.bool_()), ("position", pa.int64())])
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                archive = zipfile.ZipFile(io.BytesIO(content))
                cells = list(ods_cells(archive) if "content.xml" in archive.namelist() else xlsx_cells(archive))
            except (zipfile.BadZipFile, ElementTree.ParseError, zlib.error, EOFError, KeyError, IndexError, ValueError, AttributeError, TypeError):
                continue  # a file that is no sheet gives nothing, like one with a malformed part
            yield pa.RecordBatch.from_pylist([{"file": name, "sheet": s, "row": r, "col": c, "value": v, "numeric": n, "position": p} for s, r, c, v, n, p in cells], schema)


def xlsx_order(archive: zipfile.ZipFile) -> list[str]:
    """The parts of a workbook's sheets in its own order; by number where the workbook doesn't tell."""
    parts = sorted((n for n in archive.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    if not {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(archive.namelist()):
        return parts
    targets = {r.get("Id"): "xl/" + r.get("Target").removeprefix("/xl/") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    ids = [v for e in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter() if e.tag.endswith("}sheet") for k, v in e.attrib.items() if k.endswith("}id")]
    told = [targets[i] for i in ids if targets.get(i) in parts]
    return told + [p for p in parts if p not in told]


def xlsx_cells(archive: zipfile.ZipFile) -> Iterator[tuple[str, int, int, str, bool, int]]:
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = ["".join(t.text or "" for t in s.iter(ns + "t")) for s in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter(ns + "si")]
    for position, name in enumerate(xlsx_order(archive)):
        for cell in ElementTree.fromstring(archive.read(name)).iter(ns + "c"):
            letters, row = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
            col = 0
            for letter in letters:
                col = col * 26 + ord(letter) - 64
            value = cell.findtext(ns + "v")
            text = shared[int(value)] if cell.get("t") == "s" and value else "".join(t.text or "" for t in cell.iter(ns + "t")) if cell.get("t") == "inlineStr" else value
            if text:
                yield name.rsplit("/", 1)[1][:-4], int(row) - 1, col - 1, text, cell.get("t", "n") == "n", position


def ods_cells(archive: zipfile.ZipFile) -> Iterator[tuple[str, int, int, str, bool, int]]:
    t, o = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}", "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
    for position, sheet in enumerate(ElementTree.fromstring(archive.read("content.xml")).iter(t + "table")):
        row = 0
        for line in sheet.iter(t + "table-row"):
            col, found = 0, []
            for cell in line:
                times = int(cell.get(t + "number-columns-repeated", "1"))
                text = cell.get(o + "value") or "".join(cell.itertext()).strip()
                if text:
                    found += [(col + k, text, cell.get(o + "value") is not None) for k in range(times)]
                col += times
            many = int(line.get(t + "number-rows-repeated", "1"))
            for k in range(many if found else 0):
                for at, text, numeric in found:
                    yield sheet.get(t + "name"), row + k, at, text, numeric, position
            row += many


def read_tidy(rows: DataFrame, dataset: str, system: str, geo: str, label: str, year: str, value: str, unit: str) -> DataFrame:
    """Facts from a table that has one label, year and value a row already."""
    return rows.select(F.lit(geo).alias("geo"), F.col(year).cast("string").try_cast("long").alias("year"), F.col(value).cast("string").try_cast("double").alias("value"), F.lit(unit).alias("unit"), F.lit(dataset).alias("source_dataset"), F.col(label).cast("string").alias("source_column"), F.lit(system).alias("source_system"))


def uic_rows(tables: DataFrame, codes: dict[str, str]) -> DataFrame:
    """Rows of extracted tables (table_idx, row_idx, cells array) by status; a blank code takes the last one, an unmapped one resets it."""
    from siltstone.operators.gold import carried_forward

    mapped = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))[F.upper(F.trim("code"))]
    rows = tables.withColumn("code", F.get("cells", F.lit(0))).withColumn("own", mapped)
    rows = carried_forward(rows, ["table_idx"], ["row_idx"], "code", "own", "geo").withColumn("year", year_of_text(F.get("cells", F.lit(1))))
    numbers = F.transform(F.filter("cells", lambda c, k: k > 1), lambda c: F.replace(F.replace(F.nullif(F.regexp_extract(c, r"(-?\d[\d ]*(?:,\d+)?)", 1), F.lit("")), F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double"))
    rows = rows.withColumn("values", numbers)
    status = F.when(F.col("geo").isNull(), "geo_unmapped").when(F.col("year").isNull(), "year_missing").when(~F.exists("values", lambda v: v.isNotNull()), "value_unparseable").otherwise("success")
    return rows.select("table_idx", "row_idx", "geo", "year", "values", status.alias("parse_status"))


def url_ok(url: Column) -> Column:
    """Whether a URL has a web scheme and a host."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & (F.try_parse_url(url, F.lit("HOST")) != ""), F.lit(False))


def bronze(spark: SparkSession, root: str, domain: str, suffix: str, latest: bool = True) -> DataFrame:
    """(source, dataset, ingest_date, path, content, url_key) of landed files, without sidecars and catalogues, of the last date by default."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(f"{root}/{domain}")
    part = lambda k: F.regexp_extract("path", rf"/{re.escape(domain)}/([^/]+)/([^/]+)/ingest_date=([^/]+)/[^/]+$", k)
    out = files.select(part(1).alias("source"), part(2).alias("dataset"), part(3).alias("ingest_date"), "path", "content", url_key(F.col("path")).alias("url_key")).where("source <> '' and not startswith(dataset, '_') and not endswith(path, '.meta.json')")
    if not latest:
        return out
    last = out.groupBy("source", "dataset").agg(F.max("ingest_date").alias("ingest_date"))
    return out.join(last, ["source", "dataset", "ingest_date"], "left_semi")
