"""Landed trees read whole: every dataset by the reader of its source. Roots may be any path that Spark reads, object stores among them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schemas, vocab
from siltstone.functions.columns import url_key
from siltstone.operators.matching import identifiers
from siltstone.sources import extracted, readers, sheets

LONG = "geo string, year long, value double, unit string, source_dataset string, source_column string, source_system string"
#: Suffixes of a source's files.
STATS = {"eurostat": (".tsv", ".tsv.gz"), "worldbank": (".json",), "ksh": (".xlsx",), "statistik_austria": (".ods",), "uic": (".json",)}


def latest_folders(spark: SparkSession, root: str, domain: str) -> list[tuple[str, str, str]]:
    """(source, dataset, path) of each dataset's last date; a driver-side listing of folders, not of files. Datasets that begin with _ are catalogues."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    files = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(fs_path(f"{root}/{domain}/*/*/ingest_date=*")) or []
    last: dict[tuple[str, str], str] = {}
    for status in found:
        path = status.getPath().toString()
        source, dataset, _ = path.rsplit("/", 3)[-3:]
        if not dataset.startswith("_"):
            last[source, dataset] = max(last.get((source, dataset), ""), path)
    return sorted((s, d, p) for (s, d), p in last.items())


def files_of(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> list[str]:
    """Files of a folder by suffix, without sidecars."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    files = fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().toString() for s in files.listStatus(fs_path(folder))]
    return sorted(n for n in names if n.endswith(suffixes) and not n.endswith(".meta.json"))


def every_file(spark: SparkSession, root: str, domain: str, suffixes: tuple[str, ...], source: str = "*") -> list[str]:
    """Files of all dates by suffix, without sidecars, in order of their paths."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    files = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().toString() for s in files.globStatus(fs_path(f"{root}/{domain}/{source}/*/ingest_date=*/*")) or []]
    return sorted(n for n in names if n.lower().endswith(suffixes) and not n.endswith(".meta.json"))


def folder_of(level: int) -> Column:
    """The folder so many levels above the ingest date of a column `file`: 0 the dataset, 1 the source."""
    return F.element_at(F.split(F.substring_index("file", "/ingest_date=", 1), "/"), -1 - level)


def stats_from_tree(spark: SparkSession, root: str, codes: dict[str, str] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Long facts of all statistics under root, of the last date of each dataset; unknown sources and files that can't be read give nothing.

    Reports are read from landed extracts, where `codes` and `names` tell countries (by default the codes of `vocab.HOME_COUNTRIES`).
    Files of one layout are one read, however many there are; only coded tables, whose headers are their own, are read one by one.
    """
    out, by_source = [spark.createDataFrame([], LONG)], {}
    for source, dataset, folder in latest_folders(spark, root, "stats"):
        for path in files_of(spark, folder, STATS.get(source, ("/",))):
            if source == "eurostat":
                out.append(readers.read_sdmx(spark, path, dataset))
            else:
                by_source.setdefault(source, []).append(path)
    for source, paths in by_source.items():
        if source == "worldbank":
            out.append(readers.read_worldbank(spark, paths, folder_of(0)))
        elif source == "uic":
            files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), "content")
            tables, _ = extracted.landed_reports(files.select(folder_of(0).alias("dataset"), "content"))
            out.append(extracted.report_facts(tables, codes or {c: c for c in vocab.HOME_COUNTRIES}, names or {}))
        else:
            out.append(sheets.sheet_facts(readers.read_grid(spark, paths), folder_of(0), source))
    return reduce(lambda a, b: a.unionByName(b), (df.select(*out[0].columns) for df in out))


def articles_from_tree(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Articles of all feeds (XML) and article lists (JSON) under root, of every date, one for each id: the first by path and place in its file.

    `limit` keeps the first of these, in that order.
    """
    out = [spark.createDataFrame([], f"{schemas.ARTICLE}, file string, at long")]
    if feeds := every_file(spark, root, "news", (".xml", ".rss")):
        out.append(readers.read_rss(spark, feeds, folder_of(1), places=True))
    if lists := every_file(spark, root, "news", (".json",)):
        out.append(readers.read_gdelt(spark, lists, folder_of(1), places=True))
    rows = reduce(lambda a, b: a.unionByName(b), out)
    each = rows.groupBy("article_id").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "article_id")), F.struct("file", "at")).alias("r")).select("article_id", "r.*")
    each = each if limit is None else each.orderBy("file", "at").limit(limit)
    return each.drop("file", "at")


def gkg_from_tree(spark: SparkSession, root: str, source: str = "*") -> DataFrame:
    """Records of all knowledge-graph archives under root, of every date, one for each id: the first by path and line."""
    paths = every_file(spark, root, "news", (".zip",), source)
    if not paths:
        return spark.createDataFrame([], schemas.GKG)
    rows = readers.read_gkg(spark, paths)
    return rows.groupBy("gkg_id").agg(F.min_by(F.struct(*(c for c in rows.columns if c not in ("gkg_id", "file", "ordinal"))), F.struct("file", "ordinal")).alias("r")).select("gkg_id", "r.*")


def with_unmatched_records(articles: DataFrame, records: DataFrame) -> DataFrame:
    """articles, and after them an article for each record that none of them stands for, with the record's fields.

    A record is matched by an article that has its id, one of its documents as id, or one of them as URL. Of records whose first document is one URL the
    first by id stays. Its article has the record's id, first document and date, and its source's name, or else the document or the id, as title.
    """
    documents = records.select("gkg_id", F.explode(identifiers(F.col("document_identifier"))).alias("key"))
    urls = articles.select(url_key(F.col("url")).alias("key")).where("key <> ''").distinct()
    ids = articles.select("article_id").distinct()
    left = records.join(documents.join(urls, "key", "left_semi").select("gkg_id").distinct(), "gkg_id", "left_anti")
    left = left.join(ids, F.col("gkg_id") == F.col("article_id"), "left_anti").join(ids, F.col("document_identifier") == F.col("article_id"), "left_anti")
    first = F.coalesce(F.get(F.filter(F.transform(F.split("document_identifier", "[;|]"), F.trim), lambda d: d != ""), F.lit(0)), F.lit(""))
    shown = left.withColumn("url", first).withColumn("same", F.when(F.col("url") == "", F.col("gkg_id")).otherwise(url_key(F.col("url"))))
    kept = shown.join(shown.groupBy("same").agg(F.min("gkg_id").alias("gkg_id")), ["same", "gkg_id"], "left_semi")
    day = F.try_to_timestamp(F.substring(F.regexp_replace("gkg_date", r"\D", ""), 1, 8), F.lit("yyyyMMdd")).cast("date").cast("string")
    fields = [c for c in records.columns if c != "gkg_date"]
    more = kept.select(F.col("gkg_id").alias("article_id"), F.lit("gdelt").alias("source"), F.coalesce("source_common_name", F.nullif("url", F.lit("")), "gkg_id").alias("title"), "url", day.alias("published_date"), F.lit("").alias("body"), *fields)
    return articles.unionByName(more, allowMissingColumns=True)
