"""Files by adaptive time partitions: whole years, months, days or hours, as the rows of each need.

Rows are counted by hour. Level by level from the hours up, complete sets of siblings (the hours of a day, days of a month, months of a
year) whose parent has at most L rows collapse into it; the siblings that survive are joined, in time order, into runs of at most L rows.
A level's groups are bounded by the calendar, so no level passes through one task; only years, of which there are few, meet in one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from siltstone.llm.common import forget, fresh, settle, small_batches, table
from siltstone.tables import delete_files, new_folder

#: Of the contract of the registered query: L is 1 + rows // PARTS; rows that arrived before CUT make up the first layout.
PARTS, CUT = 650, "2024-03-01 00:00:00"
NO_TIME = "null"
#: Children of a node by its level: hours of a day, days of a month, months of a year.
LEVELS = [("day", "hour", "0", "23"), ("month", "day", "1", "day(last_day(make_date(year, month, 1)))"), ("year", "month", "1", "12")]


def hour_of(at: Column) -> Column:
    """The hour of a timestamp without a zone, counted from 1970."""
    return F.unix_date(at.cast("date")) * F.lit(24).cast("long") + F.hour(at)


def hour_counts(hours: DataFrame) -> DataFrame:
    """(at_hour, n, year, month, day, hour) of a table with a column at_hour, null hours left out."""
    date = F.date_from_unix_date(F.floor(F.col("at_hour") / 24).cast("int"))
    counts = hours.where(F.col("at_hour").isNotNull()).groupBy("at_hour").agg(F.count("*").alias("n"))
    return counts.select("at_hour", "n", F.year(date).alias("year"), F.month(date).alias("month"), F.day(date).alias("day"), F.pmod("at_hour", F.lit(24)).cast("int").alias("hour"))


def _runs(groups: DataFrame, first: str, last: str, limit: int) -> DataFrame:
    """One row (first, last, n) for each run of a group's children; `kids` are its (child, n), children without rows left out.

    Each child from first to last, in order, joins the run before it if that stays within limit. One above limit can't be joined and stands alone.
    """
    folded = F.expr(f"""
        aggregate(sequence(int({first}), int({last})), cast(array() AS array<struct<first: int, last: int, n: bigint>>), (runs, c) ->
          CASE WHEN size(runs) > 0 AND element_at(runs, -1).n + coalesce(element_at(counts, c), 0L) <= {limit}
            THEN concat(slice(runs, 1, size(runs) - 1), array(named_struct('first', element_at(runs, -1).first, 'last', c, 'n', element_at(runs, -1).n + coalesce(element_at(counts, c), 0L))))
            ELSE concat(runs, array(named_struct('first', c, 'last', c, 'n', coalesce(element_at(counts, c), 0L)))) END)""")
    return groups.withColumn("counts", F.map_from_entries("kids")).withColumn("run", F.explode(folded)).drop("counts", "kids").where("run.n > 0")


def leaves(counts: DataFrame, limit: int) -> DataFrame:
    """(at_hour, leaf, n) for each hour of hour_counts(): the leaf that it belongs to and that leaf's rows. Leaves above limit are single hours."""
    over, found, names, nodes = ["year", "month", "day", "hour"], counts.drop("n"), [], counts.drop("at_hour")
    two, four = (lambda c: F.lpad(c.cast("string"), 2, "0")), (lambda c: F.when(c.between(0, 9999), F.lpad(c.cast("string"), 4, "0")).otherwise(c.cast("string")))
    for parent, child, first, last in [*LEVELS, ("all", "year", "first_year", "last_year")]:
        above = over[: over.index(child)]
        kids = [F.sum("n").alias("n"), F.collect_list(F.struct(child, "n")).alias("kids")]
        if parent == "all":
            groups = nodes.groupBy().agg(*kids, F.min("year").alias("first_year"), F.max("year").alias("last_year")).where("n IS NOT NULL")
        else:
            groups = nodes.groupBy(*above).agg(*kids)
            nodes, groups = groups.select(*above, "n"), groups.where(F.col("n") > limit)
        runs = _runs(groups, first, last, limit)
        runs = runs if child == "hour" else runs.where(F.col("run.n") <= limit)
        text = four if child == "year" else two
        parents = [four(F.col("year")), *(two(F.col(c)) for c in above[1:])] if above else []
        name = F.concat(*(x for p in parents for x in (p, F.lit("/"))), text(F.col("run.first")), F.lit("-"), text(F.col("run.last")))
        members = runs.select(*above, F.explode(F.sequence("run.first", "run.last")).alias(child), F.struct(name.alias("leaf"), F.col("run.n").alias("n")).alias(f"by_{child}"))
        found = found.join(members, [*above, child], "left")
        names.append(f"by_{child}")
    leaf = F.coalesce(*names)
    return found.select("at_hour", leaf["leaf"].alias("leaf"), leaf["n"].alias("n"))


def _hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of all values of a column `row`, a struct of df's columns."""
    cols = [(F.col(f"row.`{c}`"), kind) for c, kind in df.dtypes]
    values = [*(F.to_json(F.struct(c)) if kind.startswith(("map", "variant")) else c for c, kind in cols), *(c.isNull() for c, _ in cols)]
    return F.xxhash64(*values).alias("h1"), F.xxhash64(F.lit(1), *values).alias("h2")


def _packed(df: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def _order(order: list[str]) -> list[str | Column]:
    """A leaf's order: by time, the named columns, then the rows' hashes; nulls first."""
    return ["at", *(F.col(f"row.`{c}`") for c in order), "h1", "h2"]


def in_parts(df: DataFrame, at: Column, order: list[str], limit: int) -> DataFrame:
    """(row, at, h1, h2, leaf, part): each row's leaf and its part there, from 1, in settled tables.

    A leaf within limit is one part. In larger ones, hours and rows without a time, rows are dealt out by ranges of their order; a row's rank is its place
    in its range and the counts of the ranges before it, so no leaf is sorted in one task.
    """
    marked = df.select(_packed(df), at.alias("at"), hour_of(at).alias("at_hour")).select("*", *_hashes(df))
    counts = settle(hour_counts(df.select(hour_of(at).alias("at_hour"))))
    timed = marked.where("at_hour IS NOT NULL").join(leaves(counts, limit), "at_hour")
    untimed = marked.where("at_hour IS NULL").withColumns({"leaf": F.lit(NO_TIME), "n": F.lit(limit + 1).cast("long")})
    placed = settle(timed.unionByName(untimed).drop("at_hour"))
    forget(counts)
    small, large = placed.where(F.col("n") <= limit).drop("n").withColumn("part", F.lit(1)), placed.where(F.col("n") > limit).drop("n")
    keys = ["leaf", *_order(order)]
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(large.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()))
    ranges = ranged.groupBy("leaf", F.shiftright("place", 33).alias("range")).agg(F.count("*").alias("rows"), F.min("place").alias("least"))
    before = Window.partitionBy("leaf").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("leaf", "range", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("least")).alias("start"))
    ranked = ranged.withColumn("range", F.shiftright("place", 33)).join(starts, ["leaf", "range"])
    parted = ranked.withColumn("part", (F.floor((F.col("place") + F.col("start")) / limit) + 1).cast("int"))
    return small.unionByName(parted.select(small.columns))


def layout_files(spark: SparkSession, folder: str, df: DataFrame) -> DataFrame:
    """The rows of the files in `folder`, a layout of a table like df: (row, leaf, part, path, at_row)."""
    leaf, part = fresh("leaf", df.columns), fresh("part", df.columns)
    files = spark.read.schema(StructType([*df.schema.fields, StructField(leaf, StringType()), StructField(part, IntegerType())])).parquet(folder)
    meta = files.metadataColumn("_metadata")
    return files.select(_packed(df), F.translate(leaf, "_", "/").alias("leaf"), F.col(part).alias("part"), meta["file_path"].alias("path"), meta["row_index"].alias("at_row"))


def _fingerprints(rows: DataFrame, *keys: str) -> DataFrame:
    """A count and sums of both hashes, in halves that can't overflow, for each key: equal for equal sets of rows, repeats included."""
    halves = [F.col("h1").bitwiseAND(2**32 - 1), F.shiftright("h1", 32), F.col("h2").bitwiseAND(2**32 - 1), F.shiftright("h2", 32)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(h).alias(f"s{k}") for k, h in enumerate(halves)))


def write_layout(df: DataFrame, at: Column, order: list[str], limit: int, folder: str) -> None:
    """Make `folder`, which exists, hold df: one Parquet file for each part of each leaf of its times `at` (timestamps without a zone), `limit` rows at most.

    A file's rows stand by time, the columns `order` and, where these tie, by hashes of the row; nulls come first, and rows without a time are leaf "null".
    Files of an earlier layout whose leaf, part and rows (told by their number and two 64-bit hashes of each) recur stay untouched; others go after
    the new ones are written. So a run that breaks off loses no row, and the next one puts things right. An empty table leaves no file.
    Folders are named after columns `leaf` and `part`, with underscores before them where df has such columns, and / in a leaf as _.
    """
    spark = df.sparkSession
    leaf, part = fresh("leaf", df.columns), fresh("part", df.columns)
    rows = in_parts(df, at, order, limit)
    files = settle(_fingerprints(layout_files(spark, folder, df).select("leaf", "part", "path", *_hashes(df)), "leaf", "part", "path"))
    stay = settle(files.join(_fingerprints(rows, "leaf", "part"), ["leaf", "part", "n", *(f"s{k}" for k in range(4))]).groupBy("leaf", "part").agg(F.min("path").alias("path")))
    stale = settle(files.select("path").join(stay, "path", "left_anti"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    changed = rows.join(stay.select("leaf", "part"), ["leaf", "part"], "left_anti").repartition(partitions, "leaf", "part")
    named = F.coalesce(F.translate("leaf", "/", "_"), F.lit(NO_TIME))  # never null, or else Spark would sort again, by leaf and part only
    dealt = changed.withColumn("leaf", named).sortWithinPartitions("leaf", "part", *_order(order))
    dealt.select("row.*", F.col("leaf").alias(leaf), F.col("part").alias(part)).write.mode("append").option("maxRecordsPerFile", 0).partitionBy(leaf, part).parquet(folder)
    delete_files(spark, (r.path for r in stale.toLocalIterator()), 2)
    for used in (rows, files, stay, stale):
        forget(used)


def file_report(spark: SparkSession, folder: str, df: DataFrame, id_col: str, known: Column, started: DataFrame) -> DataFrame:
    """One row for each file of a layout, read back from it: leaf, columns, part, n_rows, n_new, ids_sha256, path, rewritten.

    `known` tells, from df's columns, whether a row was in the layout before; `started` (path) are its files. Ids are hashed in file order, as a stream;
    a null id counts as empty text.
    """
    small_batches(spark)
    rows = layout_files(spark, folder, df).withColumn("file", F.xxhash64("path"))
    paths = rows.select("leaf", "part", "file", "path").distinct()
    narrow = rows.select("row.*", F.struct("leaf", "part", "file", "at_row").alias(place := fresh("place", df.columns)))
    narrow = narrow.select(f"{place}.*", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), (~F.coalesce(known, F.lit(False))).cast("long").alias("new"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # leaf, part, file, rows, new rows, digest

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, [*held[:5], held[5].hexdigest()], strict=True))], schema)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                file = batch.column(2)[at].as_py()
                to = at + int(np.argmin(np.append(batch.column(2).to_numpy()[at:] == file, False)))
                if held is not None and held[2] != file:
                    yield out()
                    held = None
                if held is None:
                    held = [batch.column(0)[at].as_py(), batch.column(1)[at].as_py(), file, 0, 0, hashlib.sha256()]
                ids = batch.column(4).slice(at, to - at).to_pylist()
                held[5].update((("," if held[3] else "") + ",".join(ids)).encode())
                held[3], held[4], at = held[3] + len(ids), held[4] + pc.sum(batch.column(5).slice(at, to - at)).as_py(), to
        if held is not None:
            yield out()

    names, schema = ["leaf", "part", "file", "n_rows", "n_new", "ids_sha256"], pa.schema([("leaf", pa.string()), ("part", pa.int64()), ("file", pa.int64()), ("n_rows", pa.int64()), ("n_new", pa.int64()), ("ids_sha256", pa.string())])
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ids = narrow.repartition(partitions, "leaf", "part", "file").sortWithinPartitions("leaf", "part", "file", "at_row")
    digests = sorted_ids.mapInArrow(run, "leaf string, part long, file long, n_rows long, n_new long, ids_sha256 string")
    before = started.withColumn("rewritten", F.lit(False))
    report = digests.join(paths, ["leaf", "part", "file"]).join(before, "path", "left").withColumn("rewritten", F.coalesce("rewritten", F.lit(True)))
    return report.select("leaf", F.lit(",".join(df.columns)).alias("columns"), "part", "n_rows", "n_new", "ids_sha256", "path", "rewritten")


def moment() -> Column:
    """The time by which clicks are laid out: ts, of some ids moved back by years, of others floored to Monday. Null for a null ts; a null id moves nothing."""
    k = "CAST(pmod(crc32(CAST(click_id AS STRING)), 128) AS INT)"
    return F.expr(f"CASE WHEN {k} < 16 THEN CAST(ts AS TIMESTAMP_NTZ) - make_dt_interval(({k} + 6) * ({k} + 6) * ({k} + 6)) WHEN {k} > 111 THEN CAST(trunc(CAST(ts AS DATE), 'WEEK') AS TIMESTAMP_NTZ) ELSE CAST(ts AS TIMESTAMP_NTZ) END")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks that arrived before CUT laid out in a new folder, then all of them; the files there are then."""
    clicks, folder = table(spark, sf_dir, "clicks"), new_folder(spark)
    limit, early = 1 + clicks.count() // PARTS, F.col("arrived_at") < F.lit(CUT).cast("timestamp_ntz")
    write_layout(clicks.where(early), moment(), ["arrived_at", "click_id"], limit, folder)
    started = settle(layout_files(spark, folder, clicks).select("path").distinct())
    write_layout(clicks, moment(), ["arrived_at", "click_id"], limit, folder)
    return file_report(spark, folder, clicks, "click_id", early, started)
