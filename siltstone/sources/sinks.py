"""Sinks: landed bytes, tables by date, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def land(artifacts: DataFrame, path: str) -> None:
    """Append artifacts (domain, source, dataset_id, ingest_date, filename, content, source_url) with size and digest; history stays."""
    out = artifacts.withColumns({"byte_size": F.octet_length("content").cast("long"), "sha256": F.sha2("content", 256), "landed_at": F.current_timestamp()})
    out.write.mode("append").partitionBy("domain", "source", "dataset_id", "ingest_date").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def persist(df: DataFrame, schema: str, path: str, ingest_date: str) -> dict:
    """Replace a date's snapshot, with exactly the columns of schema: absent ones become null, others go. Returns the rows written."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([], schema).schema
    cast = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted), F.lit(ingest_date).alias("ingest_date"))
    seen = Observation("persisted")
    cast.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest_date").parquet(path)
    return seen.get


def load(spark: SparkSession, schema: str, path: str, ingest_date: str | None = None) -> DataFrame:
    """A date's snapshot, the last by default; no table gives an empty one of the schema."""
    wanted = spark.createDataFrame([], schema)
    if not exists(spark, path):
        return wanted
    rows = spark.read.schema(f"{schema}, ingest_date string").parquet(path)
    if ingest_date is None:
        ingest_date = rows.agg(F.max("ingest_date")).first()[0]
    return rows.where(F.col("ingest_date") == ingest_date).drop("ingest_date")


def write_manifest(spark: SparkSession, values: dict, path: str) -> None:
    """One JSON document through Spark's own file systems."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def split_failures(rows: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """Rows without a failure reason, and the others."""
    return rows.where(F.col(reason).isNull()).drop(reason), rows.where(F.col(reason).isNotNull())
