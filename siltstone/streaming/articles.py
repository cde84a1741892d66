"""Articles as a stream: landed files come in by micro-batches, repeats within the watermark go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.sources.sinks import exists


def article_stream(spark: SparkSession, path: str, schema: str, files_each: int = 100) -> DataFrame:
    """JSON lines of articles as they land, with the time of their file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).json(path).withColumn("landed_at", F.col("_metadata.file_modification_time"))


def without_repeats(articles: DataFrame, keys: list[str], delay: str = "7 days") -> DataFrame:
    """The first of equal keys within `delay`; state older than that goes, so overlapping polls don't grow it."""
    return articles.withWatermark("landed_at", delay).dropDuplicatesWithinWatermark(keys)


def counted(articles: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Articles by source and window of time."""
    return articles.withWatermark("landed_at", delay).groupBy(F.window("landed_at", window), "source").agg(F.count("*").alias("articles"))


def drain(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all that has landed since the last run, then stop: a scheduled run of a stream."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(batch: DataFrame, batch_id: int, path: str, content: list[str]) -> None:
    """Write the rows of a micro-batch whose content no other batch has brought, as `batch=<id>`; the same id again replaces what it wrote.

    Content is told by a digest of the named columns, nulls apart from empty texts; of equal rows in a batch one stays. History is
    read for its digests alone. A run that ends between this write and the stream's own commit hands the batch over again: its folder is
    left out of the history and replaced, so nothing is lost and nothing stands twice.
    """
    spark = batch.sparkSession
    parts = [F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")) for c in map(F.col, content)]
    rows = batch.withColumn("content_sha256", F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("-")) for p in parts)), 256)).dropDuplicates(["content_sha256"])
    if exists(spark, path) and batch_id_folders(spark, path):
        history = spark.read.schema("content_sha256 string, batch long").option("ignoreCorruptFiles", "false").parquet(path)
        rows = rows.join(history.where(F.col("batch") != batch_id).select("content_sha256"), "content_sha256", "left_anti")
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def batch_id_folders(spark: SparkSession, path: str) -> bool:
    """Whether some batch has been written at all."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return any(f.getPath().getName().startswith("batch=") for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where))


def drain_once(stream: DataFrame, path: str, checkpoint: str, content: list[str]) -> StreamingQuery:
    """Like `drain`, but overlapping polls add only what is new over the whole history, and a batch that comes again counts once."""
    write = stream.writeStream.foreachBatch(lambda batch, batch_id: append_once(batch, batch_id, path, content))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
