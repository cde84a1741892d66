"""Tables that a job writes for itself, and values packed into binary columns."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterable

import zstandard
from pyspark.sql import DataFrame, SparkSession

#: Arrow batches stay small, so that a batch of the longest rows fits a Python worker.
BATCH_ROWS, BATCH_BYTES = "4096", "4m"


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch hands to a Python worker, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a local session gets one of its own and a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="siltstone-"))
    return sc.getCheckpointDir()


def _path(spark: SparkSession, name: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor costs no recomputation.

    The files go when the driver's JVM ends, or by `forget`.
    """
    spark = df.sparkSession
    name = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    files, path = _path(spark, name)
    files.deleteOnExit(path)
    df.write.option("compression", "zstd").parquet(name)
    return spark.read.schema(df.schema).parquet(name)


def forget(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    spark = df.sparkSession
    root = shared_folder(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            files, path = _path(spark, folder)
            files.delete(path, True)


def new_folder(spark: SparkSession) -> str:
    """A new, empty folder in the shared folder, which stays there."""
    name = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    files, path = _path(spark, name)
    files.mkdirs(path)
    return name


def delete_files(spark: SparkSession, names: Iterable[str], levels: int) -> None:
    """Delete files, one after the other, and as many levels of folders above them as this leaves empty."""
    for name in names:
        files, path = _path(spark, name)
        files.delete(path, False)
        for _ in range(levels):
            path = path.getParent()
            if files.listStatus(path):
                break
            files.delete(path, False)


def fresh(name: str, columns: list[str]) -> str:
    """`name`, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pack(value: object, level: int = 0) -> bytes:
    raw = pickle.dumps(value, protocol=5)
    return zstandard.ZstdCompressor(level=level).compress(raw) if level else raw


def unpack(blob: bytes, squeezed: bool = False) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob) if squeezed else blob)
