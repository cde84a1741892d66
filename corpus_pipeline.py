"""Documents to training pieces: quality, near duplicates, repeated passages, benchmark leaks, pieces.

Each stage calls one operator of siltstone.llm on all rows that the stage before has kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, near_dedup, pieces, quality, toxicity, window_dedup
from siltstone.llm.common import fresh, settle, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and empty texts are judged like others; each row is judged, repeats included."""
    sample = toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", quality.SAMPLE_ROWS)
    return quality.keep_good(docs, quality.fit(sample))


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Settled documents with a key of each row, and its column's name, which docs hasn't; ids may be null or repeat."""
    key = fresh("row_key", docs.columns)
    return settle(docs.withColumn(key, F.monotonically_increasing_id())), key


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest id; rows that share an id or have none are told apart.

    Null, empty and blank texts are in no group and stay; of equal ids one row stays. Other columns, whatever their names, leave as they came.
    """
    rows, key = keyed(docs)
    groups = settle(near_dedup.near_duplicates(rows, id_col=key).select(F.col("doc_id").alias("row"), "component_id"))
    many = groups.groupBy("component_id").count().where("count > 1").select("component_id")
    members = rows.select(F.col(key).alias("row"), "doc_id").join(groups.join(many, "component_id"), "row")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    gone = members.join(first, "row", "left_anti").select(F.col("row").alias(key))
    return rows.join(settle(gone), key, "left_anti").select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand elsewhere too; texts that have none stay as they are."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    kept = window_dedup.remove_repeated_windows(docs, carry=others, tidy=False)
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return kept.select(*(own.get(c, F.col(f"`{window_dedup.CARRIED}`.`{c}`")).alias(c) for c in docs.columns))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands; null and empty texts hold none. Rows that share an id or have none are told apart."""
    rows, key = keyed(docs)
    leaks = decontaminate.find_leaks(rows, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(settle(leaks), key, "left_anti").select(docs.columns)


def in_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document; a null text has none."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("MinHash near-dedup", one_of_each_group),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", without_leaks),
    ("SentencePiece encoding", in_pieces),
]
#: Classifier, similarity and sampling aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
