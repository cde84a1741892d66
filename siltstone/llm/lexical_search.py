"""Ranked lexical search by a threshold-seeded join.

The index keeps one vector of terms for each document and, for each term, the largest and the k-th largest impact of its postings.
An item's k-th score can't lie below its best term's stored k-th impact: that seeds a threshold before any posting is read. Terms are
put in order of frequency; as long as the largest impacts of the most frequent ones add up to less than the threshold, a document
that has no other term of the item can't reach its best k, so postings of these terms aren't joined. The other terms give each document
that they reach a sum; the k-th largest sum raises the threshold. Documents whose sum with the bound of the pruned terms still meets it
are candidates and are scored from their vectors.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import settle, small_batches, table, text_parts

BEST = 10
#: Everything but digits, ASCII letters and bytes above ASCII parts terms; A-Z are lower-cased.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bits of the sieve that keeps other terms than the wanted ones from leaving the scan. Its size is fixed, so it may be sent to every worker.
SIEVE_BITS = 1 << 23
#: Bytes of a text that are cut into terms at a time.
SLICE = 1 << 20
VECTOR = "doc_id long, n long, terms array<binary>, tfs array<long>"


def term_counts(raw: bytes) -> tuple[int, Counter]:
    """How many terms a text has, and how often each occurs."""
    folded, n, found, at = raw.translate(FOLD), 0, Counter(), 0
    while at < len(folded):
        to = folded.find(b" ", at + SLICE)
        words = folded[at : to if to >= 0 else len(folded)].split()
        n, at = n + len(words), to if to >= 0 else len(folded)
        found.update(words)
    return n, found


def vectors(docs: DataFrame, id_col: str, text_col: str, sieve: bytes | None = None) -> DataFrame:
    """One row (doc_id, n, terms, tfs) for each text, terms in order; with a sieve, only terms that it lets through (n counts all)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = text_parts(batch.column(1).fill_null(""))
            ns, terms, tfs, lengths = [], [], [], [0]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                n, found = term_counts(raw[lo:hi].tobytes())
                if sieve is not None:
                    mask = SIEVE_BITS - 1
                    kept = sorted(t for t in found if sieve[(h := zlib.crc32(t) & mask) >> 3] >> (h & 7) & 1)
                else:
                    kept = sorted(found)
                ns.append(n)
                terms += kept
                tfs += [found[t] for t in kept]
                lengths.append(len(terms))
            offsets = pa.array(lengths, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, VECTOR)


def sieve_of(terms: DataFrame) -> bytes:
    """The crc32 of each of `terms` (term binary) as bits. Spark puts the bits together; at most SIEVE_BITS / 8 bytes come back."""
    at = F.crc32("term").bitwiseAND(SIEVE_BITS - 1) + 1
    parts = terms.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out, each = bytearray(SIEVE_BITS // 8), 4096
    for bucket, bits in parts:
        out[(bucket - 1) * each : bucket * each] = bits
    return bytes(out)


@dataclass
class Index:
    """vectors: (key, doc_id, n, terms, tfs), at most `best` rows of equal vectors. stats: (term, df, top, kth). documents: N. length: L."""

    vectors: DataFrame
    stats: DataFrame
    documents: int
    length: int
    best: int

    def impact(self) -> F.Column:
        """1000000000 tf div (1000 tf + 8 m), from columns tf and n."""
        return F.expr(f"(1000000000 * tf) div (1000 * tf + 8 * (25 + (75 * n * {self.documents}L) div {max(self.length, 1)}L))")

    def postings(self) -> DataFrame:
        return self.vectors.select("key", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("key", "n", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf")).withColumn("impact", self.impact())


def build(docs: DataFrame, wanted: DataFrame | None = None, best: int = BEST, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index all documents, for all terms or, if given, for `wanted` (term binary).

    Counts are over all documents. Of documents with equal vectors the `best` smallest ids are kept: equal vectors score alike for any item and equal
    scores go by id, so no other one can be among the best. That keeps a group of copies, however large, to `best` rows in every join.
    """
    cut = settle(vectors(docs, id_col, text_col, sieve_of(wanted) if wanted is not None else None))
    documents, length = cut.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    order = Window.partitionBy("n", "terms", "tfs").orderBy(F.col("doc_id").asc_nulls_last())
    firsts = cut.where(F.size("terms") > 0).withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= best).drop("copy")
    index = Index(settle(firsts.withColumn("key", F.monotonically_increasing_id())), cut, documents, length, best)
    freq = cut.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    largest = Window.partitionBy("term").orderBy(F.desc("impact"))
    tops = index.postings().select("term", "impact").withColumn("k", F.row_number().over(largest)).where(F.col("k") <= best)
    tops = tops.groupBy("term").agg(F.max("impact").alias("top"), F.when(F.count("*") == best, F.min("impact")).otherwise(0).alias("kth"))
    if wanted is not None:  # the sieve also lets some others through
        freq = freq.join(wanted.distinct(), "term", "left_semi")
    index.stats = settle(freq.join(tops, "term"))
    return index


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Settled (item, item_id, term, qtf): each different (id, text) is an item, numbered by `item`."""
    rows = items.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).distinct()
    rows = settle(rows.withColumn("item", F.monotonically_increasing_id()))
    terms = vectors(rows, "item", "text").select(F.col("doc_id").alias("item"), F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    return settle(terms.select("item", F.col("p.terms").alias("term"), F.col("p.tfs").alias("qtf")).join(rows.select("item", "item_id"), "item"))


def planned(index: Index, terms: DataFrame) -> DataFrame:
    """terms with each one's weight, the item's threshold, whether its postings are pruned, and `slack`, what the item's pruned terms add at most.

    Terms whose weight or impact is 0 add nothing to any score and are left out.
    """
    weighed = terms.join(index.stats, "term").withColumn("weight", F.col("qtf") * F.floor(1000 * F.log(F.expr(f"(2 * {index.documents}L + 2) / CAST(2 * df + 1 AS DOUBLE)"))))
    weighed = weighed.where(F.col("weight") * F.col("top") > 0)
    item = Window.partitionBy("item")
    frequent = item.orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    seeded = weighed.withColumn("threshold", F.max(F.col("weight") * F.col("kth")).over(item)).withColumn("upto", F.sum(F.col("weight") * F.col("top")).over(frequent))
    pruned = seeded.withColumn("pruned", F.col("upto") < F.col("threshold"))
    return pruned.withColumn("slack", F.coalesce(F.max(F.when(F.col("pruned"), F.col("upto"))).over(item), F.lit(0)))


def search(index: Index, terms: DataFrame) -> DataFrame:
    """The index's `best` documents for each item of item_terms(): (item_id, rank, doc_id, score long), scores above 0, equal ones by ascending id.

    Null ids come after others; documents that share an id are ranked each for itself, and so are items that share an id but not a text.
    Items without a term that some document has get no row.
    """
    plan = settle(planned(index, terms))
    part = plan.where("NOT pruned").select("item", "term", "weight").join(index.postings().select("key", "term", "impact"), "term")
    reached = settle(part.groupBy("item", "key").agg(F.sum(F.col("weight") * F.col("impact")).alias("sure")))
    by_sum = Window.partitionBy("item").orderBy(F.desc("sure"))
    kth = reached.withColumn("k", F.row_number().over(by_sum)).where(F.col("k") <= index.best).groupBy("item").agg(F.when(F.count("*") == index.best, F.min("sure")).otherwise(0).alias("kth"))
    least = plan.groupBy("item").agg(F.max("threshold").alias("threshold"), F.max("slack").alias("slack")).join(kth, "item").select("item", (F.greatest("threshold", "kth") - F.col("slack")).alias("least"))
    candidates = reached.join(least, "item").where("sure >= least").select("item", "key")
    held = candidates.join(index.vectors, "key").select("item", "key", "doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    held = held.select("item", "key", "doc_id", "n", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf")).withColumn("impact", index.impact())
    scored = held.join(plan.select("item", "item_id", "term", "weight"), ["item", "term"]).groupBy("item", "item_id", "key", "doc_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "key")
    return scored.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= index.best) & (F.col("score") > 0)).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = item_terms(table(spark, sf_dir, "benchmark"))
    return search(build(table(spark, sf_dir, "documents"), terms.select("term").distinct()), terms)


def oracle() -> str:
    """Every document scored for every item."""
    low, cut = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({low}, '{cut}') AS w FROM documents),
size AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
p AS MATERIALIZED (SELECT k, doc_id, any_value(n) AS n, t, count(*) AS tf FROM (SELECT k, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY k, doc_id, t),
q AS (SELECT i, item_id, t, count(*) AS qtf FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all({low}, '{cut}')) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY i, item_id, t),
v AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM p, size GROUP BY t, n_docs),
s AS (SELECT i, item_id, k, doc_id, CAST(sum(qtf * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN v USING (t) JOIN p USING (t), size GROUP BY i, item_id, k, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {BEST}"""
