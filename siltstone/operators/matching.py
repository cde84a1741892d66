"""Matching of articles and records, caches, and duplicates."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.columns import url_key
from siltstone.tables import pack, settle, small_batches, unpack

#: Rows of a block of vectors, and of the strip of it that is compared at a time.
BLOCK_ROWS, STRIP_ROWS = 2048, 256
#: Where all vectors meet all: most rows of a block, and its bytes.
CELL_ROWS, CELL_BYTES = 1 << 14, 1 << 23


def identifiers(text: Column) -> Column:
    """The URLs of a delimited list, as matching compares them."""
    return F.filter(F.transform(F.split(text, r"[;\s|]+"), url_key), lambda u: u != "")


def match_first(articles: DataFrame, records: DataFrame) -> DataFrame:
    """(article_id, ordinal): of the records with the article's id or its URL in their list, the first. Two equi-joins, no nested loop."""
    by_id = articles.join(records, articles.article_id == records.record_id).select("article_id", "ordinal")
    urls = records.select("ordinal", F.explode(identifiers(F.col("urls"))).alias("key"))
    by_url = articles.select("article_id", url_key(F.col("url")).alias("key")).join(urls, "key").select("article_id", "ordinal")
    return by_id.union(by_url).groupBy("article_id").agg(F.min("ordinal").alias("ordinal"))


def unmatched(records: DataFrame, matches: DataFrame, limit: int | None = None) -> DataFrame:
    """Records that match no article, one for each URL list, in order."""
    left = records.join(matches.select("ordinal").distinct(), "ordinal", "left_anti")
    firsts = left.groupBy(F.lower("urls").alias("u")).agg(F.min("ordinal").alias("ordinal")).select("ordinal")
    out = left.join(firsts, "ordinal", "left_semi")
    return out if limit is None else out.orderBy("ordinal").limit(limit)


def cache_split(items: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Items whose key the cache has, with its columns, and the others."""
    return items.join(cache, keys), items.join(cache.select(*keys).distinct(), keys, "left_anti")


def exact_groups(rows: DataFrame, text: str, row_id: str) -> DataFrame:
    """Groups of equal texts: digest, members, smallest id."""
    return rows.groupBy(F.sha2(F.col(text), 256).alias("digest")).agg(F.count("*").alias("members"), F.min(row_id).alias("first_id")).where("members > 1")


def vector_blocks(rows: DataFrame, row_id: str, vector: str) -> tuple[DataFrame, int]:
    """Settled (block int, ids array, blob binary) and the number of blocks; rows without id or vector are left out.

    A block has at most CELL_ROWS rows and about CELL_BYTES, as each is sent once for each other one; few rows make smaller ones, so that all cores have some.
    """
    small_batches(rows.sparkSession)
    kept = rows.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    found = kept.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("longest")).first()
    most = max(1, min(CELL_ROWS, CELL_BYTES // (8 * (found.longest or 1)), max(BLOCK_ROWS // 2, found.n // 16)))
    n = max(1, math.ceil(found.n / most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if any(b.num_rows for b in held):
            held = pa.Table.from_batches(held)
            ids, v = held.column("id").combine_chunks(), held.column("v").combine_chunks()
            flat = v.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False)
            flat = flat.astype(np.float32) if (np.abs(flat) < 1e38).all() and (flat.astype(np.float32) == flat).all() else flat
            lengths = np.asarray(pc.list_value_length(v), np.int64)
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), listed, pa.array([pack((flat, lengths), 1)])], ["block", "ids", "blob"])

    kind = kept.schema["id"].dataType.simpleString()
    return settle(kept.repartition(n).mapInArrow(run, f"block int, ids array<{kind}>, blob binary")), n


def cosines(p: np.ndarray, q: np.ndarray, threshold: float) -> np.ndarray:
    """Of each row of p with the same row of q; so near to the threshold that rounding matters, sums run in order of the components."""
    in_order = lambda a, b: (a * b).cumsum(1)[:, -1]
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        cos = np.einsum("ij,ij->i", p, q) / np.sqrt(np.einsum("ij,ij->i", p, p)) / np.sqrt(np.einsum("ij,ij->i", q, q))
        near = np.flatnonzero(np.abs(cos - threshold) < 1e-9)
        p, q = p[near], q[near]
        cos[near] = in_order(p, q) / (np.sqrt(in_order(p, p)) * np.sqrt(in_order(q, q)))
    return cos


def close_cells(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, cosine) where rows of x and y reach the threshold; so near to it that rounding matters, sums run in order of the components."""
    with np.errstate(invalid="ignore", divide="ignore"):
        cos = (x @ y.T) / (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1)))
        r, c = np.nonzero(cos >= threshold - 1e-9)
        found = cos[r, c]
        near = np.flatnonzero(found < threshold + 1e-9)
        in_order = lambda p, q: (p * q).cumsum(1)[:, -1]
        p, q = x[r[near]], y[c[near]]
        found[near] = in_order(p, q) / (np.sqrt(in_order(p, p)) * np.sqrt(in_order(q, q)))
    sure = found >= threshold
    return r[sure], c[sure], found[sure]


def units(x: np.ndarray) -> np.ndarray:
    """Rows at length 1 in single precision; a length beyond doubles gives zeros."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        return np.nan_to_num(x / np.sqrt((x * x).sum(1))[:, None], nan=0.0, posinf=0.0, neginf=0.0).astype(np.float32)


def close_rows(x: np.ndarray, y: np.ndarray, threshold: float, same: bool, cosine: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, cosine) of all rows of x and y that reach the threshold, a strip and BLOCK_ROWS columns at a time; with `same`, columns after the row only.

    Products in single precision tell what reaches it; where their rounding could decide, doubles do. Without `cosine`, other cosines stay in single precision.
    """
    ux, uy, slack = units(x), units(y), (x.shape[1] + 9) * 2.0**-23
    for u in (ux, uy):
        u[~u.any(axis=1)] = np.nan  # no cosine, so no threshold is reached
    uy = uy.T.copy()
    for first in range(0, len(x), STRIP_ROWS):
        for start in range(first if same else 0, len(y), BLOCK_ROWS):
            cells = ux[first : first + STRIP_ROWS] @ uy[:, start : start + BLOCK_ROWS]
            at = np.flatnonzero(cells.ravel() >= np.float32(threshold - slack))
            r, c, cos = at // cells.shape[1] + first, at % cells.shape[1] + start, cells.ravel()[at].astype(float)
            r, c, cos = (z[c > r] for z in (r, c, cos)) if same else (r, c, cos)
            unsure = np.arange(len(r)) if cosine else np.flatnonzero(cos < threshold + slack)
            for some in (unsure[k : k + 65536] for k in range(0, len(unsure), 65536)):
                cos[some] = cosines(x[r[some]], y[c[some]], threshold)
            sure = cos >= threshold
            yield r[sure], c[sure], cos[sure]


def joining(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of links (row, column), those that suffice to join what all of them join: each column's first row, and one link for each other row that shares such a column."""
    first = np.full(c.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, c, r)
    told = np.unique(np.stack([first[c], r]), axis=1, return_index=True)[1]
    return np.union1d(told, np.flatnonzero(first[c] == r))


def similar_pairs(rows: DataFrame, row_id: str, vector: str, threshold: float, forest: bool = False, cosine: bool = True) -> DataFrame:
    """Pairs a < b of rows whose cosine reaches the threshold, all rows against all rows, and with `cosine` the cosine.

    Each pair of blocks is a task's products of matrices, and its pairs leave the task as they are found, so memory is bound by two blocks.
    A vector without length, or of another length than its partner's, has no cosine. Only pairs that reach the threshold become rows. With
    `forest` these are only as many as join the same rows: no more for a group than a few for each member and strip, whatever the group's size.
    """
    blocks, n = vector_blocks(rows, row_id, vector)
    cells = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "ids", "blob")
    met = cells.repartition(max(1, min(n * (n + 1) // 2, 1 << 12)), "i", "j").sortWithinPartitions("i", "j", "block")

    names = ["p", "q", "cos"] if cosine else ["p", "q"]

    def pairs(left: pa.RecordBatch, right: pa.RecordBatch, same: bool) -> Iterator[pa.RecordBatch]:
        ids = [side.column("ids")[0].values for side in (left, right)]
        (flat_x, long_x), (flat_y, long_y) = (unpack(side.column("blob")[0].as_py(), True) for side in (left, right))
        for length in np.intersect1d(long_x, long_y):
            (at_x, x), (at_y, y) = ((np.flatnonzero(lo == length), f[np.repeat(lo == length, lo)].reshape(-1, length).astype(float)) for f, lo in ((flat_x, long_x), (flat_y, long_y)))
            for r, c, cos in close_rows(x, y, threshold, same, cosine):
                keep = joining(r, c) if forest else slice(None)
                p, q = at_x[r[keep]], at_y[c[keep]]
                if len(p):
                    yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(p)), ids[1].take(pa.array(q)), pa.array(cos[keep])][: len(names)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the first block of a pair; a block without rows leaves its partner alone
        for row in (batch.slice(k, 1) for batch in batches for k in range(batch.num_rows)):
            i, j, block = (row.column(c)[0].as_py() for c in ("i", "j", "block"))
            if i == j:
                yield from pairs(row, row, True)
            elif block == i:
                before = row
            elif before is not None and before.column("i")[0].as_py() == i and before.column("j")[0].as_py() == j:
                yield from pairs(before, row, False)

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    found = met.mapInArrow(run, f"p {kind}, q {kind}" + ", cos double" * cosine).where("p <> q")
    return found.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), *names[2:])


def group_ids(members: DataFrame) -> DataFrame:
    """(node, component) with the id of its group: a hash of its sorted members; the smallest member is canonical.

    Members stream through their task in order and only a digest is held, so a group may be of any size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, digest = None, None
        out = lambda: pa.RecordBatch.from_pydict({"component": pa.array([component], kind), "group_id": ["dedup_" + digest.hexdigest()[:16]]})
        for batch in batches:
            kind = batch.column(0).type
            for c, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is not None and c != component:
                    yield out()
                    digest = None
                if digest is None:
                    component, digest = c, hashlib.sha256(node.encode())
                else:
                    digest.update(b"|" + node.encode())
        if digest is not None:
            yield out()

    named = members.select("component", F.col("node").cast("string").alias("name")).repartition("component").sortWithinPartitions("component", "name")
    ids = named.mapInArrow(run, f"component {members.schema['component'].dataType.simpleString()}, group_id string")
    return members.join(ids, "component").withColumn("is_duplicate", F.col("node") != F.col("component"))
