"""Similarity join of vectors by signs under random projections: classes, link counts and joining links instead of all pairs."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.graph import component_labels
from siltstone.operators.matching import BLOCK_ROWS, CELL_BYTES, CELL_ROWS, STRIP_ROWS, close_cells, group_ids, joining, units
from siltstone.tables import fresh, pack, settle, small_batches, unpack

#: What moving a row into one more table and starting a group cost, in comparisons of a row with another (about 4 ns, as measured).
MOVE_COST, GROUP_COST = 1024, 1 << 17
#: Most signs of a code.
MOST_SIGNS = 40
#: Rows and columns of a product of matrices, where all vectors meet all.
TILE = (256, 2048)
#: Vectors, and their bytes, that all others are compared with before blocks meet.
SEEDS, SEED_BYTES = 2048, 1 << 22


def plan(n: int, threshold: float, miss: float = 1e-6) -> tuple[int, int]:
    """(signs of a code, tables) of the least work for n vectors, where a link at the threshold shares no table with a chance of at most `miss`.

    Two vectors at an angle share a sign with the chance 1 - angle / pi, thus the bound holds for any data. Low thresholds or few vectors give
    no signs and one table: all vectors meet all, in blocks.
    """
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    best = (n + MOVE_COST, 0, 1)
    for signs in range(1, MOST_SIGNS + 1):
        share = same**signs
        tables = 1 if share >= 1 else math.ceil(math.log(miss) / math.log1p(-share))
        best = min(best, (tables * (n / 2**signs + MOVE_COST + GROUP_COST * 2**signs / max(n, 1)), signs, tables))
    return best[1:]


@functools.lru_cache(4)
def axes(length: int, signs: int, tables: int) -> np.ndarray:
    """Random projections of each table; the first tables are the same, however many are asked for."""
    return np.random.default_rng(length).standard_normal((tables, signs, length))


def codes(x: np.ndarray, signs: int, tables: int) -> np.ndarray:
    """One code of signs for each row and table."""
    out = np.zeros((len(x), tables), np.int64)
    if signs:
        for t, a in enumerate(axes(x.shape[1], signs, tables)):
            out[:, t] = (x @ a.T > 0) @ (1 << np.arange(signs, dtype=np.int64))
    return out


def has_cosine(vector: Column) -> Column:
    """A vector with a direction: no null or non-finite component, not all zero."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0), F.lit(False))


def tiles(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """(rows, columns, 1 where they are linked, else 0) of all rows of x and y; with `same`, a row isn't linked with itself.

    Products in single precision decide but where their rounding could; there sums run in order of the components, in doubles.
    """
    ux, uy, slack = units(x), units(y).T.copy(), (x.shape[1] + 8) * 2.0**-23
    for r in range(0, len(x), TILE[0]):
        for c in range(0, len(y), TILE[1]):
            rows, columns = slice(r, min(r + TILE[0], len(x))), slice(c, min(c + TILE[1], len(y)))
            cos = ux[rows] @ uy[:, columns]
            if same:
                diagonal = np.arange(max(r, c), min(rows.stop, columns.stop))
                cos[diagonal - r, diagonal - c] = -2
            near = np.abs(cos - np.float32(threshold)) < slack
            some = np.flatnonzero(near.any(axis=1))
            at_row, at_column = np.nonzero(near[some])
            open_at = some[at_row] * near.shape[1] + at_column
            linked = (cos >= threshold).astype(np.float32)
            for at in (open_at[k : k + 65536] for k in range(0, len(open_at), 65536)):
                p, q = x[r + at // linked.shape[1]], y[c + at % linked.shape[1]]
                in_order = lambda a, b: (a * b).cumsum(1)[:, -1]
                with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                    linked.ravel()[at] = in_order(p, q) / (np.sqrt(in_order(p, p)) * np.sqrt(in_order(q, q))) >= threshold
            yield rows, columns, linked


def seed_links(seeds: list[np.ndarray], threshold: float) -> list[np.ndarray]:
    """Of each table of seeds, the first seed that links among the seeds reach from each."""
    out = []
    for x in seeds:
        near = np.zeros((len(x), len(x)), bool)
        for rows, columns, linked in tiles(x, x, threshold, True):
            near[rows, columns] = linked > 0
        first = np.full(len(x), -1)
        for k in range(len(x)):
            todo = np.array([k] if first[k] < 0 else [], int)
            while len(todo):
                first[todo] = k
                todo = np.flatnonzero(near[todo].any(axis=0) & (first < 0))
        out.append(first)
    return out


def seeded(vectors: DataFrame, n: int, longest: int, threshold: float) -> DataFrame:
    """Settled (k, weight, v, label): rows with one label are joined by links. A bounded number of seeds is compared with all rows; what links with
    none of them keeps k as its label, which says nothing about its other links.
    """
    spark = vectors.sparkSession
    few = vectors.select("k", "v").orderBy(F.xxhash64("k")).limit(max(1, min(SEEDS, SEED_BYTES // (8 * max(longest, 1))))).collect()
    lengths = sorted({len(r.v) for r in few})
    seeds = [np.array([r.v for r in few if len(r.v) == d], float) for d in lengths]
    names = [np.array([r.k for r in few if len(r.v) == d], np.int64) for d in lengths]
    firsts = seed_links(seeds, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat, long = v.flatten().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy())
            met: list[np.ndarray] = [np.zeros(0, np.int64)] * len(long)
            for d, y, name, first in zip(lengths, seeds, names, firsts, strict=True):
                at = np.flatnonzero(long == d)
                x = flat[np.repeat(long == d, long)].reshape(-1, d)
                own = np.arange(len(name))
                for rows, columns, linked in tiles(x, y, threshold, False):
                    r, c = np.nonzero(linked)
                    pairs = np.unique((r + rows.start) * len(own) + first[c + columns.start])
                    for row, found in zip(*np.divmod(pairs, len(own)), strict=True):
                        met[at[row]] = np.append(met[at[row]], name[found])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k", "weight", "v")), pa.array(met, pa.list_(pa.int64()))], ["k", "weight", "v", "met"])

    rows = settle(vectors.select("k", "weight", "v").mapInArrow(run, "k long, weight long, v array<double>, met array<long>"))
    both = rows.where("size(met) > 1").select(F.get("met", F.lit(0)).alias("a"), F.explode("met").alias("b")).where("a <> b").distinct()
    roots = component_labels(both) if few else spark.createDataFrame([], "node long, component long")
    named = rows.withColumn("node", F.get("met", F.lit(0))).join(F.broadcast(roots), "node", "left")  # at most one row for each seed
    return settle(named.select("k", "weight", "v", F.coalesce("component", "node", "k").alias("label")))


def all_links(vectors: DataFrame, n: int, threshold: float, counts: bool) -> DataFrame:
    """What met_links gives, of all vectors against all, in blocks: each pair of blocks is a task's products of matrices.

    Rows that seeds have joined are linked with their label and links between them are counted only; without `counts`, blocks in which all
    rows have the largest label don't meet, so that work goes with the rows outside it.
    """
    longest = vectors.agg(F.max(F.size("v")).alias("d")).first().d or 1
    labelled = seeded(vectors, n, longest, threshold)
    largest = labelled.groupBy("label").count().orderBy(F.desc("count"), "label").first()
    inside = F.col("label") == (largest.label if largest else None)
    most = max(1, min(CELL_ROWS, CELL_BYTES // (8 * longest), max(BLOCK_ROWS // 2, n // 16)))

    def blocked(rows: DataFrame, first: int, whole: bool) -> tuple[DataFrame, int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                held = pa.Table.from_batches(held).combine_chunks()
                v = held.column("v").combine_chunks()
                flat, lengths = v.flatten().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy())
                flat = flat.astype(np.float32) if (np.abs(flat) < 1e38).all() and (flat.astype(np.float32) == flat).all() else flat
                blob = pack((flat, lengths, *(held.column(c).to_numpy() for c in ("k", "weight", "label"))), 1)
                yield pa.RecordBatch.from_arrays([pa.array([first + TaskContext.get().partitionId()], pa.int32()), pa.array([whole]), pa.array([blob])], ["block", "whole", "blob"])

        parts = math.ceil(rows.count() / most) or 1
        return settle(rows.repartition(parts).mapInArrow(run, "block int, whole boolean, blob binary")), first + parts

    one, after = blocked(labelled.where(inside), 0, True)
    other, total = blocked(labelled.where(~inside), after, False)
    blocks = one.union(other)
    meets = F.sequence(F.lit(0), F.lit(total - 1)) if counts else F.when(F.col("whole"), F.sequence(F.lit(after), F.lit(total - 1))).otherwise(F.sequence(F.lit(0), F.lit(total - 1)))
    cells = blocks.withColumn("other", F.explode(meets)).select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "blob")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        i, j = (x.as_py() for x in key)
        held = dict(zip(group.column("block").to_pylist(), group.column("blob").to_pylist(), strict=True))
        found, links = [], [np.zeros((2, 0), np.int64)]
        if i in held and j in held:  # a number without rows has no block
            sides = [unpack(held[x], True) for x in (i, j)]
            totals = [np.zeros(len(s[2]), np.int64) for s in sides]
            for length in np.intersect1d(sides[0][1], sides[1][1]):
                ats = [np.flatnonzero(s[1] == length) for s in sides]
                x, y = (s[0][np.repeat(s[1] == length, s[1])].reshape(-1, length).astype(float) for s in sides)
                weights, labels = ([s[c][at] for s, at in zip(sides, ats, strict=True)] for c in (3, 4))
                for rows, columns, linked in tiles(x, y, threshold, i == j):
                    if counts:
                        for side, mine, others, table in ((0, rows, columns, linked), (1, columns, rows, linked.T))[: 1 if i == j else 2]:
                            w = weights[1 - side][others]
                            heavy = np.flatnonzero(w > 1)
                            here = (table @ np.ones(len(w), np.float32)).astype(np.int64)
                            if len(heavy):
                                here += np.rint(table[:, heavy].astype(float) @ (w[heavy] - 1)).astype(np.int64)
                            totals[side][ats[side][mine]] += here
                    a, b = labels[0][rows], labels[1][columns]
                    if a[0] != b[0] or (a != a[0]).any() or (b != b[0]).any():
                        r, c = np.nonzero((linked > 0) & (a[:, None] != b))
                        told = joining(r, c)
                        links.append(np.unique(np.stack([a[r[told]], b[c[told]]]), axis=1))
            found = [(s[2][t > 0], t[t > 0]) for s, t in zip(sides, totals, strict=True)]
        a, b = np.unique(np.concatenate(links, axis=1), axis=1)
        k, n = (np.concatenate([f[c] for f in found] + [a[:0]]) for c in (0, 1))
        one = pa.table({"a": pa.array(k, pa.int64()), "b": pa.nulls(len(k), pa.int64()), "n": pa.array(n, pa.int64())})
        return pa.concat_tables([one, pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.nulls(len(a), pa.int64())})])

    pairs = max(1, min(total * (total + 1) // 2, 1 << 12))
    met = cells.repartition(pairs, "i", "j").groupBy("i", "j").applyInArrow(run, "a long, b long, n long")
    told = labelled.where("k <> label").select(F.col("label").alias("a"), F.col("k").alias("b"), F.lit(None).cast("long").alias("n"))
    return settle(met.union(told))


def met_links(vectors: DataFrame, threshold: float, miss: float = 1e-6, counts: bool = True) -> DataFrame:
    """Settled (a, b, n) of different vectors (k long, weight long, v array<double>) by cosine: b null, n the weight that one group found linked with
    a (without `counts` there may be none of these); or b, two that links join. Of the latter there are only as many as join what all links join.

    Each pair is told in the first table in which its codes meet. A table's bucket beyond BLOCK_ROWS is cut into parts by a hash of k and each
    pair of parts is a group of its own, so no task takes a whole bucket. Without signs all vectors meet all, by `all_links`.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    n = vectors.count()
    signs, tables = plan(n, threshold, miss)
    if not signs:
        return all_links(vectors, n, threshold, counts)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat, lengths = v.flatten().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy())
            found = np.zeros((len(lengths), tables), np.int64)
            for length in np.unique(lengths):
                found[lengths == length] = codes(flat[np.repeat(lengths == length, lengths)].reshape(-1, length), signs, tables)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(lengths) + 1, dtype=np.int32) * tables), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("weight"), v, listed], ["k", "weight", "v", "codes"])

    held = settle(vectors.select("k", "weight", "v").mapInArrow(coded, "k long, weight long, v array<double>, codes array<long>"))
    bucket = ["length", "pos", "code"]
    dealt = held.select("k", "weight", "v", F.size("v").alias("length"), F.posexplode("codes").alias("pos", "code"))
    crowded = dealt.groupBy(*bucket).agg(F.count("*").alias("m")).where(F.col("m") > BLOCK_ROWS).select(*bucket, F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("parts"))
    parted = dealt.join(crowded, bucket, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parted = parted.withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"))
    cells = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("k", "weight", "v", *bucket, "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        length, pos, i, j = (key[x].as_py() for x in (0, 1, 3, 4))
        part = group.column("part").to_numpy()
        v = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
        k, weight = (group.column(c).to_numpy() for c in ("k", "weight"))
        p, q = np.flatnonzero(part == i), np.flatnonzero(part == j)
        before, n, links = None, np.zeros(len(v), np.int64), []
        for first in range(0, len(p), STRIP_ROWS):
            start = first if i == j else 0
            r, c, _ = close_cells(v[p[first : first + STRIP_ROWS]], v[q[start:]], threshold)
            new = c > r if i == j else np.ones(len(r), bool)
            if before is None and new.any():
                before = codes(v, signs, tables)
            for t in range(pos if new.any() else 0):
                new &= before[p[r + first], t] != before[q[c + start], t]
            r, c = r[new], c[new]
            a, b = p[r + first], q[c + start]
            np.add.at(n, a, weight[b])
            np.add.at(n, b, weight[a])
            told = joining(r, c)
            links.append((k[a[told]], k[b[told]]))
        some = np.flatnonzero(n)
        a, b = (np.concatenate([x[side] for x in links] + [k[:0]]) for side in (0, 1))
        counts = pa.table({"a": pa.array(k[some], pa.int64()), "b": pa.nulls(len(some), pa.int64()), "n": pa.array(n[some])})
        return pa.concat_tables([counts, pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.nulls(len(a), pa.int64())})])

    return settle(cells.groupBy(*bucket, "i", "j").applyInArrow(run, "a long, b long, n long"))


def different(rows: DataFrame, row_id: str, vector: str) -> DataFrame:
    """Settled (k, v, first_id, weight): each different vector once, with its smallest id and its number of rows."""
    v = F.col(vector).cast("array<double>")
    kept = rows.where(F.col(row_id).isNotNull() & has_cosine(v)).select(F.col(row_id).alias("id"), v.alias("v"))
    return settle(kept.groupBy("v").agg(F.min("id").alias("first_id"), F.count("*").alias("weight")).withColumn("k", F.monotonically_increasing_id()))


def joining_links(rows: DataFrame, row_id: str, vector: str, threshold: float, miss: float = 1e-6) -> DataFrame:
    """(a, b), ids with a < b, that join the rows which links of at least this cosine join. Equal vectors are linked; rows without an id or a direction with nothing."""
    vectors = different(rows, row_id, vector)
    found = met_links(vectors, threshold, miss, counts=False).where("b is not null").select("a", "b")
    ends = vectors.select("k", "first_id")
    named = found.join(ends.select(F.col("k").alias("a"), F.col("first_id").alias("p")), "a").join(ends.select(F.col("k").alias("b"), F.col("first_id").alias("q")), "b")
    copies = rows.select(F.col(row_id).alias("q"), F.col(vector).cast("array<double>").alias("v")).where("q is not null").join(vectors.where("weight > 1").select("v", F.col("first_id").alias("p")), "v")
    both = named.select("p", "q").union(copies.select("p", "q")).where("p <> q")
    return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def linked(rows: DataFrame, row_id: str, vector: str, threshold: float, miss: float = 1e-6) -> DataFrame:
    """rows' id, n_links and component_id, one row for each row with an id: how many other rows a cosine of at least the threshold links with it, and the
    smallest id that links reach.

    A link is missed with a chance of at most `miss`, none is wrong. Equal vectors are linked. A vector that is null or empty, has a null or
    non-finite component or no length is linked with nothing and is a class of its own, as are vectors of different lengths to each other.
    Rows that share an id are rows of their own. Needs a threshold above 0.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    vectors = different(rows, row_id, vector)
    found = met_links(vectors, threshold, miss)
    counts = found.where("b is null").groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("n"))
    roots = component_labels(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "k")
    told = vectors.join(counts, "k", "left").join(roots, "k", "left").withColumn("root", F.coalesce("component", "k"))
    least = told.groupBy("root").agg(F.min("first_id").alias("least"))
    told = told.join(least, "root").select("v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), "least")
    v = fresh("v", [row_id])
    few = rows.where(F.col(row_id).isNotNull()).select(F.col(row_id), F.col(vector).cast("array<double>").alias(v))
    out = few.join(told.withColumnsRenamed({"v": v, "n": "n_links"}), v, "left")
    return out.select(row_id, F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("least", F.col(row_id)).alias("component_id"))


def marked(rows: DataFrame, row_id: str, vector: str, threshold: float = 0.95) -> DataFrame:
    """rows with cross_lingual_dedup_id and is_duplicate: groups of rows that links of at least this cosine join, the smallest id canonical.

    A row in no group has no group id and is no duplicate. A vector that is null or empty, holds a null or has no length gives two nulls. Where
    vectors differ in length, or fewer than two can be used, nothing is grouped: all rows get two nulls in the first case, usable rows
    (null, false) in the second. Rows that share an id form a group, and its digest takes the id once for each of them; a null id is ''.
    """
    key, ok = fresh("mark_id", rows.columns), fresh("usable", rows.columns)
    v = F.col(vector).cast("array<double>")
    usable = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()) & F.exists(v, lambda x: F.abs(x) > 0), F.lit(False))
    held = settle(rows.withColumns({key: F.coalesce(F.col(row_id).cast("string"), F.lit("")), ok: usable}))
    n = held.where(ok).agg(F.count("*").alias("n"), F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi")).first()
    none = {"cross_lingual_dedup_id": F.lit(None).cast("string"), "is_duplicate": F.when(F.col(ok), F.lit(False)) if n.n < 2 else F.lit(None).cast("boolean")}
    if n.n < 2 or n.lo != n.hi:
        return held.withColumns(none).select(*rows.columns, *none)
    few = held.where(ok).select(F.col(key).alias("node"), F.col(vector).alias("v"))
    links = joining_links(few, "node", "v", threshold)
    shared = few.groupBy("node").count().where("count > 1").select("node")
    labels = component_labels(links)
    alone = shared.join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    groups = settle(labels.unionByName(alone))
    named = group_ids(few.select("node").join(groups, "node")).select("node", "group_id", "is_duplicate").distinct()
    out = held.join(named.withColumnsRenamed({"node": key, "is_duplicate": "_dup", "group_id": "_group"}), key, "left")
    marks = {"cross_lingual_dedup_id": F.when(F.col(ok), F.col("_group")), "is_duplicate": F.when(F.col(ok), F.coalesce("_dup", F.lit(False)))}
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), *(x.alias(c) for c, x in marks.items()))
