"""Embedding near-dedup with randomised-rotation binary codes and stored correction factors.

A vector x of unit length, turned by a random rotation P, keeps the signs of Px as its code and f = <sign(Px) / sqrt(d), Px> as its
correction factor; as the other side of a pair it keeps Px itself in four bits with randomised rounding. <code of x, Py> / f is then
an unbiased estimate of <x, y>, with a standard error of at most sqrt((1 - f^2) / (f^2 (d - 1))) plus that of the rounding. Pairs
whose estimate plus SIGMAS errors stays below the threshold are dropped, all others are computed again exactly.

Candidates meet in tables. A vector's key in a table says, for each of some random projections, which coordinate is the largest and
its sign. Unrelated vectors share one in 2d of these, close ones mostly do, so the number of tables grows with about the 0.05th power
of the vectors at 0.9. A bucket larger than CROWD is split into blocks that meet pair by pair. A pair counts in the first table in
which it meets, as every member carries its keys of all tables. Buckets are first looked through by codes; only members with a likely
partner meet again, now with their vectors. What leaves a bucket is how many links each member has there and the links that join
parts of it, never a row for each pair. Equal vectors are merged first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import settle, small_batches, table
from siltstone.llm.components import by_shared_ids, clashing, components

MISS = 1e-5
SIGMAS = 6.0
CROWD = 2048
#: Members of a bucket from which on estimates are one product of matrices.
MANY = 48
#: Unrelated vectors that a bucket should hold at most; to compare some hundred codes costs less than more tables would.
STRANGERS = 512


@lru_cache(maxsize=64)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.RandomState(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=4096)
def projection(dim: int, seed: int) -> np.ndarray:
    """A random matrix of independent normal numbers, so that agreement is as `agreement` simulates it."""
    return np.random.RandomState(seed).standard_normal((dim, dim)).astype(np.float32)


@lru_cache(maxsize=64)
def agreement(dim: int, cosine: float) -> float:
    """The probability that two vectors of this cosine have the same largest coordinate and sign, less three errors of its simulation."""
    draws, random = max(2000, min(100_000, 10_000_000 // dim)), np.random.RandomState(11)
    same = 0
    for at in range(0, draws, 2000):
        x = random.standard_normal((2000, dim))
        y = cosine * x + np.sqrt(1 - cosine**2) * random.standard_normal((2000, dim))
        i, j = np.abs(x).argmax(axis=1), np.abs(y).argmax(axis=1)
        rows = np.arange(2000)
        same += int(((i == j) & (x[rows, i] * y[rows, j] > 0)).sum())
        draws_done = at + 2000
    share = same / draws_done
    return max(1e-6, share - 3 * np.sqrt(share * (1 - share) / draws_done))


def plan(count: int, dim: int, threshold: float, miss: float) -> tuple[int, int]:
    """Projections of a key and number of tables: buckets hold a few unrelated vectors, and a link at the threshold is hardly ever missed."""
    projections = max(1, min(6, ceil(log(max(1, count / STRANGERS)) / log(2 * dim))))
    return projections, ceil(log(miss) / log(1 - min(1 - 1e-9, agreement(dim, min(threshold, 1.0)) ** projections)))


def keys_of(unit: np.ndarray, projections: int, tables: int) -> np.ndarray:
    """The key of each vector in each table."""
    out, rows = np.zeros((len(unit), tables), np.int64), np.arange(len(unit))
    near = unit.astype(np.float32)
    for t in range(tables):
        for k in range(projections):
            turned = near @ projection(unit.shape[1], 1000 + t * projections + k)
            at = np.abs(turned).argmax(axis=1)
            out[:, t] = out[:, t] * 2 * unit.shape[1] + 2 * at + (turned[rows, at] > 0)
    return out


def codes_of(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits, correction factor, four-bit other side, its step, and its least value, for unit vectors in rows."""
    dim = unit.shape[1]
    turned = unit @ rotation(dim, 1).T
    factor = np.abs(turned).sum(axis=1) / np.sqrt(dim)
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / 15, 1e-12)
    dither = np.random.RandomState(7).random_sample(turned.shape)
    levels = np.clip(np.floor((turned - low[:, None]) / step[:, None] + dither), 0, 15).astype(np.uint8)
    return turned > 0, factor, levels, step, low


def packed_codes(unit: np.ndarray) -> list[bytes]:
    """codes_of in bytes: twelve of numbers, a bit and half a byte for each dimension."""
    signs, factor, levels, step, low = codes_of(unit)
    odd = unit.shape[1] % 2
    sides = (np.pad(levels, ((0, 0), (0, odd)))[:, ::2] << 4) | np.pad(levels, ((0, 0), (0, odd)))[:, 1::2]
    numbers = np.stack([factor, step, low], axis=1).astype(np.float32)
    return [a.tobytes() + b.tobytes() + c.tobytes() for a, b, c in zip(numbers, np.packbits(signs, axis=1), sides, strict=True)]


def estimates(signs: np.ndarray, factor: np.ndarray, levels: np.ndarray, step: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The estimate of <x, y> from x's code and y's four-bit side, and its standard error, for pairs in rows."""
    dim = signs.shape[1]
    side = np.where(signs, 1.0, -1.0) / np.sqrt(dim)
    dot = (side * (levels * step[:, None] + low[:, None])).sum(axis=1)
    error = np.sqrt((1 - np.minimum(factor, 1) ** 2) / max(1, dim - 1) + step**2 / 4) / factor
    return dot / factor, error


class Codes:
    """Codes of vectors of one length, unpacked."""

    def __init__(self, blobs: list[bytes], dim: int) -> None:
        raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
        numbers = np.ascontiguousarray(raw[:, :12]).view(np.float32).astype(float)
        cut = 12 + (dim + 7) // 8
        self.dim, self.factor, self.step, self.low = dim, numbers[:, 0], numbers[:, 1], numbers[:, 2]
        self.signs = np.unpackbits(raw[:, 12:cut], axis=1, count=dim).astype(bool)
        self.levels = np.stack([raw[:, cut:] >> 4, raw[:, cut:] & 15], axis=2).reshape(len(blobs), -1)[:, :dim]

    def likely(self, x: np.ndarray, y: np.ndarray, threshold: float, sigmas: float) -> np.ndarray:
        """Which of the pairs may reach the threshold."""
        out = [np.zeros(0, bool)]
        for k in range(0, len(x), 8192):
            a, b = x[k : k + 8192], y[k : k + 8192]
            estimate, error = estimates(self.signs[a], self.factor[a], self.levels[b], self.step[b], self.low[b])
            out.append(estimate + sigmas * error >= threshold)
        return np.concatenate(out)

    def likely_among(self, at: np.ndarray, threshold: float, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs among the rows `at`, the earlier one first, that may reach the threshold; 512 rows against all at a time."""
        side = np.where(self.signs[at], 1.0, -1.0) / np.sqrt(self.dim)
        other = self.levels[at] * self.step[at][:, None] + self.low[at][:, None]
        code, step, factor = (1 - np.minimum(self.factor[at], 1) ** 2) / max(1, self.dim - 1), self.step[at] ** 2 / 4, self.factor[at]
        found = []
        for lo in range(0, len(at), 512):
            rows = slice(lo, lo + 512)
            error = np.sqrt(code[rows, None] + step[lo:])
            p, q = np.nonzero(side[rows] @ other[lo:].T + sigmas * error >= threshold * factor[rows, None])
            later = q > p
            found.append((at[lo + p[later]], at[lo + q[later]]))
        return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def likely_pairs(key: np.ndarray, keys: np.ndarray, t: int, codes: Codes, mine: np.ndarray | None, threshold: float, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with one key that may be links and have met in no table before; with `mine`, those between two blocks only."""
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))[: len(order)]
    size = np.diff(np.append(first, len(order)))
    found = [codes.likely_among(order[a : a + n], threshold, sigmas) for a, n in zip(first[size >= MANY].tolist(), size[size >= MANY].tolist(), strict=True)]
    left = np.repeat(np.where(size < MANY, first + size, 0), size) - np.arange(len(order))  # members from here to the bucket's end
    at = np.flatnonzero(left > 1)
    gap = 1
    while len(at):
        x, y = order[at], order[at + gap]
        near = codes.likely(x, y, threshold, sigmas)
        found.append((x[near], y[near]))
        gap += 1
        at = at[left[at] > gap]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = (np.concatenate(v) for v in zip(*found, strict=True))
    kept = np.ones(len(x), bool)
    for lo in range(0, len(x), 1 << 16):  # tables before this one
        kept[lo : lo + (1 << 16)] = ~(keys[x[lo : lo + (1 << 16)], :t] == keys[y[lo : lo + (1 << 16)], :t]).any(axis=1)
    if mine is not None:
        kept &= mine[x] != mine[y]
    return x[kept], y[kept]


def joining(x: np.ndarray, y: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Of links between rows, those that each join two parts: a forest with the same components."""
    above, found = np.arange(count), [(x[:0], y[:0])]
    while True:
        px, py = above[x], above[y]
        apart = px != py
        x, y, px, py = x[apart], y[apart], px[apart], py[apart]
        if not len(x):
            return tuple(np.concatenate(v) for v in zip(*found, strict=True))
        # each part hooks to the least part that a link leads to, by one link, if that is less; so hooks make no circle
        high, low = np.maximum(px, py), np.minimum(px, py)
        by = np.lexsort([low, high])
        chosen = by[np.append(True, high[by][1:] != high[by][:-1])]
        above[high[chosen]] = low[chosen]
        found.append((x[chosen], y[chosen]))
        while not np.array_equal(flat := above[above], above):
            above = flat


class Meeting:
    """The tables in which vectors meet, and what a bucket does."""

    def __init__(self, projections: int, tables: int, threshold: float, sigmas: float) -> None:
        self.projections, self.tables, self.threshold, self.sigmas = projections, tables, threshold, sigmas

    def sent(self, vectors: DataFrame) -> DataFrame:
        """Settled (t, key, dim, first, keys, code) of each vector in each table."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims):
                    rows = batch.filter(pa.array(dims == dim))
                    for lo in range(0, len(rows), 512):
                        part = rows.slice(lo, 512)
                        unit = part.column("unit").flatten().to_numpy().reshape(-1, dim)
                        keys, codes = keys_of(unit, self.projections, self.tables), pa.array(packed_codes(unit), pa.binary())
                        all_keys = pa.array([k.tobytes() for k in keys.astype(key_type(int(dim), self.projections))], pa.binary())
                        for t in range(self.tables):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), t, np.int32)), pa.array(keys[:, t]), part.column("dim"), part.column("first"), all_keys, codes], ["t", "key", "dim", "first", "keys", "code"])

        return settle(vectors.mapInArrow(run, "t int, key long, dim int, first long, keys binary, code binary"))

    def dealt(self, sent: DataFrame, slots: int) -> DataFrame:
        """Rows with the group in which they meet: (t, slot, dim, x, y); a bucket of more than CROWD is split into blocks x and y."""
        crowded = sent.groupBy("t", "key", "dim").count().where(F.col("count") > CROWD)
        crowded = settle(crowded.select("t", "key", "dim", F.ceil(F.col("count") / (CROWD // 2)).cast("int").alias("blocks")))
        slot = F.pmod(F.xxhash64("key"), F.lit(slots)).alias("slot")
        few = sent.join(crowded, ["t", "key", "dim"], "left_anti").select("*", slot, F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("mine"))
        split = sent.join(crowded, ["t", "key", "dim"]).withColumn("mine", F.pmod(F.xxhash64("first"), "blocks").cast("int"))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        split = split.select(*sent.columns, F.concat_ws(":", "dim", "key").alias("slot"), F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine")
        return few.withColumn("slot", F.col("slot").cast("string")).union(split)

    def pairs(self, group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        dim, t = group.column("dim")[0].as_py(), group.column("t")[0].as_py()
        key, mine = group.column("key").to_numpy(), group.column("mine").to_numpy()
        keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), key_type(dim, self.projections)).reshape(len(key), self.tables)
        across = group.column("x")[0].as_py() != group.column("y")[0].as_py()
        return likely_pairs(key, keys, t, Codes(group.column("code").to_pylist(), dim), mine if across else None, self.threshold, self.sigmas)

    def wanted(self, group: pa.Table) -> pa.Table:
        """The members that have a likely partner in the group."""
        x, y = self.pairs(group)
        return group.select(MEMBER).take(pa.array(np.unique(np.concatenate([x, y]))))

    def linked(self, group: pa.Table) -> pa.Table:
        """(a, b, n): for each member, as a and b, the vectors it links with here, copies counted; and with n = 0 links that join parts."""
        x, y = self.pairs(group)
        first, copies = group.column("first").to_numpy(), group.column("copies").to_numpy()
        unit = group.column("unit").combine_chunks().flatten().to_numpy().reshape(len(first), -1)
        ok = np.concatenate([*(np.einsum("ij,ij->i", unit[x[k : k + 8192]], unit[y[k : k + 8192]]) >= self.threshold for k in range(0, len(x), 8192)), np.zeros(0, bool)])
        x, y = x[ok], y[ok]
        n = np.bincount(x, copies[y], len(first)) + np.bincount(y, copies[x], len(first))
        some = np.flatnonzero(n)
        p, q = joining(x, y, len(first))
        a, b = np.concatenate([first[some], first[p]]), np.concatenate([first[some], first[q]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(np.concatenate([n[some], np.zeros(len(p))]).astype(np.int64))})


GROUP = ["t", "slot", "dim", "x", "y"]
MEMBER = [*GROUP, "key", "mine", "first", "keys", "code"]


def key_type(dim: int, projections: int) -> type:
    """The narrowest number for a key."""
    bits = projections * (2 * dim - 1).bit_length()
    return np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.int64


def found_links(vectors: DataFrame, threshold: float, miss: float, sigmas: float) -> DataFrame:
    """Settled (a, b, n) over all groups of vectors (first long, unit array<double>, dim int, copies long), see Meeting.linked."""
    sizes = vectors.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    if not sizes.n:
        return vectors.sparkSession.createDataFrame([], "a long, b long, n long")
    projections, tables = plan(sizes.n, sizes.dim, threshold, miss)
    meeting = Meeting(projections, tables, threshold, sigmas)
    slots = max(1, sizes.n // 2048)
    rows = meeting.dealt(meeting.sent(vectors), slots)
    member = "t int, slot string, dim int, x int, y int, key long, mine int, first long, keys binary, code binary"
    wanted = settle(rows.groupBy(*GROUP).applyInArrow(lambda group: meeting.wanted(group), member))
    again = wanted.join(vectors.select("first", "unit", "copies"), "first").select(*MEMBER, "unit", "copies")
    return settle(again.groupBy(*GROUP).applyInArrow(lambda group: meeting.linked(group), "a long, b long, n long"))


def near_vectors(rows: DataFrame, threshold: float = 0.9, miss: float = MISS, sigmas: float = SIGMAS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Link all vectors whose cosine, in double precision, is at least `threshold`.

    Returns (vec_id, n_links, component_id, kept): how many other vectors each links with directly, the smallest id that links
    reach, and whether that is its own. Vectors that are null, empty or zero, or have null or non-finite components, link with
    nothing, like rows with a null id, whose component_id is null and which are kept; only vectors of one length are compared. Rows
    that share an id are one node of components, and each counts the links of its own vector. A link at the threshold is missed with a probability of at most `miss`. Other
    columns aren't read.
    """
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, digests, dims = [], [], []
            for vector in batch.column(1).to_pylist():
                v = np.array([np.nan] if not vector or None in vector else vector, float)
                size = np.abs(v).max()
                if np.isfinite(size) and size > 0:
                    v = v / size  # keeps squares of extreme components finite
                    units.append(v / np.sqrt(v @ v))
                    digests.append(xxhash.xxh3_128_digest(units[-1].tobytes()))
                    dims.append(len(v))
                else:
                    for x in (units, digests, dims):
                        x.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.list_(pa.float64())), pa.array(digests, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "unit", "same", "dim"])

    all_rows = settle(rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, unit array<double>, same binary, dim int"))
    if clashing(all_rows, "vec_id", "same"):  # then rows are told apart first, and their ids join what their vectors reach
        keyed = settle(all_rows.select(F.col("vec_id").alias("id"), "unit", F.monotonically_increasing_id().alias("row")))
        found = near_vectors(keyed.where("id IS NOT NULL"), threshold, miss, sigmas, "row", "unit").select(F.col("vec_id").alias("row"), "n_links", F.col("component_id").alias("component"))
        found = keyed.join(found, "row", "left").select("row", "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "row").alias("component"), F.col("unit").isNotNull().alias("linked"))
        return by_shared_ids(settle(found)).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
    usable = F.col("same").isNotNull() & F.col("vec_id").isNotNull()
    sets = settle(all_rows.where(usable).groupBy("same").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")))
    mine = all_rows.select(F.col("vec_id").alias("first"), "unit", "dim", F.col("same").alias("own"))
    vectors = settle(mine.join(sets, "first").where("same = own").dropDuplicates(["first"]).select("first", "unit", "dim", "copies"))
    links = found_links(vectors, threshold, miss, sigmas)
    degrees = links.where("n > 0").groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("n"))
    parts = components(links.where("n = 0").select("a", "b")).withColumnRenamed("node", "first")
    found = sets.join(degrees, "first", "left").join(parts, "first", "left").select("same", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    out = all_rows.where(usable).select("vec_id", "same").join(found, "same").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.union(all_rows.where(~usable).select("vec_id", F.lit(0).cast("long"), "vec_id", F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    """Brute force in DuckDB over one row for each usable vector."""
    return """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS c FROM u UNION SELECT l.b, r.c FROM r JOIN l ON r.a = l.a),
c AS (SELECT a, min(c) AS c FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""
