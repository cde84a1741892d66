"""MinHash near-dedup with sequential Bayesian verification of banded candidates.

Copies with one shingle set are merged first. Each different set gives ROWS * BANDS minima; sets that agree in all rows of a band
meet. Within a band's bucket members are first compared with the bucket's least member; the links that this finds are turned into
components. Buckets with one least member are one from then on, so a large group of near copies isn't dealt out once for each band.
Members of one bucket that still lie apart are compared and confirmed in place: first each one's likeliest partners, then,
with the components that this has joined, all that still lie apart; only links that join parts become rows. A candidate pair's signatures are compared batch by batch, and it is dropped as soon as the posterior
probability that its similarity reaches the threshold falls below MISS; survivors are compared on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Block, bucket_of, forget, mixed, settle, small_batches, table, text_parts
from siltstone.llm.components import by_shared_ids, clashing, components
from siltstone.llm.window_dedup import word_hashes

BANDS, ROWS = 40, 6
BATCH = 24
#: Members of a bucket that are compared in one piece.
CROWD = 2048
#: Bytes of their texts.
CROWD_BYTES = 1 << 24
#: Likeliest partners of each member that are confirmed before all others.
BEST = 2
MISS = 1e-6
#: Bits of the filter that keeps texts without a candidate from being dealt out; a constant, so the broadcast doesn't grow.
FILTER_BITS = 1 << 23
_random = np.random.RandomState(20240517)
MULTIPLIERS = (_random.randint(0, 2**32, BANDS * ROWS).astype(np.uint64) << np.uint64(32)) + _random.randint(0, 2**32, BANDS * ROWS).astype(np.uint64) | np.uint64(1)
ADDENDS = (_random.randint(0, 2**32, BANDS * ROWS).astype(np.uint64) << np.uint64(32)) + _random.randint(0, 2**32, BANDS * ROWS).astype(np.uint64)


def shingle_sets(batch: pa.Array, width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles of `width` words; of a shorter text, that of all its words."""
    raw, bounds = text_parts(batch)
    raw = np.where((raw >= 0x41) & (raw <= 0x5A), raw + 32, raw).astype(np.uint8)
    words, cuts = word_hashes(Block(np.zeros(len(batch)), raw, bounds))
    rolled = np.zeros(len(words), np.uint64)
    for k in range(width):
        shifted = words[k:] * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        rolled = mixed(rolled)
        rolled[: len(shifted)] += shifted
    out = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(np.unique(rolled[lo : hi - width + 1]))
        elif hi > lo:
            out.append(np.array([xxhash.xxh3_64_intdigest(words[lo:hi].tobytes())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(values: np.ndarray) -> np.ndarray:
    """The least of each hash function over the set, as 32-bit numbers."""
    best = np.full(len(MULTIPLIERS), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(values), 512):
        hashed = values[None, at : at + 512] * MULTIPLIERS[:, None]
        hashed += ADDENDS[:, None]
        np.minimum(best, hashed.min(axis=1) >> np.uint64(32), out=best)
    return best.astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    rows = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return keys.view(np.int64)


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(compared, least matches to go on) after each batch: under a uniform prior the similarity exceeds the threshold, given m of n
    matches, with the probability that at most m of n + 1 trials succeed at the threshold."""
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total, m = 0.0, 0
        while m <= n and (total := total + comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < miss:
            m += 1
        out.append((n, m))
    return out


def sketched(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, set_id, bands, sig) of each document; set_id, bands and sig are null for an empty set."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).fill_null(""), width)
            empty = np.array([len(s) == 0 for s in sets], bool)
            sigs = np.array([signature(s) for s in sets], np.uint32).reshape(-1, BANDS * ROWS)
            keys = band_keys(sigs)
            columns = [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary(), mask=empty),
                pa.array([None if e else k for k, e in zip(keys, empty, strict=True)], pa.list_(pa.int64())),
                pa.array([s.astype(np.uint16).tobytes() for s in sigs], pa.binary(), mask=empty),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_id", "bands", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return settle(rows.mapInArrow(run, "doc_id long, n_shingles long, set_id binary, bands array<long>, sig binary"))


def plausible(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Rows of two tables of signatures whose comparison, batch by batch, doesn't rule the pair out."""
    left, matches, before = np.arange(len(a)), np.zeros(len(a), int), 0
    for n, least in steps:
        matches[left] += (a[left, before:n] == b[left, before:n]).sum(axis=1)
        left, before = left[matches[left] >= least], n
    return left


def likely(pairs: DataFrame, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) that sequential verification of their signatures doesn't rule out."""
    steps = least_matches(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(len(batch), -1) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).take(pa.array(plausible(a, b, steps)))

    of = lambda c: sigs.select(F.col("doc_id").alias(c), F.col("sig").alias(f"s{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def likely_rows(group: pa.Table, steps: list[tuple[int, int]], best: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a group's rows with one key and different parts that their signatures don't rule out, and their equal minima.

    With `best`, only those among a row's so many likeliest pairs.
    """
    key, part, mine = (group.column(c).to_numpy() for c in ("key", "part", "mine"))
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(len(key), -1)
    across = group.column("x")[0].as_py() != group.column("y")[0].as_py()
    order, p, q = np.argsort(key, kind="stable"), [], []
    for gap in range(1, len(order)):
        x, y = order[:-gap], order[gap:]
        same = key[x] == key[y]
        if not same.any():
            break
        same &= part[x] != part[y]
        if across:
            same &= mine[x] != mine[y]
        x, y = x[same], y[same]
        left = plausible(sig[x], sig[y], steps)
        p.append(x[left])
        q.append(y[left])
    p, q = (np.concatenate([*v, []]).astype(np.int64) for v in (p, q))
    equal = np.concatenate([*((sig[p[k : k + 4096]] == sig[q[k : k + 4096]]).sum(axis=1) for k in range(0, len(p), 4096)), []])
    if best is not None and len(p):
        ends, pair = np.concatenate([p, q]), np.tile(np.arange(len(p)), 2)
        by = np.lexsort([pair, -equal[pair], ends])
        first = np.searchsorted(ends[by], ends[by])
        chosen = np.unique(pair[by[np.arange(len(by)) - first < best]])
        p, q, equal = p[chosen], q[chosen], equal[chosen]
    return p, q, equal


def with_columns(members: DataFrame, columns: DataFrame) -> DataFrame:
    """members (doc_id, ...) with further columns by doc_id; each document meets them once, whatever the number of its buckets."""
    mine = members.groupBy("doc_id").agg(F.collect_list(F.struct(*(c for c in members.columns if c != "doc_id"))).alias("at"))
    met = mine.join(columns, "doc_id").withColumn("at", F.explode("at"))
    return met.select("at.*", *columns.columns)


def dealt_members(members: DataFrame, columns: DataFrame, blocks: DataFrame, slots: int) -> DataFrame:
    """members with their columns and the group (slot, x, y) in which they meet; keys of `blocks` (key, blocks) are split into blocks that meet pair by pair."""
    placed = members.join(blocks, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = with_columns(placed, columns)
    rows = rows.withColumns({"mine": F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    return rows.select("key", "part", *columns.columns, "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), F.pmod("key", F.lit(slots)).alias("slot"))


def likely_members(members: DataFrame, sigs: DataFrame, threshold: float, miss: float, best: int | None) -> DataFrame:
    """Settled members (key, doc_id, part) that have a likely partner in their bucket; only signatures are dealt out."""
    steps = least_matches(threshold, miss)
    sizes = settle(members.groupBy("key").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n").alias("n")).first().n or 0
    slots = max(4 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // CROWD)
    blocks = settle(sizes.where(F.col("n") > CROWD).select("key", F.ceil(2 * F.col("n") / CROWD).cast("int").alias("blocks")))

    def meet(group: pa.Table) -> pa.Table:
        p, q, _ = likely_rows(group, steps, best)
        return group.select(["key", "doc_id", "part"]).take(pa.array(np.unique(np.concatenate([p, q]))))

    rows = dealt_members(members, sigs, blocks, slots)
    return settle(rows.groupBy("slot", "x", "y").applyInArrow(meet, "key long, doc_id long, part long").distinct())


def links_within(members: DataFrame, sigs: DataFrame, texts: DataFrame, width: int, threshold: float, miss: float, best: int | None = None) -> DataFrame:
    """Links (a, b) between members (key, doc_id, part) with one key and different parts, found and confirmed where their bucket lies.

    Pairs that their signatures don't rule out are taken with the most equal minima first and confirmed on the full sets, unless links
    before them have joined their parts; only these links become rows, for a bucket fewer than it has members. With `best`, only
    those among a member's so many likeliest pairs are looked at, which is no decision about the others. A bucket of more than CROWD
    members or CROWD_BYTES of text is split into blocks that meet pair by pair.
    """
    steps, per_cent = least_matches(threshold, miss), round(threshold * 100)
    sizes = settle(with_columns(members, texts.select("doc_id", F.octet_length("text").cast("long").alias("size"))).groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    total = sizes.agg(F.sum("n").alias("n"), F.sum("size").alias("size")).first()
    slots = max(4 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total.n or 0) // CROWD, (total.size or 0) // CROWD_BYTES)
    crowded = sizes.where((F.col("n") > CROWD) | (F.col("size") > CROWD_BYTES))
    crowded = settle(crowded.select("key", F.greatest(F.ceil(2 * F.col("n") / CROWD), F.ceil(2 * F.col("size") / CROWD_BYTES)).cast("int").alias("blocks")))
    rows = dealt_members(members, sigs.join(texts, "doc_id"), crowded, slots)

    def meet(group: pa.Table) -> pa.Table:
        return joining(group, *likely_rows(group, steps, best), *(group.column(c).to_numpy() for c in ("doc_id", "part")))

    def joining(group: pa.Table, p: np.ndarray, q: np.ndarray, equal: np.ndarray, doc: np.ndarray, part: np.ndarray) -> pa.Table:
        """The links among the pairs of rows p, q that join parts, the likeliest pairs first."""
        at, node = np.unique(doc, return_index=True, return_inverse=True)[1:]
        needed = np.unique(node[np.concatenate([p, q])])
        sets = dict(zip(needed.tolist(), shingle_sets(group.column("text").take(pa.array(at[needed])).combine_chunks(), width), strict=True)) if len(needed) else {}
        above: dict[int, int] = {}

        def root(v: int) -> int:
            while v in above:
                if (up := above[v]) in above:
                    above[v] = above[up]
                v = up
            return v

        found = []
        by = np.argsort(-equal, kind="stable")
        for x, y, px, py, a, b in zip(*(v[by].tolist() for v in (node[p], node[q], part[p], part[q], doc[p], doc[q])), strict=True):
            rx, ry = root(px), root(py)
            few, many = sorted((sets[x], sets[y]), key=len)
            if rx == ry or 100 * len(few) < per_cent * len(many):
                continue
            both = np.count_nonzero(many.take(many.searchsorted(few), mode="clip") == few)
            if 100 * both >= per_cent * (len(few) + len(many) - both):
                above[rx] = ry
                found.append((min(a, b), max(a, b)))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return settle(rows.groupBy("slot", "x", "y").applyInArrow(meet, "a long, b long").distinct())


def id_filter(ids: DataFrame) -> bytes:
    """A bitmap of FILTER_BITS bits with one bit for each id; partitions' bitmaps merge in at most 64 groups before the driver sees them."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            seen[bucket_of(batch.column(0).to_numpy().view(np.uint64), FILTER_BITS)] = True
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([np.packbits(seen).tobytes()], pa.binary())], ["k", "bits"])

    def run(group: pa.Table) -> pa.Table:
        seen = np.zeros(FILTER_BITS // 8, np.uint8)
        for one in group.column("bits"):
            seen |= np.frombuffer(one.as_py(), np.uint8)
        return pa.table({"bits": pa.array([seen.tobytes()], pa.binary())})

    seen = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in ids.mapInArrow(bits, "k int, bits binary").groupBy("k").applyInArrow(run, "bits binary").toLocalIterator():
        seen |= np.frombuffer(row.bits, np.uint8)
    return seen.tobytes()


def one_of_each(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Settled rows (doc_id long, ...) with these ids, one for each id; most others don't leave the scan."""
    bits = id_filter(ids)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            yield batch.filter(pa.array(seen[bucket_of(batch.column(0).to_numpy().view(np.uint64), FILTER_BITS)]))

    return settle(rows.mapInArrow(kept, rows.schema).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def texts_of(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Settled (doc_id, text) of the documents with these ids."""
    return one_of_each(ids, docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose full sets are as similar as the threshold asks."""
    per_cent = round(threshold * 100)
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (shingle_sets(batch.column(c), width) for c in ("ta", "tb"))
            ok = []
            for x, y in zip(a, b, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= per_cent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    of = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))
    out = settle(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))
    forget(texts)
    return out


def met_pairs(members: DataFrame) -> DataFrame:
    """Settled distinct (least, doc_id) of members (key, doc_id): each bucket's least member with each other one. Rows are dealt by key once."""
    bucket = Window.partitionBy("key")
    return settle(members.withColumn("least", F.min("doc_id").over(bucket)).where("least < doc_id").select("least", "doc_id").distinct())


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by a Jaccard similarity of their shingle sets of at least `threshold`.

    Returns (doc_id, n_shingles, component_id, kept): component_id is the smallest id that links reach, kept says that it is the
    document's own. Words are runs of other bytes than white space, A-Z in lower case; a text of fewer than `width` words has one
    shingle. Null, empty and blank texts have none and link with nothing. Rows that share an id are one node: links of any of their
    texts reach it, and each row has the set size of its own text. A null id links with nothing, keeps a null component_id and is kept. A link at the threshold is missed with a probability
    of (1 - threshold^ROWS)^BANDS, 5e-6 at 0.8, plus `miss` for each batch of the comparison. Other columns aren't read.
    """
    rows = sketched(docs, width, id_col, text_col)
    if clashing(rows, "doc_id", "set_id"):  # then rows are told apart first, and their ids join what their texts reach
        keyed = settle(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row")))
        found = near_duplicates(keyed, width, threshold, miss, "row", "text").select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("component"))
        whole = by_shared_ids(settle(found.join(keyed.select("row", "id"), "row").withColumn("linked", F.col("n_shingles") > 0)))
        return whole.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
    sets = settle(rows.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("first")))
    # a set's copies have its signature, so all but the sets' first rows are left out
    reps = rows.join(sets.select(F.col("first").alias("doc_id"), F.col("set_id").alias("own")), "doc_id").where("set_id = own")
    met = met_pairs(reps.select("doc_id", F.explode("bands").alias("key")))
    sigs = one_of_each(met.select(F.explode(F.array("least", "doc_id")).alias("doc_id")).distinct(), rows.where("set_id is not null").select("doc_id", "sig"))
    candidates = settle(likely(met.select(F.col("least").alias("a"), F.col("doc_id").alias("b")), sigs, threshold, miss))
    found = confirmed(candidates, docs, width, threshold, id_col, text_col)
    parts = settle(components(found))
    # buckets with one least member are one; pairs with the least member have been compared
    others = met.select(F.col("least").alias("key"), "doc_id")

    def apart(parts: DataFrame) -> DataFrame:
        labelled = others.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("part"))
        keys = labelled.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
        return settle(labelled.join(keys, "key"))

    rest = apart(parts)
    for best in (BEST, None):  # first what most likely joins components, which leaves few apart; then all that is left
        if not rest.isEmpty():
            few = one_of_each(rest.select("doc_id").distinct(), sigs)
            near = likely_members(rest, few, threshold, miss, best)
            texts = texts_of(near.select("doc_id").distinct(), docs, id_col, text_col)
            found = found.union(links_within(near, few, texts, width, threshold, miss, best))
            parts = settle(components(found))
            for done in (few, near, texts, rest):
                forget(done)
            rest = apart(parts) if best else rest
    for done in (met, sigs, candidates):
        forget(done)
    # rows without a set or an id link with nothing and take no part in the join, so they don't pile up in one task
    linked = F.col("set_id").isNotNull() & F.col("doc_id").isNotNull()
    groups = sets.join(parts.withColumnRenamed("node", "first"), "first", "left").select("set_id", F.coalesce("component", "first").alias("component_id"))
    out = rows.where(linked).select("doc_id", "n_shingles", "set_id").join(groups, "set_id").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return out.union(rows.where(~linked).select("doc_id", "n_shingles", F.col("doc_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def oracle() -> str:
    """All pairs of documents that share a shingle, counted in DuckDB, and their closure."""
    return r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[p] || ' ' || w[p + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS p FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM b JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON r.a = e.a),
c AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id"""
