"""Substring dedup over bytes with a sparse suffix array built by bucket-pointer refinement.

1. Anchors. Each window of `width` bytes has an anchor: the q-gram of least hash among those inside it. Equal windows have equal
   anchors, so a window whose anchor occurs once in the corpus occurs once itself. Blocks send their distinct anchor hashes to
   buckets, merged first, and learn which are shared; with them go digests of whole texts, by which all but the first of
   identical documents are settled at once.
2. Contexts. For each shared anchor the bytes of the windows that hang on it go to the anchor's bucket. There the suffixes are
   sorted by bucket-pointer refinement: q-gram buckets first, then each suffix by the pair (own bucket, bucket of the suffix at a
   later offset), each round reading the buckets that the round before has refined, until the buckets are classes of equal windows.
   Of each class all but the earliest go.
3. Hot anchors (in more than HOT places) would bring one bucket contexts without bound; their windows are dealt one by one, each by
   its own 128-bit hash, after each block has kept its earliest of equal ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import NO_ID, Block, Dealt, bucket_count, by_bucket, flat, pack_blocks, settle, table, unflat, with_parts

WIDTH = 100
GRAM = 32
BLOCK_BYTES = 4 << 20
HOT = 4096
SLICE = 1 << 16
#: Bits of a hash that hold a position in a slice instead while the least is sought.
LOW = np.uint64((1 << 17) - 1)


def words_at(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; raw has eight spare bytes at its end."""
    return np.ndarray(len(raw) - 7, np.uint64, raw, strides=(1,)).copy()


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes from each position on; raw has seven spare bytes at its end."""
    loads = words_at(raw)
    loads *= np.uint64(0x9E3779B97F4A7C15)
    loads ^= loads >> np.uint64(32)
    count = len(loads) - gram + 1
    h = np.zeros(count, np.uint64)
    for k in range(0, gram, 8):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += loads[k : k + count]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, by doubling."""
    out, span = values, 1
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[: len(out) - step], out[step:])
        span += step
    return out


class Runs:
    """Windows of a block by anchor: in each run, windows that start from lo to hi (both in the block's bytes) hang on one anchor."""

    def __init__(self, anchor: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.anchor, self.lo, self.hi = anchor, lo, hi


def anchor_runs(block: Block, width: int, gram: int) -> Runs:
    """The runs of all windows inside documents; of equal q-grams in a window the first is the anchor."""
    span, raw, found = width - gram + 1, np.append(block.raw, np.zeros(8, np.uint8)), []
    n = len(block.raw)
    valid = np.ones(n, bool)
    for k in np.flatnonzero(np.diff(block.bounds)):
        valid[max(block.bounds[k], block.bounds[k + 1] - width + 1) : block.bounds[k + 1]] = False
    for at in range(0, n - width + 1, SLICE):
        to = min(n, at + SLICE + width - 1)
        h = gram_hashes(raw[at : to + 7], gram)
        count = len(h)
        least = sliding_min((h & ~LOW) | np.arange(count, dtype=np.uint64), span) & LOW
        start = np.flatnonzero(valid[at : at + len(least)])
        if not len(start):
            continue
        place, start = least[start].astype(np.int64), start + at
        new = np.ones(len(start), bool)
        new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        found.append((h[place[first]], start[first], start[np.append(first[1:], len(start)) - 1]))
    if not found:
        return Runs(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Runs(*(np.concatenate(x) for x in zip(*found, strict=True)))


def digests(block: Block) -> np.ndarray:
    """A 128-bit digest of each text as two numbers."""
    return np.array([divmod(xxhash.xxh3_128_intdigest(block.text(k)), 1 << 64) for k in range(len(block))], np.uint64).reshape(-1, 2)


def first_of(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by keys and, within equal keys, by order; and which of these begin a new key."""
    rows = np.lexsort([*order[::-1], *keys[::-1]])
    new = np.ones(len(rows), bool)
    if len(rows):
        new[1:] = np.any([k[rows][1:] != k[rows][:-1] for k in keys], axis=0)
    return rows, new


def ragged(lo: np.ndarray, count: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... in each row, count of them, one row after the other."""
    ends = np.cumsum(count)
    return np.repeat(lo - np.append(0, ends[:-1]), count) + np.arange(ends[-1] if len(ends) else 0)


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of equal keys by number, and which members share theirs with another."""
    _, bucket, size = np.unique(keys, return_inverse=True, return_counts=True)
    return bucket, size[bucket] > 1


def refined(bucket: np.ndarray, at: np.ndarray, later: np.ndarray) -> np.ndarray:
    """The positions `at`, sorted on (own bucket, bucket of the position `later` by as much): a number for each pair."""
    out = np.zeros(len(bucket), np.int64)
    out[at] = numbered((bucket[at].astype(np.uint64) << np.uint64(32)) | bucket[later].astype(np.uint64))[0]
    return out


def window_classes(raw: np.ndarray, starts: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of starts that may share their string of `width` bytes, and a number for each, equal for equal strings.

    Bucket-pointer refinement: the first buckets hold equal q-grams; each round sorts on (bucket, bucket at the offset that the
    round before has reached), and what a round has refined serves the next as its pointers. A start goes as soon as a q-gram
    inside its window stands alone, and only positions that the starts left lead to are refined.
    """
    bucket, shared = numbered(gram_hashes(np.append(raw, np.zeros(7, np.uint8)), gram))
    for k in [*range(0, width - gram, gram), width - gram]:
        starts = starts[shared[starts + k]]
    reaches = [gram]
    while reaches[-1] < width:
        reaches.append(min(2 * reaches[-1], width))
    needed = [starts]  # from the last round back to the first
    for reach, before in zip(reaches[:0:-1], reaches[-2::-1], strict=True):
        needed.append(np.unique(np.concatenate([needed[-1], needed[-1] + reach - before])))
    for at, reach, before in zip(needed[-2::-1], reaches[1:], reaches, strict=False):
        bucket = refined(bucket, at, at + reach - before)
    return starts, bucket[starts]


def shared_in_buckets(parts: list[tuple[int, bytes]], hot: int) -> Iterator[tuple[int, bytes]]:
    """For each block: 0, 1 or 2 for each anchor it sent (in one place only, shared, hot), and which texts it has before all others."""
    sent = [(b, *unflat(p)) for b, p in parts]
    anchors, places = np.concatenate([x[1] for x in sent]), np.concatenate([x[2] for x in sent])
    distinct, inverse = np.unique(anchors, return_inverse=True)
    total = np.bincount(inverse, places, len(distinct)) if len(anchors) else np.zeros(0)
    code = np.where(total > hot, 2, (total > 1).astype(int)).astype(np.uint8)[inverse]
    texts, ids = np.concatenate([x[3] for x in sent]), np.concatenate([x[4] for x in sent])
    owner = np.repeat([x[0] for x in sent], [len(x[3]) for x in sent])
    rows, new = first_of([texts[:, 0], texts[:, 1]], [ids, owner])
    first = np.zeros(len(ids), bool)
    first[rows[new]] = True
    a = t = 0
    for block_id, hashes, _, mine, _ in sent:
        yield block_id, flat(code[a : a + len(hashes)], first[t : t + len(mine)])
        a, t = a + len(hashes), t + len(mine)


def later_in_buckets(parts: list[tuple[int, bytes]], width: int, gram: int) -> Iterator[tuple[int, bytes]]:
    """For each block the window starts whose string occurs earlier; what a block has found out itself passes through."""
    sent = [(b, *unflat(p, True)) for b, p in parts]
    gone: dict[int, list[np.ndarray]] = {b: [own] for b, own, *_ in sent}

    def share_out(owners: np.ndarray, starts: np.ndarray) -> None:
        order = np.argsort(owners, kind="stable")
        cuts = np.searchsorted(owners[order], np.arange(len(sent) + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            gone[sent[k][0]].append(starts[order[cuts[k] : cuts[k + 1]]])

    owner = lambda which: np.repeat(np.arange(len(sent)), [len(x[which]) for x in sent])
    # contexts: bytes, lengths, then document and first start of each
    raw = np.concatenate([x[2] for x in sent])
    if len(raw):
        length, doc, lo = (np.concatenate([x[k] for x in sent]) for k in (3, 4, 5))
        begin = np.cumsum(length) - length
        starts, classes = window_classes(raw, ragged(begin, length - width + 1), width, gram)
        back = np.searchsorted(begin, starts, "right") - 1
        order = [doc[back], owner(3)[back], lo[back] + starts - begin[back]]
        rows, new = first_of([classes], order)
        late = rows[~new]
        share_out(order[1][late], order[2][late])
    hashes = np.concatenate([x[6] for x in sent])
    if len(hashes):
        doc, at, who = np.concatenate([x[7] for x in sent]), np.concatenate([x[8] for x in sent]), owner(6)
        rows, new = first_of([hashes[:, 0], hashes[:, 1]], [doc, who, at])
        late = rows[~new]
        share_out(who[late], at[late])
    for block_id, found in gone.items():
        if len(every := np.concatenate(found)):
            yield block_id, flat(np.sort(every).astype(np.int32), level=1)


def window_digests(block: Block, starts: np.ndarray, width: int) -> np.ndarray:
    """Two independent 64-bit hashes of each window."""
    return np.array([divmod(xxhash.xxh3_128_intdigest(block.raw[k : k + width].tobytes()), 1 << 64) for k in starts.tolist()], np.uint64).reshape(-1, 2)


def remove_later_copies(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte that a string of `width` bytes covers which also starts earlier: in a smaller id, or further ahead in the same text.

    Returns (doc_id, kept binary, n_bytes, n_removed, span_starts, span_ends): the maximal removed runs as byte offsets of the text.
    Matches lie inside one document. A null text is empty; texts shorter than `width` stay whole; a null id counts as the smallest
    and stays null; rows with one id are told apart by where they lie in the input; other columns aren't read.
    """
    if not 8 <= gram < width or gram % 8:
        raise ValueError("gram must be a multiple of 8 below width")
    blocks = pack_blocks(docs, block_bytes, id_col, text_col)
    buckets = bucket_count(docs, 2 << 20)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = Block.unpacked(blob)
                anchors, counts = np.unique(anchor_runs(block, width, gram).anchor, return_counts=True)
                texts = digests(block)
                rows, new = first_of([texts[:, 0], texts[:, 1]], [block.ids])
                texts, ids = texts[rows[new]], block.ids[rows[new]]
                by_anchor, by_text = Dealt(anchors, buckets), Dealt(texts[:, 0], buckets)
                full, out = np.union1d(by_anchor.buckets, by_text.buckets), []
                for k in full:
                    a, t = by_anchor.of(k), by_text.of(k)
                    out.append(flat(anchors[a], counts[a].astype(np.int32), texts[t], ids[t]))
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([block_id] * len(full), pa.int64()), pa.array(out, pa.binary())], ["bucket", "block_id", "part"])

    def codes(anchors: np.ndarray, parts: list[dict] | None) -> np.ndarray:
        """The code of each distinct anchor of a block."""
        code, by_anchor = np.zeros(len(anchors), np.uint8), Dealt(anchors, buckets)
        for part in parts or ():
            code[by_anchor.of(part["bucket"])] = unflat(part["part"])[0]
        return code

    def copies(block: Block, parts: list[dict] | None) -> np.ndarray:
        """Which documents are later copies of a whole text."""
        texts = digests(block)
        rows, new = first_of([texts[:, 0], texts[:, 1]], [block.ids])
        first, by_text = np.zeros(len(block), bool), Dealt(texts[rows[new]][:, 0], buckets)
        for part in parts or ():
            first[rows[new][by_text.of(part["bucket"])]] = unflat(part["part"])[1]
        return ~first

    def send_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, blob, parts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                block = Block.unpacked(blob)
                runs = anchor_runs(block, width, gram)
                anchors, inverse = np.unique(runs.anchor, return_inverse=True)
                code, copy = codes(anchors, parts), copies(block, parts)
                of = np.searchsorted(block.bounds, runs.lo, "right") - 1
                code = np.where(copy[of], 0, code[inverse])
                here = np.flatnonzero(code == 1)
                anchor, lo, hi, doc = runs.anchor[here], runs.lo[here], runs.hi[here], block.ids[of[here]]
                by_anchor = Dealt(anchor, buckets)
                # windows of hot anchors: the block's earliest of equal ones goes on, the others are late already
                at = ragged(runs.lo[code == 2], (runs.hi - runs.lo + 1)[code == 2])
                hashes, docs_at = window_digests(block, at, width), block.ids[np.searchsorted(block.bounds, at, "right") - 1]
                rows, new = first_of([hashes[:, 0], hashes[:, 1]], [docs_at, at])
                late, rows = at[rows[~new]], rows[new]
                hashes, docs_at, at = hashes[rows], docs_at[rows], at[rows]
                by_hash = Dealt(hashes[:, 0], buckets)
                full = np.union1d(by_anchor.buckets, by_hash.buckets).astype(np.int64)
                if len(late) and not len(full):
                    full = np.zeros(1, int)
                out = []
                for k in full:
                    c, h = by_anchor.of(k), by_hash.of(k)
                    length = hi[c] - lo[c] + width
                    own = late if k == full[0] else late[:0]
                    out.append(flat(own, block.raw[ragged(lo[c], length)], length, doc[c], lo[c], hashes[h], docs_at[h], at[h], level=3))
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([block_id] * len(full), pa.int64()), pa.array(out, pa.binary())], ["bucket", "block_id", "part"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, shared, late in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                block = Block.unpacked(blob)
                copy = copies(block, shared)
                edges = np.zeros(len(block.raw) + 1, np.int32)
                for part in late or ():
                    starts = unflat(part["part"], True)[0]
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, starts + width, -1)
                size = np.diff(block.bounds)
                for k in np.flatnonzero(copy & (size >= width)):
                    edges[block.bounds[k]] += 1
                    edges[block.bounds[k + 1]] -= 1
                gone = np.cumsum(edges[:-1]) > 0
                kept, begins, ends = [], [], []
                for k in range(len(block)):
                    mask = gone[block.bounds[k] : block.bounds[k + 1]]
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                    begins.append(turn[::2])
                    ends.append(turn[1::2])
                    kept.append(block.raw[block.bounds[k] : block.bounds[k + 1]][~mask].tobytes() if len(turn) else block.text(k))
                removed = [int((e - b).sum()) for b, e in zip(begins, ends, strict=True)]
                columns = [pa.array(block.ids, pa.int64(), mask=block.ids == NO_ID), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "kept", "n_bytes", "n_removed", "span_starts", "span_ends"])

    schema = "bucket int, block_id long, part binary"
    # both later passes read these answers; settled, they are worked out once
    shared = settle(by_bucket(blocks.mapInArrow(send_anchors, schema), buckets, lambda parts: shared_in_buckets(parts, hot)))
    contexts = with_parts(blocks, shared).select("block_id", "blob", "parts0").mapInArrow(send_contexts, schema)
    late = by_bucket(contexts, buckets, lambda parts: later_in_buckets(parts, width, gram))
    out = "doc_id long, kept binary, n_bytes long, n_removed long, span_starts array<long>, span_ends array<long>"
    return with_parts(blocks, shared, late).select("blob", "parts0", "parts1").mapInArrow(cut, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_later_copies(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def oracle() -> str:
    """Every window of hexadecimal bytes, numbered by where it starts in DuckDB; runs of covered bytes by gaps between windows."""
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, o, substr(h, 2 * o + 1, {2 * (512 + WIDTH - 1)}) AS c FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {WIDTH - 1}, 512)) AS o FROM d WHERE length(h) >= {2 * WIDTH})),
g AS (SELECT doc_id, o + q AS p, substr(c, 2 * q + 1, {2 * WIDTH}) AS g FROM (SELECT doc_id, o, c, unnest(range(0, least(512, length(c) // 2 - {WIDTH - 1}))) AS q FROM c)),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY md5(g) ORDER BY doc_id, p) AS k FROM g) WHERE k > 1),
run AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {WIDTH} THEN 0 ELSE 1 END AS new FROM late)),
span AS (SELECT doc_id, min(p) AS lo, max(p) + {WIDTH} AS hi FROM run GROUP BY doc_id, run),
gap AS (SELECT doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM (SELECT doc_id, lo, hi FROM span UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM d)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS kept FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed FROM span GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""
