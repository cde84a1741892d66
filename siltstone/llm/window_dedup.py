"""Substring dedup by Rabin-Karp hashes of every fixed-length token window, counted over the corpus.

Each block of documents hashes all its windows in one rolling pass and sends SENT bytes of every distinct hash once to the hash's
bucket. A bucket finds the hashes that more than one block has and answers with a bitmap over what the block sent; what a block holds
twice it knows itself. Windows that this finds are counted again by 128 bits, of two rolling hashes over two hashes of each word, in the
same way, so that chance decides nothing at any size that fits on disks. Repeated windows then merge into maximal removal intervals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from siltstone.llm.common import Block, Dealt, bucket_count, by_bucket, mixed, pack_blocks, settle, table, with_parts

WINDOW = 35
BLOCK_BYTES = 8 << 20
CARRIED = "_siltstone_carried"
BASE = 0x9E3779B97F4A7C15
#: Base of the second hash, and bytes of the first that the first count goes by (beside the bucket, which tells the rest).
BASE_TOO, SENT = 0xC2B2AE3D27D4EB4F, 6
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(block: Block, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the block, and the bounds of each document's words; words are runs of bytes that don't separate."""
    hashes, bounds = seeded_word_hashes(block, (0,), separator)
    return hashes[0], bounds


def seeded_word_hashes(block: Block, seeds: tuple[int, ...], separator: np.ndarray = SEPARATOR) -> tuple[list[np.ndarray], np.ndarray]:
    """word_hashes with each of the seeds."""
    kept = ~separator[block.raw]
    starts = kept.copy()
    starts[1:] &= ~kept[:-1]
    first = block.bounds[:-1][np.diff(block.bounds) > 0]
    starts[first] = kept[first]
    at = np.flatnonzero(starts)
    bounds = np.searchsorted(at, block.bounds)
    if not len(at):
        return [np.zeros(0, np.uint64) for _ in seeds], bounds
    letters = block.raw[kept]
    offsets = np.append(np.flatnonzero(starts[kept]), len(letters)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    different, at = words.dictionary.to_pylist(), words.indices.to_numpy()
    return [np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in different), np.uint64, len(different))[at] for seed in seeds], bounds


def window_hashes(block: Block, width: int, both: bool = False) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The word index at which each window starts, the windows' Rabin-Karp hashes (one, or both), and the documents' word bounds."""
    words, bounds = seeded_word_hashes(block, (0, 1) if both else (0,))
    n = len(words[0])
    within = np.ones(n, bool)
    for k in range(len(block)):
        within[max(bounds[k], bounds[k + 1] - width + 1) : bounds[k + 1]] = False
    starts = np.flatnonzero(within)
    return starts, [rolling(w, starts, width, base) for w, base in zip(words, (BASE, BASE_TOO), strict=False)], bounds


def rolling(words: np.ndarray, starts: np.ndarray, width: int, base: int) -> np.ndarray:
    powers = np.cumprod(np.full(len(words), base, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers)])
    shift = np.cumprod(np.full(len(words), pow(base, -1, 2**64), np.uint64))
    return (sums[starts + width] - sums[starts]) * shift[starts]


def shortened(hashes: np.ndarray) -> bytes:
    """The SENT lower bytes of each mixed hash; the bucket is told by the upper ones."""
    return np.ascontiguousarray(mixed(hashes).view(np.uint8).reshape(-1, 8)[:, :SENT]).tobytes()


def repeated_in_buckets(parts: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """For each block the bitmap of those of its shortened hashes that another block has too."""
    sent = []
    for block_id, part in parts:
        hashes = np.zeros((len(part) // SENT, 8), np.uint8)
        hashes[:, :SENT] = np.frombuffer(part, np.uint8).reshape(-1, SENT)
        sent.append((block_id, hashes.view(np.uint64)[:, 0]))
    yield from shared(sent)


def confirmed_in_buckets(parts: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """The same for hashes of 128 bits."""
    pairs = [(block_id, np.frombuffer(part, np.uint64).reshape(-1, 2)) for block_id, part in parts]
    every = np.concatenate([p for _, p in pairs])
    by = np.lexsort([every[:, 1], every[:, 0]])
    new = np.append(True, (every[by][1:] != every[by][:-1]).any(axis=1))
    number = np.zeros(len(every), np.uint64)
    number[by] = np.cumsum(new).astype(np.uint64)
    cuts = np.cumsum([0, *(len(p) for _, p in pairs)])
    yield from shared([(block_id, number[a:b]) for (block_id, _), a, b in zip(pairs, cuts[:-1], cuts[1:], strict=True)])


def shared(sent: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, bytes]]:
    """For each block the bitmap of those of its numbers, each there once, that another block has too."""
    every = np.sort(np.concatenate([h for _, h in sent]))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    if len(twice):
        for block_id, hashes in sent:
            at = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
            if (hit := twice[at] == hashes).any():
                yield block_id, np.packbits(hit).tobytes()


class Windows:
    """The windows of a block, and which of them repeat by the first count and by the second."""

    def __init__(self, block: Block, width: int, buckets: int, parts: list[dict] | None) -> None:
        self.starts, (first, second), self.bounds = window_hashes(block, width, True)
        distinct, inverse, counts = np.unique(first, return_inverse=True, return_counts=True)
        repeated = counts > 1
        answered(repeated, Dealt(distinct, buckets), parts)
        self.starts = self.starts[hit := repeated[inverse]]
        first, second = first[hit], second[hit]
        by = np.lexsort([second, first])
        new = np.append(True, (first[by][1:] != first[by][:-1]) | (second[by][1:] != second[by][:-1]))[: len(by)]
        self.inverse = np.zeros(len(by), np.int64)
        self.inverse[by] = np.cumsum(new) - 1
        self.first, self.second, self.counts = first[by][new], second[by][new], np.bincount(self.inverse, minlength=int(new.sum()))
        self.dealt = Dealt(self.first, buckets)

    def repeated(self, parts: list[dict] | None) -> np.ndarray:
        """The word indices at which windows start that repeat."""
        repeated = self.counts > 1
        answered(repeated, self.dealt, parts)
        return self.starts[repeated[self.inverse]]


def answered(repeated: np.ndarray, dealt: Dealt, parts: list[dict] | None) -> None:
    """Mark what the buckets' bitmaps say repeats."""
    for part in parts or ():
        mine = dealt.of(part["bucket"])
        repeated[mine] |= np.unpackbits(np.frombuffer(part["part"], np.uint8), count=len(mine)).astype(bool)


def remove_repeated_windows(docs: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), tidy: bool = True) -> DataFrame:
    """Remove every word that a window of `width` words covers whose word sequence also starts elsewhere in the corpus.

    Returns (doc_id, text, n_words, n_removed): text has the kept words, joined by one space. Words are runs of other bytes
    than white space. All copies of a window go, the first one too. Null and empty texts give an empty text and zeros; rows
    that repeat a document count as further documents; a null id stays null. With tidy=False, texts that lose nothing keep their white
    space. The columns `carry` follow as they are, as fields of the column CARRIED, so that no name can clash; others are not read.
    """
    blocks = pack_blocks(docs, block_bytes, id_col, text_col, carry)
    buckets = bucket_count(docs, 2 << 20)

    def batch_of(block_id: int, dealt: Dealt, part: Callable[[np.ndarray], bytes]) -> pa.RecordBatch:
        ids = dealt.buckets
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([block_id] * len(ids), pa.int64()), pa.array([part(dealt.of(k)) for k in ids], pa.binary())], ["bucket", "block_id", "part"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = np.unique(window_hashes(Block.unpacked(blob), width)[1][0])
                yield batch_of(block_id, Dealt(hashes, buckets), lambda at, h=hashes: shortened(h[at]))

    def send_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, blob, parts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = Windows(Block.unpacked(blob), width, buckets, parts)
                yield batch_of(block_id, found.dealt, lambda at, w=found: np.stack([w.first[at], w.second[at]], axis=1).tobytes())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, parts, confirmed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                block = Block.unpacked(blob)
                found = Windows(block, width, buckets, parts)
                hit, bounds = found.repeated(confirmed), found.bounds
                edges = np.zeros(bounds[-1] + 1, np.int32)
                np.add.at(edges, hit, 1)
                np.add.at(edges, hit + width, -1)
                keep = np.cumsum(edges[:-1]) == 0
                kept, removed = [], []
                for k in range(len(block)):
                    mask, text = keep[bounds[k] : bounds[k + 1]], block.text(k)
                    removed.append(len(mask) - int(mask.sum()))
                    words = compress(text.split(), mask) if removed[-1] else text.split() if tidy else [text]
                    kept.append(b" ".join(words))
                ids = pa.array(block.ids, pa.int64(), mask=block.ids == -(2**63))
                yield pa.RecordBatch.from_arrays([ids, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(np.diff(bounds), pa.int64()), pa.array(removed, pa.int64()), *(c.combine_chunks() for c in (block.carried.columns if carry else ()))], [f.name for f in out])

    own = ["doc_id", "text", "n_words", "n_removed"]
    out = StructType([*(StructField(n, t) for n, t in zip(own, (LongType(), StringType(), LongType(), LongType()), strict=True)), *(StructField(f"_carried{k}", docs.schema[c].dataType) for k, c in enumerate(carry))])
    schema = "bucket int, block_id long, part binary"
    # both later passes read these answers; settled, they are worked out once
    first = settle(by_bucket(blocks.mapInArrow(send, schema), buckets, repeated_in_buckets))
    again = with_parts(blocks, first).select("block_id", "blob", "parts0").mapInArrow(send_again, schema)
    second = by_bucket(again, buckets, confirmed_in_buckets)
    cut_texts = with_parts(blocks, first, second).select("blob", "parts0", "parts1").mapInArrow(cut, out)
    return cut_texts.select(*own, F.struct(*(F.col(f"_carried{k}").alias(c) for k, c in enumerate(carry))).alias(CARRIED)) if carry else cut_texts


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_windows(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def oracle() -> str:
    """Every window as a text, counted in DuckDB, and the words that the repeated ones leave."""
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d WHERE len(w) >= {WINDOW})),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p + unnest(range(0, {WINDOW})) AS i FROM r),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, count(*) FILTER (gone.i IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone.i IS NULL) AS kept FROM word LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
