"""Pieces that the corpus operators share: settled tables, packed blocks of documents and the exchange by bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.tables import forget, fresh, pack, settle, small_batches, unpack  # noqa: F401

NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def bucket_count(df: DataFrame, bytes_each: int, at_least: int = 4) -> int:
    """Buckets for an exchange: some for each shuffle partition, and more as the input grows, so that one bucket keeps its size."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return int(max(at_least * partitions, size // bytes_each if size < 1 << 60 else 0))  # beyond that Spark doesn't know the size


def text_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and the offsets of its rows in them."""
    wide = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else column.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Block:
    """Some whole documents: ids (NO_ID for null), their bytes in a row, the bounds of each in these, and columns carried along."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, bounds: np.ndarray, carried: pa.Table | None = None) -> None:
        self.ids, self.raw, self.bounds, self.carried = ids, raw, bounds, carried

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, k: int) -> bytes:
        return self.raw[self.bounds[k] : self.bounds[k + 1]].tobytes()

    def packed(self) -> bytes:
        return pack((self.ids, self.raw.tobytes(), self.bounds, self.carried), 3)

    @staticmethod
    def unpacked(blob: bytes) -> Block:
        ids, raw, bounds, carried = unpack(blob, True)
        return Block(ids, np.frombuffer(raw, np.uint8), bounds, carried)


def pack_blocks(docs: DataFrame, block_bytes: int, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Settled (block_id long, blob binary): documents in runs of about block_bytes, with the columns `carry`. Null texts become empty.

    Being written once, blocks keep their members and order for every later pass, whatever is computed again.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seq, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def out() -> pa.RecordBatch:
            ids, raws, lengths = (np.concatenate(x) for x in list(zip(*held, strict=True))[:3])
            carried = pa.Table.from_batches([h[3] for h in held]).combine_chunks() if carry else None
            blob = Block(ids, raws, np.concatenate([[0], np.cumsum(lengths)]), carried).packed()
            return pa.RecordBatch.from_arrays([pa.array([first + seq], pa.int64()), pa.array([blob], pa.binary())], ["block_id", "blob"])

        for batch in batches:
            raw, bounds = text_parts(batch.column(1).fill_null(""))
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            rest = pa.RecordBatch.from_arrays(batch.columns[2:], list(carry)) if carry else batch
            at = 0
            while at < len(ids):  # as many rows as the block still takes
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + block_bytes - size, "right")) - 1)
                held.append((ids[at:to], raw[bounds[at] : bounds[to]], np.diff(bounds[at : to + 1]), rest.slice(at, to - at)))
                size, at = size + int(bounds[to] - bounds[at]), to
                if size >= block_bytes or at < len(ids):
                    yield out()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"carried{k}") for k, c in enumerate(carry)))
    return settle(rows.mapInArrow(run, "block_id long, blob binary"))


def by_bucket(entries: DataFrame, buckets: int, reduce: Callable[[list[tuple[int, bytes]]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """entries (bucket int, block_id long, part binary) meet by bucket; reduce gets a bucket's (block_id, part) and gives parts for blocks.

    Each block sends a bucket at most one part, in which equal keys were merged before; so a hot key brings a bucket one entry a block.
    Returns (bucket int, block_id long, part binary).
    """

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        out = list(reduce(list(zip(group.column("block_id").to_pylist(), group.column("part").to_pylist(), strict=True))))
        return pa.table({"bucket": pa.array([bucket] * len(out), pa.int32()), "block_id": pa.array([x[0] for x in out], pa.int64()), "part": pa.array([x[1] for x in out], pa.binary())})

    return entries.groupBy("bucket").applyInArrow(run, "bucket int, block_id long, part binary")


def with_parts(blocks: DataFrame, *returned: DataFrame) -> DataFrame:
    """blocks with a column parts<k> for each table of returned parts: an array of (bucket, part), null where none came back."""
    for k, parts in enumerate(returned):
        mine = parts.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "part")).alias(f"parts{k}"))
        blocks = blocks.join(mine, "block_id", "left")
    return blocks


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (a Murmur-style finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((mixed(h) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Dealt:
    """Keys by bucket; only buckets that have some take room, however many there are."""

    def __init__(self, keys: np.ndarray, buckets: int) -> None:
        which = bucket_of(keys, buckets)
        self.order = np.argsort(which, kind="stable")
        self.buckets, first = np.unique(which[self.order], return_index=True)
        ends = np.append(first[1:], len(which)) if len(first) else first
        self._bounds = dict(zip(self.buckets.tolist(), zip(first.tolist(), ends.tolist(), strict=True), strict=True))

    def of(self, bucket: int) -> np.ndarray:
        """Where the keys of a bucket stand."""
        lo, hi = self._bounds.get(int(bucket), (0, 0))
        return self.order[lo:hi]


def flat(*arrays: np.ndarray, level: int = 0) -> bytes:
    """Arrays as bytes: six for each array's type, columns and length, then their numbers."""
    head = b"".join(a.dtype.char.encode() + bytes([a.shape[1] if a.ndim == 2 else 0]) + len(a).to_bytes(4, "little") for a in arrays)
    raw = b"".join([bytes([len(arrays)]), head, *(a.tobytes() for a in arrays)])
    return zstandard.ZstdCompressor(level=level).compress(raw) if level else raw


def unflat(blob: bytes, squeezed: bool = False) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob) if squeezed else blob
    out, at = [], 1 + 6 * raw[0]
    for k in range(1, at, 6):
        kind, columns, length = np.dtype(chr(raw[k])), raw[k + 1], int.from_bytes(raw[k + 2 : k + 6], "little")
        count = length * max(1, columns)
        found = np.frombuffer(raw, kind, count, at)
        out.append(found.reshape(length, columns) if columns else found)
        at += count * kind.itemsize
    return out
