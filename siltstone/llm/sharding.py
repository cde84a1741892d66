"""Shards of nearly equal bytes by histogram sort.

Rows are ordered by (hash of the text, id, hash of the row). Candidate boundaries in that order are probed: every partition counts
exactly the rows and bytes between neighbouring probes and their smallest and largest keys, Spark adds the counts up, and the intervals
in which a wanted boundary lies are probed again more finely, until each boundary's bytes are within tolerance of the wanted ones. Only then do
rows move, once, into cells between the boundaries; as the rows below each boundary are counted, a row's place in its shard follows
from its place in its cell.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import forget, fresh, settle, small_batches, table

SHARDS = 40
#: Bytes of a row beside its text.
ROW_BYTES = 16
#: A shard's boundary may lie this part of a shard's bytes off; cells inside a shard half a cell.
TOLERANCE = 0.001
#: Probes inside an interval in which a boundary is wanted, and cells for each shuffle partition.
PROBES, CELLS = 24, 8
KEY = ("text_hash", "id_key", "row_hash")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as (row struct of all columns, size, text_hash, id_key, row_hash). A null text counts as empty, a null id comes first."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    plain = [F.to_json(F.struct(f"`{c}`")) if kind.startswith(("map", "variant")) else F.col(f"`{c}`") for c, kind in docs.dtypes]
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        (F.octet_length(text) + F.lit(ROW_BYTES).cast("long")).alias("size"),
        F.xxhash64(text).alias("text_hash"),
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63))).alias("id_key"),
        F.xxhash64(*plain, *(F.col(f"`{c}`").isNull() for c in docs.columns)).alias("row_hash"),
    )


def _keys(columns: list[np.ndarray]) -> np.ndarray:
    """Three signed 64-bit columns as strings of 24 bytes that compare in the same order."""
    out = np.empty((len(columns[0]), 3), ">u8")
    for k, c in enumerate(columns):
        out[:, k] = c.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out.view("S24").ravel()


def _number(key: bytes) -> int:
    return int.from_bytes(key.ljust(24, b"\0"), "big")


def _counted(keys: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(k, rows, bytes, smallest key, largest key) of the rows that have exactly k of the sorted probes at or below them; the others have none."""
    cuts = np.array([p.to_bytes(24, "big") for p in probes], "S24")
    many = len(cuts) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, low, high = np.zeros(many, np.int64), np.zeros(many, np.int64), np.full(many, b"\xff" * 24, "S24"), np.zeros(many, "S24")
        for batch in batches:
            key = _keys([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            order = np.argsort(key)
            key = key[order]
            which = np.searchsorted(cuts, key, "right")
            at, first = np.unique(which, return_index=True)
            last = np.append(first[1:], len(which)) - 1
            rows[at] += last - first + 1
            size[at] += np.add.reduceat(batch.column(3).to_numpy(zero_copy_only=False)[order], first) if len(at) else 0
            low[at], high[at] = np.where(key[first] < low[at], key[first], low[at]), np.where(key[last] > high[at], key[last], high[at])
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(rows[at]), pa.array(size[at]), *(pa.array([k.ljust(24, b"\0") for k in x[at].tolist()], pa.binary()) for x in (low, high))], ["k", "rows", "bytes", "low", "high"])

    parts = keys.select(*KEY, "size").mapInArrow(run, "k long, rows long, bytes long, low binary, high binary")
    found = parts.groupBy("k").agg(F.sum("rows"), F.sum("bytes"), F.min("low"), F.max("high")).collect()
    return sorted((k, n, b, _number(bytes(lo)), _number(bytes(hi))) for k, n, b, lo, hi in found)


@dataclass
class Span:
    """Neighbouring keys from low to high, both of which rows have, with the rows and bytes in front of them and their own."""

    low: int
    high: int
    rows_below: int
    bytes_below: int
    rows: int
    bytes: int


@dataclass
class Cells:
    """Cell k holds the rows from key starts[k] on, below starts[k + 1]; rows_before counts those of its shard in earlier cells."""

    starts: list[int]
    shard: list[int]
    rows_before: list[int]


def _split(keys: DataFrame, spans: list[Span], wide: list[Span], each: int) -> list[Span]:
    """spans with those in `wide` counted anew between `each` evenly spaced probes."""
    probes = sorted({s.low + (s.high - s.low + 1) * k // (each + 1) for s in wide for k in range(each + 1)} | {s.high + 1 for s in wide})
    index, got, out = {p: k for k, p in enumerate(probes)}, {k: rest for k, *rest in _counted(keys, probes)}, []
    for s in spans:
        if s not in wide:
            out.append(s)
            continue
        rows, size = s.rows_below, s.bytes_below
        for k in range(index[s.low] + 1, index[s.high + 1] + 1):
            if k in got:
                n, b, low, high = got[k]
                out.append(Span(low, high, rows, size, n, b))
                rows, size = rows + n, size + b
    return out


def boundaries(keys: DataFrame, shards: int = SHARDS, cells: int = 1, tolerance: float = TOLERANCE) -> Cells:
    """Boundaries of `shards` shards of nearly equal bytes, each cut into about `cells` cells, by repeated counting over keys (KEY, size).

    A boundary is taken when the bytes below it are within `tolerance` of a shard's bytes, or when its span is down to one key: then no
    boundary is nearer. Rows with equal keys (equal text, id and columns) can't be told apart and stay together. The driver gets at most
    a row for each probe: some for each shard and cell, however many rows there are.
    """
    spans = [Span(low, high, 0, 0, n, b) for _, n, b, low, high in _counted(keys, [])]
    if not spans:
        return Cells([0], [0], [0])
    total, each = spans[0].bytes, 2 * shards * cells
    goals = [(total * k // (shards * cells), total * (tolerance if k % cells == 0 else 0.5 / cells) / shards) for k in range(1, shards * cells)]
    while True:
        places = [(s.bytes_below, s.rows_below, s.low) for s in spans] + [(total, spans[-1].rows_below + spans[-1].rows, spans[-1].high + 1)]
        below, nearest, wide = [p[0] for p in places], [], set()
        for goal, off in goals:
            k = bisect_right(below, goal) - 1
            nearest.append(min(places[k : k + 2], key=lambda p: abs(p[0] - goal)))  # noqa: B023
            if abs(nearest[-1][0] - goal) > off and k < len(spans) and spans[k].low < spans[k].high:
                wide.add(k)
        if not wide:
            break
        spans, each = _split(keys, spans, [spans[k] for k in sorted(wide)], each), PROBES
    chosen = {}
    for k, (_, rows, key) in enumerate(nearest, 1):
        chosen[key] = (rows, k // cells if k % cells == 0 else chosen.get(key, (0, 0))[1])
    starts, shard, before, base = [0], [0], [0], 0
    for key, (rows, begins) in sorted(chosen.items()):
        base = rows if begins else base
        starts, shard, before = [*starts, key], [*shard, begins or shard[-1]], [*before, rows - base]
    return Cells(starts, shard, before)


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard, in key order); where docs has such a column, the new one begins with an underscore.

    Law: bytes. Each boundary between shards has an equal share of the bytes (of texts, and ROW_BYTES for each row) below it, but for `tolerance` of a
    shard, or as nearly as whole rows allow: a text longer than a shard leaves shards beside it short or empty. Equal texts lie next to each
    other, so a group of copies is cut only where a boundary falls inside it. Null texts count as empty; rows equal in all columns stay
    in one shard. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = sized(docs, id_col, text_col)
    keys = settle(rows.drop("row"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = boundaries(keys, shards, -(-CELLS * partitions // shards), tolerance)
    forget(keys)
    cuts = np.array([s.to_bytes(24, "big") for s in cells.starts[1:]], "S24")
    of_shard, before = np.array(cells.shard, np.int32), np.array(cells.rows_before, np.int64)

    @F.pandas_udf("cell int, shard int, before long")
    def cell_of(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        k = np.searchsorted(cuts, _keys([x.to_numpy() for x in (a, b, c)]), "right")
        return pd.DataFrame({"cell": k.astype(np.int32), "shard": of_shard[k], "before": before[k]})

    place = Window.partitionBy("at.cell").orderBy(*KEY)
    dealt = rows.withColumn("at", cell_of(*KEY)).withColumn("slot", F.col("at.before") + F.row_number().over(place) - 1)
    return dealt.select("row.*", F.col("at.shard").alias(fresh("shard", docs.columns)), F.col("slot").alias(fresh("slot", docs.columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return dealt.select("doc_id", (F.octet_length(text) + F.lit(ROW_BYTES).cast("long")).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
