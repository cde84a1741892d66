"""Benchmark decontamination by pigeonhole edit matching over words.

An item with an error budget of e words is split into e + 1 pieces: where a text has the item with at most e edits, one piece at least
stands there unchanged. Exact piece hits come from rolling hashes of the texts' words; around each hit Myers' bit-parallel distance
decides. Items are shipped to the tasks in chunks of bounded size, one pass over the documents for each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import small_batches, table, text_parts
from siltstone.llm.toxicity import present
from siltstone.llm.window_dedup import BASE

#: Edits an item may have, as a share of its words.
ERROR_RATE = 0.15
#: Items of fewer words are not searched; by default all are. Those of fewer than 7 words stand without edits.
LEAST_WORDS = 1
#: Characters of scripts without spaces between words: each is a word.
UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
#: Bytes of item text that one pass takes to its tasks.
CHUNK_BYTES = 8 << 20
FILTER = 1 << 20


def scores(pattern: list[int], text: list[int], anchored: bool) -> Iterator[int]:
    """After each word of text, the least edit distance of the pattern to a part that ends there; anchored: to all of text up to there."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for k, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for w in text:
        eq = peq.get(w, 0)
        vertical = eq | down
        level = (((eq & up) + up) ^ up) | eq
        rise, fall = down | (full & ~(level | up)), up & level
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise = (rise << 1 | anchored) & full
        up, down = ((fall << 1) | (full & ~(vertical | rise))) & full, rise & vertical
        yield score


class Pieces:
    """Items as word hashes with their budgets, and all their pieces by length."""

    def __init__(self, items: list[tuple[int, np.ndarray]], rate: float) -> None:
        self.ids = [i for i, _ in items]
        self.words = [w.tolist() for _, w in items]
        self.budget = [int(rate * len(w)) for w in self.words]
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        for k, (_, words) in enumerate(items):
            cuts = np.linspace(0, len(words), self.budget[k] + 2).astype(int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                by_length.setdefault(b - a, []).append((int(rolled(words[a:b], b - a)[0]), k, a))
        self.lengths = {n: (np.array([p[0] for p in sorted(found)], np.uint64), [p[1:] for p in sorted(found)]) for n, found in by_length.items()}
        self.filters = {}
        for n, (hashes, _) in self.lengths.items():
            self.filters[n] = np.zeros(FILTER, bool)
            self.filters[n][(hashes >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(item, place where it would start) for each piece that stands somewhere in words."""
        found = set()
        for n, (hashes, owners) in self.lengths.items():
            if len(words) < n:
                continue
            h = rolled(words, n)
            at = np.flatnonzero(self.filters[n][(h >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(hashes, h[at]), np.searchsorted(hashes, h[at], "right")
            for k in np.flatnonzero(hi > lo):
                found |= {(item, int(at[k]) - offset) for item, offset in owners[lo[k] : hi[k]]}
        return found


def rolled(words: np.ndarray, n: int) -> np.ndarray:
    """A Rabin-Karp hash of each n words in a row."""
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(BASE)
        out += words[k : len(words) - n + 1 + k]
    return out * np.uint64(0xD6E8FEB86659FD93)


def places(pieces: Pieces, words: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(item, first word, end, distance) of each place in a document.

    An item's places don't overlap: of all parts within its budget, each the shortest of least distance for its end, those of smaller
    distance, then of earlier end, are taken first. Parts lie around hits of pieces, so only stretches of hits are searched.
    """
    found: list[tuple[int, int, int, int]] = []
    stretch: list[int] = []
    hits = sorted(pieces.hits(words))
    for k, (item, start) in enumerate(hits):
        stretch.append(start)
        m, e = len(pieces.words[item]), pieces.budget[item]
        if k + 1 < len(hits) and hits[k + 1][0] == item and hits[k + 1][1] - e < start + m + e:
            continue
        lo, hi = max(0, stretch[0] - e), min(len(words), stretch[-1] + m + e)
        stretch = []
        text, back, taken = words[lo:hi].tolist(), pieces.words[item][::-1], np.zeros(hi - lo, bool)
        near = sorted((score, end) for end, score in enumerate(scores(pieces.words[item], text, False), 1) if score <= e)
        for score, end in near:
            if taken[end - 1]:
                continue
            length = next(n for n, s in enumerate(scores(back, text[max(0, end - m - e) : end][::-1], True), 1) if s == score)
            if not taken[end - length : end].any():
                taken[end - length : end] = True
                found.append((item, lo + end - length, lo + end, score))
    return sorted(found)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the bounds of each text's; characters of unspaced scripts, of three bytes or more, are words."""
    raw, _ = text_parts(texts)
    return present(pc.replace_substring_regex(texts, UNSPACED, r" \1 ") if (raw >= 0xE0).any() else texts)


def chunks(benchmark: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> Iterator[DataFrame]:
    """The benchmark's items in as many parts by hash as keep one under about half of chunk_bytes."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("size")).first().size
    n = 2 * size // chunk_bytes + 1
    for k in range(n):
        yield items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, least_words: int = LEAST_WORDS, chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Places where documents have benchmark items with at most rate * words edits (words put in, left out or changed).

    Returns (doc_id, item_id, first_word, end_word, distance), one row for each place: an item's places in a document don't overlap, nearer ones
    are taken first, then earlier ones. Words are runs of letters, digits and
    bytes beyond ASCII, A-Z in lower case; in scripts without spaces, such as Chinese, Japanese and Thai, characters. Null and empty texts and items of fewer than `least_words` words have no places; rows that
    repeat a document have its places each, repeated items count once; an item whose text changes under one id counts with each
    text; a null doc_id stays null. Other columns aren't read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for chunk in chunks(benchmark, item_id_col, item_text_col, chunk_bytes):
        got = chunk.orderBy("item_id", "text").toArrow()  # bounded by chunk_bytes
        hashes, bounds = words_of(pa.concat_arrays(got.column("text").chunks) if got.num_rows else pa.array([], pa.string()))
        items = [(i, hashes[a:b]) for i, a, b in zip(got.column("item_id").to_pylist(), bounds[:-1], bounds[1:], strict=True) if b - a >= least_words]
        found = searched(rows, items, rate)
        out = found if out is None else out.union(found)
    return out


def searched(rows: DataFrame, items: list[tuple[int, np.ndarray]], rate: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(items, rate)
        for batch in batches:
            words, bounds = words_of(batch.column(1).fill_null(""))
            out = []
            ids = batch.column(0).to_pylist()
            for d in touched(pieces, words, bounds):
                out += [(ids[d], pieces.ids[item], a, b, e) for item, a, b, e in places(pieces, words[bounds[d] : bounds[d + 1]])]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "first_word", "end_word", "distance"])

    return rows.mapInArrow(run, "doc_id long, item_id long, first_word long, end_word long, distance long")


def touched(pieces: Pieces, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Documents of a batch in which some piece may stand."""
    at = [np.zeros(0, np.int64)]
    for n, bits in pieces.filters.items():
        if len(words) >= n:
            h = rolled(words, n)
            here = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
            at.append(here[np.isin(h[here], pieces.lengths[n][0])])
    return np.unique(np.searchsorted(bounds, np.concatenate(at), "right") - 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
