"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text's lattice has an edge for every piece of the vocabulary that stands in it, and for the bytes of characters without a piece.
No piece has a space after another character, and none has bytes such as a line feed, so the lattice falls apart into words; a
batch's different words are filtered once, each in all positions at a time, and every occurrence is sampled by itself, with random
numbers that depend on the row's key and the position in the text alone. Equal keys and texts thus give equal pieces, however rows
are dealt out. Piece weights follow Zipf's law by rank in the vocabulary, tempered by `alpha`.

Memory: words go through lattices of at most LATTICE_BYTES of text, so a lattice has at most that many bytes times the bytes of the
longest piece as edges, whatever the batch. A word of more than LONG_WORD bytes is filtered along stretches of STRETCH bytes, of which
only the weight of each position is kept, and sampled from the last stretch back, whose edges are then made again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import mixed, small_batches, table, text_parts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 0.5
#: Added to a piece's rank: the first pieces weigh about alike.
FLAT = 100
SPACE = 0x20
#: Bytes of words in one lattice; bytes beyond which a word goes by stretches, and those of a stretch.
LATTICE_BYTES, LONG_WORD, STRETCH = 1 << 16, 1 << 10, 1 << 13
#: Bytes of the character that a byte begins; 0 for one inside a character.
WIDTH_OF = np.array([1] * 0x80 + [0] * 0x40 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10, np.int8)


class Vocabulary:
    """The pieces by id, with a space for the model's word mark; ids of single bytes; and the trie of all pieces as sorted edges."""

    def __init__(self, pieces: list[tuple[int, bytes, float]], byte_ids: list[int], size: int, alpha: float) -> None:
        self.byte_ids = np.array(byte_ids, np.int64)
        self.bytes_of = np.full(size, b"", object)
        self.log_weight = np.full(size, -30.0)
        for b, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([b])
        ranks = sorted(range(len(pieces)), key=lambda k: (-pieces[k][2], pieces[k][0]))
        scale = np.log(sum(1.0 / (r + FLAT) for r in range(len(pieces))))
        for r, k in enumerate(ranks):
            i, text, _ = pieces[k]
            self.bytes_of[i] = text
            self.log_weight[i] = alpha * (-np.log(r + FLAT) - scale)
        nodes: dict[bytes, int] = {b"": 0}
        edges, ends = {}, {}
        for i, text, _ in pieces:
            for n in range(1, len(text) + 1):
                if text[:n] not in nodes:
                    nodes[text[:n]] = len(nodes)
                    edges[nodes[text[: n - 1]] << 8 | text[n - 1]] = nodes[text[:n]]
            ends[nodes[text]] = i
        self.edge_keys = np.array(sorted(edges), np.int32)
        self.edge_to = np.array([edges[k] for k in self.edge_keys.tolist()], np.int32)
        self.start = np.full(256, -1, np.int32)
        roots = self.edge_keys < 256
        self.start[self.edge_keys[roots]] = self.edge_to[roots]
        self.piece_at = np.full(len(nodes), -1, np.int32)
        self.piece_at[list(ends)] = list(ends.values())
        self.longest = max(len(text) for _, text, _ in pieces)
        self.alone = ~np.isin(np.arange(256), np.unique(np.frombuffer(b"".join(t for _, t, _ in pieces), np.uint8)))
        if any(SPACE in text.lstrip(b" ") for _, text, _ in pieces):
            raise ValueError("a piece has a space after another character, so words aren't apart")


def pieces_of(model_file: str) -> tuple[list[tuple[int, bytes, float]], list[int], int]:
    """(id, bytes, score) of the normal pieces, the ids of the byte pieces, and the size of a model's vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    byte_ids = {int(model.id_to_piece(i)[3:-1], 16): i for i in ids if model.is_byte(i)}
    normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return [(i, model.id_to_piece(i).replace("▁", " ").encode(), model.get_score(i)) for i in normal], [byte_ids[b] for b in range(256)], len(ids)


@lru_cache(maxsize=2)
def vocabulary(model_file: str, alpha: float) -> Vocabulary:
    return Vocabulary(*pieces_of(model_file), alpha)


def word_starts(raw: np.ndarray, bounds: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Where the lattice falls apart: at the first space of some, around bytes that no piece has, and where texts begin."""
    cut = np.zeros(len(raw) + 1, bool)
    space, single = raw == SPACE, alone[raw]
    cut[:-1] |= single
    cut[1:] |= single
    cut[1:-1] |= space[1:] & ~space[:-1]
    cut[bounds] = True
    return np.flatnonzero(cut)


def edges_of(words: np.ndarray, left: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, piece) of all edges, by end and of the ways to one end the longest first; left: bytes from each byte to its word's end.

    An edge is a piece that stands in a word, or a byte of a character that is no piece by itself.
    """
    state = vocab.start[words]
    at = np.flatnonzero(state >= 0).astype(np.int32)
    state = state[at]
    keys, ids = [], []
    width = WIDTH_OF[words]
    single = np.zeros(len(words), bool)  # characters that are a piece by themselves
    for n in range(1, vocab.longest + 1):
        piece = vocab.piece_at[state]
        full = piece >= 0
        begins = at[full]
        keys.append((begins.astype(np.int64) + n) * 64 - n)
        ids.append(piece[full])
        single[begins[width[begins] == n]] = True
        more = left[at] > n
        at = at[more]
        if not len(at):
            break
        key = (state[more] << 8) | words[at + n]
        edge = np.minimum(np.searchsorted(vocab.edge_keys, key), len(vocab.edge_keys) - 1)
        ok = vocab.edge_keys[edge] == key
        at, state = at[ok], vocab.edge_to[edge[ok]]
    # bytes of characters without a piece
    lead = np.flatnonzero((width > 0) & ~single)
    by_byte = lead[:, None] + np.arange(4)
    by_byte = by_byte[(np.arange(4) < width[lead][:, None]) & (by_byte < len(words))]
    key = np.concatenate([*keys, (by_byte + 1) * 64 - 1])
    order = np.argsort(key)  # no two edges have both end and length in common
    key = key[order]
    end = (key + 63) >> 6
    return end - (-key & 63), end, np.concatenate([*ids, vocab.byte_ids[words[by_byte]].astype(np.int32)])[order]


def upto_of(share: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For edges sorted by end: the share of each and those before it to the same end, the last taking whatever rounding leaves; and
    which edges are the first of an end."""
    group = np.append(True, end[1:] != end[:-1])[: len(end)]
    total = np.cumsum(share)
    upto = total - (total - share)[group][np.cumsum(group) - 1] if len(share) else total
    upto[np.flatnonzero(np.append(group[1:], True))[: len(share)]] = 2.0
    return upto, group


def random_at(seed: np.ndarray, far: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each seed and position in its word."""
    return (mixed(seed + far.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) * 2.0**-53


class Lattice:
    """All edges of some words, laid one after the other, and for each position the weights of the ways to come from behind.

    Position k + j of a word that begins at byte k stands at k + j + its number, so that every word has a last position of its own.
    """

    def __init__(self, words: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> None:
        offsets = offsets.astype(np.int32)
        length = np.diff(offsets)
        word = np.repeat(np.arange(len(length), dtype=np.int32), length)
        begin, end, self.piece = edges_of(words, offsets[1:][word] - np.arange(len(words), dtype=np.int32), vocab)
        owner = word[end - 1]
        level = (end - offsets[owner]).astype(np.int32)
        self.end = (end + owner).astype(np.int32)
        self.begin = (begin + owner).astype(np.int32)
        self.first = offsets[:-1] + np.arange(len(length), dtype=np.int32)
        self.last = offsets[1:] + np.arange(len(length), dtype=np.int32)
        share = np.zeros(len(end))
        ahead = np.full(offsets[-1] + len(length), -np.inf)
        ahead[self.first] = 0.0
        in_turn = np.argsort(level.astype(np.uint16) if len(level) and level.max() < 1 << 16 else level, kind="stable")
        cuts = np.append(0, np.cumsum(np.bincount(level)))
        for now in (in_turn[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b):
            way = ahead[self.begin[now]] + vocab.log_weight[self.piece[now]]
            ends = self.end[now]
            group = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))
            many = np.diff(np.append(group, len(now)))
            most = np.maximum.reduceat(way, group)
            each = np.exp(way - np.repeat(most, many))
            sums = np.add.reduceat(each, group)
            ahead[ends[group]] = most + np.log(sums)
            share[now] = each / np.repeat(sums, many)
        self.upto, group = upto_of(share, self.end)
        self.ways = np.zeros(offsets[-1] + len(length), np.int32)
        self.ways[self.end[group]] = np.flatnonzero(group)

    def sampled(self, word: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of occurrences of words, one after the other, and how many each has: backward sampling of all at once."""
        live = np.argsort(word, kind="stable")  # occurrences of a word walk its edges together
        at, first = self.last[word[live]], self.first[word]
        who, what = [], []
        while len(live):
            u = random_at(seed[live], at - first[live])
            edge = self.ways[at]
            past = np.flatnonzero(self.upto[edge] <= u)
            while len(past):
                edge[past] += 1
                past = past[self.upto[edge[past]] <= u[past]]
            who.append(live)
            what.append(self.piece[edge])
            at = self.begin[edge]
            more = at > first[live]
            live, at = live[more], at[more]
        count = np.bincount(np.concatenate(who), minlength=len(word)) if who else np.zeros(len(word), np.int64)
        out, ends = np.zeros(count.sum(), np.int32), np.cumsum(count)
        for step, (w, p) in enumerate(zip(who, what, strict=True)):
            out[ends[w] - 1 - step] = p
        return out, count


def stretch_edges(word: np.ndarray, lo: int, hi: int, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges of a word that end in (lo, hi]; pieces may begin before."""
    from_ = max(0, lo - vocab.longest)
    while from_ and WIDTH_OF[word[from_]] == 0:  # a character counts from its first byte
        from_ -= 1
    to = min(len(word), hi + 4)
    begin, end, piece = edges_of(word[from_:to], np.arange(to - from_, 0, -1), vocab)
    begin, end = begin + from_, end + from_
    here = (end > lo) & (end <= hi)
    return begin[here], end[here], piece[here]


def sampled_long(word: np.ndarray, seeds: np.ndarray, vocab: Vocabulary) -> list[np.ndarray]:
    """Pieces of each occurrence of one long word: forward filtering by stretches, then backward sampling from the last stretch on.

    Kept are eight bytes for each byte of the word, and the edges of one stretch.
    """
    cuts = [*range(0, len(word), STRETCH), len(word)]
    ahead = np.full(len(word) + 1, -np.inf)
    ahead[0] = 0.0
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        begin, end, piece = stretch_edges(word, lo, hi, vocab)
        first = max(0, lo - vocab.longest)
        known, weight = ahead[first : hi + 1].tolist(), vocab.log_weight[piece].tolist()
        ends, begins, at = (end - first).tolist(), (begin - first).tolist(), 0
        while at < len(ends):
            to = at + 1
            while to < len(ends) and ends[to] == ends[at]:
                to += 1
            ways = [known[begins[k]] + weight[k] for k in range(at, to)]
            most = max(ways)
            known[ends[at]] = most + log(sum(exp(w - most) for w in ways)) if to > at + 1 else most
            at = to
        ahead[lo + 1 : hi + 1] = known[lo + 1 - first :]
    place, out = [len(word)] * len(seeds), [[] for _ in seeds]
    for lo, hi in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
        begin, end, piece = stretch_edges(word, lo, hi, vocab)
        upto, group = upto_of(np.exp(ahead[begin] + vocab.log_weight[piece] - ahead[end]), end)
        ways = np.zeros(hi - lo + 1, np.int64)
        ways[end[group] - lo] = np.flatnonzero(group)
        for k, seed in enumerate(seeds):
            draws = random_at(np.full(hi - lo + 1, seed, np.uint64), np.arange(lo, hi + 1))
            at, found = place[k], out[k]
            while at > lo:
                edge = ways[at - lo]
                while upto[edge] <= draws[at - lo]:
                    edge += 1
                found.append(piece[edge])
                at = int(begin[edge])
            place[k] = at
    return [np.array(found[::-1], np.int32) for found in out]


def words_sampled(different: np.ndarray, offsets: np.ndarray, word: np.ndarray, seed: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of occurrences of words, one after the other, and how many each has; one bounded lattice after the other."""
    length = np.diff(offsets)
    by_word = np.argsort(word, kind="stable")
    cuts = np.searchsorted(word[by_word], np.arange(len(length) + 1))
    count, parts = np.zeros(len(word), np.int64), []
    long = np.flatnonzero(length > LONG_WORD)
    for k in long.tolist():
        who = by_word[cuts[k] : cuts[k + 1]]
        for one in range(0, len(who), 64):
            found = sampled_long(different[offsets[k] : offsets[k + 1]], seed[who[one : one + 64]], vocab)
            count[who[one : one + 64]] = [len(f) for f in found]
            parts.append((who[one : one + 64], np.concatenate(found)))
    lo = 0
    for stop in [*long.tolist(), len(length)]:
        while lo < stop:
            hi = max(lo + 1, min(stop, int(np.searchsorted(offsets, offsets[lo] + LATTICE_BYTES, "right")) - 1))
            who = by_word[cuts[lo] : cuts[hi]]
            ids, many = Lattice(different[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], vocab).sampled(word[who] - lo, seed[who])
            count[who] = many
            parts.append((who, ids))
            lo = hi
        lo = stop + 1
    begin = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int32)
    for who, ids in parts:
        many = count[who]
        out[np.repeat(begin[who] - (np.cumsum(many) - many), many) + np.arange(len(ids))] = ids
    return out, count


def encode_batch(texts: pa.Array, keys: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of all texts, and the bounds of each text's; a space goes before each text that isn't empty."""
    texts, empty, space = texts.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    spaced, bounds = text_parts(pc.if_else(pc.equal(texts, empty), empty, pc.binary_join_element_wise(empty, texts, space)))
    starts = word_starts(spaced, bounds, vocab.alone)
    if len(starts) < 2:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(spaced)]).dictionary_encode()
    different, offsets = text_parts(words.dictionary)
    text_of = np.searchsorted(bounds, starts[:-1], "right") - 1
    seed = mixed(keys.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))[text_of] + (starts[:-1] - bounds[text_of]).astype(np.uint64) * np.uint64(0xDA942042E4DD58B5)
    ids, count = words_sampled(different, offsets, words.indices.to_numpy(), mixed(seed), vocab)
    total = np.append(0, np.cumsum(count))
    return ids, total[np.searchsorted(starts, bounds)]


def decode_batch(ids: np.ndarray, bounds: np.ndarray, vocab: Vocabulary) -> pa.Array:
    """The texts of pieces, as bytes: pieces joined, without the space in front."""
    table_of = pa.array(vocab.bytes_of, pa.large_binary())
    raw, at = text_parts(table_of.take(pa.array(ids)))
    ends = at[bounds]
    keep = np.ones(len(raw), bool)
    keep[ends[:-1][np.diff(ends) > 0]] = False
    offsets = ends - np.append(0, np.cumsum(np.diff(ends) > 0))
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[keep])])


def encode(docs: DataFrame, model_file: str = MODEL, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", key_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Sampled segmentations: (doc_id, ids array<int>, n_pieces, lossless).

    ids are those of the model's vocabulary; the sampling is seeded by a hash of key_cols, so rows of equal keys and texts get equal
    pieces. lossless says that decoding gives back the text's bytes. A null or empty text has no pieces; the word mark as a
    character of the text itself, and every other one without a piece, is spelled in bytes. Columns beyond those named aren't read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_file, alpha)
        for batch in batches:
            texts = batch.column(2).fill_null("")
            ids, bounds = encode_batch(texts, batch.column(1).to_numpy(), vocab)
            same = pc.equal(decode_batch(ids, bounds, vocab), texts.cast(pa.large_string()).cast(pa.large_binary()))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.diff(bounds), pa.int64()), same], ["doc_id", "ids", "n_pieces", "lossless"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(*key_cols).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, lossless boolean")


def decode(encoded: DataFrame, model_file: str = MODEL, alpha: float = ALPHA, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ids; null ids give an empty text."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_file, alpha)
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten().to_numpy()
            bounds = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), decode_batch(ids, bounds, vocab).cast(pa.large_string()).cast(pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
