"""A toxicity classifier with a counterfactual penalty.

A logistic regression over the presence of words is fitted on a bounded sample of labelled documents. Every sentence of these that
names a group has twins with each other name of that kind; into the first sentence of a document that names none, the names of one
kind are put in turn. The loss is charged with the square of the change in score between a sentence and its twin, so that a name
alone moves no score and neutral mentions don't become false positives. Words and twins are counted in Spark, and the driver gets the
model's words, the counts of twins by name and the sample's rows as lists of these words: all of bounded size, however long the
texts. Scoring is one pass over the documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import Block, settle, small_batches, table, text_parts
from siltstone.llm.logistic import fit_sparse, sigmoid
from siltstone.llm.window_dedup import word_hashes

#: Bound of the labelled sample, of the model's words, and the fewest sample documents a word must be in.
SAMPLE_ROWS, MODEL_WORDS, LEAST_DOCS = 12_000, 512, 5
L2, PENALTY = 0.05, 4.0
CUT = 0.7
#: Names of groups by what may stand for what, in English, German, French and Spanish.
GROUPS = [
    ["women", "men"],
    ["woman", "man"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "indigenous"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["immigrant", "native", "refugee", "foreigner"],
    ["immigrants", "natives", "refugees", "foreigners"],
    ["disabled", "deaf", "blind"],
    ["frauen", "männer"],
    ["muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"],
    ["schwarze", "weiße", "asiaten", "latinos"],
    ["schwule", "lesben", "bisexuelle", "transsexuelle"],
    ["einwanderer", "einheimische", "flüchtlinge", "ausländer"],
    ["femmes", "hommes"],
    ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"],
    ["noirs", "blancs", "asiatiques"],
    ["homosexuels", "lesbiennes", "bisexuels", "transgenres"],
    ["immigrés", "réfugiés", "étrangers"],
    ["mujeres", "hombres"],
    ["musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"],
    ["negros", "blancos", "asiáticos"],
    ["homosexuales", "lesbianas", "bisexuales", "transexuales"],
    ["inmigrantes", "nativos", "refugiados", "extranjeros"],
]
NAMES = sorted({name for group in GROUPS for name in group})
SEPARATE = np.ones(256, bool)
SEPARATE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def present(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z in lower case, and the bounds of each text's."""
    raw, bounds = text_parts(batch)
    raw = np.where((raw >= 0x41) & (raw <= 0x5A), raw + 32, raw).astype(np.uint8)
    return word_hashes(Block(np.zeros(len(batch)), raw, bounds), SEPARATE)


def twins(text: str) -> list[tuple[str, str]]:
    """(name, other name) for each change of a name in a sentence of the text; in a text that names no group, names of one kind come
    into its first sentence, ("", name), and change there."""
    out = []
    sentences = [set(re.findall(r"[^\W\d_]+", s)) for s in re.split(r"[.!?\n]+", text.lower())]
    for words in sentences:
        for group in GROUPS:
            out += [(name, other) for name in group if name in words for other in group if other not in words]
    if not out:
        group = GROUPS[xxhash.xxh3_64_intdigest(text) % len(GROUPS)]
        out = [("", name) for name in group] + [(name, other) for name in group for other in group if name < other]
    return out


class Model:
    """Word hashes in order, their weights, and the intercept."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, intercept: float) -> None:
        self.words, self.weights, self.intercept = words, weights, intercept

    def scores(self, batch: pa.Array) -> np.ndarray:
        hashes, bounds = present(batch)
        z = np.full(len(batch), self.intercept)
        if len(self.words) and len(hashes):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            here = np.flatnonzero(self.words[at] == hashes)
            of = np.searchsorted(bounds, here, "right") - 1
            pairs = np.unique(of * len(self.words) + at[here])
            z += np.bincount(pairs // len(self.words), self.weights[pairs % len(self.words)], len(batch))
        return sigmoid(z)


def name_hash(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode())


def counted(sample: DataFrame) -> DataFrame:
    """Settled (kind, a, b, n, ones): of each word (a) of the sample the documents with it and those of label 1, as kind 0; of all
    documents, as kind 1; of each change from name a to b (0 for none) how many twins have it, as kind 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, label = batch.column(0).fill_null(""), batch.column(1).to_numpy()
            hashes, bounds = present(texts)
            found = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            words, at = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_inverse=True)
            ones = np.bincount(at, np.repeat(label, [len(f) for f in found]), len(words)).astype(np.int64)
            swaps = Counter(pair for t in texts.to_pylist() for pair in twins(t))
            ends = np.array([[name_hash(n) if n else 0 for n in pair] for pair in swaps], np.uint64).reshape(-1, 2)
            kind = np.repeat([0, 1, 2], [len(words), 1, len(swaps)]).astype(np.int32)
            a, b = np.concatenate([words, [np.uint64(0)], ends[:, 0]]).view(np.int64), np.concatenate([np.zeros(len(words) + 1, np.uint64), ends[:, 1]]).view(np.int64)
            n = np.concatenate([np.bincount(at, minlength=len(words)), [len(label)], list(swaps.values())]).astype(np.int64)
            of_label = np.concatenate([ones, [label.sum()], np.zeros(len(swaps))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kind, a, b, n, of_label)], ["kind", "a", "b", "n", "ones"])

    each = sample.mapInArrow(run, "kind int, a long, b long, n long, ones long")
    return settle(each.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")))


def fit(labelled: DataFrame, penalty: float = PENALTY, words: int = MODEL_WORDS, least_docs: int = LEAST_DOCS) -> Model:
    """A model from (text string, label int); the caller bounds the rows. Without both labels, every score is the share of label 1."""
    small_batches(labelled.sparkSession)
    sample = settle(labelled.select("text", F.col("label").cast("int").alias("label")))
    counts = counted(sample)
    whole = counts.where("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("ones"), F.lit(0)).alias("ones")).first()
    if not 0 < whole.ones < whole.n:
        share = whole.ones / whole.n if whole.n else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    share = whole.ones / whole.n
    signal = F.pow(F.col("ones") - F.col("n") * share, 2) / (F.col("n") * share * (1 - share))
    telling = counts.where((F.col("kind") == 0) & (F.col("n") >= least_docs)).orderBy(signal.desc(), "a").limit(words).select("a").collect()
    model = np.unique(np.array([*(r.a & (1 << 64) - 1 for r in telling), *map(name_hash, NAMES)], np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bounds = present(batch.column(0).fill_null(""))
            at = np.minimum(np.searchsorted(model, hashes), len(model) - 1)
            known = model[at] == hashes
            found = [np.unique(at[a:b][known[a:b]]).astype(np.int16).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["words", "label"])

    rows = sample.mapInArrow(run, "words binary, label int").collect()  # at most two bytes a word of the model and row
    y = np.array([r.label for r in rows], float)
    found = [np.frombuffer(r.words, np.int16) for r in rows]
    row, col = np.repeat(np.arange(len(rows)), [len(f) for f in found]), np.concatenate(found).astype(np.int64)
    swaps = counts.where("kind = 2").select("a", "b", "n").collect()  # at most one for each two names
    ends = np.array([[r.a & (1 << 64) - 1, r.b & (1 << 64) - 1] for r in swaps], np.uint64).reshape(-1, 2)
    at = np.minimum(np.searchsorted(model, ends), len(model) - 1)
    known = model[at] == ends
    pair, sign = np.repeat(np.arange(len(ends)), 2).reshape(-1, 2), np.broadcast_to([-1.0, 1.0], ends.shape)
    w = fit_sparse(row, col, y, len(model), L2, (pair[known], at[known], sign[known]), penalty * np.array([r.n for r in swaps], float))
    return Model(model, w[:-1], float(w[-1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row; a null or empty text has the score of no words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1).fill_null("")))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, label) of at most `bound` documents, drawn evenly by a hash of the id, none of them held out; an id's greatest label counts,
    and of several texts under one id the one of least hash. `bound` ids are what is broadcast."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(known), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("label").alias("label")).select("text", "label")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", SAMPLE_ROWS))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
