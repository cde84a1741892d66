"""Deduplication operators against brute force on small fixtures."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import common, components, near_dedup, suffix_dedup, vector_dedup, window_dedup

DOCS = "doc_id long, text string, n_bytes string, kept string"


@pytest.fixture(scope="module")
def texts():
    rng = np.random.RandomState(3)
    words = [f"w{k}" for k in range(400)]
    line = lambda n: " ".join(rng.choice(words, n))
    passage, near = line(60), rng.choice(words, 300)
    rows = {0: line(80), 1: None, 2: "", 3: "  \n", 4: "one", 5: line(20) + " " + passage + " " + line(20), 6: passage + "\n" + line(30), 7: "For " * 300, 8: "é" * 120, 9: "é" * 120}
    rows |= {10: rows[0], 11: rows[0].upper(), 12: rows[0], 13: line(9000)}
    for k in range(20, 40):
        copy = near.copy()
        copy[rng.randint(0, 300, 6)] = "changed"
        rows[k] = " ".join(copy)
    return rows


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x", "y") for k, t in texts.items()], DOCS).repartition(3)


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(spark, texts, hot):
    seen, expected = set(), {}
    for k in sorted(texts):
        x = (texts[k] or "").encode()
        gone = bytearray(len(x))
        for i in range(len(x) - 99):
            if x[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(x[i : i + 100])
        expected[k] = (len(x), sum(gone), bytes(a for a, b in zip(x, gone, strict=True) if not b))
    got = suffix_dedup.remove_later_copies(frame(spark, texts), block_bytes=4096, hot=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in got} == expected
    assert all(sum(e - s for s, e in zip(r.span_starts, r.span_ends, strict=True)) == r.n_removed for r in got)


def test_window_dedup(spark, texts):
    words = {k: (t or "").encode().split() for k, t in texts.items()}
    counts = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    got = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in window_dedup.remove_repeated_windows(frame(spark, texts), block_bytes=4096).collect()}
    for k, w in words.items():
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if counts[tuple(w[i : i + 35])] > 1:
                keep[i : i + 35] = [False] * 35
        assert got[k] == (b" ".join(a for a, b in zip(w, keep, strict=True) if b).decode(), len(w), len(w) - sum(keep))


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(spark, texts, width):
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    root[a] = root[b] = min(root[a], root[b])
    got = near_dedup.near_duplicates(frame(spark, texts), width=width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {k: (len(sets[k]), root[k], root[k] == k) for k in sets}


def test_near_copies_meet_once_for_each_least_member(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = []
    for d in range(200):
        words = [f"w{k}" for k in range(60)]
        for at in rng.choice(60, 2 if d % 4 else 4, replace=False):
            words[at] = f"x{rng.integers(10**9)}"
        texts.append(" ".join(words))
    dealt, deal = [], near_dedup.likely_members
    monkeypatch.setattr(near_dedup, "likely_members", lambda members, *rest: dealt.append(members.count()) or deal(members, *rest))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=2).collect()}
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for t in texts]
    linked = np.array([[100 * len(a & b) >= 80 * len(a | b) for b in sets] for a in sets])
    root = np.arange(len(sets))
    for _ in range(20):
        root = np.array([root[np.flatnonzero(row)].min() for row in linked])
    assert [got[k] for k in range(len(sets))] == root.tolist() and len(set(root.tolist())) > 20
    assert 0 < max(dealt) < 12 * len(sets)  # a row for each band would be about 20 times as many


def test_posterior_bound():
    steps = near_dedup.least_matches(0.8, 1e-6)
    assert steps[-1][0] == near_dedup.BANDS * near_dedup.ROWS and all(m < 0.8 * n for n, m in steps) and steps[-1][1] > 0.6 * steps[-1][0]


def test_vectors(spark):
    rng = np.random.RandomState(1)
    rows = {k: rng.normal(size=16) for k in range(60)}
    for k in range(60, 100):
        rows[k] = rows[k % 7] + rng.normal(size=16) * 0.15
    rows[100] = rows[3]
    data = [(k, [float(x) for x in v], "c") for k, v in rows.items()]
    data += [(200, None, "c"), (201, [], "c"), (202, [0.0] * 16, "c"), (203, [float("nan")] * 16, "c"), (204, [None] * 16, "c"), (205, [1.0, 2.0], "c")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, first string")).collect()}
    unit = {k: v / np.linalg.norm(v) for k, v in rows.items()}
    linked = {k: {j for j in rows if j != k and unit[k] @ unit[j] >= 0.9} for k in rows}
    root = {k: k for k in rows}
    for _ in rows:
        for k in rows:
            root[k] = min([root[k], *(root[j] for j in linked[k])])
    assert {k: got[k] for k in rows} == {k: (len(linked[k]), root[k], root[k] == k) for k in rows}
    assert all(got[k] == (0, k, True) for k in range(200, 206))


def test_estimates_are_unbiased():
    rng = np.random.RandomState(2)
    x = rng.normal(size=64)
    x /= np.linalg.norm(x)
    y = 0.8 * x + 0.6 * (lambda z: z / np.linalg.norm(z))(rng.normal(size=64) - x)
    y /= np.linalg.norm(y)
    found = []
    for seed in range(300):
        p = vector_dedup.rotation(64, 5000 + seed)
        signs, factor, _, _, _ = vector_dedup.codes_of((x @ p)[None])
        _, _, levels, step, low = vector_dedup.codes_of((y @ p)[None])
        found.append(vector_dedup.estimates(signs, factor, levels, step, low)[0][0])
    assert abs(np.mean(found) - x @ y) < 0.01


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in range(100, 130)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert suffix_dedup.remove_later_copies(none).count() == 0
    assert window_dedup.remove_repeated_windows(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_thousands_of_links_near_the_threshold(spark):
    rng = np.random.RandomState(8)
    centres = rng.normal(size=(40, 32))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    noise = rng.normal(size=(40, 50, 32)) / np.sqrt(32)
    rows = (centres[:, None] + 0.33 * noise).reshape(-1, 32)  # cosines of members spread around 0.9
    data = [(k, [float(x) for x in v]) for k, v in enumerate(rows)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    assert linked.sum() > 10_000
    assert [got[k][0] for k in range(len(rows))] == linked.sum(axis=1).tolist()
    root = np.arange(len(rows))
    for _ in range(60):
        root = np.array([min([root[k], *root[np.flatnonzero(linked[k])]]) for k in range(len(rows))])
    assert [got[k][1] for k in range(len(rows))] == root.tolist()


def test_flat_arrays():
    arrays = [np.arange(5, dtype=np.uint64), np.zeros((0, 2), np.uint64), np.array([True, False]), np.arange(6, dtype=np.int32).reshape(3, 2)]
    for level in (0, 3):
        back = common.unflat(common.flat(*arrays, level=level), bool(level))
        assert all(a.dtype == b.dtype and np.array_equal(a, b) for a, b in zip(arrays, back, strict=True))
    assert len(common.flat(np.zeros(1, np.uint64), np.zeros(1, np.int32))) == 25


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(80))
    df = spark.createDataFrame([(None, text), (None, text), (3, text), (3, "other words " + text)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup.remove_later_copies(df).collect())[0] == 0
    assert [r.n_words - r.n_removed for r in window_dedup.remove_repeated_windows(df).orderBy("n_words").collect()] == [0, 0, 0, 2]
    assert {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()} == {(None, None, True), (3, 3, True)}
    vectors = spark.createDataFrame([(None, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [2.0, 4.0]), (7, [1.0, 2.01])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.component_id) for r in vector_dedup.near_vectors(vectors).collect()} == {(None, None), (5, 5), (7, 5)}


def test_registered_queries_equal_their_sql(spark):
    import os

    import duckdb

    from siltstone.llm.catalog import ORACLES, QUERIES

    path, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("documents", "embeddings", "conversations", "benchmark"):
        file = f"{path}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{file + '/*.parquet' if os.path.isdir(file) else file}')")
    for name in ORACLES:
        df, found = QUERIES[name](spark, path), con.execute(ORACLES[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, map(tuple, found.fetchall()))), name


def test_one_id_with_different_contents(spark):
    """Links of either content reach the id, also over two of its rows."""
    texts = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "xyz"}
    near = {k: t.rsplit(" ", 1)[0] + " changed" for k, t in texts.items()}
    rows = [(5, texts["x"]), (5, texts["y"]), (7, near["x"]), (8, near["y"]), (9, texts["z"]), (2, near["z"]), (8, near["z"]), (None, texts["x"]), (5, None), (11, ""), (11, "alone here now")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got) == sorted(
        [(5, 56, 2, False), (5, 56, 2, False), (7, 56, 2, False), (8, 56, 2, False), (9, 56, 2, False), (2, 56, 2, True), (8, 56, 2, False), (0, 56, 0, True), (5, 0, 5, True), (11, 0, 11, True), (11, 1, 11, True)]
    )
    axes = np.eye(4)
    vectors = [(5, axes[0]), (5, axes[1]), (7, axes[0] + 0.01), (8, axes[1] + 0.01), (3, axes[2]), (None, axes[0]), (5, axes[0] * 0), (4, axes[1] * 7)]
    table = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors], "vec_id long, embedding array<double>")
    got = vector_dedup.near_vectors(table).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == sorted(
        [(5, 1, 4, False), (5, 2, 4, False), (7, 1, 4, False), (8, 2, 4, False), (3, 0, 3, True), (0, 0, 0, True), (5, 0, 5, True), (4, 2, 4, True)]
    )
