"""The similarity join of vectors against brute force."""

import math

import numpy as np
import pytest

from siltstone.operators import vector_join


def brute(rows, threshold):
    """{(id, n_links, component)} of (id, vector) rows by all pairs."""
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    near = {x: set() for x in range(len(rows))}
    for x in range(len(rows)):
        for y in range(x):
            if good[x] and good[y] and len(rows[x][1]) == len(rows[y][1]):
                a, b = np.array(rows[x][1]), np.array(rows[y][1])
                if rows[x][1] == rows[y][1] or a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    near[x].add(y)
                    near[y].add(x)
    found = []
    for x in near:
        seen, todo = {x}, [x]
        while todo:
            more = near[todo.pop()] - seen
            seen |= more
            todo += more
        found.append((rows[x][0], len(near[x]), min(rows[y][0] for y in seen)))
    return sorted(found)


@pytest.mark.parametrize("threshold, move_cost", [(0.95, 1), (0.95, 10**9), (0.3, 1)])
def test_classes_and_counts(spark, monkeypatch, threshold, move_cost):
    monkeypatch.setattr(vector_join, "MOVE_COST", move_cost)
    monkeypatch.setattr(vector_join, "GROUP_COST", 1)
    monkeypatch.setattr(vector_join, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vector_join, "STRIP_ROWS", 5)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 12))
    v = np.concatenate([rng.normal(size=(150, 12)), *(b + rng.normal(size=(25, 12)) * 0.2 for b in base), np.repeat(base[:1], 30, axis=0)])
    rows = [(k, x.tolist()) for k, x in enumerate(v[rng.permutation(len(v))])]
    rows += [(900, None), (901, []), (902, [0.0] * 12), (903, [0.0] * 12), (904, [1.0, None]), (905, [float("nan"), 1.0]), (906, [2.0, 1.0]), (907, [2.0, 1.0]), (908, [2.0, 1.01])]
    signs, tables = vector_join.plan(len(v), threshold)
    assert (signs > 1 and tables > 1) == (move_cost == 1 and threshold == 0.95)
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(None, [1.0] * 12, "x")], "id long, v array<double>, n_links string")
    assert sorted(tuple(r) for r in vector_join.linked(df, "id", "v", threshold).collect()) == brute(rows, threshold)


def test_rows_of_one_id_and_empty_tables(spark):
    schema = "v string, k array<double>"
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])]
    found = sorted(tuple(r) for r in vector_join.linked(spark.createDataFrame(rows, schema), "v", "k", 0.9).collect())
    assert found == [("a", 1, "a"), ("a", 1, "a"), ("b", 1, "a"), ("c", 1, "a")]
    assert vector_join.linked(spark.createDataFrame([], schema), "v", "k", 0.9).collect() == []
    with pytest.raises(ValueError):
        vector_join.linked(spark.createDataFrame(rows, schema), "v", "k", 0.0)


def test_plan_keeps_its_bound_and_grows_slowly():
    work = {}
    for n in (10**6, 10**8):
        signs, tables = vector_join.plan(n, 0.95)
        share = (1 - math.acos(0.95) / math.pi) ** signs
        assert (1 - share) ** tables <= 1e-6
        work[n] = tables * n / 2**signs
    assert work[10**8] < 3 * work[10**6]
    assert vector_join.plan(10**5, 0.3) == (0, 1) and vector_join.plan(0, 0.95) == (0, 1) and vector_join.plan(10**7, 1.0)[1] == 1


@pytest.mark.parametrize("seeds, threshold", [(1, 0.5), (40, 0.5), (40, 0.9)])
def test_all_with_all_in_small_blocks(spark, monkeypatch, seeds, threshold):
    for name, value in {"CELL_ROWS": 60, "TILE": (7, 11), "SEEDS": seeds, "MOVE_COST": 10**9}.items():
        monkeypatch.setattr(vector_join, name, value)
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(size=(120, 8)), np.repeat(rng.normal(size=(5, 8)), 12, axis=0) * 3.0])
    rows = [(k, x.tolist()) for k, x in enumerate(v[rng.permutation(len(v))])] + [(500 + k, x.tolist()) for k, x in enumerate(rng.normal(size=(40, 3)))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert sorted(tuple(r) for r in vector_join.linked(df, "id", "v", threshold).collect()) == brute(rows, threshold)


def test_links_that_join_are_fewer_than_vectors_of_one_class(spark):
    v = np.random.default_rng(5).normal(size=(600, 6))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    links = vector_join.met_links(vector_join.different(df, "id", "v"), 0.3).where("b is not null")
    assert links.count() < len(v)  # 89,000 pairs are linked


def test_products_in_single_precision_decide_as_sums_in_order():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 64))
    y = np.concatenate([x * 3.0, x + rng.normal(size=x.shape) * 1e-9, rng.normal(size=(40, 64))])
    for threshold in (1.0, 1 - 1e-9, 0.1):
        want = np.zeros((40, 120), bool)
        r, c, _ = vector_join.close_cells(x, y, threshold)
        want[r, c] = True
        got = np.zeros(want.shape, bool)
        for rows, columns, linked in vector_join.tiles(x, y, threshold, False):
            got[rows, columns] = linked > 0
        assert (got == want).all()


def test_classes_without_counts_leave_out_blocks_of_the_largest_class(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "CELL_ROWS", 100)
    v = np.concatenate([np.abs(np.random.default_rng(7).normal(size=(500, 6))), -np.eye(6)])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    vectors = vector_join.different(df, "id", "v")
    assert vector_join.met_links(vectors, 0.3, counts=False).where("b is null").isEmpty()
    labels = vector_join.component_labels(vector_join.joining_links(df, "id", "v", 0.3))
    want = {(k, c) for k, n, c in brute(list(enumerate(v.tolist())), 0.3) if n}
    assert {tuple(r) for r in labels.collect()} == want
