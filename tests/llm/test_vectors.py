"""Whitening and hard negatives against NumPy over whole tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.llm import negatives, whiten
from terrace.llm.vectors import floored, usable

RAW = "vec_id long, label int, embedding array<float>, x string, n int, row long, cell int"


def raw(spark, rows):
    """Embeddings with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, label, v, "x", 1, 2, 3) for i, label, v in rows], RAW)


def whole(df):
    return df.where(usable("embedding")).select("vec_id", floored("embedding").alias("x"))


def random_rows(seed, n, dim, groups=3, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    at = rng.integers(groups, size=n)
    x = centres[at] + spread * rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True), at


def check_whitened(got, ids, x, components=4):
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    cov = (fit - sums / n).T @ (fit - sums / n) / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    for c in range(len(e)):
        mine = {r.vec_id: r for r in got if r.component == c + 1}
        want = (x - sums / n) @ v[:, c] / math.sqrt(e[c])
        values = np.array([mine[i].whitened for i in ids])
        assert np.abs(values * np.sign(values @ want) - want).max() < 1e-9
        r = mine[ids[0]]
        assert r.n == n and abs(r.explained - e[c] / np.trace(cov)) < 1e-12 and r.identity_error < 1e-9
        assert all(mine[i].deviation == int(((n * x[j] - sums) ** 2).sum()) for j, i in enumerate(ids))


def test_whitening_against_eigenvectors(spark):
    x, _ = random_rows(1, 300, 12)
    rows = [(i, 0, [float(c) for c in v]) for i, v in enumerate(x)] + [(900 + i, 0, [float(c) for c in x[5]]) for i in range(100)]
    got = whiten.whiten(whole(raw(spark, rows))).collect()
    vectors = np.array([np.floor(256.0 * np.float32(r[2]).astype(float)) for r in rows]).astype(np.int64)
    assert len(got) == 4 * 400
    check_whitened(got, [r[0] for r in rows], vectors)


def test_bidiagonal_form_keeps_equal_and_zero_values():
    """Repeated singular values, a rank below the dimension, and large offsets."""
    for x in (np.eye(6)[[0, 1, 2]] * 5, np.diag([3.0, 3, 3, 1, 1, 0]), np.zeros((4, 3)), np.arange(12.0).reshape(6, 2)):
        right, b = whiten.bidiagonalise(lambda a, p, x=x: ((x @ p).T @ (x @ a), float((x @ a) @ (x @ a)), x.T @ (x @ a)), x.shape[1])
        assert np.allclose(right.T @ right, np.eye(x.shape[1]), atol=1e-12)
        want = np.linalg.svd(x, compute_uv=False)
        assert np.allclose(np.linalg.svd(b, compute_uv=False)[: len(want)], want, atol=1e-7)
        assert np.allclose(b, np.triu(np.tril(b, 1)))


def test_whitening_odd_inputs(spark):
    inf, nan = float("inf"), float("nan")
    good = [[1.0, 2.0], [3.0, 1.0], [0.5, -0.25], [0.5, -0.25]]
    rows = [(1, 0, None), (2, 0, [inf, 1.0]), (3, 0, [nan, 1.0]), (4, 0, [None, 1.0]), (None, None, good[0]), (6, None, good[1]), (7, 0, good[2]), (7, 0, good[3]), (8, 0, [-0.0])]
    got = whiten.whiten(whole(raw(spark, rows))).collect()
    x = np.array([[256, 512], [768, 256], [128, -64], [0, 0]])
    assert len(got) == 10 and {r.vec_id for r in got} == {None, 6, 7, 8} and {r.n for r in got} == {4}
    distinct = {r.vec_id: r for r in got if r.component == 1}
    assert distinct[8].deviation == int((x.sum(axis=0) ** 2).sum())
    for some in ([], [(1, 0, None)], [(1, 0, [1.0, 2.0])], [(1, 0, [1.0]), (2, 0, [1.0])], [(1, 0, []), (2, 0, [])]):
        assert whiten.whiten(whole(raw(spark, some))).collect() == []
    line = whiten.whiten(whole(raw(spark, [(i, 0, [float(i), 0.0, 1.0]) for i in range(4)]))).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
    # Components beyond a long: nearest values, and deviations that no longer fit are null.
    far = whiten.whiten(whole(raw(spark, [(1, 0, [3e38, 0.0]), (2, 0, [-3e38, 1.0]), (3, 0, [1.0, 5.0])]))).collect()
    assert {r.vec_id for r in far} == {1, 2, 3} and next(r for r in far if r.vec_id == 1).deviation is None


def expected(rows, positives=5, negatives_=10, low=30, high=90):
    out = []
    for a, (anchor, label, _, is_anchor) in enumerate(rows):
        if not is_anchor:
            continue
        score = [sum(int(p) * int(q) for p, q in zip(rows[a][2], r[2], strict=False)) for r in rows]
        order = sorted(range(len(rows)), key=lambda j: (-score[j], rows[j][0]))
        for p in [j for j in order if rows[j][1] == label and j != a][:positives]:
            found = [j for j in order if rows[j][1] != label and low * score[p] <= 100 * score[j] <= high * score[p]][:negatives_]
            out += [(anchor, rows[p][0], r, rows[j][0], score[p], score[j]) for r, j in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, label, [int(c) for c in v], a, "x", 1) for i, label, v, a in rows], "vec_id long, label int, x array<long>, anchor boolean, cell string, slot int")
    got = negatives.hard_negatives(df, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("seed, groups, spread", [(1, 1, 1.0), (2, 6, 0.15)])
def test_negatives_against_all_pairs(spark, monkeypatch, seed, groups, spread):
    """Small rounds and slots, so that later rounds, certificates and split cells all take part."""
    monkeypatch.setattr(negatives, "FIRST_ROWS", 40)
    monkeypatch.setattr(negatives, "SLOT_ROWS", 16)
    monkeypatch.setattr(negatives, "CELL_ROWS", 4)
    x, at = random_rows(seed, 500, 16, groups, spread)
    rng = np.random.default_rng(seed)
    labels = (at + rng.integers(3, size=500)) % 4
    rows = [(i, int(labels[i]), np.floor(256 * v).astype(int), i % 20 == 0) for i, v in enumerate(x)]
    assert mined(spark, rows) == expected(rows)


def test_visits_stop_at_the_certificate(spark, monkeypatch):
    """Far-off groups: the second round asks for few of the rows."""
    monkeypatch.setattr(negatives, "CELL_ROWS", 4)
    x, at = random_rows(4, 600, 8, 8, 0.02)
    rows = [(i, int(at[i] % 2), [int(c) for c in np.floor(256 * v)], i % 50 == 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, label long, x array<long>, anchor boolean")
    table, index = negatives.indexed(df, negatives.shape_of(df))
    anchors = table.where("anchor")
    asked = {}
    for floor in (-negatives.ENDLESS, 62_000):
        windows = F.array(F.struct(F.lit(0).alias("window"), F.lit(-negatives.ENDLESS).alias("low"), F.lit(floor).alias("floor"), F.lit(negatives.ENDLESS).alias("high")))
        rows_asked = negatives.visiting(anchors.withColumn("windows", windows), index, 0, negatives.ENDLESS)
        asked[floor] = sum(len(r.rows) // 8 for r in rows_asked.collect())
    assert asked[62_000] < 0.5 * asked[-negatives.ENDLESS]


def test_cells_come_by_falling_bound():
    rng = np.random.default_rng(3)
    left, right = rng.standard_normal(7), rng.standard_normal(5)
    got = list(negatives.cells_by_bound(left, right))
    assert len({(i, j) for _, i, j in got}) == 35 and all(a[0] >= b[0] for a, b in zip(got, got[1:], strict=False))
    assert all(math.isclose(s, left[i] + right[j]) for s, i, j in got)


def test_negatives_odd_inputs(spark):
    same = [3, 4]
    rows = [(100, 1, same, True), (100, 1, same, True), (7, 1, same, False), (5, 2, [2, 3], False), (6, 2, [2, 3], False), (4, 3, [], False), (200, 9, [1, 1], True), (300, 2, [-9, 1], True), (8, 1, [100, -3], False), (400, 3, [0, 0, 5], True)]
    assert mined(spark, rows) == expected(rows)
    df = spark.createDataFrame([*rows, (None, 1, same, True), (9, None, same, True), (10, 1, None, True), (11, 1, same, None)], "vec_id long, label int, x array<long>, anchor boolean")
    got = sorted(map(tuple, negatives.hard_negatives(df).collect()))
    assert got == expected([*rows, (11, 1, same, False)])
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, same, True)]) == []
    # Products beyond what a double holds stay exact.
    wide = [(100, 1, [1 << 30, 5], True), (1, 1, [(1 << 30) + 1, 1], False), (2, 2, [1 << 29, -1], False), (3, 2, [(1 << 29) + 1, -1], False)]
    assert mined(spark, wide) == expected(wide)
