import math

import numpy as np
import pytest

from coursegrain.llm import whitening as W

ROWS = "vec_id long, embedding array<float>, component string, n long"


def _by_hand(vectors):
    """Whole numbers, exact deviations, variances and components from the covariance itself."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviations = [sum((n * c - t) ** 2 for c, t in zip(row, s)) for row in x]
    y = np.array([[(n * c - t) / n for c, t in zip(row, s)] for row in x])
    values, directions = np.linalg.eigh(y.T @ y / n)
    return deviations, values[::-1], directions[:, ::-1], y


def _whitened(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in rows], ROWS).repartition(parts)
    return W.whitened(df, **more).collect()


def _check(spark, rows, distinct=True):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    deviations, values, directions, y = _by_hand([v for _, v in good])
    got = _whitened(spark, rows)
    k = max((r["component"] for r in got), default=0)
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got) == sorted((i, c, len(good), d) for (i, _), d in zip(good, deviations) for c in range(1, k + 1))
    table = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(1, k + 1):
        assert table[good[0][0], c]["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
        if distinct:
            want = y @ directions[:, c - 1] / np.sqrt(values[c - 1])
            mine = np.array([table[i, c]["whitened"] for i, _ in good])
            assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8
    if k:
        z = np.array([[table[i, c]["whitened"] for c in range(1, k + 1)] for i, _ in good])
        z = z - z.mean(0)
        error = np.abs(z.T @ z / len(z) - np.eye(k)).max()
        assert error < 1e-9 and all(abs(r["identity_error"] - error) < 1e-9 for r in got)
    return k


def test_matches_the_covariance(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((300, 12)) * np.linspace(1, 3, 12)
    assert _check(spark, [(i, v.tolist()) for i, v in enumerate(x)]) == 8


def test_fewer_dimensions_than_components_and_steep_spectra(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((90, 5)) @ np.diag([1000.0, 30.0, 1.0, 0.05, 1.0])
    assert _check(spark, [(i, v.tolist()) for i, v in enumerate(x)]) == 5


def test_equal_variances_and_dimensions_without_any(spark):
    corners = [[float(a), float(b), float(c), 0.5, float(a)] for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    assert _check(spark, [(i, v) for i, v in enumerate(corners)], distinct=False) == 3
    lows = [float(x) for x in range(40)]
    assert _check(spark, [(i, [x, -x, 2 * x]) for i, x in enumerate(lows)]) == 1


def test_odd_rows(spark):
    r = np.random.default_rng(3)
    good = [(i, v.tolist()) for i, v in enumerate(r.standard_normal((60, 4)))]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [float("nan"), 1.0, 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0, 1.0])]
    _check(spark, good + odd)
    # Another length is left out, and so is an entry beyond 64 bits.
    assert {x["vec_id"] for x in _whitened(spark, [*good, (200, [1.0, 2.0]), (201, [1e30, 0.0, 0.0, 0.0])])} == set(range(60))
    # Repeated rows and null ids are rows of their own.
    twice = _whitened(spark, [*good, *good[:9], (None, [0.0, 1.0, 2.0, 3.0])])
    assert len(twice) == 70 * 4 and {x["n"] for x in twice} == {70}


def test_nothing_to_whiten(spark):
    assert _whitened(spark, []) == []
    assert _whitened(spark, [(1, [1.0, 2.0])]) == []
    assert _whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2.0**40 * i), float(i % 3)]) for i in range(9)]
    deviations = _by_hand([v for _, v in rows])[0]
    got = {r["vec_id"]: r["deviation"] for r in _whitened(spark, rows)}
    assert got == {i: d if d < 1 << 63 else None for (i, _), d in zip(rows, deviations)}


def test_many_parts_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(W, "MOST_PARTS", 24)
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist(), "", 0) for i, v in enumerate(r.standard_normal((64, 6)))], ROWS)
    blocks = W.written(df.select("embedding").mapInArrow(W._blocks, "dim int, n long, x binary"), "test-blocks")
    one, two = (W.fit(blocks, 6, 64, 4, many) for many in (False, True))
    assert one[0].sums == two[0].sums and np.allclose(one[1], two[1], rtol=1e-12)
    first, second = ({(r["vec_id"], r["component"]): r["whitened"] for r in W.whitened(df).collect()} for _ in range(2))
    assert first.keys() == second.keys() and all(abs(first[k] - second[k]) < 1e-9 for k in first)


def test_steps_end_early_when_the_rest_cannot_hide_a_component():
    r = np.random.default_rng(6)
    x = r.standard_normal((400, 60)) * np.r_[[90.0, 60.0, 40.0, 30.0], np.full(56, 0.01)]
    steps = []
    values, vectors = W.bidiagonalise(lambda v: steps.append(1) or x.T @ (x @ v), 60, float((x * x).sum()), 4)
    assert len(steps) < 30 and np.allclose(values, np.linalg.eigvalsh(x.T @ x)[::-1][:4], rtol=1e-12)
    assert np.abs(x.T @ (x @ vectors) - vectors * values).max() < 1e-8 * values[0]
