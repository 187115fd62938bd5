import math
import random

import numpy as np
import pytest

from millrace.llm import spectra
from millrace.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, x string, n long"


def brute(vectors, most=32):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    y = (n * x - sums) / n
    values, parts = np.linalg.eigh(y.T @ y / n)
    values, parts = values[::-1], parts[:, ::-1]
    k = min(most, x.shape[1])
    return ((n * x - sums) ** 2).sum(1), y @ parts[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize("dims", [1, 2, 5, 40])
@pytest.mark.parametrize("kind", ["plain", "repeated", "few", "scaled", "constant"])
def test_updates_keep_a_spectrum(dims, kind):
    rng = np.random.default_rng(dims)
    rows = rng.normal(size=(60, dims))
    if kind == "repeated":
        rows = np.repeat(rows[:3], 20, axis=0)
    if kind == "few":
        rows = rows[: max(1, dims // 3)]
    if kind == "scaled":
        rows *= 10.0 ** rng.integers(-5, 5, size=dims)
    if kind == "constant":
        rows[:, 0] = 0
    found = spectra.empty(dims)
    for row in rows:
        found = spectra.updated(found, row)
    joined = spectra.combined(spectra.folded(spectra.empty(dims), rows[:20]), spectra.folded(spectra.empty(dims), rows[20:]))
    for values, vectors in (found, joined):
        matrix = rows.T @ rows
        top = np.abs(matrix).max() or 1
        assert np.abs(vectors.T @ vectors - np.eye(dims)).max() < 1e-12
        assert np.abs(vectors * values @ vectors.T - matrix).max() < 1e-12 * top * dims
        assert np.abs(values - np.linalg.eigvalsh(matrix)).max() < 1e-12 * top * dims


def test_whitening_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1 + d) + (i % 3) for d in range(6)], "a", 1) for i in range(400)]
    rows += [(7, rows[3][1], "a", 1)] * 100  # repeated rows
    found = whiten(spark.createDataFrame(rows, SCHEMA).repartition(20), "vec_id", "embedding").collect()
    deviation, coordinates, explained = brute([r[1] for r in rows])
    assert len(found) == len(rows) * 6 and {r["n"] for r in found} == {500}
    assert max(r["identity_error"] for r in found) < 1e-9
    by_id = {(r["vec_id"], r["component"]): r for r in found if r["vec_id"] != 7}
    sign = {}
    for i in range(400):
        for c in range(6):
            if i != 7:
                r = by_id[i, c + 1]
                assert r["deviation"] == deviation[i]
                assert math.isclose(r["explained"], explained[c], rel_tol=1e-9)
                sign.setdefault(c, 1 if r["whitened"] * coordinates[i, c] > 0 else -1)
                assert abs(r["whitened"] - sign[c] * coordinates[i, c]) < 1e-9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    sound = [(1, [0.5, 1.0], None, None), (None, [1.5, 1.0], "x", 2), (1, [0.5, 1.0], None, None)]
    odd = [(2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0]), (8, [1e30, 1.0])]
    found = whiten(spark.createDataFrame(sound + [(*r, "x", 1) for r in odd], SCHEMA), "vec_id", "embedding").collect()
    assert sorted(((r["vec_id"] or 0), r["component"]) for r in found) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2)]
    # The second dimension never varies: it explains nothing and cannot be scaled.
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in found)
    assert {round(r["explained"], 12) for r in found} == {1.0, 0.0}
    assert {r["deviation"] for r in found} == {64**2, 128**2}


def test_no_vectors_and_no_variance(spark):
    assert whiten(spark.createDataFrame([], SCHEMA), "vec_id", "embedding").collect() == []
    same = spark.createDataFrame([(i, [0.25, 0.5], "x", 1) for i in range(3)], SCHEMA)
    found = whiten(same, "vec_id", "embedding").collect()
    assert len(found) == 6 and all(r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None for r in found)
