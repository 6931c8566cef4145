"""Skylines against a comparison of all pairs."""

import numpy as np
import pytest

from maploom.operators import aggregates as A


def slow(p):
    return {i for i, a in enumerate(p) if not any((b >= a).all() and (b > a + 1e-12).any() for b in p)}


@pytest.mark.parametrize("kind,dims,tile", [("any", 3, 20_000), ("any", 2, 40), ("front", 3, 60), ("ties", 4, 25)])
def test_skyline(spark, monkeypatch, kind, dims, tile):
    monkeypatch.setattr(A, "SKYLINE_TILE", tile)
    rng = np.random.default_rng(dims)
    p = rng.random((400, dims))
    if kind == "front":  # no point beats another
        p /= np.linalg.norm(p, axis=1, keepdims=True)
    if kind == "ties":
        p = np.round(4 * p) + 0.0
        p[::7] += 5e-13  # less than the tolerance
        p[5] = -0.0
    p[-20:] = p[:20]  # repeated rows
    want = slow(p)
    names = [f"v{i}" for i in range(dims)]
    rows = [(i, *map(float, [*q[:-1], -q[-1]])) for i, q in enumerate(p)] + [(900, None, *[9.0] * (dims - 1)), (901, float("nan"), *[9.0] * (dims - 1))]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names))
    got = A.pareto_frontier(df, "id", names[:-1], names[-1:])
    assert got.columns == df.columns
    assert sorted(r["id"] for r in got.collect()) == sorted(want)
    assert A.pareto_frontier(df.limit(0), "id", names[:-1], names[-1:]).count() == 0
