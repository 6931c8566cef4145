"""Order-free merging against all pairs, and how many links it makes of copies."""

import numpy as np

from maploom.operators import graphs
from maploom.operators import memory as M


def _expected(rows, distance):
    parent = {r[0]: r[0] for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for s, la, *p in rows:
        for t, lb, *q in rows:
            if la == lb and np.sqrt(sum((x - y) ** 2 for x, y in zip(p, q))) <= distance:
                a, b = root(s), root(t)
                parent[max(a, b)] = min(a, b)
    return {s: root(s) for s in parent}


def test_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    at = np.round(np.r_[rng.uniform(-8, 8, (420, 3)), rng.uniform(0, 6, (120, 3))], 1)
    label = ["dense"] * 420 + [f"k{i}" for i in rng.integers(0, 6, 120)]
    seq = rng.permutation(5000)[:540]
    rows = [(int(s), la, *map(float, p)) for s, la, p in zip(seq, label, at)]
    rows += [(6000 + i, "k1", 1.5, 1.5, 1.5) for i in range(5)] + [(rows[0][0], "k2", 50.0, 50.0, 50.0), (7000, "k3", 50.0, 50.0, 50.0)]
    monkeypatch.setattr(M, "FEW", 100)
    schema = "seq long, label string, x double, y double, z double"
    got = {r.seq: r.entity for r in M.merge_entities_blocked(spark.createDataFrame(rows + [(9000, "k1", float("nan"), 0.0, 0.0)], schema), 1.0).collect()}
    assert got == _expected(rows, 1.0)
    assert 50 < len(set(got.values())) < len(got)


def test_copies_make_a_link_each(spark, monkeypatch):
    """Observations at one place made a link of each pair."""
    stored, links = graphs.stored, []

    def seen(df, label):
        out = stored(df, label)
        links.append(out.count())
        return out

    monkeypatch.setattr(graphs, "stored", seen)
    o = spark.range(400).selectExpr("id as seq", "'a' as label", "1.0d as x", "2.0d as y", "3.0d as z")
    assert {r.entity for r in M.merge_entities_blocked(o, 1.0).collect()} == {0}
    assert max(links) < 400
