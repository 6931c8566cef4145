"""Density clusters against all pairs, and without rows a pair."""

import math
import random

import pytest
from pyspark.sql import DataFrame

from maploom.operators import aggregates as A
from maploom.operators import joins as J


def plain(points, eps, least):
    near = {i: [j for j, q, c in points if c == b and math.dist(p, q) <= eps] for i, p, b in points}
    core = {i for i in near if len(near[i]) >= least}
    found = {}
    for i in sorted(core):
        if i in found:
            continue
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in found:
                found[k] = i
                todo += [o for o in near[k] if o in core]
    for i in near:
        if i not in core and (met := [o for o in near[i] if o in core]):
            found[i] = found[min(met)]
    return found


@pytest.mark.parametrize("seed, by", [(1, None), (2, "label"), (3, None), (4, "label")])
def test_dbscan_as_all_pairs(spark, seed, by):
    r = random.Random(seed)
    rows = [(i, tuple(round(r.gauss(0, 1.3), 1 if seed > 2 else 3) for _ in range(3)), r.randrange(2) if by else 0) for i in r.sample(range(5000), 700)]
    rows += [(9000 + i, (0.5 * i, 50.0, -50.0), 0) for i in range(12)]  # a chain of steps as wide as the radius
    rows += [(9100 + i, (90.0, 90.0, 90.0), 0) for i in range(9)]  # copies of a place
    # two plates that only inner points of the facing cells bring within the radius
    rows += [(9200 + i, (30.0 + 0.02 * (i % 3), 30.0 + 0.1 * (i // 3), 30.0), 0) for i in range(9)] + [(9300 + i, (30.5 + 0.02 * (i % 3), 30.0 + 0.1 * (i // 3), 30.0), 0) for i in range(9)]
    df = spark.createDataFrame([(i, *p, b) for i, p, b in rows] + [(9999, float("nan"), 0.0, 0.0, 0), (9998, None, 0.0, 0.0, 0)], "id long, x double, y double, z double, label long")
    want = plain(rows, 0.5, 4)
    assert {x.id: x.cluster for x in A.dbscan(df, 0.5, 4, by).collect()} == want


def test_dense_clouds_are_not_paired(spark, monkeypatch):
    r, pairs = random.Random(5), []
    rows = [(i, r.uniform(0, 1), r.uniform(0, 1), r.uniform(0, 1)) for i in range(2000)]  # nearly all within each other's radius
    join = J.radius_join

    def counted(*a, **b):
        found = join(*a, **b)
        pairs.append(found.count())
        return found

    monkeypatch.setattr(J, "radius_join", counted)
    got = A.dbscan(spark.createDataFrame(rows, "id long, x double, y double, z double"), 0.5, 6)
    assert isinstance(got, DataFrame) and {(x.id, x.cluster) for x in got.collect()} == {(i, 0) for i in range(2000)}
    assert sum(pairs) < 10 * 2000
