"""Queries that rank more than once make the products of queries and records once."""

import pytest

from maploom.operators import retrieval as R
from maploom.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["r1_retrieve", "r5_evaluate_queries", "r8_alias_conflict"])
def test_products_are_made_once(spark, monkeypatch, name):
    grids, runs = [], spark.sparkContext.accumulator(0)
    whole, in_order = R._grid, R._in_order
    monkeypatch.setattr(R, "_grid", lambda *a, **b: grids.append(1) or whole(*a, **b))

    def counted(a, b):
        runs.add(1)
        return in_order(a, b)

    monkeypatch.setattr(R, "_in_order", counted)
    got = catalog.QUERIES[name](spark, DIR)
    before = runs.value
    assert len(grids) == 1 and before > 0
    assert got.count() > 0 and runs.value == before  # what follows reads the matches


def test_decisions_from_found_matches(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query long, embedding array<double>")
    rec = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.6, 0.1]), (12, [0.0, 0.2])], "ord long, embedding array<double>")
    rows = lambda d: sorted(map(repr, d.collect()))
    assert rows(R.decide(q, R.top_k(q, rec, 3), 2, 0.5)) == rows(R.retrieve_with_decision(q, rec, 2, 0.5))
    with pytest.raises(ValueError):
        R.decide(q, R.top_k(q, rec, 3), 0)
