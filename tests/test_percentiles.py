"""Exact percentiles that no task holds, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maploom.operators import aggregates as A


def test_error_summary_lists_few_values(spark, monkeypatch):
    """Percentiles gathered every value of a group in one task."""
    monkeypatch.setattr(F, "percentile", lambda *a: pytest.fail("a group in one task"))
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(0, 5, 30_000), None: rng.choice([1.0, 1.5, 2.0], 5000), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "some": rng.normal(0, 1, 1501)}
    rows = [(g, float(v), 2.0 if i % 3 else 0.0) for g, x in groups.items() for i, v in enumerate(x)] + [("none", None, 1.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, p double, r double").repartition(5)
    got = {r.g: r for r in A.error_summary(df, ["g"], "p", "r").collect()}
    assert set(got) == {*groups, "none"} and got["none"].n == 1 and got["none"].median is None
    for g, x in groups.items():
        r = np.array([2.0 if i % 3 else 0.0 for i in range(len(x))])
        e = x - r
        rel = np.abs(e) / np.maximum(r, 1e-6)
        want = [np.median(e), np.median(np.abs(e)), np.percentile(np.abs(e), 90), np.median(rel), np.abs(e).mean(), (np.abs(e) <= 1).mean()]
        assert [got[g][c] for c in ("median", "median_abs", "p90_abs", "median_rel", "mae", "within_1")] == pytest.approx(want, rel=1e-12), g
        assert got[g].n == len(x) + (g == "a")


@pytest.mark.parametrize("q", [0.0, 1e-4, 0.25, 0.9997, 1.0])
def test_ranks_of_any_share(spark, q):
    x = np.random.default_rng(2).permutation(np.repeat(np.arange(20_000), 3)[:50_001]).astype(float)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").withColumn("k", F.lit(1))
    assert A.spread_percentiles(df, ["k"], {"v": (F.col("x"), q)}).first().v == pytest.approx(np.percentile(x, 100 * q), rel=1e-12)
