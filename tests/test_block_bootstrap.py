"""Block bootstrap against replicates drawn out in full."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from maploom.operators import aggregates as A


def _expected(spark, groups, length, replicates, seed, stat):
    """Interval of each group, with every replicate's values written out."""
    keys = [(g, len(v), r, d) for g, v in groups.items() for r in range(1, replicates + 1) for d in range(1, math.ceil(len(v) / length) + 1)]
    df = spark.createDataFrame(keys, "g string, n long, replicate int, draw long")
    starts = {(r.g, r.replicate, r.draw): r.s for r in df.withColumn("s", F.pmod(F.xxhash64(F.lit(seed), "g", "replicate", "draw"), F.col("n"))).collect()}
    out = {}
    for g, v in groups.items():
        v, m = np.array(v), []
        for r in range(1, replicates + 1):
            at = np.concatenate([starts[g, r, d] + np.arange(length) for d in range(1, math.ceil(len(v) / length) + 1)])[: len(v)] % len(v)
            m.append(getattr(np, stat)(v[at]))
        out[g] = np.percentile(m, [2.5, 50, 97.5])
    return out


@pytest.mark.parametrize("stat", ["mean", "median"])
@pytest.mark.parametrize("length", [1, 7, 60])
def test_against_full_replicates(spark, stat, length):
    rng = np.random.default_rng(3)
    groups = {
        "even": list(rng.normal(0, 1, 400)), "odd": list(rng.exponential(1, 333)), "ties": [float(x) for x in rng.choice([1, 1, 1, 2, 3], 200)],
        "one": [4.5], "few": [3.0, 1.0, 2.0], "trend": [float(i) for i in range(250)],
    }
    rows = [(g, i, x) for g, v in groups.items() for i, x in enumerate(v)] + [("odd", 500, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(str(g), int(i), None if x is None else float(x)) for g, i, x in rows], "g string, i long, value double")
    got = {r.g: (r.low, r.middle, r.high) for r in A.block_bootstrap(df, "g", "i", length, 25, 9, stat).collect()}
    want = _expected(spark, groups, length, 25, 9, stat)
    assert set(got) == set(want)
    for g, w in want.items():
        assert got[g] == pytest.approx(w, abs=1e-9), g


def test_empty_and_wrong(spark):
    df = spark.createDataFrame([], "g string, i long, value double")
    assert A.block_bootstrap(df, "g", "i", 5, 10, 1, "median").count() == 0
    with pytest.raises(ValueError):
        A.block_bootstrap(df, "g", "i", 0, 10, 1)


def test_draws_are_not_sent_through_the_driver(spark):
    """Draws are exploded from a row a group: taken for small, they were broadcast, though they grow with the table."""
    v = spark.createDataFrame([("g", i, 9, float(i)) for i in range(9)], "g string, _i long, _n long, value double")
    draws = v.groupBy("g").agg(F.max("_n").alias("_n")).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(3))))
    draws = draws.withColumns({"start": (F.col("replicate") + F.col("draw")) % 9, "len": F.when(F.col("draw") < 3, 4).otherwise(1)})
    sums = A._replicate_sums(v, draws, "g", 4, ["value"])
    assert "Broadcast" not in sums._jdf.queryExecution().executedPlan().toString()
    start = lambda r, d: (r + d) % 9
    want = {r: sum((start(r, d) + i) % 9 for d in (1, 2, 3) for i in range(4 if d < 3 else 1)) for r in range(1, 6)}
    assert {r.replicate: r.value for r in sums.collect()} == want
