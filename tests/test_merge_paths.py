"""Merging of paths: as one after another over whole lists, holding only the paths that others may join."""

import random

import numpy as np
from pyspark.sql import DataFrame

from maploom.operators import streams as S


def plain(paths, near, overlap, ratio):
    kept, out = [], []
    for path, p in paths:
        length, best = np.linalg.norm(np.diff(p, axis=0), axis=1).sum(), None
        for k, (q, n, ql, _) in enumerate(kept):
            for flip, cand in ((False, p), (True, p[::-1])):
                d = np.linalg.norm(cand - q, axis=1)
                if (d <= near).mean() >= overlap and min(length, ql) >= ratio * max(length, ql) and np.median(d) <= near and (best is None or np.median(d) < best[0]):
                    best = (np.median(d), k, flip, cand)
        if best is None:
            kept.append([p, 1, length, path])
            out.append((path, path, False))
        else:
            _, k, flip, cand = best
            q, n = kept[k][0], kept[k][1]
            kept[k][0], kept[k][1] = q + (cand - q) / (n + 1), n + 1
            out.append((path, kept[k][3], flip))
    return out


def test_paths_pass_by_in_batches(spark, monkeypatch):
    r, rows, want = random.Random(4), [], []
    for m in (1, 2):
        paths = []
        for k in range(150):
            a, b, turn = r.randrange(12), r.uniform(-0.2, 0.2), r.random() < 0.5
            p = np.array([(a * 3 + i + b, (a * i) % 7 + b) for i in range(8)])
            paths.append((1000 * m + k, p[::-1] if turn else p))
        rows += [(m, k, i, float(x), float(y)) for k, p in paths for i, (x, y) in enumerate(p)]
        want += [(m, *o) for o in plain(paths, 2.0, 0.6, 0.3)]
    r.shuffle(rows)
    plan = DataFrame.groupBy
    grouped = []
    monkeypatch.setattr(DataFrame, "groupBy", lambda self, *c: grouped.append(c) or plan(self, *c))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = S.merge_paths(spark.createDataFrame(rows, "map long, path long, i int, x double, y double"), 2.0, 0.6, 0.3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((x.map, x.path, x.merged, x.reversed) for x in got) == want
    assert {x[2] == x[1] for x in want} == {True, False} and any(x[3] for x in want)
    assert ("map",) not in grouped  # no group of a whole map in one frame
