"""Steps whose cost must follow the input: what moves between tasks, on small tables."""

import numpy as np

from maploom.operators import retrieval as R


def test_pairs_of_many_blocks_and_tiles(spark, monkeypatch):
    """outlines and tiles lose no pair and add none, however small blocks and tiles are."""
    monkeypatch.setattr(R, "TILE", 4)
    monkeypatch.setattr(R, "BLOCK", 16)
    monkeypatch.setattr(R, "OWN", 8)
    monkeypatch.setattr(R, "SHARED", 8)
    rng = np.random.default_rng(3)
    base = rng.random((6, 40)) * (rng.random((6, 40)) < 0.4)
    m = np.concatenate([base[rng.integers(0, 6, 90)] * (rng.random((90, 40)) < 0.85) + 1e-3, rng.random((10, 40)) - 0.5])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(i, f"w{j}", float(m[i, j])) for i in range(len(m)) for j in range(40) if m[i, j]]
    got = {(r.a, r.b): r.score for r in R.similar_pairs(spark.createDataFrame(rows, "item long, word string, weight double"), 0.8).collect()}
    s = m @ m.T
    assert set(got) == {(a, b) for a in range(len(m)) for b in range(a + 1, len(m)) if s[a, b] >= 0.8}
    assert all(abs(v - s[k]) < 1e-9 for k, v in got.items())


def test_blocks_of_scores_keep_ties_odd_vectors_and_groups(spark, monkeypatch):
    """F8 to F16, F18, F19: blocks give what row by row gives, also for equal, odd and missing vectors."""
    monkeypatch.setattr(R, "QUERIES", 7)
    monkeypatch.setattr(R, "RECORDS", 40)
    rng = np.random.default_rng(5)
    e = rng.normal(size=(20, 6)).round(2)[rng.integers(0, 20, 150)].tolist()
    e[3], e[40], e[41], e[42], e[60] = None, [1.0], [float("nan")] * 6, [None] * 6, [1e200] * 6
    records = spark.createDataFrame([(i, None if i % 7 == 0 else i % 3, v) for i, v in enumerate(e)], "ord long, label int, embedding array<double>")
    queries = records.filter("ord % 10 = 0").selectExpr("ord as query", "ord as own", "embedding")
    each = R._each(queries.withColumnRenamed("own", "_own"), records)
    assert sorted(map(repr, R.scores(queries, records).select("query", "ord", "label", "score").collect())) == sorted(map(repr, each.select("query", "ord", "label", "score").collect()))
    for by in ([], ["label"]):
        w = R.W.partitionBy("query", *by).orderBy(R.F.desc("score"), "ord")
        want = each.withColumn("rank", R.F.row_number().over(w)).filter("rank <= 4").select("query", "ord", "label", "score", "rank")
        assert sorted(map(repr, R.top_k(queries, records, 4, by).select("query", "ord", "label", "score", "rank").collect())) == sorted(map(repr, want.collect()))


def test_size_batches_stream_through_keys(spark):
    """no call a key; a key may span Arrow batches."""
    from maploom.operators.sequences import size_batches

    rows = [(k, i, float(i % 4)) for k in (None, 1, 2) for i in range(9)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        d = size_batches(spark.createDataFrame(rows, "key long, id long, size double"), "key", "id", "size", 5.0)
        got = {(r.key, r.id): r.batch for r in d.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in d._jdf.queryExecution().toString()
    assert got == {(k, i): b for k in (None, 1, 2) for i, b in enumerate([0, 0, 0, 0, 1, 1, 1, 1, 2])}


def test_candidates_without_written_scores(spark, monkeypatch):
    """bins of products give the candidates that written scores give, also with equal, odd and missing vectors."""
    rng = np.random.default_rng(11)
    e = rng.normal(size=(60, 6)).round(2)[rng.integers(0, 60, 400)].tolist()
    e[3], e[40], e[60] = None, [1.0], [1e200] * 6
    records = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(e)], "ord long, label int, embedding array<double>")
    queries = records.filter("ord % 10 = 2").selectExpr("ord as query", "ord as own", "embedding")
    scored = R.scores(queries, records).filter("score is not null")
    extra = spark.createDataFrame([(i, float(i * 7 % 31)) for i in range(400)], "ord long, far double")
    want = R.semantic_candidates(scored, 5).select("query", "ord", "label", "score")
    threshold = {r.query: r.threshold for r in R.otsu(scored, ["query"], "score").collect()}
    w = R.W.partitionBy("query").orderBy("far", "ord")
    near = lambda c: sorted(map(tuple, c.withColumn("r", R.F.row_number().over(w)).filter("r <= 4").select("query", "ord", "r").collect()))
    nearest, want = near(want.join(extra, "ord")), sorted(map(repr, want.collect()))
    monkeypatch.setattr(R, "scores", None)
    monkeypatch.setattr(R, "BLOCK_QUERIES", 16)
    got = R.candidates_of_products(queries, records, 5).select("query", "ord", "label", "score")
    assert sorted(map(repr, got.collect())) == want
    assert near(R.candidates_of_products(queries, records, 5, extra=extra, nearest=("far", 4))) == nearest
    got = {r.query: r.threshold for r in R.otsu_of_products(queries, records).collect()}
    assert got.keys() == threshold.keys() and all(abs(v - threshold[k]) < 1e-9 for k, v in got.items())
