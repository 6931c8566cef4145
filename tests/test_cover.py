"""Frame covers take one shuffle by task."""

from maploom.operators import retrieval as R


def test_cover_qualifies_tracks_in_its_own_step(spark):
    rows = [(1, 10, 1, True), (1, 11, 1, False), (1, 11, 2, False), (1, 12, 2, None), (1, 12, 3, True), (1, 10, 4, True), (1, 12, 4, None), (1, 12, 4, None), (2, 20, 1, False), (2, None, 1, True), (None, 20, 1, True)]
    o = spark.createDataFrame(rows, "task long, frame long, track long, depth_valid boolean")
    c = R.greedy_frame_cover(o, 2, 64)
    assert "Join" not in c._jdf.queryExecution().optimizedPlan().toString()  # the rows were shuffled and sorted for two joins more
    assert sorted(map(tuple, c.collect())) == [(1, 0, 10, 1, 0), (1, 0, 10, 4, 0)]
    assert {(r.task, r.track) for r in R.qualified_tracks(o, 2).collect()} == {(1, 1), (1, 4)}
