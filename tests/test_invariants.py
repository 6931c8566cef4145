"""Literal inputs: the rules that SQL can't show."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from maploom.functions import vectors as V
from maploom.operators import expectations as X
from maploom.operators import joins as J
from maploom.operators import memory as M
from maploom.operators import retrieval as R
from maploom.operators import sequences as Q
from maploom.operators import streams as S
from maploom.operators.merging import MERGE_SCHEMA
from maploom.operators.graphs import connected_components
from maploom.operators.registry import call_tool, register_tool
from maploom.sources import readers
from maploom.streaming import machines


def test_unit_vector_of_odd_inputs(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, []), (4, [float("nan"), 1.0]), (5, None)], "id int, v array<double>")
    got = {r.id: r.u for r in df.select("id", V.unit_vector(F.col("v")).alias("u")).collect()}
    assert got == {1: [0.6, 0.8], 2: None, 3: None, 4: None, 5: None}


def test_both_embeddings_missing_is_an_error(spark):
    df = spark.createDataFrame([(None, None)], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="both embeddings are missing"):
        df.select(V.combine_embeddings(F.col("a"), F.col("b"), 0.5, 0.5)).collect()


def _obs(spark, xs, locals_=None, label="chair"):
    rows = [(1, i, (locals_ or [7] * len(xs))[i], i, x, 0.0, 0.0, label) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "map long, seq long, local long, us long, x double, y double, z double, label string")


def test_merge_takes_the_median_and_splits_far_observations(spark):
    m = sorted(M.merge_entities(_obs(spark, [0.0, 0.1, 0.2, 3.0]), 0.4).collect(), key=lambda r: r.seq)
    assert len({r.entity for r in m[:3]}) == 1 and m[3].entity != m[0].entity
    assert m[2].x == pytest.approx(0.1)
    assert [r.action for r in M.merge_events(spark.createDataFrame(m, MERGE_SCHEMA)).orderBy("seq").collect()] == ["create", "reuse", "reuse", "split"]


def test_merge_keeps_labels_apart(spark):
    a, b = _obs(spark, [0.0], [1], "chair"), _obs(spark, [0.0], [2], "table").withColumn("seq", F.lit(5).cast("long"))
    assert M.merge_entities(a.union(b), 0.5).select("entity").distinct().count() == 2


def test_merge_against_a_slow_replay(spark):
    rng = np.random.default_rng(4)
    rows = [(0, i, int(rng.integers(5)), i, *map(float, rng.normal(0, 1, 3)), "abc"[rng.integers(3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "map long, seq long, local long, us long, x double, y double, z double, label string")
    got = {r.seq: r.entity for r in M.merge_entities(df, 0.8).collect()}
    points, names, mapping = [], [], {}
    for _, seq, local, _, x, y, z, label in rows:
        at = np.array([x, y, z])
        mid = [np.median(p, axis=0) for p in points]
        e = mapping.get(local)
        if e is not None and np.linalg.norm(mid[e] - at) > 0.8:
            e = None
        if e is None:
            near = sorted((np.linalg.norm(c - at), k) for k, c in enumerate(mid) if np.linalg.norm(c - at) <= 0.8 and label in names[k])
            e = near[0][1] if near else None
        if e is None:
            points.append([])
            names.append(set())
            e = len(points) - 1
        points[e].append(at)
        names[e].add(label)
        mapping[local] = e
        rows_e = got[seq]
        assert rows_e == got[next(s for s in got if got[s] == rows_e)]
    assert len(set(got.values())) == len(points)


def test_components_of_a_long_chain(spark):
    e = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(e).select("component").distinct().collect()[0][0] == 0


def test_match_streams_by_two_pointers(spark):
    a = spark.createDataFrame([(1, t, t) for t in (0, 10, 20, 500)], "key long, t long, seq long")
    b = spark.createDataFrame([(1, t, t) for t in (3, 14, 300, 505)], "key long, t long, seq long")
    got = {(r.left_seq, r.right_seq) for r in J.match_streams(a, b, ["key"], 5).collect()}
    assert got == {(0, 3), (10, 14), (20, None), (None, 300), (500, 505)}


def test_nearest_of_an_empty_side(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    b = a.withColumnRenamed("id", "other")
    assert J.nearest(a, b.limit(0), "id", "other", 1, 1.0).count() == 0
    assert J.nearest(a, b.withColumn("x", F.lit(900.0)), "id", "other", 1, 1.0).first().distance == 900.0


def test_decision_margin_and_bad_arguments(spark):
    rec = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.98, 0.199])], "ord long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query long, embedding array<double>")
    got = {r.query: (r.found, r.reason) for r in R.retrieve_with_decision(q, rec, 1).collect()}
    assert got == {1: (True, None), 2: (False, "below_min_similarity")}
    got = {r.query: r.reason for r in R.retrieve_with_decision(q, rec, 1, 0.1, 0.5).collect()}
    assert got == {1: "below_min_margin", 2: "below_min_margin"}
    with pytest.raises(ValueError):
        R.retrieve_with_decision(q, rec, 0)


def test_otsu_of_one_and_of_equal_values(spark):
    df = spark.createDataFrame([(1, 0.4, 0), (2, 0.5, 0), (2, 0.5, 1), (3, 0.1, 0), (3, 0.2, 1), (3, 0.9, 2)], "query long, score double, ord long")
    got = {r.query: r.threshold for r in R.otsu(df, ["query"], "score").collect()}
    assert got == {1: 0.4, 2: 0.5, 3: pytest.approx(0.55)}


def test_otsu_and_percentile_of_skewed_scores(spark):
    rng = np.random.default_rng(2)
    lists = {1: rng.normal(0, 1, 900), 2: np.concatenate([rng.normal(0, 1e-6, 500), [50.0]]), 3: np.repeat([1.0, 2.0, 7.0], 40), 4: rng.exponential(1, 700) ** 4, 5: np.array([0.3, 0.9])}
    df = spark.createDataFrame([(q, float(x), k) for q, v in lists.items() for k, x in enumerate(v)], "query long, score double, ord long")
    got = {r.query: r.threshold for r in R.otsu(df, ["query"], "score").collect()}
    cut = {r.query: r.value for r in R.exact_percentile(df, ["query"], "score", 0.85).collect()}
    for q, v in lists.items():
        v = np.sort(v)
        best, at = -1.0, None
        for i in range(1, len(v)):
            var = round(i / len(v) * (1 - i / len(v)) * (v[:i].mean() - v[i:].mean()) ** 2, 12)
            if var > best:
                best, at = var, (v[i - 1] + v[i]) / 2
        assert got[q] == pytest.approx(at, abs=1e-12) and cut[q] == pytest.approx(np.percentile(v, 85), rel=1e-12)


def test_pose_gate_only_moves_on_acceptance():
    class Row:
        def __init__(self, seq, ns, std=0.1, revision=1):
            self.seq, self.ns, self.std, self.revision = seq, ns, std, revision

    g = S.PoseGate(1)
    rows = [Row(0, 10**9), Row(1, 10**9), Row(2, int(1.2e9), 5.0), Row(3, int(1.6e9)), Row(4, int(9e9)), Row(5, int(1.7e9), 0.1, 2)]
    assert [g.step(r)[3] for r in rows] == [None, "non_monotonic", "position_uncertain", "pose_gap", "clock_jump", "calibration_changed"]


def test_corrections_one_pending_per_entity_and_revision(spark):
    rows = [("a", 1, 0, "x", 0.5, 10, 0), ("a", 1, 0, "x", 0.5, 10, 1), ("b", 1, 0, "y", 0.9, 20, 2), ("c", 1, 0, "z", 0.9, 5, 3)]
    df = spark.createDataFrame(rows, "op string, entity long, revision long, label string, confidence double, us long, seq long")
    assert {r.seq: r.state for r in M.coalesce_corrections(df).collect()} == {0: "superseded", 1: "duplicate", 2: "pending", 3: "superseded"}


def test_visit_timeline_sentences(spark):
    df = spark.createDataFrame([(1, 0.0, "A"), (2, 0.0, "A"), (2, 1.0, "B"), (3, 0.0, "A"), (3, 1.0, "B"), (3, 2.0, "C")], "key long, entered double, r string")
    got = {r.key: r.timeline for r in Q.visit_timeline(df, "r").collect()}
    assert got[1] == "You were in A(0.0)."
    assert got[2] == "You started in A(0.0), and finally ended in B(1.0)."
    assert got[3] == "You started in A(0.0), then went to B(1.0), and finally ended in C(2.0)."


def test_paths_merge_forward_and_reversed_but_not_parallel(spark):
    line = [(float(i), 0.0) for i in range(5)]
    paths = {1: line, 2: line[::-1], 3: [(x, 5.0) for x, _ in line]}
    df = spark.createDataFrame([(0, p, i, *xy) for p, pts in paths.items() for i, xy in enumerate(pts)], "map long, path long, i long, x double, y double")
    got = {r.path: (r.merged, r.reversed) for r in S.merge_paths(df, 0.25, 0.75, 0.65).collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (3, False)}


def test_covariance_and_missing_gate_evidence(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 1.0]), (2, [1.0, 3.0, 3.0, 1.0])], "id long, c array<double>")
    assert {r.id: r.ok for r in df.select("id", X.covariance_ok(F.col("c")).alias("ok")).collect()} == {1: True, 2: False}
    e = spark.createDataFrame([(1, None)], "id long, v double")
    g = X.gates_passed(X.run_gates(e, [("time", "t", "v", 1.0, 2.0, True)])).first()
    assert (g.passed, g.blocking) == (False, "t")


def test_tools_refuse_unknown_names_and_arguments():
    register_tool("echo", lambda n: n, {"n": int})
    assert call_tool("echo", {"n": 3}) == 3
    with pytest.raises(KeyError):
        call_tool("nothing", {})
    with pytest.raises(ValueError):
        call_tool("echo", {"m": 3})
    with pytest.raises(TypeError):
        call_tool("echo", {"n": "3"})


def test_readers(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(json.dumps({"tick": 1, "sensor_time_ns": 5, "images": [{"name": "left", "timestamp_ns": 1000000}, {"name": "right", "timestamp_ns": 3000000, "error": "x"}], "lidar": [], "poses": {"values": {"base": [1.0]}}}) + "\n\n" + "{bad\n")
    rows = readers.read_manifest_jsonl(spark, str(tmp_path / "m.jsonl")).collect()
    good = next(r for r in rows if r.tick == 1)
    assert (good.stereo_ms, good.has_left, good.has_lidar, good.has_pose, good.errors) == (2.0, True, False, True, 1)
    assert any(r._corrupt for r in rows)
    (tmp_path / "t.json").write_text(json.dumps({"frames": [{"index": 0, "timestamp_ns": 10**9}, {"index": 1, "timestamp_ns": 2 * 10**9, "timestamp": 5.0}]}))
    assert [(r.timestamp, r.agrees) for r in readers.read_tick_index(spark, str(tmp_path / "t.json")).orderBy("ordinal").collect()] == [(0.0, True), (1.0, False)]
    (tmp_path / "p.txt").write_text(" ".join(map(str, range(16))) + "\n1 2\n")
    (tmp_path / "s.txt").write_text("5\n6\n7\n")
    assert [r.complete for r in readers.read_pose_text(spark, str(tmp_path / "p.txt"), str(tmp_path / "s.txt")).orderBy("ordinal").collect()] == [True, False, False]
    (tmp_path / "o.jsonl").write_text("\n".join(map(json.dumps, [{"sensor_time_ns": 1, "position_m": [1, 2, 3], "orientation_xyzw": {"x": 0, "y": 0, "z": 0, "w": 1}}, {"header": {"stamp_ns": 2}, "pose": {"position": {"x": 1, "y": 2, "z": 3}, "orientation": [0, 0, 0, 1]}}, {"sensor_time_ns": 3, "position_m": [1, 2, 3], "orientation_xyzw": [0, 0, 0, 0]}])))
    good, bad = readers.read_odometry(spark, str(tmp_path / "o.jsonl"))
    assert sorted(r.sensor_time_ns for r in good.collect()) == [1, 2] and [r.sensor_time_ns for r in bad.collect()] == [3]
    (tmp_path / "q.csv").write_text('"se\nq",id,c\n"a ""x""",2,"two\nlines"\n')
    assert tuple(readers.read_qa_csv(spark, str(tmp_path / "q.csv")).first()) == ('a "x"', "2", "two\nlines")
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": (ord("O") << 56) + 7, "layer": 2, "partition": 0, "attributes": {"name": "cup"}}], "edges": [{"source": 1, "target": 2}]}))
    nodes, edges = readers.read_scene_graph_json(spark, str(tmp_path / "g.json"))
    n = nodes.first()
    assert (n.prefix, n.number, n.name, edges.count()) == ("O", 7, "cup", 1)


def test_write_collection_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.5, 2.0], "a,b")], "id long, v array<double>, s string")
    readers.write_collection(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c/parquet")).collect() == df.collect()
    r = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c/csv")).first()
    assert (r.id, r.s, json.loads(r.v)) == ("1", "a,b", [1.5, 2.0])
    with pytest.raises(Exception, match="NaN in x"):
        readers.write_collection(spark.createDataFrame([(math.nan,)], "x double"), str(tmp_path / "d"))


@pytest.mark.parametrize("machine", [S.PoseGate, S.KeyframeGate])
def test_stream_equals_batch(spark, tmp_path, machine):
    from maploom.plans.streams import rows

    df = rows(spark, "/root/testdata/sf0.001").filter("key < 6")
    for part in range(3):  # files in time order, so that a trigger never sees the past
        lo, hi = (1 + part * 44_000_000_000, 1 + (part + 1) * 44_000_000_000)
        df.filter((F.col("ns") >= lo) & (F.col("ns") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    name = f"out_{machine.__name__}"
    q = machines.run_machine(stream, machine).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(repr, spark.table(name).collect()))
    read = df.filter(F.col("ns") < 1 + 3 * 44_000_000_000)
    assert got == sorted(map(repr, S.replay(read, machine).collect()))
