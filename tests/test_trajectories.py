"""Trajectory acceptance against a plain numpy version."""

import math

import numpy as np
import pandas as pd
import pytest

from maploom.operators import trajectories as TR
from maploom.plans import catalog

DIR = "/root/testdata/sf0.001"


def sampled(points, n):
    length = np.r_[0.0, np.cumsum(np.linalg.norm(np.diff(points, axis=0), axis=1))]
    at = np.linspace(0.0, length[-1], n)
    keep = np.r_[True, np.diff(length) > 1e-12]
    return np.column_stack([np.interp(at, length[keep], points[keep, c]) for c in range(3)])


def fitted(source, target):
    """Errors after the best rotation and shift, by the quaternion of the largest eigenvalue (another way than the library's)."""
    a, b = source - source.mean(0), target - target.mean(0)
    s = a.T @ b
    skew = np.array([s[1, 2] - s[2, 1], s[2, 0] - s[0, 2], s[0, 1] - s[1, 0]])
    k = np.zeros((4, 4))
    k[0, 0], k[0, 1:], k[1:, 0] = np.trace(s), skew, skew
    k[1:, 1:] = s + s.T - np.trace(s) * np.eye(3)
    w, x, y, z = np.linalg.eigh(k)[1][:, -1]
    r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    return np.linalg.norm(a @ r.T - b, axis=1)


def slow(path, n):
    """{traversal: (reversed, p50, p95, most)} for a list of (traversal, point) in order."""
    parts = {}
    for name, p in path:
        parts.setdefault(name, []).append(p)
    names = list(parts)
    ref = sampled(np.array(parts[names[0]]), n)
    out = {}
    for name in names[1:]:
        c = sampled(np.array(parts[name]), n)
        ways = []
        for back, q in ((False, c), (True, c[::-1])):
            e = fitted(q, ref)
            ways.append((np.percentile(e, 95), back, np.percentile(e, 50), e.max()))
        p95, back, p50, most = min(ways)
        out[name] = (back, p50, p95, most)
    return out


def turn(axis, deg):
    a = np.array(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    t = math.radians(deg)
    return np.eye(3) + math.sin(t) * k + (1 - math.cos(t)) * k @ k


def frame(spark, rows):
    """rows: (key, traversal, t, point, rotation)"""
    data = []
    for i, (key, name, t, p, r) in enumerate(rows):
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = r, p
        data.append((key, name, i, float(t), *map(float, p), [float(v) for v in m.ravel()]))
    return spark.createDataFrame(data, "key string, part string, seq long, t double, x double, y double, z double, m array<double>")


@pytest.fixture(scope="module")
def walk():
    s = np.linspace(0, 2 * np.pi, 61)
    return np.column_stack([10 * np.cos(s) * (1 + s / 9), 6 * np.sin(s), np.sin(2 * s) + s / 3])


def test_moved_and_reversed_paths_fit(spark, walk):
    far = np.array([4e5, -7e5, 90.0])
    turned = walk @ turn((1, 2, 3), 77).T + far
    back = (walk @ turn((0, 1, -1), 140).T - far)[::-1]
    mirrored = walk * [1, 1, -1]
    rows = [("a", name, i, p, np.eye(3)) for name, pts in (("one", walk), ("two", turned), ("three", back), ("four", mirrored), ("five", 1.5 * walk)) for i, p in enumerate(pts)]
    got = {r["part"]: r for r in TR.align_traversals(frame(spark, rows), "key", "part", "seq", 128).collect()}
    assert set(got) == {"two", "three", "four", "five"} and {r["reference"] for r in got.values()} == {"one"}
    assert got["two"]["most"] < 1e-6 and not got["two"]["reversed"]
    assert got["three"]["most"] < 1e-6 and got["three"]["reversed"]
    assert got["four"]["p95"] > 0.5  # no mirror images
    assert got["five"]["p95"] > 1  # no scale
    want = slow([(name, p) for _, name, _, p, _ in rows], 128)
    for name in ("four", "five"):
        assert got[name]["reversed"] == want[name][0]
        assert np.allclose([got[name][c] for c in ("p50", "p95", "most")], want[name][1:], atol=1e-6)


def test_paths_of_the_table(spark):
    e = pd.read_parquet(f"{DIR}/events.parquet").sort_values("event_id")
    got = {(r["key"], r["kind"]): r for r in catalog.QUERIES["j9_repeated_paths"](spark, DIR).collect()}
    seen = 0
    for key, g in e.groupby("user_id"):
        z = g["props"].str.extract(r"(\d+)")[0].astype(float) / 2
        path = list(zip(g["event_type"], np.column_stack([g["value"], g["event_id"] % 100, z])))
        few = {k for k, n in g["event_type"].value_counts().items() if n < 2}
        if path[0][0] in few:
            continue
        for kind, (back, p50, p95, most) in slow([(k, p) for k, p in path if k not in few], 32).items():
            r = got[key, kind]
            assert r["reversed"] == back and r["error"] is None
            assert np.allclose([r["p50"], r["p95"], r["most"]], [p50, p95, most], atol=2e-6)
            seen += 1
    assert seen and seen == sum(r["p95"] is not None for r in got.values())


def test_traversals_that_cant_be_used(spark, walk):
    rows = [("a", "one", i, p, np.eye(3)) for i, p in enumerate(walk)]
    rows += [("a", "point", 70, walk[0], np.eye(3)), ("a", "still", 71, walk[0], np.eye(3)), ("a", "still", 72, walk[0], np.eye(3))]
    rows += [("a", "nan", 73, walk[0], np.eye(3)), ("a", "nan", 74, np.array([math.nan, 0, 0]), np.eye(3))]
    rows += [("b", "point", 1, walk[0], np.eye(3)), ("b", "fine", 2, walk[0], np.eye(3)), ("b", "fine", 3, walk[9], np.eye(3)), ("c", "only", 1, walk[3], np.eye(3))]
    got = {(r["key"], r["part"]): (r["p95"], r["error"]) for r in TR.align_traversals(frame(spark, rows), "key", "part", "seq").collect()}
    assert got == {
        ("a", "point"): (None, "fewer than two points"), ("a", "still"): (None, "no length"), ("a", "nan"): (None, "points that are not finite"),
        ("b", "fine"): (None, "reference: fewer than two points"),
    }
    assert TR.align_traversals(frame(spark, rows).limit(0), "key", "part", "seq").collect() == []


def test_checks(spark, walk):
    away = turn((3, 1, 2), 25)
    loop = np.vstack([walk, walk[::-1]])
    good = [("good", "out" if i < len(walk) else "back", 20 * i, p, np.eye(3)) for i, p in enumerate(loop)]
    once = [("once", "out", 20 * i, p, np.eye(3)) for i, p in enumerate(loop)]
    bent = [("bent", "out" if i < len(walk) else "back", i / 100, p + (i == len(loop) - 1), away if i == len(loop) - 1 else np.eye(3)) for i, p in enumerate(loop)]
    traj = frame(spark, good + once + bent)
    events = [(k, s, i, float(20 * i)) for k in ("good", "bent") for s in TR.SENSORS for i in range(122)] + [("once", "imu", i, float(i % 60)) for i in range(122)]
    sensors = TR.sensor_streams(spark.createDataFrame(events, "key string, stream string, seq long, t double"), "key", "stream", "seq")
    imu = sensors.filter("key = 'once'").first()
    assert (imu["n"], imu["monotonic"], imu["duration"], imu["gap"]) == (122, False, 1.0, 1.0)
    got = {(r["key"], r["code"]): (r["value"], r["passed"]) for r in TR.trajectory_acceptance(traj, "key", "part", "seq", sensors, least_rate=0.01).collect()}
    assert len(got) == 3 * len(TR.CODES)
    assert all(got["good", c][1] for c in TR.CODES)
    assert {c for c in TR.CODES if not got["once", c][1]} == {"vio.repeated_path", "vio.sensor_evidence"}
    p95 = slow([(name, p) for _, name, _, p, _ in bent], 128)["back"][2]  # the jump at the end shifts the samples, too
    assert p95 > 0.3 and got["bent", "vio.repeated_path"][0] == pytest.approx(p95)
    assert {c for c in TR.CODES if not got["bent", c][1]} == {"vio.duration", "vio.loop_translation", "vio.loop_rotation", "vio.repeated_path"}
    assert got["bent", "vio.loop_rotation"][0] == pytest.approx(25) and got["once", "vio.repeated_path"][0] is None
    assert len({code for code in (r["code"] for r in TR.trajectory_acceptance(traj, "key", "part", "seq").select("code").collect())}) == 5


def test_paths_are_rows_and_ties_go_forward(spark):
    """F30, F32: no row a sample and direction once paths are sampled; paths that lie as well both ways are forward, whatever the rounding."""
    rows = [("k", s, 0.0, (x, y, 0.0)) for s, (x, y) in enumerate([(0.0, 0.0), (3.0, 1.0)])] + [(f"t{n}", 10 * n + s, 0.0, p) for n in range(1, 40) for s, p in enumerate([(n * 0.37, n / 7, 1.0), (n * 0.37 + n / 3, n / 7 + 0.1 * n, 1.0)])]
    df = spark.createDataFrame([(1, k, s, t, *p) for k, s, t, p in rows], "key long, kind string, seq long, t double, x double, y double, z double")
    out = TR.align_traversals(df, "key", "kind", "seq", 16)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    got = out.collect()
    assert len(got) == 39 and not any(r.reversed for r in got)


def test_samples_lie_on_one_segment_each(spark):
    from maploom.operators.sequences import resample_path

    df = spark.createDataFrame([(k, s, float(s * s % 7 + k / 3), float(s % 3)) for k in range(20) for s in range(30)] + [(99, 0, 1.0, 1.0), (99, 1, 1.0, 1.0), (99, 2, 4.0, 5.0), (99, 3, 4.0, 5.0)], "key long, seq long, x double, y double")
    got = resample_path(df, "key", "seq", 16)
    assert {(r.key, r["count"]) for r in got.groupBy("key").count().collect()} == {(k, 16) for k in [*range(20), 99]}
    assert got.select("key", "i").distinct().count() == 21 * 16
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
