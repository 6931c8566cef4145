"""Scenes and entity maps: against slow replays, and streams against batches."""

import math
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from maploom.operators import merging, scenes
from maploom.plans import catalog
from maploom.plans import memory as plans_memory
from maploom.plans import streams as plans_streams
from maploom.streaming import machines

DIR = "/root/testdata/sf0.001"


class Sighting:
    def __init__(self, seq, s, track, at, motion=0.0, labels=None, std=0.1, size=(1.0, 1.0, 1.0)):
        self.seq, self.ns, self.track, self.motion, self.labels, self.std = seq, round(s * 1e9), track, motion, labels, std
        self.x, self.y, self.z = at
        self.sx, self.sy, self.sz = size


def get(rows, name):
    return [r[scenes.COLUMNS.index(name)] for r in rows]


def test_silence_occludes_then_expires():
    m = scenes.Scene(1)
    rows = m.step(Sighting(0, 0.0, 7, (0, 0, 0), 0.9, {"cup": 1.0}))
    assert get(rows, "state") == ["dynamic"] and m.next_deadline() == 500_000_000
    assert m.silence(400_000_000) == []
    rows = m.silence(10**10)
    assert get(rows, "state") == ["occluded", "expired"] and get(rows, "ns") == [500_000_000, 5_000_000_000] and get(rows, "observed") == [False, False]
    rows = m.step(Sighting(1, 20.0, 7, (0, 0, 0)))
    assert get(rows, "object") == [1]  # an expired object does not come back


def test_a_still_object_is_promoted_and_moves_again():
    m = scenes.Scene(1)
    rows = [m.step(Sighting(k, k * 0.4, 7, (1.0, 2.0, 3.0)))[-1] for k in range(9)]
    assert get(rows, "state") == ["tentative"] + ["stationary_candidate"] * 5 + ["promoted_static"] * 3
    assert get(m.step(Sighting(9, 3.3, 7, (1.0, 2.0, 3.0), 0.8)), "state") == ["dynamic"]
    assert get(m.step(Sighting(10, 3.3, 7, (1.0, 2.0, 3.0))), "reason") == ["not_chronological"]
    assert get(m.step(Sighting(11, 3.4, 7, (math.nan, 2.0, 3.0))), "reason") == ["not_finite"]


def test_labels_and_reach_decide_who_is_the_same():
    m = scenes.Scene(1)
    m.step(Sighting(0, 0.0, 1, (0, 0, 0), labels={"cup": 1.0}))
    assert get(m.step(Sighting(1, 0.1, 2, (0.5, 0, 0), labels={"dog": 1.0})), "object") == [1]
    assert get(m.step(Sighting(2, 0.2, 3, (0.1, 0, 0), labels={"cup": 0.5, "dog": 0.5})), "object") == [0]
    assert get(m.step(Sighting(3, 0.3, 4, (5, 0, 0), labels={"cup": 1.0})), "object") == [2]
    rows = m.step(Sighting(4, 0.4, 1, (0, 0, 0), labels={"dog": 1.0}))
    shares = 0.8 * (0.9 / 1.0), 0.8 * 0.1 + 0.2
    assert get(rows, "object") == [0] and rows[-1][scenes.COLUMNS.index("share")] == pytest.approx(max(shares) / sum(shares))


def slow_scene(rows):
    """A plain replay: one dictionary an object, the filter by its textbook matrices."""
    h = np.hstack([np.eye(3), np.zeros((3, 3))])
    objects, track_of, out, made = {}, {}, [], 0

    def predict(o, ns):
        dt = (ns - o["at"]) / 1e9
        if dt > 0:
            f = np.block([[np.eye(3), dt * np.eye(3)], [np.zeros((3, 3)), np.eye(3)]])
            q = np.block([[np.eye(3) * dt**4 / 4, np.eye(3) * dt**3 / 2], [np.eye(3) * dt**3 / 2, np.eye(3) * dt**2]])
            o["m"], o["p"], o["at"] = f @ o["m"], f @ o["p"] @ f.T + q, ns

    def quiet(until):
        while True:
            due = [(o["last"] + d, k, s) for k, o in objects.items() for d, s in ((500_000_000, "occluded"), (5_000_000_000, "expired")) if not (s == "occluded" and o["quiet"])]
            due = [d for d in due if until is None or d[0] <= until]
            if not due:
                return
            ns, k, s = min(due)
            predict(objects[k], ns)
            objects[k]["quiet"] = True
            out.append((None, ns, k, s, objects[k]["m"][:3].copy(), objects[k]["n"]))
            if s == "expired":
                del objects[k]

    for r in sorted(rows, key=lambda r: (r.ns, r.seq)):
        quiet(r.ns)
        at, labels = np.array([r.x, r.y, r.z]), dict(r.labels or {})
        k = track_of.get(r.track)
        k = k if k in objects else None
        if k is None:
            near = [(np.linalg.norm(o["m"][:3] + o["m"][3:] * (r.ns - o["at"]) / 1e9 - at), k) for k, o in objects.items() if not labels or not o["labels"] or set(labels) & set(o["labels"])]
            k = min(near)[1] if near and min(near)[0] <= 1.0 else None
        if k is None:
            k, made = made, made + 1
            p = np.diag([r.std**2 + 1e-9] * 3 + [4.0] * 3)
            objects[k] = {"m": np.r_[at, 0, 0, 0], "p": p, "at": r.ns, "last": r.ns, "labels": labels, "n": 1, "since": None, "still": 0}
            state = "dynamic" if r.motion >= 0.55 else "tentative"
        else:
            o = objects[k]
            if r.ns <= o["last"]:
                out.append((r.seq, r.ns, None, None, None, None))
                continue
            old, dt = o["m"][:3].copy(), (r.ns - o["last"]) / 1e9
            predict(o, r.ns)
            noise = np.eye(3) * r.std**2
            g = o["p"] @ h.T @ np.linalg.inv(h @ o["p"] @ h.T + noise + 1e-9 * np.eye(3))
            o["m"] = o["m"] + g @ (at - h @ o["m"])
            o["p"] = (np.eye(6) - g @ h) @ o["p"] @ (np.eye(6) - g @ h).T + g @ noise @ g.T
            if o["n"] == 1:
                o["m"][3:] = (at - old) / dt
                o["p"][3:, 3:] = (noise + np.eye(3) * 0.15**2) / dt**2
            mixed = {x: 0.8 * o["labels"].get(x, 0) + 0.2 * labels.get(x, 0) for x in set(o["labels"]) | set(labels)}
            o["labels"] = {x: v / sum(mixed.values()) for x, v in mixed.items()}
            o["n"], o["last"] = o["n"] + 1, r.ns
            speed = np.linalg.norm(o["m"][3:])
            if r.motion >= 0.55 or speed >= 0.2:
                state, o["since"], o["still"] = "dynamic", None, 0
            elif speed <= 0.08:
                o["since"], o["still"] = (r.ns, 1) if o["since"] is None else (o["since"], o["still"] + 1)
                state = "promoted_static" if r.ns - o["since"] >= 2e9 and o["still"] >= 5 else "stationary_candidate"
            else:
                state = "tentative"
        o = objects[k]
        o["quiet"] = False
        track_of[r.track] = k
        out.append((r.seq, r.ns, k, state, o["m"][:3].copy(), o["n"]))
    quiet(None)
    return out


def test_scenes_equal_a_slow_replay(spark):
    s = plans_streams.sightings(spark, DIR)
    s = s.withColumn("ns", F.expr("ns div 4 + 1")).withColumn("x", F.col("x") / 3)  # denser, so that objects meet
    got = {}
    for r in scenes.replay_scenes(s).collect():
        got.setdefault(r.key, []).append(r)
    rows = {}
    for r in s.collect():
        rows.setdefault(r.key, []).append(r)
    assert got.keys() == rows.keys()
    states = set()
    for key, sights in rows.items():
        mine = {(r.seq, r.ns, r.object, r.state, r.seen) for r in got[key]}
        want = slow_scene(sights)
        assert mine == {(seq, ns, k, state, n) for seq, ns, k, state, _, n in want}
        at = {(r.seq, r.ns, r.object, r.state): (r.x, r.y, r.z) for r in got[key] if r.object is not None}
        for seq, ns, k, state, place, _ in want:
            if k is not None:
                assert at[seq, ns, k, state] == pytest.approx(tuple(place), abs=1e-6)
                states.add(state)
    assert {"dynamic", "tentative", "occluded", "expired"} <= states


def test_histories_of_objects(spark):
    rows = catalog.QUERIES["p1_dynamic_objects"](spark, DIR).toPandas()
    rows = rows[rows["object"].notna()].sort_values(["ns", "seq"], na_position="first")
    want = {}
    for (key, o), g in rows.groupby(["key", "object"]):
        seen = g[g["observed"]]
        want[key, o] = (seen["ns"].min(), seen["ns"].max(), len(seen), seen["track"].nunique(), (g["state"] == "occluded").sum(), g.loc[g["state"] == "expired", "ns"].max(), seen["state"].iloc[-1], g["state"].iloc[-1])
    got = {(r.key, r.object): (r.first_ns, r.last_ns, r.seen, r.tracks, r.occlusions, r.expired_ns, r.last_seen_state, r.state) for r in catalog.QUERIES["p2_expire_objects"](spark, DIR).collect()}
    assert got == want and {v[-1] for v in got.values()} == {"expired"}


def run_stream(spark, build, folder, tmp_path, schema, parts):
    """Run a stream over table parts that arrive one after the other."""
    name = f"t{uuid.uuid4().hex}"
    out = []
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(folder)
        q = build(spark.readStream.schema(schema).parquet(folder)).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(str(tmp_path / f"{name}-out"))


def test_scene_stream_fires_timers_like_the_batch(spark, tmp_path):
    s = plans_streams.sightings(spark, DIR).filter("key < 6").withColumn("t", F.timestamp_micros(F.expr("ns div 1000")))
    s = s.withColumn("labels", F.col("labels").cast("map<string,double>"))
    cut = s.agg(F.percentile("ns", 0.5)).first()[0]
    last = s.agg(F.max("ns")).first()[0]
    far = spark.createDataFrame([(99, 1, last + 3600 * 10**9, 0)], "key long, seq long, ns long, track long")
    far = s.limit(1).drop("key", "seq", "ns", "track", "t").crossJoin(far).withColumn("t", F.timestamp_micros(F.expr("ns div 1000"))).select(s.columns)
    batch = scenes.replay_scenes(s)
    got = run_stream(spark, lambda d: machines.scene_stream(d, "t", "1 second"), str(tmp_path / "in"), tmp_path, s.schema, [s.filter(F.col("ns") <= cut), s.filter(F.col("ns") > cut), far])
    assert sorted(map(repr, got.filter("key < 99").collect())) == sorted(map(repr, batch.collect()))
    assert got.filter("state = 'expired' and seq is null").count() > 0


# ---------------------------------------------------------------- entities


def slow_merge(rows, distance):
    """A plain replay of one map: every entity is looked at, medians over all observations."""
    entities, mapping, seen, out = [], {}, set(), []
    for r in sorted(rows, key=lambda r: r.seq):
        at, label = np.array([r.x, r.y, r.z]), (r.label or "").strip()
        prior = mapping.get((r.session, r.local))
        found = prior
        if prior is not None and np.linalg.norm(entities[prior]["at"] - at) > distance:
            found = None
        if found is None:
            best = math.inf
            for k, e in enumerate(entities):
                if e["type"] == r.type and (not label or label.casefold() in e["names"]):
                    d = np.linalg.norm(e["at"] - at)
                    if d <= distance and d < best:
                        found, best = k, d
        created = found is None
        if created:
            entities.append({"type": r.type, "names": {(label or "unknown").casefold()}, "at": at, "points": [], "sizes": [], "sure": [r.confidence]})
            found = len(entities) - 1
        e = entities[found]
        if label:
            e["names"].add(label.casefold())
        mapping[r.session, r.local] = found
        if (r.session, r.local, r.us) not in seen:
            seen.add((r.session, r.local, r.us))
            e["points"].append(at)
            e["sure"].append(r.confidence)
            if r.sx is not None:
                e["sizes"].append([r.sx, r.sy, r.sz])
        if e["points"]:
            e["at"] = np.median(np.array(e["points"]), axis=0)
        out.append((r.seq, prior, found, created, tuple(np.round(e["at"], 6)), None if not e["sizes"] else tuple(np.round(np.median(np.array(e["sizes"]), axis=0), 6)), max(e["sure"])))
    return out


def observations(spark, n=1500, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        at = [float(v) for v in rng.uniform(0, 4, 3)]
        size = [float(v) for v in rng.uniform(0.1, 1, 3)] if rng.random() < 0.8 else [None] * 3
        rows.append((int(rng.integers(3)), k, int(rng.integers(2)), int(rng.integers(60)), int(rng.integers(1, 90)), *at, *size, float(rng.random()), [None, "", " Cup ", "cup", "dog"][rng.integers(5)], ["object", "place"][int(rng.random() < 0.2)]))
    return spark.createDataFrame(rows, "map long, seq long, session long, local long, us long, x double, y double, z double, sx double, sy double, sz double, confidence double, label string, type string")


def test_merging_equals_a_slow_replay(spark):
    o = observations(spark)
    by_map = {}
    for r in o.collect():
        by_map.setdefault(r.map, []).append(r)
    got = {}
    for r in merging.merge_entities(o, 0.8).collect():
        got.setdefault(r.map, []).append(r)
    for m, rows in by_map.items():
        mine = sorted(got[m], key=lambda r: r.seq)
        number = {}
        for r in mine:
            number.setdefault(r.entity, len(number))
        size = lambda r: None if r.sx is None else tuple(round(v, 6) for v in (r.sx, r.sy, r.sz))
        assert [(r.seq, None if r.prior is None else number[r.prior], number[r.entity], r.created, tuple(round(v, 6) for v in (r.x, r.y, r.z)), size(r), r.confidence) for r in mine] == slow_merge(rows, 0.8)
        assert any(r.moved is not None for r in mine)


def test_a_large_map_is_not_square():
    m = merging.EntityMap(1, 1.0)

    class Row:
        session, us, label, type, sx, sy, sz, confidence = 0, 1, "cup", "object", None, None, None, 0.5

    looked = 0
    near = merging.math.dist

    def counted(a, b):
        nonlocal looked
        looked += 1
        return near(a, b)

    merging.math = type("M", (), {"dist": staticmethod(counted), "floor": math.floor, "inf": math.inf})
    try:
        for k in range(4000):
            r = Row()
            r.seq = r.local = k
            r.x, r.y, r.z = float(k % 100) * 3, float(k // 100) * 3, 0.0
            m.observe(r)
    finally:
        merging.math = math
    assert len(m.entities) == 4000 and looked < 4000


def test_merge_stream_equals_the_batch(spark, tmp_path):
    o = observations(spark, 600)
    want = sorted(map(repr, merging.merge_entities(o, 0.8).collect()))
    o.cache()
    got = run_stream(spark, lambda d: machines.merge_stream(d, 0.8), str(tmp_path / "in"), tmp_path, o.schema, [o.filter("seq < 200"), o.filter("seq between 200 and 399"), o.filter("seq >= 400")])
    assert sorted(map(repr, got.select(*merging.COLUMNS).collect())) == want


def test_entity_stream_query_equals_the_batch(spark):
    got = sorted(map(repr, catalog.QUERIES["p5_entity_merge_stream"](spark, DIR).collect()))
    batch = merging.merged_entities(merging.merge_entities(plans_memory._observed(spark, DIR), 4.0))
    assert got == sorted(map(repr, batch.collect()))


def test_sessions_are_moved_or_refused(spark):
    o = observations(spark, 40).withColumn("session", F.col("seq") % 4).withColumn("confidence", F.when(F.col("seq") == 4, 1.5).otherwise(F.col("confidence"))).withColumn("x", F.when(F.col("seq") == 8, float("nan")).otherwise(F.col("x")))
    o = o.withColumn("sx", F.when(F.col("seq") == 12, -1.0).otherwise(F.col("sx"))).withColumn("local", F.when(F.col("seq") != 16, F.col("local")))
    sessions = spark.createDataFrame([(0, "registered", [float(v) for v in plans_memory.STRAIGHT]), (1, "registered", [float(v) for v in (0, -1, 0, 5, 1, 0, 0, 2, 0, 0, 1, 0, 0, 0, 0, 1)]), (2, "rejected", None)], "session long, status string, transform array<double>")
    c = {r.seq: r for r in merging.canonical_observations(o, sessions).collect()}
    raw = {r.seq: r for r in o.collect()}
    assert c[2].refused == "session_not_registered" and c[3].refused == "unknown_session" and c[4].refused == "confidence_out_of_range" and c[8].refused == "position_not_finite" and c[16].refused == "no_local_id_or_time"
    assert c[12].refused == "size_not_positive" and c[12].x is None
    assert (c[5].x, c[5].y, c[5].z) == pytest.approx((5 - raw[5].y, raw[5].x + 2, raw[5].z))


def test_audit_and_final_entities(spark):
    m = merging.merge_entities(observations(spark), 0.8).cache()
    log = merging.merge_audit(m).toPandas()
    rows = m.toPandas()
    switched = rows[rows["moved"].notna()]
    assert len(switched) and (switched["prior"] != switched["entity"]).all() and (switched["moved"] > 0.8).all()
    assert log["action"].value_counts().to_dict() == {"entity_created": int(rows["created"].sum()), "entity_observed": int((~rows["created"]).sum()), "local_track_reassociated": len(switched)}
    versions = log[log["version"].notna()].sort_values("seq").groupby(["map", "entity"])["version"].apply(list)
    assert all(v == list(range(1, len(v) + 1)) for v in versions)
    final = {r.entity: r for r in merging.merged_entities(m).collect()}
    for entity, g in rows.sort_values("seq").groupby("entity"):
        f = final[entity]
        assert (f.n, f.x, f.created_us, f.name) == (len(g), g["x"].iloc[-1], g["us"].min(), g["name"].iloc[0])
        assert set(filter(None, f.aliases.split(","))) == set(g["label"].dropna()) - {f.name}
    assert pd.isna(rows["sx"]).sum() >= 0


def test_three_numbers_are_the_whole_covariance():
    """the scalar filter gives what 6 x 6 matrices give."""
    from types import SimpleNamespace

    rng = np.random.default_rng(2)
    s = scenes.Scene(1)
    mean, spread, last, tag = None, None, None, np.eye(3)
    for n in range(12):
        at, std, ns = rng.normal(size=3) * 0.1, 0.05 + n / 50, 1 + n * 300_000_000
        s.step(SimpleNamespace(seq=n, ns=ns, track=1, x=at[0], y=at[1], z=at[2], sx=1.0, sy=1.0, sz=1.0, std=std, motion=0.0, labels=None))
        error = tag * std**2
        if mean is None:
            mean, spread = np.r_[at, 0, 0, 0], np.kron([[1, 0], [0, 0]], error + tag * 1e-9) + np.kron([[0, 0], [0, 1]], tag * 4.0)
        else:
            dt, before = (ns - last) / 1e9, mean[:3].copy()
            move = np.kron([[1, dt], [0, 1]], tag)
            g = np.array([dt * dt / 2, dt])
            mean, spread = move @ mean, move @ spread @ move.T + np.kron(np.outer(g, g), tag)
            gain = spread[:, :3] @ np.linalg.inv(spread[:3, :3] + error + tag * 1e-9)
            keep = np.eye(6)
            keep[:, :3] -= gain
            mean, spread = mean + gain @ (at - mean[:3]), keep @ spread @ keep.T + gain @ error @ gain.T
            if n == 1:
                mean[3:], spread[3:, 3:] = (at - before) / dt, (error + tag * 0.15**2) / dt**2
        last, t = ns, s.things[0]
        p, c, v = t.spread
        assert np.allclose(np.kron([[p, c], [c, v]], tag), spread, rtol=1e-9, atol=1e-12) and np.allclose(t.mean, mean, rtol=1e-9, atol=1e-12)


def test_sweep_and_audit_replay_once(spark):
    """one replay serves all distances, and one serves both kinds of the audit's rows."""
    from maploom.operators import memory

    o = plans_memory._observed(spark, DIR)
    rows = {}
    for d in (2.0, 6.0):
        e = memory.merge_events(merging.merge_entities(o, d)).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("map", "entity").alias("k"))
        rows |= {(d, r.action): (r.n, r.k) for r in e.collect()}
    sweep = memory.merge_sweep(o, [2.0, 6.0])
    assert {(r.distance, r.action): (r.n, r.entities) for r in sweep.collect()} == rows
    for df in (sweep, merging.merge_audit(merging.merge_entities(o, 4.0))):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
