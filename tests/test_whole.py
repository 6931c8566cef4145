"""The registered queries do the whole job, also where their SQL leaves rows out."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from maploom.operators import aggregates
from maploom.plans import catalog

DIR = "/root/testdata/sf0.001"


def _rows(spark, name):
    return catalog.QUERIES[name](spark, DIR).collect()


@pytest.fixture(scope="module")
def vectors():
    e = pd.read_parquet(f"{DIR}/embeddings.parquet")
    return e["vec_id"].to_numpy(), e["label"].to_numpy(), np.array(e["embedding"].tolist(), dtype=np.float64)


def test_queries_search_all_records(spark, vectors):
    ids, _, e = vectors
    found = {}
    for q in np.flatnonzero(ids % 20 == 0):
        order = sorted(np.flatnonzero(ids != ids[q]), key=lambda i: (-(e[i] @ e[q]), ids[i]))
        found[ids[q]] = [ids[i] for i in order]
    got = {}
    for r in sorted(_rows(spark, "g1_top_k_matches"), key=lambda r: r["rank"]):
        got.setdefault(r.query, []).append(r.ord)
    assert got == {q: f[:5] for q, f in found.items()}
    assert any(i % 20 == 0 for f in got.values() for i in f)
    at = {v: i for i, v in enumerate(ids)}
    for r in _rows(spark, "r8_alias_conflict"):
        a, b = (e[at[i]] @ e[at[r.query]] for i in found[r.query][:2])
        assert r.margin == pytest.approx(a - b, abs=2e-6)


def test_cosine_of_all_records(spark, vectors):
    ids = vectors[0]
    got = Counter(r.q for r in _rows(spark, "b3_cosine01"))
    assert got == {q: len(ids) - 1 for q in ids[ids % 20 == 0]}


def test_tfidf_of_all_words(spark):
    import re

    docs = pd.read_parquet(f"{DIR}/documents.parquet")
    bags = {i: Counter(re.findall("[a-z0-9]+", t.lower(), re.A)) for i, t in zip(docs["doc_id"], docs["text"]) if t}
    bags = {i: b for i, b in bags.items() if b}
    df = Counter(w for b in bags.values() for w in b)
    want = {}
    for i, b in bags.items():
        raw = {w: n * (math.log((len(bags) + 1) / (df[w] + 1)) + 1) for w, n in b.items()}
        length = math.sqrt(sum(x * x for x in raw.values()))
        want |= {(i, w): x / length for w, x in raw.items()}
    got = {(r.item, r.word): r.weight for r in _rows(spark, "r6_visual_word_tfidf")}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
    ids = sorted(bags)
    sim = {}
    for a in ids:
        for b in ids:
            if b >= a + 5:
                s = sum(want[a, w] * want[b, w] for w in bags[a].keys() & bags[b].keys())
                if s >= 0.8:
                    sim[a, b] = s
    near = {}
    for (a, b), s in sim.items():
        near.setdefault(a, []).append((-round(s, 9), b))
        near.setdefault(b, []).append((-round(s, 9), a))
    best = {(min(i, o), max(i, o)) for i, v in near.items() for _, o in sorted(v)[:3]}
    assert {(r.a, r.b) for r in _rows(spark, "r7_retrieve_pairs")} == best


def test_sign_flip_of_groups_of_any_size(spark):
    from maploom.operators import aggregates as A

    rng = np.random.default_rng(8)
    diffs = {"three": np.array([1.0, 2.0, 3.0]), "exact": rng.normal(0.4, 1, 16), "random": rng.normal(0.3, 1, 40)}
    rows = [(g, i, 0, float(x)) for g, v in diffs.items() for i, x in enumerate(v)]
    got = {r.g: r.p for r in A.sign_flip_p(spark.createDataFrame(rows, "g string, seed long, repeat long, diff double"), "g").collect()}
    masks = 1 - 2 * ((np.arange(1 << 16)[:, None] >> np.arange(16)) & 1)
    exact = (np.abs(masks @ diffs["exact"]) >= abs(diffs["exact"].sum()) - 1e-9).mean()
    signs = rng.choice([-1, 1], (100_000, 40))
    near = (np.abs(signs @ diffs["random"]) >= abs(diffs["random"].sum())).mean()
    assert got == {"three": 0.25, "exact": pytest.approx(exact), "random": pytest.approx(near, abs=0.01)}


def test_sign_flip_is_by_experiment(spark):
    assert {r.g for r in _rows(spark, "d29_sign_flip")} == {r.experiment for r in _rows(spark, "d29_paired_effect")}


def test_farthest_first_without_a_task_that_holds_a_region(spark, vectors):
    ids, labels, e = vectors
    e = e / np.linalg.norm(e, axis=1, keepdims=True)
    want = set()
    for label in set(labels):
        at = np.flatnonzero(labels == label)
        at = at[np.argsort(ids[at])]
        v = e[at]
        mean = v.mean(axis=0)
        chosen = list(range(len(v))) if len(v) <= 5 else [int(np.argmax(1 - v @ mean / np.linalg.norm(mean)))]
        while len(chosen) < min(5, len(v)):
            far = (1 - v @ v[chosen].T).min(axis=1)
            far[chosen] = -1
            chosen.append(int(np.argmax(far)))
        want |= {(label, ids[at[c]], n) for n, c in enumerate(chosen)}
    df = catalog.QUERIES["g8_farthest_first"](spark, DIR)
    assert {(r.label, r.ord, r.pick) for r in df.collect()} == want
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()


def test_mesh_quality_welds_and_takes_no_faces(spark):
    v = [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 1.0, 0.00001, 0.0), (4, 1.0, 1.0, 0.0), (5, 9.0, 9.0, 9.0), (6, 5.0, 0.0, 0.0), (7, 5.01, 0.0, 0.0), (8, 5.0, 0.01, 0.0)]
    vertices = spark.createDataFrame(v, "vid long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 1, 2), (3, 4, 2), (6, 7, 8), (0, 1, 77)], "a long, b long, c long")
    r = aggregates.mesh_quality(vertices, faces).first().asDict()
    assert {k: r[k] for k in ("vertices", "faces", "welded", "components", "isolated", "invalid_faces", "significant")} == {"vertices": 9, "faces": 4, "welded": 8, "components": 2, "isolated": 1, "invalid_faces": 1, "significant": 1}
    assert r["largest_ratio"] == pytest.approx(4 / 7) and r["tiny_area_ratio"] == pytest.approx(5e-5 / r["area"])
    r = aggregates.mesh_quality(vertices, faces.filter("a > 9")).first().asDict()
    assert (r["components"], r["isolated"], r["area"], r["largest_ratio"], r["tiny_area_ratio"]) == (0, 8, 0.0, 0.0, 0.0)


def test_cluster_geometry_chooses_the_nearest_of_those_that_count(spark):
    p = [("a", i, 10.0 + i * 0.01, 0.0, 0.0, 3) for i in range(40)] + [("a", 100 + i, 2.0 + i * 0.01, 0.0, 0.0, 3) for i in range(6)] + [("a", 200 + i, 1.0 + i * 0.01, 0.0, 0.0, 3) for i in range(4)]
    p += [("b", 300 + i, 2.0 + i * 0.01, 0.0, 0.0, 1) for i in range(4)]  # beside a's points, and too few
    points = spark.createDataFrame(p, "record string, id long, x double, y double, z double, support long")
    cameras = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("b", 0.0, 0.0, 0.0)], "record string, cx double, cy double, cz double")
    (r,) = aggregates.cluster_geometry(points, cameras, 0.05, 3, 5).collect()
    assert (r.record, r.cluster, r.points, r.candidates, r.dy) == ("a", 100, 6, 2, 0.02)
    assert r.camera == pytest.approx(2.025) and r.x == pytest.approx(2.025) and r.dx == pytest.approx(0.045)
